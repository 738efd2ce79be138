"""Evaluation of a score against outcomes, threshold choice and risk tiers. Input: columns ``y`` (0/1) and ``p``.

All ranking measures are aggregations over one row per distinct score with counts below it, so no step sorts the rows.
"""
from pyspark.sql import Window, functions as F

from ..functions.stats import average_rank, cumdist, global_quantiles, numbered_ties
from ..session import stage

# Fixed values.
RISK_ORDER = ["Low", "Medium", "High"]
PRECISION_CAP = 0.9
MIN_GROUP = 30


def score_table(df):
    """Distinct scores with positives, counts below and totals; ``at_or_above`` counts the flagged group."""
    table = cumdist(df, "p", {"pos": F.col("y").cast("bigint")}).withColumnRenamed("key", "p")
    return table.select(
        "*",
        (F.col("n_total") - F.col("n_before")).alias("flagged"),
        (F.col("pos_total") - F.col("pos_before")).alias("caught"),
        (F.col("n_before") + F.col("n")).alias("at_or_below"),
        (F.col("pos_before") + F.col("pos")).alias("pos_at_or_below"),
    )


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(df, threshold):
    """Confusion counts and what follows from them, in one aggregation."""
    flagged, churned = F.col("p") >= threshold, F.col("y") == 1
    counts = df.agg(
        F.count_if(~flagged & ~churned).alias("tn"),
        F.count_if(flagged & ~churned).alias("fp"),
        F.count_if(~flagged & churned).alias("fn"),
        F.count_if(flagged & churned).alias("tp"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        F.avg(F.col("y").cast("double")).alias("base_rate"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        F.lit(float(threshold)).alias("threshold"),
        "tn",
        "fp",
        "fn",
        "tp",
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        "brier",
        "base_rate",
    )


def roc_auc(table):
    """Mann-Whitney: ranks of the positives with ties averaged."""
    positives, negatives = F.max("pos_total"), F.max("n_total") - F.max("pos_total")
    rank_sum = F.sum(F.col("pos") * average_rank())
    return table.agg(
        F.try_divide(rank_sum - positives * (positives + 1) / 2, positives * negatives).alias("roc_auc")
    )


def pr_auc(table):
    """Average precision: recall step times precision at each distinct score."""
    precision = F.col("caught") / F.col("flagged")
    return table.agg(F.try_divide(F.sum(F.col("pos") * precision), F.max("pos_total")).alias("pr_auc"))


def brier(df):
    return df.agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def best_f1(table):
    """Threshold with the highest F1 over distinct scores, the lowest one on ties."""
    f1 = 2 * F.col("caught") / (F.col("flagged") + F.col("pos_total"))
    ranked = table.withColumn("f1", f1)
    return ranked.agg(
        F.min_by("p", F.struct(-F.col("f1"), "p")).alias("threshold"), F.max("f1").alias("f1")
    )


def threshold_candidates(table, min_lift=2.0, max_low_churn=0.15, min_share=0.03):
    """One row: the thresholds that the outcomes support, and the numbers they were held against."""
    base = F.col("pos_total") / F.col("n_total")
    required = F.least(F.lit(PRECISION_CAP), base * min_lift)
    smallest = F.greatest(F.lit(MIN_GROUP), F.floor(F.col("n_total") * min_share))
    high_ok = (F.col("caught") / F.col("flagged") >= required) & (F.col("flagged") >= smallest)
    low_ok = (F.col("pos_at_or_below") / F.col("at_or_below") <= max_low_churn) & (F.col("at_or_below") >= smallest)
    return table.agg(
        F.min(F.when(high_ok, F.col("p"))).alias("t_high"),
        F.max(F.when(low_ok, F.col("p"))).alias("t_low"),
        F.max(required).alias("required_high_churn_rate"),
    )


def risk_thresholds(df, min_lift=2.0, max_low_churn=0.15, min_share=0.03, table=None):
    """(t_low, t_high, info). Where outcomes support no threshold, quantiles of the score stand in."""
    table = score_table(df) if table is None else table
    row = threshold_candidates(table, min_lift, max_low_churn, min_share).first()
    info = {
        "high_fallback_to_quantile": row["t_high"] is None,
        "low_fallback_to_quantile": row["t_low"] is None,
        "required_high_churn_rate": row["required_high_churn_rate"],
    }
    t_low, t_high = row["t_low"], row["t_high"]
    fallback = None
    if t_low is None or t_high is None or t_low >= t_high:
        fallback = global_quantiles(df, ["p"], [0.33, 0.67, 0.90])["p"]
        t_high = fallback[2] if t_high is None else t_high
        t_low = fallback[0] if t_low is None else t_low
    info["thresholds_crossed_used_terciles"] = t_low >= t_high
    if t_low >= t_high:
        t_low, t_high = fallback[0], fallback[1]
    return t_low, t_high, info


def risk_level(p, t_low, t_high):
    return F.when(p >= t_high, "High").when(p <= t_low, "Low").when(p.isNotNull(), "Medium")


def risk_table(df, t_low, t_high):
    """Per tier: size, observed and predicted churn, shares. All three tiers are present."""
    tiers = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(RISK_ORDER)], "tier_order int, risk string")
    per_tier = (
        df.withColumn("risk", risk_level(F.col("p"), t_low, t_high))
        .groupBy("risk")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg(F.col("y").cast("double")).alias("observed_churn_rate"),
            F.avg("p").alias("mean_predicted_prob"),
            F.sum(F.col("y").cast("bigint")).alias("churners"),
        )
    )
    every = Window.orderBy("tier_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # three rows
    return (
        tiers.join(per_tier, "risk", "left")
        .fillna(0, ["customers", "churners"])
        .withColumn("share_of_customers", F.try_divide(F.col("customers"), F.sum("customers").over(every)))
        .withColumn("share_of_all_churners", F.try_divide(F.col("churners"), F.sum("churners").over(every)))
    )


def decile_lift(df, bins=10, tie_break="customer_id"):
    """Groups of equal size by descending score (position order inside ties by id), with rate and lift.

    Ties count as one row; only those that the edge of a group cuts, fewer than ``bins``, are sorted by id.
    """
    scored = df.select(tie_break, F.col("y").cast("double").alias("y"), (-F.col("p").cast("double")).alias("down"))
    ties = stage(cumdist(scored, "down", {"positive": F.col("y")}), "score-ties")
    total = ties.agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).first()
    if not total["n"]:
        return df.sparkSession.createDataFrame([], "decile bigint, customers bigint, churn_rate double, lift double")
    scaled = lambda position: (position - 1) * bins / F.lit(max(total["n"] - 1, 1))
    decile = lambda position: F.greatest(F.lit(1), F.ceil(scaled(position))).cast("bigint")
    placed = ties.select("key", "n", "n_before", "positive", decile(F.col("n_before") + 1).alias("decile"), decile(F.col("n_before") + F.col("n")).alias("last"))
    cut = placed.where(F.col("decile") < F.col("last")).collect()  # at most one for each edge
    parts = placed.where(F.col("decile") == F.col("last")).select("decile", "n", "positive")
    if cut:
        single = numbered_ties(scored, "down", cut, [F.col(tie_break)])
        parts = parts.unionByName(single.select(decile(F.col("position")).alias("decile"), F.lit(1).cast("bigint").alias("n"), F.col("y").alias("positive")))
    rate = F.col("positive") / F.col("customers")
    return (
        parts.groupBy("decile")
        .agg(F.sum("n").alias("customers"), F.sum("positive").alias("positive"))
        .select("decile", "customers", rate.alias("churn_rate"), (rate / F.lit(total["positive"] / total["n"])).alias("lift"))
    )


def curve_points(table):
    """ROC and precision-recall coordinates at each distinct score."""
    negatives = F.col("n_total") - F.col("pos_total")
    return table.select(
        F.col("p").alias("threshold"),
        F.try_divide(F.col("caught").cast("double"), F.col("pos_total")).alias("tpr"),
        F.try_divide((F.col("flagged") - F.col("caught")).cast("double"), negatives).alias("fpr"),
        (F.col("caught") / F.col("flagged")).alias("precision"),
    )


def calibration(df, bins=10):
    """Quantile bins of the score: mean prediction against observed rate."""
    edges = global_quantiles(df, ["p"], [i / bins for i in range(bins + 1)])["p"]
    inner = edges[1:-1]
    bin_index = sum((F.when(F.col("p") > e, 1).otherwise(0) for e in inner), F.lit(0))
    return (
        df.groupBy(bin_index.cast("bigint").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg("p").alias("mean_predicted"),
            F.avg(F.col("y").cast("double")).alias("observed_rate"),
        )
    )


def rule_text(t_low, t_high, base_rate, min_lift=2.0, max_low_churn=0.15):
    """The risk rule of a run in words; a threshold that no score reaches is said to be none."""
    shown = lambda t: "no score" if t is None else f"{t:.2f}"
    tiers = {
        "High": f"from {shown(t_high)} up, where validation churn reached {min_lift:g} times its base rate of {base_rate:.1%}",
        "Low": f"up to {shown(t_low)}, where validation churn stayed within {max_low_churn:.0%}",
        "Medium": "all between",
    }
    return "; ".join(f"{tier}: {where}" for tier, where in tiers.items())
