"""Report tables: monthly figures, histograms, cohorts, comparisons and worklists as DataFrames."""
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from ..functions.stats import cumdist, exact_quantiles, global_quantiles
from ..sources.keyed import rows_of
from .orders import purchases

# Fixed values.
AGE_BANDS = [(24, "<=24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (100, "55+")]
INTERVENTIONS = [("cheap_email", 1.0, 0.05), ("phone_call", 20.0, 0.25)]
THRESHOLD_GRID = [round(0.05 * i, 2) for i in range(15)]
COMPARED = [
    "recency_days", "frequency", "monetary", "aov", "discount_order_share", "n_unique_categories",
    "frequency_change", "avg_gap_days",
]
SUBSTITUTES = ["n_unique_products", "orders_90d", "spend_90d", "active_months"]
MEDIANS = [
    "recency_days", "frequency", "monetary", "aov", "avg_gap_days", "discount_order_share", "n_unique_categories",
    "n_unique_products", "frequency_change",
]
FREQUENCY_CAP = 15
COHORT_MONTHS = 12
COHORT_MINIMUM = 30
SHIFT_NOTE_ABOVE = 0.03


def month(column):
    return F.trunc(column, "MM")


# --- revenue and orders --------------------------------------------------------------------------------------------


def monthly_summary(lines, orders):
    """Revenue by the month of the line, orders and customers by the month of the order."""
    back = F.col("is_return")
    revenue = lines.groupBy(month("date").alias("month")).agg(
        F.sum(F.when(~back, F.col("transaction_value"))).alias("gross_revenue"),
        (-F.sum(F.when(back, F.col("transaction_value")))).alias("returns"),
    )
    activity = orders.groupBy(month("order_date").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("customer_id").alias("active_customers")
    )
    both = revenue.join(activity, "month", "full_outer").fillna(0)
    return both.withColumn("net_revenue", F.col("gross_revenue") - F.col("returns")).withColumn(
        "aov", F.try_divide(F.col("gross_revenue"), F.col("orders"))
    )


def month_highlights(monthly):
    """First, last and strongest month by net revenue."""
    at = lambda pick, key: pick("month", key)
    return monthly.agg(
        F.min("month").alias("first_month"),
        F.min_by("net_revenue", "month").alias("first_revenue"),
        F.max("month").alias("last_month"),
        F.max_by("net_revenue", "month").alias("last_revenue"),
        at(F.min_by, F.struct(-F.col("net_revenue"), "month")).alias("best_month"),
        F.max("net_revenue").alias("best_revenue"),
    )


def category_revenue(lines):
    return purchases(lines).groupBy("category").agg(F.sum("transaction_value").alias("revenue"))


def cohort_retention(orders, months=COHORT_MONTHS, minimum=COHORT_MINIMUM):
    """Share of each first-month cohort ordering k months later; months the data cannot show yet are NULL."""
    index = lambda c: F.year(c) * 12 + F.month(c)
    active = orders.select("customer_id", month("order_date").alias("m")).distinct()
    # a customer's rows are now one per month, so the window is bounded by the calendar
    first = F.min("m").over(Window.partitionBy("customer_id"))
    dated = active.withColumn("cohort", first).withColumn("k", index("m") - index("cohort"))
    counts = dated.where(F.col("k") <= months).groupBy("cohort", "k").agg(F.count(F.lit(1)).alias("customers"))
    sizes = counts.where("k = 0").select("cohort", F.col("customers").alias("size"))
    last = orders.agg(month(F.max("order_date"))).scalar()
    grid = sizes.where(F.col("size") >= minimum).select(
        "cohort", "size", F.explode(F.sequence(F.lit(0), F.lit(months))).alias("k")
    )
    visible = index("cohort") + F.col("k") <= index("last")
    return (
        grid.join(counts, ["cohort", "k"], "left")
        .withColumn("last", last)
        .select(
            "cohort",
            "k",
            "size",
            F.when(visible, F.col("customers") / F.col("size")).alias("retention"),
        )
    )


def return_flags(standard_lines):
    """Negative quantities by whether the return rule covers them."""
    return (
        standard_lines.where("quantity < 0")
        .groupBy(F.when(F.col("is_return"), "flagged").otherwise("not flagged").alias("kind"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def price_spread(standard_lines):
    """Median and standard deviation of valid prices within each product."""
    valid = standard_lines.where("unit_price > 0 and product_id is not null").select("product_id", "unit_price")
    medians = exact_quantiles(valid, ["unit_price"], [0.5], by=["product_id"]).select(
        "product_id", F.col("q0").alias("median_price")
    )
    spread = valid.groupBy("product_id").agg(F.stddev_samp("unit_price").alias("price_std"))
    return medians.join(spread, "product_id")


def describe(df, column):
    """count, mean, std, min, quartiles and max of one column."""
    shape = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    p25, p50, p75 = global_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    return shape.select("*", F.lit(p25).alias("p25"), F.lit(p50).alias("p50"), F.lit(p75).alias("p75"))


# --- distributions -------------------------------------------------------------------------------------------------


def histogram(df, column, bins=40, log=False):
    """Equal-width bins between the smallest and largest value (of log10 for ``log``)."""
    value = F.log10(F.when(F.col(column) > 0, F.col(column))) if log else F.col(column).cast("double")
    values = df.select(value.alias("v")).where("v is not null")
    low, high = values.agg(F.min("v")).scalar(), values.agg(F.max("v")).scalar()
    width = (F.col("high") - F.col("low")) / bins
    bin_of = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), width)), F.lit(bins - 1)), F.lit(0))
    return (
        values.select("v", low.alias("low"), high.alias("high"))
        .groupBy(bin_of.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("low").alias("_low"), F.max("high").alias("_high"))
        .select(
            "bin", "n", (F.col("_low") + F.col("bin") * (F.col("_high") - F.col("_low")) / bins).alias("bin_start")
        )
    )


def capped_counts(df, column="frequency", cap=FREQUENCY_CAP):
    return df.groupBy(F.least(F.col(column), F.lit(cap)).cast("bigint").alias("orders")).agg(
        F.count(F.lit(1)).alias("customers")
    )


def gap_histogram(gaps, limit=300, bins=60):
    return histogram(gaps.where(F.col("gap") <= limit), "gap", bins)


def probability_histogram(scored, bins=40):
    """Fixed-width bins of the churn probability per risk tier."""
    bin_of = F.least(F.floor(F.col("churn_prob") * bins), F.lit(bins - 1)).cast("bigint")
    return (
        scored.where("churn_prob is not null")
        .groupBy(bin_of.alias("bin"), "risk_level")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def adjusted_skew(column):
    """Bias-corrected skewness, as pandas computes it."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def skew_table(df, columns):
    row = df.agg(*[adjusted_skew(F.col(c)).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("skew")) for c in columns]
    return row.select(F.inline(F.array(*entries)))


# --- customers -----------------------------------------------------------------------------------------------------


def share_of_total(df, group, value="monetary"):
    """Customers and revenue per group as shares of the whole."""
    parts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    everyone, everything = df.agg(F.count(F.lit(1))).scalar(), df.agg(F.sum(value)).scalar()
    return parts.select(
        *[c for c in parts.columns if not c.startswith("_")],
        (F.col("_n") / everyone).alias("customer_share"),
        (F.col("_v") / everything).alias("revenue_share"),
    )


def one_time_vs_repeat(df):
    return share_of_total(df, F.when(F.col("frequency") == 1, "One-time").otherwise("Repeat").alias("kind"))


def top_share(df, share=0.2, value="monetary"):
    """Share of revenue of the top customers (floor of their number), exact for tied values without breaking ties."""
    table = cumdist(df, value)
    wanted = F.floor(F.col("n_total") * share)
    above = F.col("n_total") - F.col("n_before") - F.col("n")
    taken = F.greatest(F.least(wanted - above, F.col("n")), F.lit(0))
    return table.agg(F.try_divide(F.sum(taken * F.col("key")), F.sum(F.col("n") * F.col("key"))).alias("top_share"))


def repeat_share(df):
    return df.agg(F.avg((F.col("frequency") >= 2).cast("double")).alias("repeat_share"))


def lapsed_by(df, dimension):
    return df.groupBy(dimension).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg((F.col("status") == "Lapsed").cast("double")).alias("lapsed_share"),
    )


def age_group(age):
    band = reduce(lambda chain, b: chain.when(age <= b[0], b[1]), AGE_BANDS, F.when(age <= 0, "Unknown"))
    return F.coalesce(band, F.lit("Unknown"))


# --- snapshots -----------------------------------------------------------------------------------------------------


def buy_again_by_recency(snapshot, width=10):
    """Chance of another purchase by recency bin (the first bin includes 0), with its upper bound."""
    upper = F.greatest(F.ceil(F.col("recency_days") / width), F.lit(1)) * width
    return snapshot.groupBy(upper.cast("bigint").alias("recency_up_to")).agg(
        (1 - F.avg(F.col("churned").cast("double"))).alias("p_return"), F.count(F.lit(1)).alias("n")
    )


def compared_features(available=None):
    """The features to compare: those of ``COMPARED`` that the data has, filled up from ``SUBSTITUTES``."""
    has = lambda name: available is None or name in available
    return [c for c in [*COMPARED, *SUBSTITUTES] if has(c)][: len(COMPARED)]


def quartiles_by_outcome(snapshot, columns=COMPARED):
    found = exact_quantiles(snapshot, list(columns), [0.25, 0.5, 0.75], by=["churned"])
    return found.select(
        "churned", "feature", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )


def medians_by_outcome(snapshot, columns=MEDIANS):
    """Median per feature for churned and retained customers and which side is higher."""
    found = exact_quantiles(snapshot, list(columns), [0.5], by=["churned"])
    wide = found.groupBy("feature").agg(
        F.max(F.when(F.col("churned") == 1, F.col("q0"))).alias("churned_median"),
        F.max(F.when(F.col("churned") == 0, F.col("q0"))).alias("retained_median"),
    )
    a, b = F.col("churned_median"), F.col("retained_median")
    return wide.withColumn("direction", F.when(a > b, "higher").when(a < b, "lower").otherwise("equal"))


def correlation(df, features):
    """Pearson correlation of every pair over the rows where both are known. Output: ``a, b, r``.

    Each partition adds up its moment matrices (features x features, so their size does not depend on the rows) from
    Arrow batches; the partial sums of a pair are then added in Spark. Values are centred first to keep the digits.
    """
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    centred = df.select(*[(F.col(f).cast("double") - F.lit(means[f])).alias(f) for f in features])
    size = len(features)

    def moments(batches):
        total = np.zeros((6, size, size))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            square = x * x
            total += np.stack(
                [known.T @ known, x.T @ known, known.T @ x, square.T @ known, known.T @ square, x.T @ x]
            )
        first, second = np.triu_indices(size)
        rows = {"a": [features[i] for i in first], "b": [features[j] for j in second]}
        rows.update({name: total[m][first, second] for m, name in enumerate(["n", "sa", "sb", "saa", "sbb", "sab"])})
        yield pd.DataFrame(rows)

    schema = "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double"
    sums = (
        centred.mapInPandas(moments, schema)
        .groupBy("a", "b")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    )
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab"))
    spread = F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb))
    return sums.select("a", "b", F.try_divide(n * sab - sa * sb, spread).alias("r"))


def split_table(snapshot):
    return snapshot.groupBy("split").agg(
        F.count_distinct("cutoff").alias("cutoffs"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("churned").cast("double")).alias("churn_rate"),
    )


def threshold_tradeoff(df, margin=0.30, grid=THRESHOLD_GRID, interventions=INTERVENTIONS):
    """Contacts, reach and net benefit per contact threshold and intervention.

    ``df``: y, p, monetary, days_since_first_order. Each row is counted once in the highest threshold it passes (at most
    one group per threshold after the map side); lower thresholds are running sums over those few groups.
    """
    annual = F.col("monetary") / F.greatest(F.col("days_since_first_order"), F.lit(90)) * 365 * margin
    passed = sum((F.when(F.col("p") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    per_step = df.groupBy(passed.alias("passed")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("y").cast("bigint")).alias("_y"),
        F.sum(F.when(F.col("y") == 1, annual).otherwise(0.0)).alias("_margin"),
    )
    grid_table = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "step int, threshold double")
    steps = per_step.where("passed > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("passed"))))
    sums = steps.groupBy("step").agg(*[F.sum(c).alias(c) for c in ("_n", "_y", "_margin")])
    churners = df.agg(F.sum(F.col("y").cast("bigint"))).scalar()
    reached = grid_table.join(sums, "step", "left").fillna(0).withColumn("_all", churners)
    benefit = [
        (F.col("_margin") * save - cost * F.col("_n")).alias(f"net_{name}") for name, cost, save in interventions
    ]
    return reached.select(
        "threshold",
        F.col("_n").alias("contacted"),
        F.col("_y").alias("churners_reached"),
        F.try_divide(F.col("_y").cast("double"), F.col("_all")).alias("recall"),
        *benefit,
    )


def best_thresholds(tradeoff, interventions=INTERVENTIONS):
    return tradeoff.agg(
        *[
            F.min_by("threshold", F.struct(-F.col(f"net_{name}"), "threshold")).alias(f"best_{name}")
            for name, _, _ in interventions
        ]
    )


# --- worklists -----------------------------------------------------------------------------------------------------

TIER_NAMES = ["High", "Medium", "Low"]


def active(scored):
    return scored.where("status = 'Active'")


def risk_by_value(scored):
    counted = active(scored).groupBy("risk_level").pivot("value_tier", TIER_NAMES).count()
    return counted.fillna(0, TIER_NAMES)


def priority_summary(scored):
    return active(scored).groupBy("priority").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("margin_at_risk").alias("expected_margin_at_risk"),
        F.avg("churn_prob").alias("mean_churn_prob"),
    )


def top_worklist(scored, n=10):
    return active(scored).orderBy(F.col("priority_score").desc(), "customer_id").limit(n)


def critical_totals(scored):
    return active(scored).where(F.col("priority").startswith("P1")).agg(
        F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("margin_at_risk"), F.lit(0.0)).alias("margin_at_risk")
    )


def worklist(scored, risk_level=("High", "Medium"), **filters):
    """Active customers by risk and any of rfm_segment, value_tier, cluster_name, customer_location, favorite_category."""
    view = active(scored).where(F.col("risk_level").isin(list(risk_level)))
    for column, values in filters.items():
        if values:
            view = view.where(F.col(column).isin(list(values)))
    return view


def ranked_worklist(scored, **filters):
    return worklist(scored, **filters).orderBy(F.col("priority_score").desc(), "customer_id")


def worklist_totals(view):
    return view.agg(
        F.count(F.lit(1)).alias("customers"),
        F.coalesce(F.sum("margin_at_risk"), F.lit(0.0)).alias("margin_at_risk"),
        F.avg("churn_prob").alias("mean_churn_prob"),
    )


def win_back(scored, n=500):
    lapsed = scored.where("status = 'Lapsed'")
    return lapsed.orderBy(F.col("annual_margin_run_rate").desc(), "customer_id").limit(n)


def customer_history(lines, customer_id):
    """All lines of a customer; of lines laid out by customer (``sources.keyed``) one bucket is read."""
    return rows_of(lines, "customer_id", customer_id)


def customer_profile(scored, customer_id):
    return rows_of(scored, "customer_id", customer_id)


def customer_months(lines, customer_id):
    return (
        purchases(customer_history(lines, customer_id))
        .groupBy(month("date").alias("month"))
        .agg(F.sum("transaction_value").alias("spend"))
    )


def probability_by_cluster(scored):
    return active(scored).groupBy("cluster_name").agg(
        F.count(F.lit(1)).alias("active_customers"), F.avg("churn_prob").alias("mean_churn_prob")
    )


def shift_note(train_rate, test_rate):
    if abs(train_rate - test_rate) <= SHIFT_NOTE_ABOVE:
        return ""
    return (
        f"Churn moved from {train_rate:.1%} in training to {test_rate:.1%} in the test period: "
        "read the probabilities as a ranking until the model is fitted again."
    )
