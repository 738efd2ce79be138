"""RFM scores and rule-based segments."""
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles, rank_cuts, score_from_cuts

# Fixed values.
QUINTILES = [0.2, 0.4, 0.6, 0.8]
SEGMENT_ORDER = [
    "Champions",
    "Loyal customers",
    "Potential loyalists",
    "New customers",
    "At-risk customers",
    "Hibernating",
]
ONE_TIME_LIMIT = 0.7
FEW_FREQUENCIES = 4


def quintile(df, column, name):
    """1..5 by average-tie percentile rank. A step function of the value, so four thresholds are enough: the ranks are
    computed on distinct values and the scoring is a plain projection without a join."""
    return df.withColumn(name, score_from_cuts(F.col(column), rank_cuts(df, column, QUINTILES)))


def rfm_scores(df):
    """R (recent = 5), F, M, the three-digit code and the sum."""
    scored = df.withColumn("_recent", -F.col("recency_days"))
    scored = quintile(scored, "_recent", "R")
    scored = quintile(scored, "frequency", "F")
    scored = quintile(scored, "monetary", "M").drop("_recent")
    code = F.concat(*[F.col(c).cast("string") for c in "RFM"])
    return scored.withColumn("RFM_score", code).withColumn("RFM_sum", F.col("R") + F.col("F") + F.col("M"))


def rfm_segments(df, new_days=60):
    """First matching rule wins; ``fm`` is the mean of the frequency and monetary scores."""
    r, fm = F.col("R"), (F.col("F") + F.col("M")) / 2
    newcomer = (F.col("days_since_first_order") <= new_days) & (F.col("frequency") <= 2)
    segment = (
        F.when(newcomer, "New customers")
        .when((r >= 4) & (fm >= 4), "Champions")
        .when((r >= 3) & (fm >= 3.5), "Loyal customers")
        .when((r <= 2) & (fm >= 3), "At-risk customers")
        .when(r >= 3, "Potential loyalists")
        .otherwise("Hibernating")
    )
    return df.withColumn("rfm_segment", segment)


def with_status(df, window):
    return df.withColumn("status", F.when(F.col("recency_days") <= window, "Active").otherwise("Lapsed"))


def rfm_quality(df):
    return df.agg(
        F.avg((F.col("frequency") <= 1).cast("double")).alias("share_one_time"),
        F.count_distinct("frequency").alias("distinct_frequencies"),
    )


def rfm_warnings(row):
    found = []
    if row["share_one_time"] > ONE_TIME_LIMIT:
        found.append(f"{row['share_one_time']:.0%} of customers bought only once: the Frequency score says little.")
    if row["distinct_frequencies"] < FEW_FREQUENCIES:
        found.append("Fewer than 4 distinct order counts: the Frequency score has little resolution.")
    return found


def segment_summary(df):
    """Per segment: size, revenue, medians, lapsed share, and shares of customers and revenue."""
    totals = df.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary").alias("revenue"),
        F.avg((F.col("status") == "Lapsed").cast("double")).alias("lapsed_share"),
    )
    columns = {"recency_days": "median_recency", "frequency": "median_frequency", "monetary": "median_spend"}
    medians = exact_quantiles(df, list(columns), [0.5], by=["rfm_segment"])
    wide = medians.groupBy("rfm_segment").agg(
        *[F.max(F.when(F.col("feature") == c, F.col("q0"))).alias(name) for c, name in columns.items()]
    )
    everyone = df.agg(F.count(F.lit(1))).scalar()
    revenue = df.agg(F.sum("monetary")).scalar()
    return (
        totals.join(wide, "rfm_segment")
        .withColumn("customer_share", F.col("customers") / everyone)
        .withColumn("revenue_share", F.col("revenue") / revenue)
    )
