"""Customer value and the retention playbook."""
import math

from pyspark.sql import functions as F

from ..functions.stats import rank_cuts, score_from_cuts

# Fixed values: (risk, value tier, priority, suggested action); "Lapsed" rows are the win-back list.
PLAYBOOK = [
    ("High", "High", "P1 - Critical", "Personal outreach: customer-service call or account-owner email, loyalty gesture; discount only if needed"),
    ("High", "Medium", "P2 - High", "Personalised email with product recommendations based on favourite category"),
    ("High", "Low", "P3 - Low-cost", "Automated reminder email / 'we miss you' message (no discount)"),
    ("Medium", "High", "P2 - High", "Loyalty communication (early access, thank-you) plus a gentle reminder"),
    ("Medium", "Medium", "P3 - Low-cost", "Automated reminder or product-recommendation email"),
    ("Medium", "Low", "P4 - Monitor", "Keep in regular newsletter; re-score next month"),
    ("Low", "High", "P5 - Maintain", "Loyalty / VIP communication; do NOT discount (customer is likely to stay anyway)"),
    ("Low", "Medium", "P5 - Maintain", "Business-as-usual communication"),
    ("Low", "Low", "P5 - Maintain", "Business-as-usual communication"),
    ("Lapsed", "High", "W1 - Win-back (high value)", "Personal win-back message; an offer is justified because the customer has already lapsed"),
    ("Lapsed", "Medium", "W2 - Win-back", "Reactivation email with recommendations"),
    ("Lapsed", "Low", "W3 - Low priority", "Include in low-cost reactivation batch or suppress"),
]
TIERS = ["Low", "Medium", "High"]
TIER_CUTS = [1 / 3, 2 / 3]
SHORTEST_LIFE_DAYS = 90


def run_rates(df, margin=0.30):
    """Annual revenue and margin at the customer's historical pace (at least 90 days of life)."""
    life = F.greatest(F.col("days_since_first_order"), F.lit(SHORTEST_LIFE_DAYS))
    revenue = F.col("monetary") / life * 365
    return df.withColumn("annual_revenue_run_rate", revenue).withColumn(
        "annual_margin_run_rate", F.col("annual_revenue_run_rate") * margin
    )


def twelve_month_value(df, window):
    """Annual margin times the mean survival over the windows of the next year; no probability means lost."""
    periods = math.ceil(365 / window)
    stay = 1 - F.coalesce(F.col("churn_prob"), F.lit(1.0))
    power, total = stay, stay
    for _ in range(periods - 1):
        power = power * stay
        total = total + power
    return df.withColumn("clv_12m_proxy", F.col("annual_margin_run_rate") * (total / periods))


def at_risk(df):
    """Expected margin lost; unknown for lapsed customers. It is also the ranking score."""
    return df.withColumn("margin_at_risk", F.col("annual_margin_run_rate") * F.col("churn_prob")).withColumn(
        "priority_score", F.col("margin_at_risk")
    )


def value_tier(df, column="annual_margin_run_rate"):
    """Thirds of all customers by average-tie percentile rank; ties share a tier."""
    score = score_from_cuts(F.col(column), rank_cuts(df, column, TIER_CUTS))
    return df.withColumn("value_tier", F.element_at(F.array(*[F.lit(t) for t in TIERS]), score.cast("int")))


def with_playbook(df):
    """Priority and action for active customers by (risk, value), for lapsed ones by value: a fixed twelve-row table."""
    book = df.sparkSession.createDataFrame(
        PLAYBOOK, "_risk string, value_tier string, priority string, suggested_action string"
    )
    risk = F.when(F.col("status") == "Active", F.col("risk_level")).otherwise("Lapsed")
    return df.withColumn("_risk", risk).join(F.broadcast(book), ["_risk", "value_tier"], "left").drop("_risk")


def value_and_priority(df, window, margin=0.30):
    valued = value_tier(at_risk(twelve_month_value(run_rates(df, margin), window)))
    return with_playbook(valued)


def favourite_category(lines):
    """Category with the highest total value per customer (smallest name on ties)."""
    per_pair = (
        lines.where(~F.col("is_return") & F.col("category").isNotNull())
        .groupBy("customer_id", "category")
        .agg(F.sum("transaction_value").alias("value"))
    )
    return per_pair.groupBy("customer_id").agg(
        F.min_by("category", F.struct(-F.col("value"), "category")).alias("favorite_category")
    )


def with_demographics(df, customers):
    return df.join(customers.drop("customer_registration_date"), "customer_id", "left")


def headline(customers, orders, lines, scored):
    """One row of totals over the four tables; the totals of the others enter as scalar subqueries."""
    returned, amount = F.col("is_return"), F.col("transaction_value")
    total = lambda df, measure: df.agg(measure).scalar()
    return scored.agg(
        F.count_if(F.col("status") == "Active").alias("n_active"),
        F.count_if(F.col("status") == "Lapsed").alias("n_lapsed"),
        F.avg((F.col("status") == "Lapsed").cast("double")).alias("lapsed_share"),
        F.count_if(F.col("risk_level") == "High").alias("n_high_risk"),
        F.avg("monetary").alias("avg_customer_value"),
        F.avg("churn_prob").alias("mean_pred_churn_active"),
    ).select(
        "*",
        total(customers, F.count(F.lit(1))).alias("n_customers_total"),
        total(orders, F.count(F.lit(1))).alias("n_orders"),
        total(orders, F.count_distinct("customer_id")).alias("n_customers_with_orders"),
        total(lines, F.count_if(~returned)).alias("n_lines"),
        total(lines, F.sum(F.when(~returned, amount))).alias("gross_revenue"),
        total(lines, F.sum(amount)).alias("net_revenue"),
        total(lines, F.coalesce(-F.sum(F.when(returned, amount)), F.lit(0.0))).alias("return_value"),
    )
