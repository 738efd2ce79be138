"""Registered queries on models, clusters, explanations and whole-run results.

Fits are iterative, so most of these have no SQL counterpart; where a step is plain arithmetic on given numbers it has one.
"""
from pyspark.sql import functions as F

from ..operators import cleaning, cluster, explain, models, orders as ordering, quality, standardize
from ..session import shared_folder, stage
from ..sources import star
from .checks_sql import CLEAN, O, SEGMENTED, features
from .registry import register
from .run_folder import RunFolder

_END = features("SELECT b AS cutoff FROM span")

# --- clusters --------------------------------------------------------------------------------------------------------


def _evaluated_k(ws):
    return ws.spark.createDataFrame(ws.evaluated_k, "k int, inertia double, silhouette double")


def _assigned(ws):
    return cluster.fit_kmeans(ws.cluster_vectors, ws.chosen_k).transform(ws.cluster_vectors)


register("k3_evaluate_k", "k:i inertia:4 silhouette:6", _evaluated_k)
register("k5_kmeans_assignment", "customer_id:s cluster:i", _assigned)
register(
    "k6_adjusted_rand",
    "ari:8",
    lambda ws: cluster.adjusted_rand(ws.labelled, "cluster", "rfm_segment"),
    SEGMENTED
    + """, c2 AS (SELECT cluster, rfm_segment, count(*) AS n FROM seg GROUP BY 1, 2),
     s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c2) AS joint, (SELECT count(*) FROM seg) AS n,
       (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c2 GROUP BY cluster)) AS a,
       (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c2 GROUP BY rfm_segment)) AS b)""",
    """SELECT (joint - a * b / (CAST(n AS DOUBLE) * (n - 1) / 2)) / ((a + b) / 2 - a * b / (CAST(n AS DOUBLE) * (n - 1) / 2)) AS ari
       FROM s""",
)


def _stability(ws):
    value = cluster.stability(ws.cluster_vectors, ws.chosen_k)
    return ws.cluster_vectors.agg(F.count(F.lit(1)).alias("customers")).withColumn("mean_ari", F.lit(value))


register("k6_stability", "customers:i mean_ari:6", _stability)


def _projection(ws):
    points, _ = cluster.pca_projection(ws.cluster_vectors)
    return points.agg(
        F.count(F.lit(1)).alias("customers"),
        F.stddev_pop("pc1").alias("spread_1"),
        F.stddev_pop("pc2").alias("spread_2"),
        F.abs(F.corr("pc1", "pc2")).alias("correlation"),
    )


register("d10_pca_projection", "customers:i spread_1:6 spread_2:6 correlation:6", _projection)

# --- models ----------------------------------------------------------------------------------------------------------


def _candidate(name):
    return lambda ws: ws.test_scores.where(F.col("model") == name)


register("m1_logistic_all_features", "customer_id:s y:i p:6", _candidate(models.ALL))
register("m2_logistic_recency", "customer_id:s y:i p:6", _candidate(models.RECENCY))
register("m3_gradient_boosting", "customer_id:s y:i p:6", _candidate(models.BOOSTING))
register(
    "m4_boosting_grid",
    "learning_rate:4 max_depth:i min_samples_leaf:i val_pr_auc:6",
    lambda ws: ws.selection.grid_df(ws.spark),
)
register(
    "m5_model_selection",
    "model:s val_pr_auc:6 val_roc_auc:6 threshold:6",
    lambda ws: ws.selection.table_df(ws.spark),
)
register(
    "m6_test_comparison",
    "model:s roc_auc:6 pr_auc:6 precision:6 recall:6 f1:6 accuracy:6 base_rate:6",
    lambda ws: models.evaluate_on_test(ws.selection, ws.split("test")),
)


def _saved_and_loaded(ws):
    path = f"{shared_folder(ws.spark).rstrip('/')}/saved-model-{ws.spark.sparkContext.applicationId}"
    models.save(ws.selection.best, path)
    again = models.outcomes(models.load(path), ws.split("test")).withColumnRenamed("p", "p_loaded")
    return models.outcomes(ws.selection.best, ws.split("test")).join(again.drop("y"), "customer_id")


register("m7_saved_model", "customer_id:s p:6 p_loaded:6", _saved_and_loaded)
register(
    "m8_scored_customers",
    "customer_id:s status:s churn_prob:6 risk_level:s",
    lambda ws: ws.scored_by_model(),
)

# --- explanations ----------------------------------------------------------------------------------------------------


def _additivity(name):
    """Contributions add up to the model's own log-odds: the base, the sum and the log-odds per customer."""

    def build(ws):
        found, base, used = ws.contributions(name)
        total = F.lit(base) + sum((F.col(f"c_{f}") for f in used), F.lit(0.0))
        log_odds = F.log(F.col("p") / (1 - F.col("p")))
        scores = ws.test_scores.where(F.col("model") == name).select("customer_id", "p")
        return found.join(scores, "customer_id").select(
            "customer_id", total.alias("explained"), log_odds.alias("log_odds"), F.abs(total - log_odds).alias("gap")
        )

    return build


def _factors(ws):
    found, _, used = ws.contributions(models.ALL)
    return explain.top_factors(found, used)


register("x1_linear_contributions", "customer_id:s explained:6 log_odds:6 gap:4", _additivity(models.ALL))
register("x2_tree_contributions", "customer_id:s explained:6 log_odds:6 gap:4", _additivity(models.BOOSTING))
register("x3_top_factors", "customer_id:s top_risk_factors:s top_protective_factors:s", _factors)
register(
    "x4_feature_texts",
    "customer_id:s recency:s orders:s change:s gap:s",
    lambda ws: ws.at_end.select(
        "customer_id",
        explain.describe("recency_days").alias("recency"),
        explain.describe("frequency").alias("orders"),
        explain.describe("frequency_change").alias("change"),
        F.when(F.col("avg_gap_days").isNull(), explain.describe("avg_gap_days")).alias("gap"),
    ),
    _END,
    """SELECT customer_id, CAST(recency_days AS VARCHAR) || ' days since last purchase' AS recency,
         CAST(frequency AS VARCHAR) || ' orders placed so far' AS orders,
         'order count changed by ' || CASE WHEN frequency_change >= 0 THEN '+' ELSE '' END
           || CAST(frequency_change AS VARCHAR) || ' vs the previous 90 days' AS change,
         CASE WHEN avg_gap_days IS NULL THEN 'avg_gap_days: not enough history' END AS gap FROM f""",
)


def _given_contributions(ws):
    shift = {"recency_days": 100.0, "frequency": 3.0, "orders_90d": 1.0}
    return ws.at_end.select("customer_id", *shift, *[(F.col(c) - v).alias(f"c_{c}") for c, v in shift.items()])


register(
    "x5_explanation_text",
    "customer_id:s top_risk_factors:s top_protective_factors:s",
    lambda ws: explain.top_factors(_given_contributions(ws), ["recency_days", "frequency", "orders_90d"]),
    _END
    + """, ct AS (
      SELECT customer_id, recency_days - 100 AS c, 0 AS i, CAST(recency_days AS VARCHAR) || ' days since last purchase' AS text FROM f
      UNION ALL SELECT customer_id, frequency - 3, 1, CAST(frequency AS VARCHAR) || ' orders placed so far' FROM f
      UNION ALL SELECT customer_id, orders_90d - 1, 2, CAST(orders_90d AS VARCHAR) || ' orders in the last 90 days' FROM f)""",
    """SELECT customer_id, coalesce(string_agg(text, ' | ' ORDER BY c DESC, i) FILTER (c > 0), '') AS top_risk_factors,
         coalesce(string_agg(text, ' | ' ORDER BY c, i) FILTER (c < 0), '') AS top_protective_factors
       FROM ct GROUP BY customer_id""",
)
register(
    "x6_global_importance",
    "feature:s mean_abs_contribution:6",
    lambda ws: explain.global_importance(_given_contributions(ws), ["recency_days", "frequency", "orders_90d"]),
    _END,
    """SELECT 'recency_days' AS feature, avg(abs(recency_days - 100)) AS mean_abs_contribution FROM f
       UNION ALL SELECT 'frequency', avg(abs(frequency - 3)) FROM f
       UNION ALL SELECT 'orders_90d', avg(abs(orders_90d - 1)) FROM f""",
)
register(
    "x6_model_importance",
    "feature:s mean_abs_contribution:6",
    lambda ws: explain.global_importance(ws.contributions(models.ALL)[0], ws.used_features),
)


def _permuted(ws):
    return explain.permutation_importance(ws.selection.models[models.ALL], ws.split("test"), ws.used_features)


register("x7_permutation_importance", "feature:s pr_auc_drop:6 std:6", _permuted)
register(
    "x8_example_customers",
    "example:s customer_id:s y:i p:6 top_risk_factors:s top_protective_factors:s",
    lambda ws: explain.example_customers(
        ws.test_scores.where(F.col("model") == models.ALL).select("customer_id", "y", "p"), _factors(ws)
    ),
)
register(
    "x9_importance_agreement",
    "feature:s contribution_rank:i permutation_rank:i",
    lambda ws: explain.agreement(
        explain.global_importance(ws.contributions(models.ALL)[0], ws.used_features), _permuted(ws)
    ),
)

# --- results of a run ------------------------------------------------------------------------------------------------


def _written(ws):
    """Standardised lines, orders and customers written as result tables of a run, published and read back by a reader."""
    import uuid

    out = RunFolder.begin(ws.spark, shared_folder(ws.spark), f"written-{uuid.uuid4().hex[:8]}")
    tables = {"lines": ws.lines, "orders": ws.orders, "customers": ws.customers}
    for name, df in tables.items():
        out.write(name, df)
    out.publish()
    reader = RunFolder(ws.spark, out.root, out.name)
    return quality.table_shapes(**{name: reader.read(name) for name in tables}).select("table", "rows")


register(
    "s6_result_tables",
    "table:s rows:i",
    _written,
    O,
    """SELECT 'lines' AS table, count(*) AS rows FROM t UNION ALL SELECT 'orders', count(*) FROM o
       UNION ALL SELECT 'customers', count(*) FROM customer""",
)


def _report(ws):
    """Validation of the lines with injected defects: every check with its level."""
    standard = standardize.standardize(ws.dirty, star.DIRTY_LINES)
    cleaned = cleaning.clean(standard, star.DIRTY_LINES)
    orders = ordering.build_orders(cleaned.lines)
    return quality.validate("dirty", star.DIRTY_LINES, standard, cleaned, orders).checks_table(ws.spark)


def _events_report(ws):
    """The events as a second schema: a month of data is too little for the window it implies."""
    cfg = star.EVENTS
    standard = standardize.standardize(star.event_purchases(ws.spark, ws.folder), cfg)
    cleaned = cleaning.clean(standard, cfg)
    orders = ordering.build_orders(cleaned.lines)
    return quality.validate("events", cfg, standard, cleaned, orders).checks_table(ws.spark)


_FOUND = "SELECT row_number() OVER (ORDER BY ord) - 1 AS position, level, title, detail FROM found"
_MAPPED = lambda fields: " UNION ALL ".join(
    f"SELECT {i} AS ord, 'ok' AS level, '{name} is mapped' AS title, 'from {column}' AS detail" for i, (name, column) in enumerate(fields)
)
_WINDOW = """gap AS (SELECT date_diff('day', lag(d) OVER (PARTITION BY customer_id ORDER BY d), d) AS gap FROM days),
 q AS (SELECT quantile_cont(gap, 0.95) AS q FROM gap),
 size AS (SELECT (SELECT count(DISTINCT customer_id) FROM days) AS buyers, (SELECT count(gap) FROM gap) AS gaps),
 w AS (SELECT q, CAST(least(greatest(ceil(q / 15) * 15, 30), 180) AS INTEGER) AS w FROM q, size WHERE buyers >= 50 AND gaps >= 200),
 cuts AS (SELECT a, b, w, CAST(floor((date_diff('day', a, b) - 3 * w - 120) / 30) + 1 AS BIGINT) AS n FROM span, w)"""
_LIMITS = """SELECT 18, 'error', 'Too few customers', buyers || ' buyers, 50 are the least' FROM size WHERE buyers < 50
  UNION ALL SELECT 19, 'error', 'Too few repeat orders for a churn window', gaps || ' gaps, 200 are the least; analysis.churn_window_days can give the window'
    FROM size WHERE buyers >= 50 AND gaps < 200
  UNION ALL SELECT 20, 'warn', format('The gaps ask for {:.0f} days; the limits 30 to 180 make it {}', q, w), '' FROM w WHERE q > 180 OR q < 15"""
_HISTORY = """SELECT 21, 'ok', 'History suffices for a split in time', n || ' cut-offs to train on' FROM cuts WHERE n >= 3
  UNION ALL SELECT 22, 'error', 'Not enough history', format('The dataset contains only {:.0f} months of history ({} -> {}). About {:.0f} '
    || 'months are needed for a churn horizon of {} days (120 days of observation, 3 training cut-offs and three consecutive windows). '
    || 'Provide more history or set analysis.churn_window_days.', date_diff('day', a, b) / 30.4, strftime(a, '%Y-%m-%d'),
    strftime(b, '%Y-%m-%d'), (180 + 3 * w) / 30.4, w) FROM cuts WHERE n < 3"""
_UNKNOWN = """SELECT 10, 'warn', 'No registration date', 'the first purchase stands in for it'
  UNION ALL SELECT 11, 'warn', 'No demographics', 'tables by age, gender and place are left out'"""

register(
    "q14_validation_report",
    "position:i level:s title:s detail:s",
    _report,
    CLEAN
    + f""", days AS (SELECT DISTINCT customer_id, d FROM (
     SELECT min(customer_id) AS customer_id, min(date) AS d FROM clean WHERE NOT is_return GROUP BY order_id)),
 span AS (SELECT min(date) AS a, max(date) AS b FROM clean), {_WINDOW},
 bad AS (SELECT count(*) FILTER (px IS NOT NULL AND unit_price IS NULL) AS n FROM std),
 found AS ({_MAPPED([("customer_id", "cust"), ("order_id", "inv"), ("date", "dt"), ("quantity", "qty"), ("unit_price", "px")])}
  UNION ALL {_UNKNOWN}
  UNION ALL SELECT 12, 'warn', n || ' non-numeric texts stand where a quantity or price should be; they count as missing.', '' FROM bad WHERE n > 0
  UNION ALL {_LIMITS} UNION ALL {_HISTORY})""",
    _FOUND,
)
register(
    "q11_history_check",
    "position:i level:s title:s detail:s",
    _events_report,
    f"""bought AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase' AND value > 0),
 days AS (SELECT DISTINCT * FROM bought), span AS (SELECT min(d) AS a, max(d) AS b FROM bought), {_WINDOW},
 found AS ({_MAPPED([("customer_id", "user_id"), ("order_id", "event_id"), ("date", "ts"), ("quantity", "units"), ("unit_price", "value")])}
  UNION ALL SELECT 5 + i, 'warn', 'No ' || name, 'features that need it are left out'
    FROM (VALUES (0, 'discount'), (1, 'category'), (2, 'product_id'), (3, 'payment_method')) AS missing(i, name)
  UNION ALL {_UNKNOWN} UNION ALL {_LIMITS} UNION ALL {_HISTORY})""",
    _FOUND,
)
