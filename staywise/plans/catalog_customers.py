"""Registered queries on customers: features, snapshots, segments, evaluation, value and report tables."""
from pyspark.sql import functions as F

from ..operators import cluster, evaluate, features as feats, quality, reports, rfm, value
from . import named_queries
from .checks_sql import FAVOURITE, O, OUTCOMES, SCORED, SEGMENTED, SNAPSHOTS, T, average_tie_rank, features, quintile
from .registry import register

# --- features and snapshots ------------------------------------------------------------------------------------------

_FEATURE_SPEC = (
    "recency_days:2 frequency:2 monetary:4 aov:4 purchase_frequency_30d:6 days_since_registration:2 "
    "days_since_first_order:2 avg_gap_days:6 gap_std_days:6 gap_cv:6 recency_to_gap_ratio:6 orders_30d:2 orders_90d:2 "
    "orders_prev90d:2 frequency_change:2 spend_90d:4 spend_prev90d:4 spend_change:4 active_months:2 n_unique_products:2 "
    "n_unique_categories:2 avg_discount:6 discount_order_share:6 avg_units_per_order:6 return_rate:6"
)

register(
    "f4_compute_features",
    "customer_id:s first_order:d last_order:d " + _FEATURE_SPEC,
    lambda ws: ws.features_at([ws.span[1]]),
    features("SELECT b AS cutoff FROM span"),
    "SELECT * FROM f",
)
register(
    "f4_features_of_extended_table",
    "customer_id:s first_order:d last_order:d " + _FEATURE_SPEC,
    lambda ws: ws.features_at([ws.span[1]], activity=ws.extended_activity),
    features("SELECT b AS cutoff FROM span"),
    "SELECT * FROM f",
)
register(
    "f5_active_snapshot",
    "customer_id:s cutoff:d recency_days:2 frequency:2 monetary:4",
    lambda ws: ws.features_at([ws.schedule[1]], ws.window),
    features("SELECT cutoff FROM splits WHERE split = 'validation'"),
    "SELECT f.* FROM f, h WHERE recency_days <= h",
)
register(
    "f6_churn_label",
    "customer_id:s cutoff:d churned:i",
    lambda ws: feats.snapshots(
        ws.lines, ws.customers, list(ws.schedule[1:]), ws.window, ws.span[1], ws.available
    ),
    SNAPSHOTS,
    "SELECT customer_id, cutoff, churned FROM snap WHERE split <> 'train'",
)
register(
    "f9_make_snapshots",
    "split:s customer_id:s cutoff:d churned:i " + _FEATURE_SPEC,
    lambda ws: ws.snapshots(),
    SNAPSHOTS,
    "SELECT * FROM snap",
)
register(
    "f10_window_sensitivity",
    "H_days:i eligible_customers:i churn_rate:6",
    lambda ws: feats.window_sensitivity(ws.orders, *ws.span, ws.window),
    O
    + """, w AS (SELECT unnest([30, 60, 90, 120, 150, 180]) AS w UNION SELECT h FROM h),
     cut AS (SELECT b - CAST((SELECT max(w) FROM w) AS INTEGER) AS cutoff FROM span),
     r AS (SELECT customer_id, date_diff('day', max(order_date) FILTER (order_date <= cutoff), any_value(cutoff)) AS recency,
                  date_diff('day', any_value(cutoff), min(order_date) FILTER (order_date > cutoff)) AS ahead
           FROM o, cut GROUP BY customer_id)""",
    """SELECT w AS H_days, count(*) AS eligible_customers,
         avg(CAST(NOT coalesce(ahead <= w, false) AS INT)) AS churn_rate FROM r JOIN w ON recency <= w GROUP BY w""",
)
register(
    "f11_feature_support",
    "feature:s n_values:i varies:b",
    lambda ws: feats.feature_support(ws.split("train")),
    SNAPSHOTS,
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n_values, coalesce(min({c}) < max({c}), false) AS varies FROM snap WHERE split = 'train'"
        for c in feats.FEATURES
    ),
)
register(
    "q12_target_check",
    "split:s rows:i churned:i retained:i churn_rate:6 enough:b",
    lambda ws: quality.target_table(ws.staged_snapshots),
    SNAPSHOTS,
    """SELECT split, count(*) AS rows, sum(churned) AS churned, sum(1 - churned) AS retained, avg(churned) AS churn_rate,
         least(sum(churned), sum(1 - churned)) >= CASE split WHEN 'train' THEN 100 ELSE 30 END AS enough
       FROM snap GROUP BY split""",
)
register(
    "d19_split_table",
    "split:s cutoffs:i rows:i churn_rate:6",
    lambda ws: reports.split_table(ws.staged_snapshots),
    SNAPSHOTS,
    "SELECT split, count(DISTINCT cutoff) AS cutoffs, count(*) AS rows, avg(churned) AS churn_rate FROM snap GROUP BY split",
)

# --- RFM -------------------------------------------------------------------------------------------------------------

_END = features("SELECT b AS cutoff FROM span")

register(
    "r1_quintile",
    "customer_id:s monetary:4 score:i",
    lambda ws: rfm.quintile(ws.at_end, "monetary", "score"),
    _END + f", ranked AS (SELECT *, {average_tie_rank('round(monetary, 6)', 'pm')} FROM f)",
    f"SELECT customer_id, monetary, {quintile('pm')} AS score FROM ranked",
)
register(
    "r2_rfm_scores",
    "customer_id:s R:i F:i M:i RFM_score:s RFM_sum:i",
    lambda ws: rfm.rfm_scores(ws.at_end),
    SEGMENTED,
    "SELECT * FROM seg",
)
register(
    "r3_rfm_quality",
    "share_one_time:6 distinct_frequencies:i",
    lambda ws: rfm.rfm_quality(ws.at_end),
    _END,
    "SELECT avg(CAST(frequency <= 1 AS INT)) AS share_one_time, count(DISTINCT frequency) AS distinct_frequencies FROM f",
)
register(
    "r4_rfm_segments",
    "customer_id:s rfm_segment:s",
    lambda ws: ws.segmented,
    SEGMENTED,
    "SELECT customer_id, rfm_segment FROM seg",
)
register(
    "r5_status",
    "customer_id:s recency_days:2 status:s",
    lambda ws: rfm.with_status(ws.at_end, ws.window),
    SEGMENTED,
    "SELECT customer_id, recency_days, status FROM seg",
)
_SUMMARY = (
    "rfm_segment:s customers:i revenue:4 median_recency:4 median_frequency:4 median_spend:4 lapsed_share:6 "
    "customer_share:6 revenue_share:6"
)
register(
    "r6_segment_summary",
    _SUMMARY,
    lambda ws: rfm.segment_summary(ws.segmented),
    SEGMENTED,
    """SELECT rfm_segment, count(*) AS customers, sum(monetary) AS revenue, median(recency_days) AS median_recency,
         median(frequency) AS median_frequency, median(monetary) AS median_spend,
         avg(CAST(status = 'Lapsed' AS INT)) AS lapsed_share, count(*) / (SELECT count(*) FROM seg) AS customer_share,
         sum(monetary) / (SELECT sum(monetary) FROM seg) AS revenue_share FROM seg GROUP BY rfm_segment""",
)

# --- clusters, given labels ------------------------------------------------------------------------------------------

_CL = ["recency_days", "frequency", "monetary", "aov", "purchase_frequency_30d", "n_unique_categories"]
register(
    "k2_prepare_matrix",
    "customer_id:s " + " ".join(f"{c}:6" for c in _CL),
    lambda ws: cluster.prepared_columns(ws.at_end, _CL),
    _END
    + ", lg AS (SELECT customer_id, "
    + ", ".join(f"ln(1 + CAST({c} AS DOUBLE)) AS {c}" for c in _CL)
    + " FROM f), cl AS (SELECT customer_id, "
    + ", ".join(
        f"greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM lg)), (SELECT quantile_cont({c}, 0.01) FROM lg)) AS {c}"
        for c in _CL
    )
    + " FROM lg)",
    "SELECT customer_id, " + ", ".join(f"({c} - (SELECT avg({c}) FROM cl)) / (SELECT stddev_pop({c}) FROM cl) AS {c}" for c in _CL) + " FROM cl",
)
_PROFILE = (
    SEGMENTED
    + ", prof AS (SELECT cluster, "
    + ", ".join(f"avg({c}) AS {c}" for c in _CL)
    + """, count(*) AS customers, sum(monetary) / (SELECT sum(monetary) FROM seg) AS revenue_share,
           avg(CAST(status = 'Lapsed' AS INT)) AS lapsed_share FROM seg GROUP BY cluster)"""
)
register(
    "k7_cluster_profile",
    "cluster:i " + " ".join(f"{c}:6" for c in _CL) + " customers:i revenue_share:6 lapsed_share:6",
    lambda ws: cluster.cluster_profile(ws.labelled, _CL),
    _PROFILE,
    "SELECT * FROM prof",
)
_NAMED = """, pop AS (SELECT avg(recency_days) AS mr, stddev_pop(recency_days) AS sr, avg(frequency) AS mf,
     stddev_pop(frequency) AS sf, avg(monetary) AS mm, stddev_pop(monetary) AS sm FROM seg),
 z AS (SELECT cluster, (recency_days - mr) / sr AS zr, ((frequency - mf) / sf + (monetary - mm) / sm) / 2 AS zv FROM prof, pop)"""
register(
    "k8_name_clusters",
    "cluster:i cluster_name:s",
    lambda ws: cluster.cluster_names(cluster.cluster_profile(ws.labelled, _CL), ws.labelled),
    _PROFILE + _NAMED,
    """SELECT cluster, 'C' || CAST(cluster AS VARCHAR) || ': ' ||
         CASE WHEN zr < -0.4 THEN 'Active' WHEN zr > 0.4 THEN 'Dormant' ELSE 'Cooling' END || ', ' ||
         CASE WHEN zv > 0.4 THEN 'high-value' WHEN zv < -0.4 THEN 'low-value' ELSE 'mid-value' END AS cluster_name FROM z""",
)
register(
    "d11_cluster_heat",
    "cluster:i " + " ".join(f"{c}:6" for c in _CL),
    lambda ws: cluster.cluster_heat(cluster.cluster_profile(ws.labelled, _CL), _CL),
    _PROFILE,
    "SELECT cluster, "
    + ", ".join(
        f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}"
        for c in _CL
    )
    + " FROM prof",
)
register(
    "d32_leading_clusters",
    "most_revenue:i most_lapsed:i",
    lambda ws: cluster.leading_clusters(cluster.cluster_profile(ws.labelled, _CL)),
    _PROFILE,
    "SELECT arg_max(cluster, revenue_share) AS most_revenue, arg_max(cluster, lapsed_share) AS most_lapsed FROM prof",
)

# --- evaluation of a score -------------------------------------------------------------------------------------------

register(
    "e1_classification_metrics",
    "threshold:4 tn:i fp:i fn:i tp:i precision:6 recall:6 f1:6 accuracy:6 brier:6 base_rate:6",
    lambda ws: evaluate.confusion(ws.outcomes, 0.5),
    OUTCOMES,
    """SELECT 0.5 AS threshold, tn, fp, fn, tp, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
         2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy, brier, base_rate FROM (
         SELECT count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p >= 0.5 AND y = 0) AS fp,
                count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p >= 0.5 AND y = 1) AS tp,
                avg((p - y) * (p - y)) AS brier, avg(y) AS base_rate FROM e)""",
)
register(
    "e2_roc_auc",
    "roc_auc:8",
    lambda ws: evaluate.roc_auc(evaluate.score_table(ws.outcomes)),
    OUTCOMES,
    """SELECT (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM e a, e b
               WHERE a.y = 1 AND b.y = 0) / (sum(y) * sum(1 - y)) AS roc_auc FROM e""",
)
register(
    "e3_pr_auc",
    "pr_auc:8",
    lambda ws: evaluate.pr_auc(evaluate.score_table(ws.outcomes)),
    OUTCOMES,
    "SELECT sum(pos / pos_total * (caught / flagged)) AS pr_auc FROM pg",
)
register("e4_brier", "brier:8", lambda ws: evaluate.brier(ws.outcomes), OUTCOMES, "SELECT avg((p - y) ** 2) AS brier FROM e")
register(
    "e5_best_f1_threshold",
    "threshold:8 f1:8",
    lambda ws: evaluate.best_f1(evaluate.score_table(ws.outcomes)),
    OUTCOMES + ", fs AS (SELECT p, 2 * caught / (flagged + pos_total) AS f1 FROM pg)",
    "SELECT p AS threshold, f1 FROM fs ORDER BY f1 DESC, p LIMIT 1",
)
register(
    "e6_risk_thresholds",
    "t_high:8 t_low:8 required_high_churn_rate:8",
    lambda ws: evaluate.threshold_candidates(evaluate.score_table(ws.outcomes), min_lift=1.05, max_low_churn=0.52),
    OUTCOMES
    + """, need AS (SELECT least(0.9, 1.05 * avg(y)) AS r, greatest(30, floor(0.03 * count(*))) AS size FROM e)""",
    """SELECT min(p) FILTER (caught / flagged >= r AND flagged >= size) AS t_high,
         max(p) FILTER (pos_at_or_below / at_or_below <= 0.52 AND at_or_below >= size) AS t_low,
         any_value(r) AS required_high_churn_rate FROM pg, need""",
)


def _fallback_thresholds(ws):
    low, high, info = evaluate.risk_thresholds(ws.outcomes, min_lift=2.0, max_low_churn=0.01)
    return ws.spark.createDataFrame(
        [(low, high, info["high_fallback_to_quantile"], info["low_fallback_to_quantile"])],
        "t_low double, t_high double, high_fallback boolean, low_fallback boolean",
    )


register(
    "e6_risk_threshold_fallback",
    "t_low:8 t_high:8 high_fallback:b low_fallback:b",
    _fallback_thresholds,
    OUTCOMES
    + """, need AS (SELECT least(0.9, 2.0 * avg(y)) AS r, greatest(30, floor(0.03 * count(*))) AS size FROM e),
     cand AS (SELECT min(p) FILTER (caught / flagged >= r AND flagged >= size) AS hi,
                     max(p) FILTER (pos_at_or_below / at_or_below <= 0.01 AND at_or_below >= size) AS lo FROM pg, need),
     qs AS (SELECT quantile_cont(p, 0.33) AS q33, quantile_cont(p, 0.67) AS q67, quantile_cont(p, 0.9) AS q90 FROM e),
     st AS (SELECT *, coalesce(hi, q90) AS h1, coalesce(lo, q33) AS l1 FROM cand, qs)""",
    """SELECT CASE WHEN l1 >= h1 THEN q33 ELSE l1 END AS t_low, CASE WHEN l1 >= h1 THEN q67 ELSE h1 END AS t_high,
         hi IS NULL AS high_fallback, lo IS NULL AS low_fallback FROM st""",
)
register(
    "e7_assign_risk",
    "customer_id:s p:8 risk:s",
    lambda ws: ws.outcomes.withColumn("risk", evaluate.risk_level(F.col("p"), 0.3, 0.7)),
    OUTCOMES,
    "SELECT customer_id, p, CASE WHEN p >= 0.7 THEN 'High' WHEN p <= 0.3 THEN 'Low' ELSE 'Medium' END AS risk FROM e",
)
register(
    "e8_risk_table",
    "risk:s customers:i observed_churn_rate:6 mean_predicted_prob:6 churners:i share_of_customers:6 share_of_all_churners:6",
    lambda ws: evaluate.risk_table(ws.outcomes, -1.0, 0.7),
    OUTCOMES
    + """, lv AS (SELECT *, CASE WHEN p >= 0.7 THEN 'High' WHEN p <= -1.0 THEN 'Low' ELSE 'Medium' END AS risk FROM e),
     tiers(risk) AS (VALUES ('Low'), ('Medium'), ('High'))""",
    """SELECT tiers.risk, count(p) AS customers, avg(y) AS observed_churn_rate, avg(p) AS mean_predicted_prob,
         coalesce(sum(y), 0) AS churners, count(p) / (SELECT count(*) FROM e) AS share_of_customers,
         coalesce(sum(y), 0) / (SELECT sum(y) FROM e) AS share_of_all_churners
       FROM tiers LEFT JOIN lv ON lv.risk = tiers.risk GROUP BY tiers.risk""",
)
register(
    "e9_decile_lift",
    "decile:i customers:i churn_rate:6 lift:6",
    lambda ws: evaluate.decile_lift(ws.outcomes),
    OUTCOMES
    + """, rk AS (SELECT y, row_number() OVER (ORDER BY p DESC, customer_id) AS r, count(*) OVER () AS n FROM e)""",
    """SELECT greatest(1, ceil((r - 1) * 10 / (n - 1))) AS decile, count(*) AS customers, avg(y) AS churn_rate,
         avg(y) / (SELECT avg(y) FROM e) AS lift FROM rk GROUP BY 1""",
)
register(
    "e10_curve_points",
    "threshold:8 tpr:6 fpr:6 precision:6",
    lambda ws: evaluate.curve_points(evaluate.score_table(ws.outcomes)),
    OUTCOMES,
    """SELECT p AS threshold, caught / pos_total AS tpr, (flagged - caught) / (n_total - pos_total) AS fpr,
         caught / flagged AS precision FROM pg""",
)
register(
    "e11_calibration",
    "bin:i customers:i mean_predicted:6 observed_rate:6",
    lambda ws: evaluate.calibration(ws.outcomes),
    OUTCOMES
    + ", qs AS (SELECT unnest(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM e)",
    """SELECT bin, count(*) AS customers, avg(p) AS mean_predicted, avg(y) AS observed_rate
       FROM (SELECT y, p, (SELECT count(*) FROM qs WHERE p > q) AS bin FROM e) GROUP BY bin""",
)

# --- value -----------------------------------------------------------------------------------------------------------

register(
    "v1_run_rates",
    "customer_id:s annual_revenue_run_rate:4 annual_margin_run_rate:4",
    lambda ws: value.run_rates(ws.at_end),
    SCORED,
    "SELECT * FROM money",
)
register(
    "v2_clv_12m_proxy",
    "customer_id:s clv_12m_proxy:4",
    lambda ws: value.twelve_month_value(value.run_rates(ws.rated), ws.window),
    SCORED,
    "SELECT customer_id, annual_margin_run_rate * survival AS clv_12m_proxy FROM money",
)
register(
    "v3_margin_at_risk",
    "customer_id:s margin_at_risk:4 priority_score:4",
    lambda ws: value.at_risk(value.run_rates(ws.rated)),
    SCORED,
    "SELECT customer_id, margin_at_risk, priority_score FROM scored",
)
register(
    "v4_value_tier",
    "customer_id:s value_tier:s",
    lambda ws: value.value_tier(value.run_rates(ws.at_end)),
    SCORED,
    "SELECT customer_id, value_tier FROM scored",
)
register(
    "v5_playbook",
    "customer_id:s status:s risk_level:s value_tier:s priority:s suggested_action:s",
    lambda ws: value.with_playbook(value.value_tier(value.run_rates(ws.rated))),
    SCORED,
    "SELECT * FROM scored",
)
register(
    "v6_favourite_category",
    "customer_id:s favorite_category:s",
    lambda ws: value.favourite_category(ws.lines),
    T + ", " + FAVOURITE,
    "SELECT * FROM fav",
)
register(
    "v7_demographics",
    "customer_id:s recency_days:2 customer_location:s",
    lambda ws: value.with_demographics(ws.at_end, ws.customers),
    SCORED,
    "SELECT customer_id, recency_days, customer_location FROM scored",
)
register(
    "v8_headline",
    "n_customers_total:i n_orders:i n_customers_with_orders:i n_lines:i gross_revenue:4 net_revenue:4 return_value:4 "
    "n_active:i n_lapsed:i lapsed_share:6 n_high_risk:i avg_customer_value:4 mean_pred_churn_active:6",
    lambda ws: value.headline(ws.customers, ws.orders, ws.lines, ws.scored),
    SCORED,
    """SELECT (SELECT count(*) FROM customer) AS n_customers_total, (SELECT count(*) FROM o) AS n_orders,
         (SELECT count(DISTINCT customer_id) FROM o) AS n_customers_with_orders,
         (SELECT count(*) FROM t WHERE NOT is_return) AS n_lines,
         (SELECT sum(transaction_value) FROM t WHERE NOT is_return) AS gross_revenue,
         (SELECT sum(transaction_value) FROM t) AS net_revenue,
         (SELECT -sum(transaction_value) FROM t WHERE is_return) AS return_value,
         count(*) FILTER (status = 'Active') AS n_active, count(*) FILTER (status = 'Lapsed') AS n_lapsed,
         avg(CAST(status = 'Lapsed' AS INT)) AS lapsed_share, count(*) FILTER (risk_level = 'High') AS n_high_risk,
         avg(monetary) AS avg_customer_value, avg(churn_prob) AS mean_pred_churn_active FROM scored""",
)

# --- report tables ---------------------------------------------------------------------------------------------------


def _histogram_sql(value):
    return (
        f", v AS (SELECT {value} AS v FROM f), sp AS (SELECT min(v) AS low, max(v) AS high FROM v)",
        """SELECT bin, count(*) AS n, any_value(low + bin * (high - low) / 40) AS bin_start FROM (
             SELECT least(floor((v - low) / ((high - low) / 40)), 39) AS bin, low, high FROM v, sp WHERE v IS NOT NULL)
           GROUP BY bin""",
    )


for _name, _column, _log in (("spend", "monetary", True), ("aov", "aov", True), ("recency", "recency_days", False)):
    _cte, _select = _histogram_sql(f"log10({_column})" if _log else _column)
    register(
        f"d2_{_name}_histogram",
        "bin:i n:i bin_start:4",
        lambda ws, c=_column, lg=_log: reports.histogram(ws.at_end, c, 40, lg),
        _END + _cte,
        _select,
    )
register(
    "d2_orders_per_customer",
    "orders:i customers:i",
    lambda ws: reports.capped_counts(ws.at_end),
    _END,
    "SELECT least(frequency, 15) AS orders, count(*) AS customers FROM f GROUP BY 1",
)
register(
    "d6_one_time_vs_repeat",
    "kind:s customer_share:6 revenue_share:6",
    lambda ws: reports.one_time_vs_repeat(ws.at_end),
    _END,
    """SELECT CASE WHEN frequency = 1 THEN 'One-time' ELSE 'Repeat' END AS kind,
         count(*) / (SELECT count(*) FROM f) AS customer_share,
         sum(monetary) / (SELECT sum(monetary) FROM f) AS revenue_share FROM f GROUP BY 1""",
)
register(
    "d7_buy_again_by_recency",
    "recency_up_to:i p_return:6 n:i",
    lambda ws: reports.buy_again_by_recency(ws.split("train")),
    SNAPSHOTS,
    """SELECT greatest(ceil(recency_days / 10), 1) * 10 AS recency_up_to, 1 - avg(churned) AS p_return, count(*) AS n
       FROM snap WHERE split = 'train' GROUP BY 1""",
)
register(
    "d8_quartiles_by_outcome",
    "churned:i feature:s p25:4 p50:4 p75:4",
    lambda ws: reports.quartiles_by_outcome(ws.split("train")),
    SNAPSHOTS,
    " UNION ALL ".join(
        f"""SELECT churned, '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25,
             quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75
            FROM snap WHERE split = 'train' GROUP BY churned"""
        for c in reports.COMPARED
    ),
)
_CORR = [c for c in feats.FEATURES if c != "days_since_registration"]  # the bound tables have no registration date
register(
    "d9_correlation",
    "a:s b:s r:5",
    lambda ws: reports.correlation(ws.split("train"), _CORR),
    SNAPSHOTS + ", tr AS MATERIALIZED (SELECT * FROM snap WHERE split = 'train')",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM tr"
        for i, a in enumerate(_CORR)
        for b in _CORR[i:]
    ),
)
register(
    "d13_top_customer_share",
    "top_share:8",
    lambda ws: reports.top_share(ws.at_end),
    _END + ", rk AS (SELECT monetary, row_number() OVER (ORDER BY monetary DESC) AS r, count(*) OVER () AS n FROM f)",
    "SELECT sum(monetary) FILTER (r <= floor(0.2 * n)) / sum(monetary) AS top_share FROM rk",
)
register(
    "d14_repeat_share",
    "repeat_share:8",
    lambda ws: reports.repeat_share(ws.at_end),
    _END,
    "SELECT avg(CAST(frequency >= 2 AS INT)) AS repeat_share FROM f",
)
register(
    "d15_medians_by_outcome",
    "feature:s churned_median:4 retained_median:4 direction:s",
    lambda ws: reports.medians_by_outcome(ws.split("train")),
    SNAPSHOTS,
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, a AS churned_median, b AS retained_median,
              CASE WHEN a > b THEN 'higher' WHEN a < b THEN 'lower' ELSE 'equal' END AS direction FROM (
              SELECT median(CAST({c} AS DOUBLE)) FILTER (churned = 1) AS a, median(CAST({c} AS DOUBLE)) FILTER (churned = 0) AS b
              FROM snap WHERE split = 'train')"""
        for c in reports.MEDIANS
    ),
)
_SKEWED = ["monetary", "frequency", "aov"]
register(
    "d18_skewness",
    "feature:s skew:5",
    lambda ws: reports.skew_table(ws.at_end, _SKEWED),
    _END,
    " UNION ALL ".join(f"SELECT '{c}' AS feature, skewness(CAST({c} AS DOUBLE)) AS skew FROM f" for c in _SKEWED),
)
register(
    "d20_threshold_tradeoff",
    "threshold:4 contacted:i churners_reached:i recall:6 net_cheap_email:4 net_phone_call:4",
    lambda ws: reports.threshold_tradeoff(ws.outcomes),
    OUTCOMES
    + """, th AS (SELECT unnest(range(15)) * 0.05 AS threshold),
     em AS (SELECT y, p, monetary / greatest(days_since_first_order, 90) * 365 * 0.30 AS margin FROM e)""",
    """SELECT round(threshold, 2) AS threshold, count(p) AS contacted, coalesce(sum(y), 0) AS churners_reached,
         coalesce(sum(y), 0) / (SELECT sum(y) FROM e) AS recall,
         coalesce(sum(y * margin), 0) * 0.05 - 1 * count(p) AS net_cheap_email,
         coalesce(sum(y * margin), 0) * 0.25 - 20 * count(p) AS net_phone_call
       FROM th LEFT JOIN em ON p >= CAST(round(threshold, 2) AS DOUBLE) GROUP BY threshold""",
)
register(
    "d20_best_thresholds",
    "best_cheap_email:4 best_phone_call:4",
    lambda ws: reports.best_thresholds(reports.threshold_tradeoff(ws.outcomes)),
    OUTCOMES
    + """, th AS (SELECT unnest(range(15)) * 0.05 AS threshold),
     em AS (SELECT y, p, monetary / greatest(days_since_first_order, 90) * 365 * 0.30 AS margin FROM e),
     net AS (SELECT round(threshold, 2) AS threshold, coalesce(sum(y * margin), 0) * 0.05 - count(p) AS a,
               coalesce(sum(y * margin), 0) * 0.25 - 20 * count(p) AS b
             FROM th LEFT JOIN em ON p >= CAST(round(threshold, 2) AS DOUBLE) GROUP BY threshold)""",
    "SELECT arg_max(threshold, a) AS best_cheap_email, arg_max(threshold, b) AS best_phone_call FROM net",
)
register(
    "d21_risk_by_value",
    "risk_level:s High:i Medium:i Low:i",
    lambda ws: reports.risk_by_value(ws.scored),
    SCORED,
    """SELECT risk_level, count(*) FILTER (value_tier = 'High') AS "High", count(*) FILTER (value_tier = 'Medium') AS "Medium",
         count(*) FILTER (value_tier = 'Low') AS "Low" FROM scored WHERE status = 'Active' GROUP BY risk_level""",
)
register(
    "d21_priority_summary",
    "priority:s customers:i expected_margin_at_risk:4 mean_churn_prob:6",
    lambda ws: reports.priority_summary(ws.scored),
    SCORED,
    """SELECT priority, count(*) AS customers, sum(margin_at_risk) AS expected_margin_at_risk,
         avg(churn_prob) AS mean_churn_prob FROM scored WHERE status = 'Active' GROUP BY priority""",
)
register(
    "d22_top_worklist",
    "customer_id:s priority_score:4 priority:s",
    lambda ws: reports.top_worklist(ws.scored),
    SCORED,
    """SELECT customer_id, priority_score, priority FROM scored WHERE status = 'Active'
       ORDER BY priority_score DESC, customer_id LIMIT 10""",
)
register(
    "d22_critical_totals",
    "customers:i margin_at_risk:4",
    lambda ws: reports.critical_totals(ws.scored),
    SCORED,
    """SELECT count(*) AS customers, coalesce(sum(margin_at_risk), 0) AS margin_at_risk
       FROM scored WHERE status = 'Active' AND priority LIKE 'P1%'""",
)
for _dimension in ("rfm_segment", "cluster_name", "customer_location", "favorite_category"):
    register(
        f"d23_lapsed_by_{_dimension}",
        f"{_dimension}:s customers:i lapsed_share:6",
        lambda ws, d=_dimension: reports.lapsed_by(ws.scored, d),
        SCORED,
        f"""SELECT {_dimension}, count(*) AS customers, avg(CAST(status = 'Lapsed' AS INT)) AS lapsed_share
            FROM scored GROUP BY {_dimension}""",
    )
register(
    "d24_lapsed_by_age_group",
    "age_group:s customers:i lapsed_share:6",
    lambda ws: reports.lapsed_by(
        ws.scored.withColumn(
            "age_group",
            reports.age_group(
                F.when(F.col("customer_id").cast("bigint") % 9 != 0, F.col("customer_id").cast("bigint") % 120)
            ),
        ),
        "age_group",
    ),
    SCORED
    + ", aged AS (SELECT *, CASE WHEN CAST(customer_id AS BIGINT) % 9 <> 0 THEN CAST(customer_id AS BIGINT) % 120 END AS age FROM scored)",
    """SELECT CASE WHEN age IS NULL OR age <= 0 OR age > 100 THEN 'Unknown' WHEN age <= 24 THEN '<=24' WHEN age <= 34 THEN '25-34'
         WHEN age <= 44 THEN '35-44' WHEN age <= 54 THEN '45-54' ELSE '55+' END AS age_group, count(*) AS customers,
         avg(CAST(status = 'Lapsed' AS INT)) AS lapsed_share FROM aged GROUP BY 1""",
)
_FILTER = {"risk_level": ["High", "Medium"], "value_tier": ["High", "Medium"], "cluster_name": ["C0", "C1"]}
_FILTER_SQL = (
    "status = 'Active' AND risk_level IN ('High', 'Medium') AND value_tier IN ('High', 'Medium') AND cluster_name IN ('C0', 'C1')"
)
register(
    "d25_filtered_worklist",
    "customer_id:s rfm_segment:s churn_prob:6 risk_level:s priority_score:4",
    lambda ws: reports.ranked_worklist(ws.scored, **_FILTER),
    SCORED,
    f"SELECT customer_id, rfm_segment, churn_prob, risk_level, priority_score FROM scored WHERE {_FILTER_SQL}",
)
register(
    "d26_worklist_totals",
    "customers:i margin_at_risk:4 mean_churn_prob:6",
    lambda ws: reports.worklist_totals(reports.worklist(ws.scored, **_FILTER)),
    SCORED,
    f"""SELECT count(*) AS customers, coalesce(sum(margin_at_risk), 0) AS margin_at_risk, avg(churn_prob) AS mean_churn_prob
        FROM scored WHERE {_FILTER_SQL}""",
)
register(
    "d27_win_back",
    "customer_id:s annual_margin_run_rate:4 priority:s",
    lambda ws: reports.win_back(ws.scored),
    SCORED,
    """SELECT customer_id, annual_margin_run_rate, priority FROM scored WHERE status = 'Lapsed'
       ORDER BY annual_margin_run_rate DESC, customer_id LIMIT 500""",
)
register(
    "d28_customer_profile",
    "customer_id:s status:s frequency:2 monetary:4 rfm_segment:s",
    lambda ws: reports.customer_profile(ws.keyed_scored, ws.keyed_lines.agg(F.min("customer_id")).first()[0]),
    SCORED,
    "SELECT customer_id, status, frequency, monetary, rfm_segment FROM scored WHERE customer_id = (SELECT min(customer_id) FROM t)",
)
register(
    "d29_probability_by_cluster",
    "cluster_name:s active_customers:i mean_churn_prob:6",
    lambda ws: reports.probability_by_cluster(ws.scored),
    SCORED,
    """SELECT cluster_name, count(*) AS active_customers, avg(churn_prob) AS mean_churn_prob
       FROM scored WHERE status = 'Active' GROUP BY 1""",
)
register(
    "d29_probability_histogram",
    "bin:i risk_level:s customers:i",
    lambda ws: reports.probability_histogram(ws.scored),
    SCORED,
    """SELECT least(floor(churn_prob * 40), 39) AS bin, risk_level, count(*) AS customers
       FROM scored WHERE churn_prob IS NOT NULL GROUP BY 1, 2""",
)

# --- named SQL over scored customers ---------------------------------------------------------------------------------


def _named(name):
    def build(ws):
        named_queries.register(ws.lines, ws.scored)
        return named_queries.run(ws.spark, name)

    return build


register(
    "l5_lapsed_share_by_rfm_segment",
    "rfm_segment:s customers:i lapsed_pct:1 revenue:0",
    _named("lapsed_share_by_rfm_segment"),
    SCORED,
    """SELECT rfm_segment, count(*) AS customers, round(100.0 * avg(CAST(status = 'Lapsed' AS INT)), 1) AS lapsed_pct,
         round(sum(monetary), 0) AS revenue FROM scored GROUP BY rfm_segment""",
)
register(
    "l6_high_value_high_risk",
    "customer_id:s rfm_segment:s churn_prob:2 annual_margin:0 priority:s",
    _named("high_value_high_risk"),
    SCORED,
    """SELECT customer_id, rfm_segment, round(churn_prob, 2) AS churn_prob, round(annual_margin_run_rate, 0) AS annual_margin,
         priority FROM scored WHERE status = 'Active' AND risk_level = 'High' AND value_tier = 'High'
       ORDER BY margin_at_risk DESC, customer_id LIMIT 10""",
)
