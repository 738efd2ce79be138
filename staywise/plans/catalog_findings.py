"""Registered queries on findings: what a run decides and says from its tables."""
from pyspark.sql import functions as F

from ..operators import cluster, evaluate, explain, features as feats, orders as ordering, quality, reports, rfm
from .catalog_customers import _CL, _END
from .checks_sql import O, OUTCOMES, SEGMENTED, SNAPSHOTS
from .registry import register


def _rows(ws, schema, *rows):
    return ws.spark.createDataFrame(list(rows), schema)


def _usable(ws):
    usable, n = cluster.usable_features(ws.at_end)
    reason = cluster.skip_reason(n, usable)
    return _rows(ws, "feature string, usable boolean, customers bigint, skipped boolean", *[(c, c in usable, n, reason is not None) for c in _CL])


register(
    "k1_usable_features",
    "feature:s usable:b customers:i skipped:b",
    _usable,
    _END
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(min({c}) < max({c}), false) AS usable, count(*) AS customers FROM f" for c in _CL)
    + ")",
    "SELECT *, customers < 100 OR (SELECT count(*) FROM u WHERE usable) < 3 AS skipped FROM u",
)
register(
    "f7_required_history",
    "window_days:i required_days:i enough:b",
    lambda ws: _rows(
        ws,
        "window_days int, required_days int, enough boolean",
        (ws.window, ordering.required_history_days(ws.window), (ws.span[1] - ws.span[0]).days >= ordering.required_history_days(ws.window)),
    ),
    O,
    "SELECT h AS window_days, 180 + 3 * h AS required_days, date_diff('day', a, b) >= 180 + 3 * h AS enough FROM h, span",
)


def _stability(ws):
    report = quality.Report("windows")
    rows = feats.window_sensitivity(ws.orders, *ws.span, ws.window).collect()  # one row per window of a fixed grid
    quality.window_stability(report, ws.window, rows)
    return report.checks_table(ws.spark)


register(
    "q13_window_stability",
    "level:s title:s detail:s",
    _stability,
    O
    + """, w AS (SELECT unnest([30, 60, 90, 120, 150, 180]) AS w UNION SELECT h FROM h),
     cut AS (SELECT b - CAST((SELECT max(w) FROM w) AS INTEGER) AS cutoff FROM span),
     r AS (SELECT customer_id, date_diff('day', max(order_date) FILTER (order_date <= cutoff), any_value(cutoff)) AS recency,
                  date_diff('day', any_value(cutoff), min(order_date) FILTER (order_date > cutoff)) AS ahead
           FROM o, cut GROUP BY customer_id),
     rates AS (SELECT w, avg(CAST(NOT coalesce(ahead <= w, false) AS INT)) AS rate FROM r JOIN w ON recency <= w GROUP BY w),
     two AS (SELECT a.rate AS own, a.w AS h, b.rate AS other, b.w AS near FROM rates a, rates b, h
             WHERE a.w = h.h AND b.w <> a.w ORDER BY abs(b.w - a.w), b.w LIMIT 1)""",
    """SELECT CASE WHEN abs(own - other) > 0.10 THEN 'warn' ELSE 'ok' END AS level,
         CASE WHEN abs(own - other) > 0.10 THEN 'The churn rate depends much on the window'
              ELSE 'Neighbouring windows agree on the churn rate' END AS title,
         format('{} days: {:.0f}%, {} days: {:.0f}%', h, 100 * own, near, 100 * other) AS detail FROM two""",
)


def _shift(ws):
    rates = {r["split"]: r["churn_rate"] for r in reports.split_table(ws.staged_snapshots).collect()}
    return _rows(ws, "note string", (reports.shift_note(rates["train"], rates["test"]),))


register(
    "d30_shift_note",
    "note:s",
    _shift,
    SNAPSHOTS + ", two AS (SELECT avg(churned) FILTER (split = 'train') AS a, avg(churned) FILTER (split = 'test') AS b FROM snap)",
    """SELECT CASE WHEN abs(a - b) <= 0.03 THEN '' ELSE format('Churn moved from {:.1f}% in training to {:.1f}% in the test period: '
         || 'read the probabilities as a ranking until the model is fitted again.', 100 * a, 100 * b) END AS note FROM two""",
)


def _rule(ws):
    found = evaluate.threshold_candidates(evaluate.score_table(ws.outcomes), min_lift=1.05, max_low_churn=0.52).first()
    base = ws.outcomes.agg(F.avg(F.col("y").cast("double"))).first()[0]
    return _rows(ws, "rule string", (evaluate.rule_text(found["t_low"], found["t_high"], base, 1.05, 0.52),))


register(
    "e12_rule_text",
    "rule:s",
    _rule,
    OUTCOMES
    + """, need AS (SELECT least(0.9, 1.05 * avg(y)) AS r, greatest(30, floor(0.03 * count(*))) AS size, avg(y) AS base FROM e),
     cut AS (SELECT min(p) FILTER (caught / flagged >= r AND flagged >= size) AS t_high,
                    max(p) FILTER (pos_at_or_below / at_or_below <= 0.52 AND at_or_below >= size) AS t_low,
                    any_value(base) AS base FROM pg, need)""",
    """SELECT 'High: from ' || coalesce(format('{:.2f}', t_high), 'no score') || format(' up, where validation churn reached 1.05 times its '
         || 'base rate of {:.1f}%; Low: up to ', 100 * base) || coalesce(format('{:.2f}', t_low), 'no score')
         || ', where validation churn stayed within 52%; Medium: all between' AS rule FROM cut""",
)


def _ordered_segments(ws):
    order = F.create_map(*[F.lit(x) for pair in zip(rfm.SEGMENT_ORDER, range(1, 7), strict=True) for x in pair])
    return rfm.segment_summary(ws.segmented).withColumn("position", F.element_at(order, F.col("rfm_segment")))


register(
    "d12_segments_in_order",
    "position:i rfm_segment:s customers:i",
    _ordered_segments,
    SEGMENTED,
    """SELECT list_position(['Champions', 'Loyal customers', 'Potential loyalists', 'New customers', 'At-risk customers', 'Hibernating'],
         rfm_segment) AS position, rfm_segment, count(*) AS customers FROM seg GROUP BY rfm_segment""",
)
register(
    "d18_skewness_after_transform",
    "feature:s skew:5",
    lambda ws: reports.skew_table(cluster.prepared_columns(ws.at_end, _CL), _CL),
    _END
    + ", lg AS (SELECT "
    + ", ".join(f"ln(1 + CAST({c} AS DOUBLE)) AS {c}" for c in _CL)
    + " FROM f)",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, skewness(greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM lg)),
              (SELECT quantile_cont({c}, 0.01) FROM lg))) AS skew FROM lg"""
        for c in _CL
    ),
)
_WITHOUT = [c for c in feats.FEATURES if feats.NEEDS.get(c) not in ("category", "discount", "registration_date")]
_SUBSTITUTED = [
    "recency_days", "frequency", "monetary", "aov", "frequency_change", "avg_gap_days", "n_unique_products", "orders_90d",
]
register(
    "d8_quartiles_with_substitutes",
    "churned:i feature:s p25:4 p50:4 p75:4",
    lambda ws: reports.quartiles_by_outcome(ws.split("train"), reports.compared_features(_WITHOUT)),
    SNAPSHOTS,
    " UNION ALL ".join(
        f"""SELECT churned, '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25,
             quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75
            FROM snap WHERE split = 'train' GROUP BY churned"""
        for c in _SUBSTITUTED
    ),
)


def _permuted_recency(ws):
    """Importance of recency for the rule of thumb that a longer silence is riskier, on the test customers."""
    silent = lambda rows, keep: rows.select(*keep, (F.col("recency_days") / F.lit(float(ws.window))).alias("p"))
    return explain.importance_by_permutation(silent, ws.split("test"), ["recency_days"], repeats=3, seed=7)


register(
    "x7_permuted_recency",
    "feature:s pr_auc_drop:6 std:6",
    _permuted_recency,
    SNAPSHOTS
    + f""", ts AS (SELECT customer_id, churned AS y, recency_days AS x, md5(customer_id || '|' || strftime(cutoff, '%Y-%m-%d') || '|7') AS d
                   FROM snap WHERE split = 'test'),
     dealt AS (SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / {explain.DONOR_ROWS}.0) AS BIGINT)) FROM ts) AS bucket FROM ts),
     placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM dealt),
     swapped AS (SELECT r, a.y, b.x FROM placed a, (VALUES (1), (2), (3)) AS rep(r), placed b
                 WHERE a.bucket = b.bucket AND b.i = (a.i + greatest(1, CAST(floor(a.n * r / 4.0) AS BIGINT))) % a.n
                 UNION ALL SELECT 0, y, x FROM ts),
     pt AS (SELECT r, x, sum(y) AS pos, sum(sum(y)) OVER (PARTITION BY r ORDER BY x DESC) AS caught,
                   sum(count(*)) OVER (PARTITION BY r ORDER BY x DESC) AS flagged, sum(sum(y)) OVER (PARTITION BY r) AS total FROM swapped GROUP BY r, x),
     ap AS (SELECT r, sum(pos / total * (caught / flagged)) AS ap FROM pt GROUP BY r),
     drops AS (SELECT (SELECT ap FROM ap WHERE r = 0) - ap AS lost FROM ap WHERE r > 0)""",
    "SELECT 'recency_days' AS feature, avg(lost) AS pr_auc_drop, stddev_pop(lost) AS std FROM drops",
)
