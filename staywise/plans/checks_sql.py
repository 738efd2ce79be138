"""Building blocks of the oracle SQL: the definitions of the chain, written as common table expressions."""

# --- clean binding ---------------------------------------------------------------------------------------------------

RAW = """raw AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice / l_quantity AS unit_price, l_discount,
         l_returnflag, o_custkey, o_orderdate, p_name, p_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

T = (
    RAW
    + """, t0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(o_orderdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS product_id, p_name AS product_name,
         p_type AS category, l_returnflag = 'R' AS is_return,
         CASE WHEN l_returnflag = 'R' THEN -abs(l_quantity) ELSE l_quantity END AS quantity,
         unit_price, l_discount AS discount
  FROM raw), t AS (SELECT *, quantity * unit_price * (1 - discount) AS transaction_value FROM t0)"""
)

O = (
    T
    + """, o AS (
  SELECT order_id, min(customer_id) AS customer_id, min(date) AS order_date, sum(transaction_value) AS order_value,
         count(*) AS n_lines, sum(quantity) AS n_units, count(DISTINCT category) AS n_categories,
         avg(discount) AS discount, avg(discount) > 0 AS has_discount
  FROM t WHERE NOT is_return GROUP BY order_id),
 oo AS (
  SELECT *, date_diff('day', lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id),
                      order_date) AS gap0 FROM o),
 gaps AS (SELECT customer_id, order_date, gap0 AS gap FROM oo WHERE gap0 > 0),
 span AS (SELECT min(date) AS a, max(date) AS b FROM t),
 h AS (SELECT CAST(least(greatest(ceil(quantile_cont(gap, 0.95) / 15) * 15, 30), 180) AS INTEGER) AS h FROM gaps)"""
)

SCHEDULE = """, splits AS (
  SELECT 'validation' AS split, b - 2 * h AS cutoff FROM span, h
  UNION ALL SELECT 'test', b - h FROM span, h
  UNION ALL SELECT 'train', CAST(unnest(generate_series(CAST(a + 120 AS TIMESTAMP), CAST(b - 3 * h AS TIMESTAMP),
                                        INTERVAL 30 DAY)) AS DATE) FROM span, h)"""


def features(cutoffs):
    """Features of every customer at every cut-off of ``cutoffs`` (a query giving a column ``cutoff``)."""
    return f"""{O}{SCHEDULE}, c AS ({cutoffs}),
 fo AS (
  SELECT c.cutoff, customer_id, count(*) AS frequency, sum(order_value) AS monetary, min(order_date) AS first_order,
         max(order_date) AS last_order, count(DISTINCT date_trunc('month', order_date)) AS active_months,
         avg(CASE WHEN gap0 > 0 THEN gap0 END) AS avg_gap_days,
         stddev_samp(CASE WHEN gap0 > 0 THEN gap0 END) AS gap_std_days,
         avg(CASE WHEN has_discount THEN 1.0 ELSE 0.0 END) AS discount_order_share,
         count(*) FILTER (date_diff('day', order_date, c.cutoff) < 30) AS orders_30d,
         count(*) FILTER (date_diff('day', order_date, c.cutoff) < 90) AS orders_90d,
         count(*) FILTER (date_diff('day', order_date, c.cutoff) BETWEEN 90 AND 179) AS orders_prev90d,
         coalesce(sum(order_value) FILTER (date_diff('day', order_date, c.cutoff) < 90), 0) AS spend_90d,
         coalesce(sum(order_value) FILTER (date_diff('day', order_date, c.cutoff) BETWEEN 90 AND 179), 0)
           AS spend_prev90d
  FROM oo JOIN c ON order_date <= c.cutoff GROUP BY c.cutoff, customer_id),
 fl AS (
  SELECT c.cutoff, customer_id, count(DISTINCT product_id) AS n_unique_products,
         count(DISTINCT category) AS n_unique_categories, avg(discount) AS avg_discount, sum(quantity) AS units
  FROM t JOIN c ON date <= c.cutoff WHERE NOT is_return GROUP BY c.cutoff, customer_id),
 fr AS (
  SELECT c.cutoff, customer_id, -sum(transaction_value) AS returned
  FROM t JOIN c ON date <= c.cutoff WHERE is_return GROUP BY c.cutoff, customer_id),
 reg AS (SELECT customer_id, min(order_date) AS registered FROM o GROUP BY customer_id),
 f AS (
  SELECT fo.*, date_diff('day', last_order, cutoff) AS recency_days,
         date_diff('day', first_order, cutoff) AS days_since_first_order, monetary / frequency AS aov,
         frequency / CAST(greatest(date_diff('day', first_order, cutoff), 30) AS DOUBLE) * 30 AS purchase_frequency_30d,
         date_diff('day', registered, cutoff) AS days_since_registration, gap_std_days / avg_gap_days AS gap_cv,
         date_diff('day', last_order, cutoff) / avg_gap_days AS recency_to_gap_ratio,
         orders_90d - orders_prev90d AS frequency_change, spend_90d - spend_prev90d AS spend_change,
         n_unique_products, n_unique_categories, avg_discount, units / frequency AS avg_units_per_order,
         least(greatest(coalesce(returned, 0) / monetary, 0), 1) AS return_rate
  FROM fo LEFT JOIN fl USING (cutoff, customer_id) LEFT JOIN fr USING (cutoff, customer_id)
       LEFT JOIN reg USING (customer_id))"""


SNAPSHOTS = (
    features("SELECT DISTINCT cutoff FROM splits")
    + """, snap AS (
  SELECT s.split, f.*, CAST(NOT EXISTS (
           SELECT 1 FROM o WHERE o.customer_id = f.customer_id AND o.order_date > f.cutoff
                              AND o.order_date <= f.cutoff + h) AS INTEGER) AS churned
  FROM f JOIN splits s USING (cutoff), h WHERE recency_days <= h)"""
)

OUTCOMES = (
    SNAPSHOTS
    + """, e AS (
  SELECT customer_id, churned AS y, recency_days / CAST(h AS DOUBLE) AS p, monetary, days_since_first_order
  FROM snap, h WHERE split = 'validation'),
 pg AS (
  SELECT p, count(*) AS n, sum(y) AS pos, sum(count(*)) OVER () AS n_total, sum(sum(y)) OVER () AS pos_total,
         sum(count(*)) OVER (ORDER BY p DESC) AS flagged, sum(sum(y)) OVER (ORDER BY p DESC) AS caught,
         sum(count(*)) OVER (ORDER BY p) AS at_or_below, sum(sum(y)) OVER (ORDER BY p) AS pos_at_or_below
  FROM e GROUP BY p)"""
)

# --- scored customers ------------------------------------------------------------------------------------------------


def average_tie_rank(column, name):
    return f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0) / count(*) OVER () AS {name}"


def quintile(rank):
    return f"CASE WHEN {rank} <= 0.2 THEN 1 WHEN {rank} <= 0.4 THEN 2 WHEN {rank} <= 0.6 THEN 3 WHEN {rank} <= 0.8 THEN 4 ELSE 5 END"


SEGMENTED = (
    features("SELECT b AS cutoff FROM span")
    + f""", ranked AS (
  SELECT f.*, {average_tie_rank('-recency_days', 'pr')}, {average_tie_rank('frequency', 'pf')},
         {average_tie_rank('round(monetary, 6)', 'pm')} FROM f),
 rfm0 AS (SELECT *, {quintile('pr')} AS R, {quintile('pf')} AS F, {quintile('pm')} AS M FROM ranked),
 seg AS (
  SELECT *, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS RFM_score, R + F + M AS RFM_sum,
         CASE WHEN days_since_first_order <= 60 AND frequency <= 2 THEN 'New customers'
              WHEN R >= 4 AND F + M >= 8 THEN 'Champions'
              WHEN R >= 3 AND F + M >= 7 THEN 'Loyal customers'
              WHEN R <= 2 AND F + M >= 6 THEN 'At-risk customers'
              WHEN R >= 3 THEN 'Potential loyalists' ELSE 'Hibernating' END AS rfm_segment,
         CASE WHEN recency_days <= h THEN 'Active' ELSE 'Lapsed' END AS status,
         frequency % 3 AS cluster
  FROM rfm0, h)"""
)

PEOPLE = """people AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, n_name AS customer_location
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PLAYBOOK = """book(risk, value, priority, suggested_action) AS (VALUES
  ('High', 'High', 'P1 - Critical', 'Personal outreach: customer-service call or account-owner email, loyalty gesture; discount only if needed'),
  ('High', 'Medium', 'P2 - High', 'Personalised email with product recommendations based on favourite category'),
  ('High', 'Low', 'P3 - Low-cost', 'Automated reminder email / ''we miss you'' message (no discount)'),
  ('Medium', 'High', 'P2 - High', 'Loyalty communication (early access, thank-you) plus a gentle reminder'),
  ('Medium', 'Medium', 'P3 - Low-cost', 'Automated reminder or product-recommendation email'),
  ('Medium', 'Low', 'P4 - Monitor', 'Keep in regular newsletter; re-score next month'),
  ('Low', 'High', 'P5 - Maintain', 'Loyalty / VIP communication; do NOT discount (customer is likely to stay anyway)'),
  ('Low', 'Medium', 'P5 - Maintain', 'Business-as-usual communication'),
  ('Low', 'Low', 'P5 - Maintain', 'Business-as-usual communication'),
  ('Lapsed', 'High', 'W1 - Win-back (high value)', 'Personal win-back message; an offer is justified because the customer has already lapsed'),
  ('Lapsed', 'Medium', 'W2 - Win-back', 'Reactivation email with recommendations'),
  ('Lapsed', 'Low', 'W3 - Low priority', 'Include in low-cost reactivation batch or suppress'))"""

FAVOURITE = """fav AS (
  SELECT customer_id, category AS favorite_category FROM (
    SELECT customer_id, category, row_number() OVER (
             PARTITION BY customer_id ORDER BY round(sum(transaction_value), 6) DESC, category) AS place
    FROM t WHERE NOT is_return GROUP BY customer_id, category) WHERE place = 1)"""

SCORED = (
    SEGMENTED
    + f""", {PEOPLE}, {PLAYBOOK}, {FAVOURITE}, rated AS (
  SELECT *, CASE WHEN status = 'Active' THEN recency_days / (2.0 * h) END AS churn_prob FROM seg),
 leveled AS (
  SELECT *, CASE WHEN churn_prob IS NULL THEN 'Lapsed' WHEN churn_prob >= 0.35 THEN 'High'
                 WHEN churn_prob <= 0.15 THEN 'Low' ELSE 'Medium' END AS risk_level,
         monetary / greatest(days_since_first_order, 90) * 365 AS annual_revenue_run_rate FROM rated),
 money AS (
  SELECT *, annual_revenue_run_rate * 0.30 AS annual_margin_run_rate,
         (SELECT sum(power(1 - coalesce(churn_prob, 1.0), k)) / max(k)
          FROM (SELECT unnest(range(1, CAST(ceil(365.0 / h) AS BIGINT) + 1)) AS k)) AS survival FROM leveled),
 tiered AS (
  SELECT *, {average_tie_rank('round(annual_margin_run_rate, 6)', 'pv')} FROM money),
 scored AS (
  SELECT x.*, annual_margin_run_rate * survival AS clv_12m_proxy, annual_margin_run_rate * churn_prob AS margin_at_risk,
         annual_margin_run_rate * churn_prob AS priority_score, priority, suggested_action, customer_location,
         favorite_category, 'C' || CAST(cluster AS VARCHAR) AS cluster_name
  FROM (SELECT *, CASE WHEN pv <= 1.0 / 3 THEN 'Low' WHEN pv <= 2.0 / 3 THEN 'Medium' ELSE 'High' END AS value_tier
        FROM tiered) x
  JOIN book ON book.risk = risk_level AND book.value = value_tier
  LEFT JOIN people USING (customer_id) LEFT JOIN fav USING (customer_id))"""
)

# --- dirty binding ---------------------------------------------------------------------------------------------------

DIRTY = (
    RAW
    + """, d0 AS (
  SELECT CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_orderkey % 59 = 0 THEN 'nan'
              ELSE CAST(o_custkey AS VARCHAR) || '.0' END AS cust,
         CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS inv,
         CASE WHEN l_orderkey % 101 = 0 THEN 'not a date'
              WHEN l_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN l_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
              WHEN l_orderkey % 4 = 2 THEN strftime(o_orderdate, '%d/%m/%Y')
              ELSE strftime(o_orderdate, '%d.%m.%Y') END AS dt,
         CASE WHEN l_partkey % 113 = 0 THEN 'POST' ELSE CAST(l_partkey AS VARCHAR) END AS sku,
         p_name AS title,
         CASE l_orderkey % 7 WHEN 1 THEN lower(p_type) WHEN 2 THEN upper(p_type) WHEN 3 THEN p_type || ' '
              ELSE p_type END AS dept,
         CAST(CAST(CASE WHEN l_orderkey % 97 = 0 THEN 0
              WHEN l_orderkey % 89 = 0 AND l_returnflag <> 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT)
              AS VARCHAR) AS qty,
         CASE WHEN l_orderkey % 71 = 0 THEN '0' WHEN l_orderkey % 73 = 0 THEN 'n.a.'
              ELSE CAST(CAST(floor(unit_price * 100) AS BIGINT) AS VARCHAR) || 'e-2' END AS px,
         CAST(CAST(CASE WHEN l_orderkey % 61 = 0 THEN l_discount * 100 ELSE l_discount END AS DECIMAL(18, 4))
              AS VARCHAR) AS disc,
         CASE l_linenumber % 3 WHEN 0 THEN 'card' WHEN 1 THEN ' Card' ELSE 'cash' END AS pay,
         l_returnflag AS kind, CAST(l_linenumber AS VARCHAR) AS line_no, l_orderkey AS k FROM raw),
 dirty AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE k % 83 = 0),
 std0 AS (
  SELECT *, CASE WHEN lower(regexp_replace(trim(cust), '\\.0+$', '')) NOT IN ('', 'nan', 'none', 'null', '<na>')
                 THEN regexp_replace(trim(cust), '\\.0+$', '') END AS customer_id,
         trim(inv) AS order_id, dt AS date, trim(sku) AS product_id, trim(title) AS product_name, trim(dept) AS category,
         trim(pay) AS payment_method, TRY_CAST(qty AS DOUBLE) AS q0, TRY_CAST(px AS DOUBLE) AS unit_price,
         coalesce(TRY_CAST(disc AS DOUBLE), 0) AS discount, lower(trim(kind)) = 'r' AS is_return FROM dirty),
 std AS (
  SELECT *, CASE WHEN is_return THEN -abs(q0) ELSE q0 END AS quantity, upper(product_id) = 'POST' AS is_non_product
  FROM std0)"""
)

DAY = """coalesce(TRY_CAST(try_strptime(date, '%Y-%m-%d') AS DATE), TRY_CAST(try_strptime(date, '%Y-%m-%dT%H:%M:%S') AS DATE),
         TRY_CAST(try_strptime(date, '%d/%m/%Y') AS DATE), TRY_CAST(try_strptime(date, '%d.%m.%Y') AS DATE))"""

CLEAN = (
    DIRTY
    + f""", parsed AS (
  SELECT *, {DAY} AS day,
         CASE WHEN {DAY} IS NULL THEN 'unparseable date' WHEN customer_id IS NULL THEN 'missing customer id' END AS reason1
  FROM std WHERE NOT is_non_product),
 surface AS (
  SELECT lower(trim(category)) AS key, trim(category) AS spelling, row_number() OVER (
           PARTITION BY lower(trim(category)) ORDER BY count(*) DESC, trim(category)) AS place
  FROM parsed WHERE reason1 IS NULL AND category IS NOT NULL GROUP BY 1, 2),
 surface_pay AS (
  SELECT lower(trim(payment_method)) AS key, trim(payment_method) AS spelling, row_number() OVER (
           PARTITION BY lower(trim(payment_method)) ORDER BY count(*) DESC, trim(payment_method)) AS place
  FROM parsed WHERE reason1 IS NULL AND payment_method IS NOT NULL GROUP BY 1, 2),
 spelled AS (
  SELECT parsed.* EXCLUDE (category, payment_method), s.spelling AS category, sp.spelling AS payment_method FROM parsed
  LEFT JOIN surface s ON s.key = lower(trim(category)) AND s.place = 1
  LEFT JOIN surface_pay sp ON sp.key = lower(trim(payment_method)) AND sp.place = 1),
 dedup AS (
  SELECT *, CASE WHEN reason1 IS NULL AND row_number() OVER (
              PARTITION BY reason1, order_id, customer_id, day, product_id, product_name, category, quantity, unit_price,
                           discount, payment_method ORDER BY is_return) > 1 THEN 'exact duplicate row'
            ELSE reason1 END AS reason2 FROM spelled),
 qty_ok AS (
  SELECT *, CASE WHEN reason2 IS NULL AND NOT coalesce(CASE WHEN is_return THEN quantity < 0 ELSE quantity > 0 END, false)
                 THEN 'invalid quantity (zero / missing / negative but not a return)' ELSE reason2 END AS reason3
  FROM dedup),
 price_ok AS (
  SELECT *, CASE WHEN reason3 IS NULL AND NOT coalesce(unit_price > 0, false)
                 THEN 'invalid price (<= 0 or missing)' ELSE reason3 END AS reason
  FROM qty_ok),
 graded AS (
  SELECT *, CASE WHEN d < 0 OR d > 1 THEN 0 ELSE d END AS fixed_discount FROM (
    SELECT *, CASE WHEN discount > 1 AND discount <= 100 THEN discount / 100 ELSE discount END AS d FROM price_ok)),
 clean AS (
  SELECT order_id, customer_id, day AS date, product_id, product_name, category, quantity, unit_price,
         fixed_discount AS discount, payment_method, is_return,
         quantity * unit_price * (1 - fixed_discount) AS transaction_value
  FROM graded WHERE reason IS NULL)"""
)
