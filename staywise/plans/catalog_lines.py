"""Registered queries on order lines: sources, standardisation, cleaning, profiling, orders, named SQL."""
import copy

from pyspark.sql import functions as F

from ..config import merge
from ..functions.values import clean_id, parse_date
from ..operators import cleaning, orders as ordering, quality, reports, standardize
from ..schema import LINE_FIELDS
from ..session import shared_folder, stage, staged_path
from ..sources import star
from ..sources.tables import read_table
from . import named_queries
from .checks_sql import CLEAN, DAY, DIRTY, O, RAW, SCHEDULE, T
from .registry import register

# --- sources ---------------------------------------------------------------------------------------------------------


def _delimited_round_trip(ws, separator, suffix, **options):
    """Orders written as delimited files with two different headers, read back as one table."""
    import uuid

    root = f"{shared_folder(ws.spark).rstrip('/')}/delimited-{uuid.uuid4().hex[:10]}"
    table = ws.table("orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    paths = []
    for name, part in (("a", table.where("key % 2 = 0")), ("b", table.where("key % 2 = 1").drop("priority"))):
        paths.append(f"{root}/{name}.{suffix}")
        part.write.option("header", True).option("sep", separator).options(**options).csv(paths[-1])
    return read_table(ws.spark, paths)


_SPLIT_ORDERS = """SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status,
                   CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority FROM orders"""

register("s1_read_csv", "key:s status:s priority:s", lambda ws: _delimited_round_trip(ws, ",", "csv"), None, _SPLIT_ORDERS)
register(
    "s2_read_tsv_gz",
    "key:s status:s priority:s",
    lambda ws: _delimited_round_trip(ws, "\t", "tsv", compression="gzip"),
    None,
    _SPLIT_ORDERS,
)


def _mixed_round_trip(ws):
    """Orders in folders of CSV files with three headers, gzipped or not, with line breaks inside names and values."""
    root = staged_path(ws.spark, "mixed")
    note = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", end'))
    table = ws.table("orders").select(F.col("o_orderkey").cast("string").alias("the\nkey"), F.col("o_custkey").cast("string").alias("cust"), note.alias("note"))
    number = F.col("`the\nkey`").cast("bigint")
    parts = {
        "a.csv": table.where(number % 3 == 0),
        "deep/b.csv": table.where(number % 3 == 1).select("note", "the\nkey"),
        "deep/c.csv.gz": table.where(number % 3 == 2).select("cust", "the\nkey"),
    }
    for name, part in parts.items():
        part.write.options(header=True, escape='"', compression="gzip" if name.endswith("gz") else "none").csv(f"{root}/{name}")
    return read_table(ws.spark, [f"{root}/a.csv", f"{root}/deep"], {"multi_line": True}).withColumnRenamed("the\nkey", "key")


register(
    "s1_read_mixed_headers",
    "key:s cust:s note:s",
    _mixed_round_trip,
    None,
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 <> 1 THEN CAST(o_custkey AS VARCHAR) END AS cust,
         CASE WHEN o_orderkey % 3 <> 2 THEN o_orderpriority || chr(10) || '"' || o_orderstatus || '", end' END AS note FROM orders""",
)
register(
    "s3_read_parquet",
    "l_orderkey:i l_partkey:i l_quantity:4 l_extendedprice:4",
    lambda ws: read_table(ws.spark, [f"{ws.folder}/lineitem.parquet"]),
    None,
    "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem",
)

# --- standardisation -------------------------------------------------------------------------------------------------

_MAPPED = "order_id:s customer_id:s date:d product_id:s product_name:s category:s quantity:4 unit_price:8 discount:6"

register(
    "p3_column_mapping",
    _MAPPED,
    lambda ws: standardize.mapped_lines(ws.raw, star.ORDER_LINES)[0],
    T,
    "SELECT * FROM t",
)
register(
    "p4_clean_id",
    "inv:s raw:s customer_id:s",
    lambda ws: ws.dirty.select("inv", F.col("cust").alias("raw"), clean_id(F.col("cust")).alias("customer_id")),
    DIRTY,
    "SELECT inv, cust AS raw, customer_id FROM std",
)
register(
    "p5_numeric_coercion",
    "rows:i bad_numbers:i units:4 prices:4",
    lambda ws: ws.dirty_mapped.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("bad_numbers").alias("bad_numbers"),
        F.sum("quantity").alias("units"),
        F.sum("unit_price").alias("prices"),
    ),
    DIRTY,
    """SELECT count(*) AS rows, count(*) FILTER (px IS NOT NULL AND unit_price IS NULL)
         + count(*) FILTER (qty IS NOT NULL AND q0 IS NULL) AS bad_numbers,
         sum(quantity) AS units, sum(unit_price) AS prices FROM std""",
)


def _percent(ws):
    cfg = merge(star.DIRTY_LINES, {"discount": {"scale": "percent"}})
    return standardize.mapped_lines(ws.dirty, cfg)[0]


register(
    "p6_discount_scale",
    "order_id:s product_id:s discount:8",
    _percent,
    DIRTY,
    "SELECT order_id, product_id, discount / 100 AS discount FROM std",
)


def _order_fallback(ws):
    cfg = copy.deepcopy(star.DIRTY_LINES)
    cfg["columns"].update(order_id=None, transaction_id="inv")
    return standardize.mapped_lines(ws.dirty, cfg)[0]


register(
    "p7_order_id_fallback",
    "order_id:s transaction_id:s product_id:s",
    _order_fallback,
    DIRTY,
    "SELECT order_id, order_id AS transaction_id, product_id FROM std",
)
register(
    "p8_line_ids",
    "rows:i distinct_ids:i shortest:i",
    lambda ws: standardize.number_copies(
        ws.dirty.withColumn("transaction_id", standardize.content_id(ws.dirty)), "transaction_id"
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("transaction_id").alias("distinct_ids"),
        F.min(F.length("transaction_id")).alias("shortest"),
    ),
    DIRTY,
    "SELECT count(*) AS rows, count(*) AS distinct_ids, 35 AS shortest FROM dirty",
)
register(
    "p9_missing_optional_field",
    "payment_methods:i rows:i",
    lambda ws: standardize.mapped_lines(ws.raw, star.ORDER_LINES)[0].agg(
        F.count("payment_method").alias("payment_methods"), F.count(F.lit(1)).alias("rows")
    ),
    T,
    "SELECT 0 AS payment_methods, count(*) AS rows FROM t",
)


def _with_rule(ws, **rule):
    return standardize.mapped_lines(ws.dirty, merge(star.DIRTY_LINES, {"returns": rule}))[0]


_FLAGS = "order_id:s product_id:s quantity:4 is_return:b"


def _flag_sql(condition):
    return f"""SELECT order_id, product_id, CASE WHEN flag THEN -abs(q0) ELSE q0 END AS quantity, flag AS is_return
               FROM (SELECT *, coalesce({condition}, false) AS flag FROM std)"""


register(
    "p10_return_negative_quantity",
    _FLAGS,
    lambda ws: _with_rule(ws, method="negative_quantity"),
    DIRTY,
    _flag_sql("q0 < 0"),
)
register(
    "p11_return_id_prefix",
    _FLAGS,
    lambda ws: _with_rule(ws, method="id_prefix", column="inv", prefixes=["c"], require_negative_quantity=False),
    DIRTY,
    _flag_sql("upper(trim(inv)) LIKE 'C%'"),
)
register(
    "p12_return_flag_column",
    _FLAGS,
    lambda ws: _with_rule(ws, method="flag_column", column="kind", values=["A", "r"]),
    DIRTY,
    _flag_sql("lower(trim(kind)) IN ('a', 'r')"),
)
register("p13_return_none", _FLAGS, lambda ws: _with_rule(ws, method="none"), DIRTY, _flag_sql("false"))


def _negated(ws):
    """Returns with negative quantity, as a shop that books them that way would deliver them."""
    returned = F.col("kind") == "R"
    return ws.dirty.withColumn("qty", F.when(returned, F.concat(F.lit("-"), "qty")).otherwise(F.col("qty")))


register(
    "p14_return_auto",
    _FLAGS,
    lambda ws: standardize.mapped_lines(
        _negated(ws), merge(star.DIRTY_LINES, {"returns": {"method": "auto", "column": "inv"}})
    )[0],
    RAW
    + """, once AS (
  SELECT l_orderkey AS k, l_returnflag = 'R' AS back, CASE WHEN l_partkey % 113 = 0 THEN 'POST' ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
         CASE WHEN l_orderkey % 97 = 0 THEN 0 WHEN l_returnflag = 'R' OR l_orderkey % 89 = 0 THEN -l_quantity ELSE l_quantity END AS q
  FROM raw),
 neg AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE k % 83 = 0),
 pre AS (SELECT avg(CAST(back AS INT)) >= 0.8 AS by_prefix FROM neg WHERE q < 0)""",
    """SELECT CASE WHEN back THEN 'C' ELSE '' END || k AS order_id, product_id, q AS quantity,
         q < 0 AND (back OR NOT by_prefix) AS is_return FROM neg, pre""",
)
register(
    "p15_returned_quantity_sign",
    _FLAGS,
    lambda ws: ws.lines,
    T,
    "SELECT order_id, product_id, quantity, is_return FROM t",
)


def _separate_returns(ws):
    kept, back = ws.dirty.where("kind <> 'R'"), ws.dirty.where("kind = 'R'").drop("disc", "pay", "dept")
    cfg = merge(star.DIRTY_LINES, {"returns": {"method": "none"}, "filters": {"exclude_product_ids": []}})
    return standardize.standardize(kept, cfg, returns_raw=back).lines


register(
    "p16_separate_returns_table",
    "order_id:s customer_id:s product_id:s category:s quantity:4 discount:6 is_return:b",
    _separate_returns,
    DIRTY,
    """SELECT order_id, customer_id, product_id, category, q0 AS quantity, discount, false AS is_return
       FROM std WHERE kind <> 'R'
       UNION ALL SELECT 'R' || order_id, customer_id, product_id, NULL, -abs(q0), 0, true FROM std WHERE kind = 'R'""",
)
register(
    "p17_non_product_filter",
    "order_id:s product_id:s quantity:4",
    lambda ws: ws.dirty_standard,
    DIRTY,
    "SELECT order_id, product_id, quantity FROM std WHERE NOT is_non_product",
)
register(
    "p18_customer_projection",
    "customer_id:s customer_age:s customer_location:s",
    lambda ws: standardize.mapped_customers(star.customers(ws.spark, ws.folder), star.ORDER_LINES),
    None,
    """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, NULL AS customer_age, n_name AS customer_location
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
register(
    "p19_customers_from_lines",
    "customer_id:s",
    lambda ws: standardize.customers_from_lines(ws.dirty_standard),
    DIRTY,
    "SELECT DISTINCT customer_id FROM std WHERE customer_id IS NOT NULL AND NOT is_non_product",
)
register(
    "p20_availability",
    "registration_date:b age:b gender:b location:b",
    lambda ws: standardize.availability_table(
        ws.spark, standardize.standardize(ws.raw, star.ORDER_LINES, star.customers(ws.spark, ws.folder)).availability
    ),
    None,
    "SELECT 0 AS registration_date, 0 AS age, 0 AS gender, CAST(count(n_name) > 0 AS INT) AS location FROM customer JOIN nation ON c_nationkey = n_nationkey",
)

# --- cleaning --------------------------------------------------------------------------------------------------------


def _parsed(ws):
    return cleaning.parse_dates(ws.dirty_standard, star.DIRTY_LINES)


register(
    "c1_parse_dates",
    "inv:s raw:s day:d",
    lambda ws: ws.dirty.select("inv", F.col("dt").alias("raw"), parse_date(F.col("dt"), dayfirst=True).alias("day")),
    DIRTY,
    f"SELECT inv, dt AS raw, {DAY} AS day FROM std",
)
register(
    "c2_non_iso_dates",
    "rows:i non_iso:i",
    lambda ws: _parsed(ws).agg(F.count(F.lit(1)).alias("rows"), F.count_if("non_iso").alias("non_iso")),
    CLEAN,
    "SELECT count(*) AS rows, count(*) FILTER (day IS NOT NULL AND k % 4 IN (2, 3)) AS non_iso FROM parsed",
)
register(
    "c3_unparseable_dates",
    "reason:s rows:i",
    lambda ws: _parsed(ws).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows")
    ),
    CLEAN,
    "SELECT coalesce(reason1, 'kept') AS reason, count(*) AS rows FROM parsed GROUP BY 1",
)
register(
    "c4_lines_with_customer_and_date",
    "order_id:s customer_id:s date:d product_id:s",
    lambda ws: _parsed(ws).where("drop_reason is null"),
    CLEAN,
    "SELECT order_id, customer_id, day AS date, product_id FROM parsed WHERE reason1 IS NULL",
)
register(
    "c5_canonical_spelling",
    "order_id:s product_id:s category:s",
    lambda ws: cleaning.unify_lines(_parsed(ws), ["category"]).where("drop_reason is null"),
    RAW
    + """, once AS (
  SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey AS order_id,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CASE l_orderkey % 7 WHEN 1 THEN lower(p_type) WHEN 2 THEN upper(p_type) ELSE p_type END AS dept
  FROM raw WHERE l_partkey % 113 <> 0 AND l_orderkey % 101 <> 0 AND l_orderkey % 53 <> 0 AND l_orderkey % 59 <> 0),
 named AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE k % 83 = 0),
 counted AS (SELECT lower(dept) AS key, dept, count(*) AS n FROM named GROUP BY 1, 2),
 surface AS (SELECT key, arg_min(dept, (-n, dept)) AS category FROM counted GROUP BY key)""",
    "SELECT order_id, product_id, category FROM named JOIN surface ON key = lower(dept)",
)


def _deduplicated(ws):
    spelled = cleaning.unify_lines(_parsed(ws), ["category", "payment_method"])
    return cleaning.collapse_duplicates(spelled, [c for c in LINE_FIELDS if c != "transaction_id"])


_LINE = "order_id:s customer_id:s date:d product_id:s category:s payment_method:s quantity:4 unit_price:8 discount:6"

register(
    "c6_exact_duplicates",
    _LINE,
    lambda ws: _deduplicated(ws).where("drop_reason is null"),
    CLEAN,
    "SELECT * EXCLUDE (date), day AS date FROM dedup WHERE reason2 IS NULL",
)


def _one_per_id(ws):
    lines = _parsed(ws).withColumn("transaction_id", F.when(F.col("order_id").try_cast("bigint") % 5 != 0, F.col("order_id")))
    plain = lines.withColumn("copies", F.lit(1)).withColumn("non_iso_rows", F.lit(0)).drop("non_iso")
    return cleaning.collapse_repeated_ids(plain).where("drop_reason is null")


register(
    "c7_repeated_transaction_id",
    "transaction_id:s repeated:i",
    _one_per_id,
    CLEAN,
    """SELECT CASE WHEN TRY_CAST(order_id AS BIGINT) % 5 <> 0 THEN order_id END AS transaction_id, count(*) - 1 AS repeated
       FROM parsed WHERE reason1 IS NULL GROUP BY 1""",
)
register(
    "c8_invalid_quantity",
    "order_id:s product_id:s quantity:4 is_return:b valid:b",
    lambda ws: ws.dirty_standard.withColumn("valid", cleaning.quantity_ok()),
    DIRTY,
    """SELECT order_id, product_id, quantity, is_return,
         coalesce(CASE WHEN is_return THEN quantity < 0 ELSE quantity > 0 END, false) AS valid
       FROM std WHERE NOT is_non_product""",
)
register(
    "c9_price_drop",
    "order_id:s product_id:s unit_price:8",
    lambda ws: ws.dirty_standard.where(cleaning.price_ok()),
    DIRTY,
    "SELECT order_id, product_id, unit_price FROM std WHERE NOT is_non_product AND unit_price > 0",
)
register(
    "c10_price_impute_product_median",
    "order_id:s product_id:s unit_price:8 price_imputed:b",
    lambda ws: cleaning.impute_prices(ws.dirty_standard).where(cleaning.price_ok()),
    DIRTY
    + """, med AS (SELECT product_id, quantile_cont(unit_price, 0.5) AS m FROM std
                   WHERE NOT is_non_product AND unit_price > 0 GROUP BY product_id)""",
    """SELECT order_id, product_id, unit_price, false AS price_imputed FROM std WHERE NOT is_non_product AND unit_price > 0
       UNION ALL SELECT order_id, product_id, m, true FROM std JOIN med USING (product_id)
       WHERE NOT is_non_product AND NOT coalesce(unit_price > 0, false)""",
)
register(
    "c11_discount_repair",
    "order_id:s product_id:s raw:6 discount:8 scaled:b",
    lambda ws: ws.dirty_standard.select(
        "order_id",
        "product_id",
        F.col("discount").alias("raw"),
        cleaning.percent_discount().alias("scaled"),
        cleaning.fixed_discount().alias("discount"),
    ),
    DIRTY,
    """SELECT order_id, product_id, raw, scaled, CASE WHEN d < 0 OR d > 1 THEN 0 ELSE d END AS discount FROM (
         SELECT order_id, product_id, discount AS raw, discount > 1 AND discount <= 100 AS scaled,
                CASE WHEN discount > 1 AND discount <= 100 THEN discount / 100 ELSE discount END AS d
         FROM std WHERE NOT is_non_product)""",
)
register(
    "c12_transaction_value",
    "order_id:s product_id:s transaction_value:6",
    lambda ws: ws.lines,
    T,
    "SELECT order_id, product_id, transaction_value FROM t",
)
register(
    "c13_suspicious_value",
    "order_id:s product_id:s transaction_value:6 suspicious_value:b",
    lambda ws: cleaning.flag_suspicious(ws.lines),
    T + ", cut AS (SELECT quantile_cont(transaction_value, 0.999) AS q FROM t WHERE NOT is_return)",
    """SELECT order_id, product_id, transaction_value, NOT is_return AND transaction_value > q AS suspicious_value
       FROM t, cut""",
)


def _people(ws):
    """Customer records with defects: repeated ids, impossible ages, gender and place spellings, two date formats."""
    k = F.col("c_custkey")
    base = ws.table("customer").join(ws.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.when(k % 5 == 0, F.upper("n_name")).when(k % 5 == 1, F.concat(F.lit(" "), F.lower("n_name"))).when(
        k % 5 != 2, F.col("n_name")
    )
    joined = F.date_add(F.lit("1994-01-01").cast("date"), (k % 900).cast("int"))
    one = base.select(
        k.cast("string").alias("customer_id"),
        F.when(k % 11 != 0, F.when(k % 2 == 0, F.date_format(joined, "yyyy-MM-dd")).otherwise(F.date_format(joined, "dd/MM/yyyy"))).alias(
            "customer_registration_date"
        ),
        F.when(k % 9 != 0, (k % 120).cast("string")).alias("customer_age"),
        F.when(k % 4 == 0, "F").when(k % 4 == 1, " male").when(k % 4 == 2, "Other").alias("customer_gender"),
        place.alias("customer_location"),
        k.alias("k"),
    )
    k = F.col("k")
    again = one.where("k % 13 = 0").withColumn("customer_age", F.lit("999"))
    poorer = again.withColumn("customer_registration_date", F.when(k % 2 == 0, F.col("customer_registration_date")))
    return one.unionByName(poorer.withColumn("customer_gender", F.when(k % 3 == 0, F.col("customer_gender")))).where("k % 17 <> 0").drop("k")


_CUST = (
    O
    + """, base AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c_custkey % 11 <> 0 THEN DATE '1994-01-01' + CAST(c_custkey % 900 AS INTEGER) END AS registered,
         CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 120 END AS age,
         CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN ' male' WHEN 2 THEN 'Other' END AS gender,
         CASE c_custkey % 5 WHEN 0 THEN upper(n_name) WHEN 1 THEN ' ' || lower(n_name) WHEN 2 THEN NULL ELSE n_name END AS place
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 17 <> 0),
 listed AS (
  SELECT k, customer_id, registered, age, gender, place FROM base),
 added AS (
  SELECT customer_id, registered, age, gender, place FROM listed
  UNION ALL SELECT DISTINCT customer_id, CAST(NULL AS DATE), CAST(NULL AS BIGINT), NULL, NULL FROM t
            WHERE customer_id NOT IN (SELECT customer_id FROM listed)),
 first AS (SELECT customer_id, min(date) AS first_day FROM t WHERE NOT is_return GROUP BY customer_id)"""
)


_DAYFIRST = {"date_format": None, "dayfirst": True}


def _listed(ws):
    return cleaning.one_row_per_customer(_people(ws), _DAYFIRST)


register(
    "c14_customer_per_id",
    "customer_id:s customer_registration_date:d customer_gender:s",
    _listed,
    _CUST,
    "SELECT customer_id, registered AS customer_registration_date, gender AS customer_gender FROM listed",
)
register(
    "c15_add_unlisted_customers",
    "customer_id:s customer_registration_date:d",
    lambda ws: cleaning.add_unlisted_customers(_listed(ws), ws.lines),
    _CUST,
    "SELECT customer_id, registered AS customer_registration_date FROM added",
)
register(
    "c16_fill_registration",
    "customer_id:s customer_registration_date:d registration_filled:b",
    lambda ws: cleaning.fill_registration(cleaning.add_unlisted_customers(_listed(ws), ws.lines), ws.lines),
    _CUST,
    """SELECT customer_id, coalesce(registered, first_day) AS customer_registration_date,
         registered IS NULL AS registration_filled FROM added LEFT JOIN first USING (customer_id)""",
)
register(
    "c17_plausible_age",
    "customer_id:s customer_age:2",
    lambda ws: _people(ws).select("customer_id", cleaning.plausible_age(F.col("customer_age")).alias("customer_age")),
    _CUST,
    """SELECT customer_id, CASE WHEN age BETWEEN 16 AND 100 THEN age END AS customer_age FROM listed
       UNION ALL SELECT customer_id, NULL FROM listed WHERE k % 13 = 0""",
)
register(
    "c18_gender_label",
    "customer_id:s customer_gender:s",
    lambda ws: _listed(ws).select("customer_id", cleaning.gender_label(F.col("customer_gender")).alias("customer_gender")),
    _CUST,
    """SELECT customer_id, CASE lower(trim(gender)) WHEN 'f' THEN 'Female' WHEN 'female' THEN 'Female' WHEN 'm' THEN 'Male'
         WHEN 'male' THEN 'Male' ELSE 'Unknown' END AS customer_gender FROM listed""",
)
register(
    "c19_location_spelling",
    "customer_id:s customer_location:s",
    lambda ws: cleaning.locations(_listed(ws)),
    _CUST
    + """, spelled AS (SELECT lower(trim(place)) AS key, trim(place) AS spelling, row_number() OVER (
            PARTITION BY lower(trim(place)) ORDER BY count(*) DESC, trim(place)) AS rank
          FROM listed WHERE place IS NOT NULL GROUP BY 1, 2)""",
    """SELECT customer_id, coalesce(spelling, 'Unknown') AS customer_location FROM listed
       LEFT JOIN spelled ON key = lower(trim(place)) AND rank = 1""",
)
register(
    "c20_before_registration",
    "before_registration:i",
    lambda ws: cleaning.before_registration(
        ws.lines, cleaning.fill_registration(cleaning.add_unlisted_customers(_listed(ws), ws.lines), ws.lines)
    ),
    _CUST,
    """SELECT count(*) AS before_registration FROM t JOIN added USING (customer_id) LEFT JOIN first USING (customer_id)
       WHERE date < coalesce(registered, first_day)""",
)
register(
    "c21_row_account",
    "reason:s rows:i",
    lambda ws: cleaning.account_table(ws.spark, ws.dirty_account[1]),
    CLEAN,
    "SELECT coalesce(reason, 'kept') AS reason, count(*) AS rows FROM graded GROUP BY 1",
)


def _log(ws):
    """The cleaning log of the lines with defects, and of customers of whom every seventeenth is not listed."""
    standard = standardize.standardize(ws.dirty, star.DIRTY_LINES)
    people = {"customer_table": True, **{label: True for label in ("registration_date", "age", "gender", "location")}}
    standard.customers, standard.availability = _people(ws), {**standard.availability, **people}
    return cleaning.clean(standard, {**star.DIRTY_LINES, **_DAYFIRST}).log


_COUNT = lambda issue, condition, table="graded": f"SELECT '{issue}' AS issue, count(*) AS rows_affected FROM {table} WHERE {condition}"
_MERGED = lambda column, table: (
    f"SELECT 'Spellings of {column} merged' AS issue, count(DISTINCT key || '/' || spelling) - count(DISTINCT key) AS rows_affected FROM {table}"
)
register(
    "c21_cleaning_log",
    "issue:s rows_affected:i explained:b",
    lambda ws: _log(ws).withColumn("explained", (F.length("decision") > 0) & (F.length("rationale") > 0)),
    CLEAN
    + """, listed AS (
  SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c_custkey % 11 <> 0 THEN DATE '1994-01-01' + CAST(c_custkey % 900 AS INTEGER) END AS registered,
         CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 120 WHEN c_custkey % 13 = 0 AND (c_custkey % 2 = 0 OR c_custkey % 11 = 0) THEN 999 END AS age,
         c_custkey % 4 < 2 AS known_gender, CASE c_custkey % 5 WHEN 0 THEN upper(n_name) WHEN 1 THEN lower(n_name) WHEN 2 THEN NULL ELSE n_name END AS place
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 17 <> 0),
 buyers AS (SELECT customer_id, min(date) FILTER (NOT is_return) AS first_day FROM clean GROUP BY customer_id),
 everyone AS (
  SELECT customer_id, coalesce(registered, first_day) AS registered, registered IS NULL AS filled, age, known_gender, place,
         listed.customer_id IS NULL AS unlisted FROM listed FULL JOIN buyers USING (customer_id)),
 places AS (SELECT lower(place) AS key, place AS spelling FROM listed WHERE place IS NOT NULL),
 large AS (SELECT quantile_cont(transaction_value, 0.999) AS q FROM clean WHERE NOT is_return)""",
    "SELECT *, 1 AS explained FROM ("
    + " UNION ALL ".join(
        [
            _COUNT("Dates not in ISO form", "day IS NOT NULL AND k % 4 IN (2, 3)"),
            _COUNT("No date can be read", "reason = 'unparseable date'"),
            _COUNT("No customer", "reason = 'missing customer id'"),
            _MERGED("category", "surface"),
            _MERGED("payment_method", "surface_pay"),
            _COUNT("Copies of a row", "reason = 'exact duplicate row'"),
            _COUNT("Return lines", "is_return", "clean"),
            _COUNT("Quantity of no sale", "reason LIKE 'invalid quantity%'"),
            _COUNT("Negative quantity not covered by the return rule", "reason LIKE 'invalid quantity%' AND quantity < 0 AND NOT is_return"),
            _COUNT("No price above zero", "reason LIKE 'invalid price%'"),
            _COUNT("Line id used again for other content", "false"),
            _COUNT("Price filled in", "false"),
            _COUNT("No price for the product at all", "false"),
            _COUNT("Discount out of range", "reason IS NULL AND (discount < 0 OR discount > 100)"),
            _COUNT("Discount given in percent", "reason IS NULL AND discount > 1 AND discount <= 100"),
            _COUNT("Very large purchase", "NOT is_return AND transaction_value > q", "clean, large"),
            _COUNT("Customer in the lines only", "unlisted", "everyone"),
            _COUNT("No registration date", "filled", "everyone"),
            _COUNT("Age out of range", "age IS NOT NULL AND age NOT BETWEEN 16 AND 100", "everyone"),
            _COUNT("No age", "age IS NULL OR age NOT BETWEEN 16 AND 100", "everyone"),
            _COUNT("Gender spelled differently or missing", "true", "everyone"),
            _MERGED("customer_location", "places"),
            _COUNT("No location", "place IS NULL", "everyone"),
            _COUNT("Purchases before registration", "date < registered", "clean JOIN everyone USING (customer_id)"),
        ]
    )
    + ")",
)
register(
    "c21_clean_lines",
    _LINE + " transaction_value:6 is_return:b",
    lambda ws: cleaning.kept_lines(ws.dirty_graded),
    CLEAN,
    "SELECT * FROM clean",
)
register(
    "c22_date_window",
    "kept:i outside:i",
    lambda ws: ws.lines.agg(
        F.count_if(cleaning.date_window("1996-01-01", "1999-12-31")).alias("kept"),
        F.count_if(~cleaning.date_window("1996-01-01", "1999-12-31")).alias("outside"),
    ),
    T,
    """SELECT count(*) FILTER (date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS kept,
         count(*) FILTER (NOT date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS outside FROM t""",
)

# --- profile ---------------------------------------------------------------------------------------------------------

register(
    "q1_table_shapes",
    "table:s rows:i columns:i",
    lambda ws: quality.table_shapes(lines=ws.dirty_standard, customers=_people(ws)),
    DIRTY,
    """SELECT 'lines' AS table, count(*) AS rows, 12 AS columns FROM std WHERE NOT is_non_product
       UNION ALL SELECT 'customers', count(*) + count(*) FILTER (c_custkey % 13 = 0), 5
       FROM customer WHERE c_custkey % 17 <> 0""",
)
_PROFILE = ["customer_id", "order_id", "date", "product_id", "category", "quantity", "unit_price", "discount", "payment_method"]
register(
    "q2_column_profile",
    "column:s type:s missing:i missing_pct:2 n_unique:i",
    lambda ws: quality.column_profile(ws.dirty_stored.lines.select(*_PROFILE)),
    DIRTY,
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{'double' if c in ('quantity', 'unit_price', 'discount') else 'string'}' AS type,
             count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct,
             count(DISTINCT {c}) AS n_unique FROM std WHERE NOT is_non_product"""
        for c in _PROFILE
    ),
)
_ISSUES = {
    "rows without customer id": "customer_id IS NULL",
    "dates that could not be parsed": f"{DAY} IS NULL",
    "returns / cancellations (per configured rule)": "is_return",
    "negative quantity NOT flagged as return": "quantity < 0 AND NOT is_return",
    "zero or missing quantity": "coalesce(quantity, 0) = 0",
    "unit_price <= 0 or missing": "coalesce(unit_price, 0) <= 0",
    "discount outside [0, 1]": "discount < 0 OR discount > 1",
}
register(
    "q3_issue_counts",
    "issue:s count:i",
    lambda ws: quality.line_issues(ws.dirty_standard, star.DIRTY_LINES),
    DIRTY,
    " UNION ALL ".join(
        f"SELECT '{name}' AS issue, count(*) FILTER ({rule}) AS count FROM std WHERE NOT is_non_product"
        for name, rule in _ISSUES.items()
    )
    + """ UNION ALL SELECT 'exact duplicate rows', sum(n - 1) FROM (SELECT count(*) AS n FROM std WHERE NOT is_non_product
          GROUP BY order_id, customer_id, date, product_id, product_name, category, quantity, unit_price, discount, payment_method)""",
)
register(
    "q3_age_issues",
    "issue:s count:i",
    lambda ws: quality.age_issues(_people(ws)),
    _CUST + ", ages AS (SELECT age FROM listed UNION ALL SELECT 999 FROM listed WHERE k % 13 = 0)",
    """SELECT 'impossible ages (<16 or >100)' AS issue, count(*) FILTER (age < 16 OR age > 100) AS count FROM ages
       UNION ALL SELECT 'missing ages', count(*) FILTER (age IS NULL) FROM ages""",
)
register(
    "q4_category_spellings",
    "raw_spellings:i normalised:i",
    lambda ws: quality.spellings(ws.dirty_standard),
    DIRTY,
    """SELECT count(DISTINCT category) AS raw_spellings, count(DISTINCT lower(trim(category))) AS normalised
       FROM std WHERE NOT is_non_product""",
)
register(
    "q6_line_facts",
    "rows:i return_share:6 missing_customer_id:6 missing_unit_price:8 missing_date:6",
    lambda ws: quality.facts_row(ws.spark, ws.dirty_stored.facts),
    DIRTY,
    """SELECT count(*) AS rows, avg(CAST(is_return AS INT)) AS return_share,
         100.0 * avg(CAST(customer_id IS NULL AS INT)) AS missing_customer_id,
         100.0 * avg(CAST(unit_price IS NULL AS INT)) AS missing_unit_price,
         100.0 * avg(CAST(date IS NULL AS INT)) AS missing_date FROM std WHERE NOT is_non_product""",
)
register(
    "q9_date_range",
    "data_start:d data_end:d history_days:i",
    lambda ws: quality.date_range(ws.lines),
    T,
    "SELECT min(date) AS data_start, max(date) AS data_end, date_diff('day', min(date), max(date)) AS history_days FROM t",
)

# --- orders and the churn window -------------------------------------------------------------------------------------

register(
    "f1_build_orders",
    "order_id:s customer_id:s order_date:d order_value:4 n_lines:i n_units:4 n_categories:i discount:6 has_discount:b",
    lambda ws: ws.orders,
    O,
    "SELECT * FROM o",
)
register(
    "f2_interpurchase_gaps",
    "customer_id:s order_date:d gap:i",
    lambda ws: ws.gaps,
    O,
    "SELECT * FROM gaps",
)
register(
    "f3_choose_churn_window",
    "window_days:i n_gaps:i p50:4 p75:4 p90:4 p95:4 p99:4",
    lambda ws: ordering.churn_window_table(ws.gaps),
    O,
    """SELECT h AS window_days, count(*) AS n_gaps, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.75) AS p75,
         quantile_cont(gap, 0.9) AS p90, quantile_cont(gap, 0.95) AS p95, quantile_cont(gap, 0.99) AS p99
       FROM gaps, h GROUP BY h""",
)
register(
    "f8_cutoff_schedule",
    "split:s cutoff:d",
    lambda ws: ordering.cutoff_table(ws.lines.select(F.col("date").alias("order_date")), ws.window),
    O + SCHEDULE,
    "SELECT split, cutoff FROM splits",
)

# --- reports on lines and orders -------------------------------------------------------------------------------------

_MONTHLY = (
    O
    + """, money AS (
  SELECT date_trunc('month', date) AS month, coalesce(sum(transaction_value) FILTER (NOT is_return), 0) AS gross_revenue,
         coalesce(-sum(transaction_value) FILTER (is_return), 0) AS returns FROM t GROUP BY 1),
 activity AS (
  SELECT date_trunc('month', order_date) AS month, count(*) AS orders, count(DISTINCT customer_id) AS active_customers
  FROM o GROUP BY 1),
 monthly AS (
  SELECT coalesce(m.month, a.month) AS month, coalesce(gross_revenue, 0) AS gross_revenue, coalesce(returns, 0) AS returns,
         coalesce(orders, 0) AS orders, coalesce(active_customers, 0) AS active_customers,
         coalesce(gross_revenue, 0) - coalesce(returns, 0) AS net_revenue,
         gross_revenue / nullif(orders, 0) AS aov
  FROM money m FULL JOIN activity a ON m.month = a.month)"""
)
register(
    "d1_monthly_summary",
    "month:d gross_revenue:4 returns:4 orders:i active_customers:i net_revenue:4 aov:4",
    lambda ws: reports.monthly_summary(ws.lines, ws.orders),
    _MONTHLY,
    "SELECT * FROM monthly",
)
register(
    "d31_month_highlights",
    "first_month:d first_revenue:4 last_month:d last_revenue:4 best_month:d best_revenue:4",
    lambda ws: reports.month_highlights(reports.monthly_summary(ws.lines, ws.orders)),
    _MONTHLY,
    """SELECT min(month) AS first_month, arg_min(net_revenue, month) AS first_revenue, max(month) AS last_month,
         arg_max(net_revenue, month) AS last_revenue, arg_max(month, net_revenue) AS best_month,
         max(net_revenue) AS best_revenue FROM monthly""",
)
_GAP_HIST = ", span2 AS (SELECT min(gap) AS low, max(gap) AS high FROM gaps WHERE gap <= 300)"
register(
    "d3_gap_histogram",
    "bin:i n:i bin_start:4",
    lambda ws: reports.gap_histogram(ws.gaps),
    O + _GAP_HIST,
    """SELECT bin, count(*) AS n, any_value(low + bin * (high - low) / 60) AS bin_start FROM (
         SELECT least(floor((gap - low) / ((high - low) / 60)), 59) AS bin, low, high FROM gaps, span2 WHERE gap <= 300)
       GROUP BY bin""",
)
register(
    "d4_category_revenue",
    "category:s revenue:4",
    lambda ws: reports.category_revenue(ws.lines),
    T,
    "SELECT category, sum(transaction_value) AS revenue FROM t WHERE NOT is_return GROUP BY category",
)
register(
    "d5_cohort_retention",
    "cohort:d k:i size:i retention:6",
    lambda ws: reports.cohort_retention(ws.orders, minimum=5),
    O
    + """, m AS (SELECT DISTINCT customer_id, date_trunc('month', order_date) AS m FROM o),
     ch AS (SELECT customer_id, min(m) AS cohort FROM m GROUP BY customer_id),
     sz AS (SELECT cohort, count(*) AS size FROM ch GROUP BY cohort HAVING count(*) >= 5),
     grid AS (SELECT cohort, size, unnest(range(13)) AS k FROM sz)""",
    """SELECT cohort, k, size, CASE WHEN cohort + to_months(CAST(k AS INTEGER)) <= (SELECT max(m) FROM m) THEN nullif((
           SELECT count(*) FROM ch JOIN m USING (customer_id)
           WHERE ch.cohort = grid.cohort AND date_diff('month', ch.cohort, m.m) = grid.k), 0) END / size AS retention
       FROM grid""",
)
register(
    "d16_return_flags",
    "kind:s rows:i",
    lambda ws: reports.return_flags(ws.dirty_standard),
    DIRTY,
    """SELECT CASE WHEN is_return THEN 'flagged' ELSE 'not flagged' END AS kind, count(*) AS rows
       FROM std WHERE NOT is_non_product AND quantity < 0 GROUP BY 1""",
)
_SPREAD = (
    DIRTY
    + """, spread AS (SELECT product_id, quantile_cont(unit_price, 0.5) AS median_price, stddev_samp(unit_price) AS price_std
                      FROM std WHERE NOT is_non_product AND unit_price > 0 GROUP BY product_id)"""
)
register(
    "d17_price_spread",
    "product_id:s median_price:5 price_std:4",
    lambda ws: reports.price_spread(ws.dirty_standard),
    _SPREAD,
    "SELECT * FROM spread",
)
register(
    "d17_price_spread_summary",
    "count:i mean:4 std:4 min:4 max:4 p25:4 p50:4 p75:4",
    lambda ws: reports.describe(stage(reports.price_spread(ws.dirty_standard), "price-spread"), "price_std"),
    _SPREAD,
    """SELECT count(price_std) AS count, avg(price_std) AS mean, stddev_samp(price_std) AS std, min(price_std) AS min,
         max(price_std) AS max, quantile_cont(price_std, 0.25) AS p25, quantile_cont(price_std, 0.5) AS p50,
         quantile_cont(price_std, 0.75) AS p75 FROM spread""",
)
_ONE = "customer_id = (SELECT min(customer_id) FROM t)"


def _one_customer(ws):
    return ws.keyed_lines.agg(F.min("customer_id")).first()[0]


register(
    "d28_customer_history",
    "order_id:s date:d product_id:s quantity:4 transaction_value:6",
    lambda ws: reports.customer_history(ws.keyed_lines, _one_customer(ws)),
    T,
    f"SELECT order_id, date, product_id, quantity, transaction_value FROM t WHERE {_ONE}",
)
register(
    "d28_customer_months",
    "month:d spend:4",
    lambda ws: reports.customer_months(ws.keyed_lines, _one_customer(ws)),
    T,
    f"""SELECT date_trunc('month', date) AS month, sum(transaction_value) AS spend FROM t
        WHERE NOT is_return AND {_ONE} GROUP BY 1""",
)

# --- named SQL -------------------------------------------------------------------------------------------------------


def _named(name):
    def build(ws):
        named_queries.register(ws.lines)
        return named_queries.run(ws.spark, name)

    return build


register(
    "l1_monthly_revenue",
    "month:s net_revenue:0 orders:i",
    _named("monthly_revenue"),
    T,
    """SELECT strftime(date, '%Y-%m') AS month, round(sum(transaction_value), 0) AS net_revenue,
         count(DISTINCT CASE WHEN NOT is_return THEN order_id END) AS orders FROM t GROUP BY 1""",
)
register(
    "l2_top_10_customers_by_spend",
    "customer_id:s net_spend:0 orders:i",
    _named("top_10_customers_by_spend"),
    T,
    """SELECT customer_id, round(sum(transaction_value), 0) AS net_spend,
         count(DISTINCT CASE WHEN NOT is_return THEN order_id END) AS orders
       FROM t GROUP BY customer_id ORDER BY net_spend DESC, customer_id LIMIT 10""",
)
_BUYERS = T + ", buyers AS (SELECT customer_id, count(DISTINCT order_id) AS n FROM t WHERE NOT is_return GROUP BY 1)"
register(
    "l3_repeat_purchase_rate",
    "customers:i repeat_customers:i repeat_rate_pct:1",
    _named("repeat_purchase_rate"),
    _BUYERS,
    """SELECT count(*) AS customers, count(*) FILTER (n >= 2) AS repeat_customers,
         round(100.0 * count(*) FILTER (n >= 2) / count(*), 1) AS repeat_rate_pct FROM buyers""",
)
register(
    "l4_purchase_frequency_distribution",
    "orders_bucket:s customers:i",
    _named("purchase_frequency_distribution"),
    _BUYERS,
    """SELECT CASE WHEN n >= 10 THEN '10+' ELSE CAST(n AS VARCHAR) END AS orders_bucket, count(*) AS customers
       FROM buyers GROUP BY 1""",
)
