"""Binding of the star-schema tables (lineitem, orders, part, customer, nation) to the retail model.

``order_lines`` is a raw table with its own column names, so everything still goes through the configured mapping.
"""
from pyspark.sql import functions as F

from ..config import with_defaults

ORDER_LINES = with_defaults(
    {
        "name": "star",
        "columns": {
            "customer_id": "o_custkey",
            "order_id": "l_orderkey",
            "date": "o_orderdate",
            "product_id": "l_partkey",
            "product_name": "p_name",
            "category": "p_type",
            "quantity": "l_quantity",
            "unit_price": "unit_price",
            "discount": "l_discount",
        },
        "customer_columns": {"customer_id": "c_custkey", "customer_location": "n_name"},
        "returns": {"method": "flag_column", "column": "l_returnflag", "values": ["R"]},
    }
)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def order_lines(spark, folder):
    """lineitem with the customer and day of its order and the name and type of its part; join strategy left to Spark."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_quantity",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        "l_discount",
        "l_returnflag",
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .drop("o_orderkey", "p_partkey")
    )


def customers(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return people.join(nations, people.c_nationkey == nations.n_nationkey).select("c_custkey", "n_name")


# --- the same lines with defects, by deterministic expressions on the keys ------------------------------------------

DIRTY_LINES = with_defaults(
    {
        "name": "dirty",
        "columns": {
            "customer_id": "cust",
            "order_id": "inv",
            "date": "dt",
            "product_id": "sku",
            "product_name": "title",
            "category": "dept",
            "quantity": "qty",
            "unit_price": "px",
            "discount": "disc",
            "payment_method": "pay",
        },
        "dayfirst": True,
        "returns": {"method": "flag_column", "column": "kind", "values": ["r"]},
        "filters": {"exclude_product_ids": ["post"]},
    }
)


def dirty_lines(spark, folder):
    """Every kind of defect the cleaning handles, injected into the order lines (all columns as text)."""
    k, n, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    every = lambda m: k % m == 0
    returned = F.col("l_returnflag") == "R"
    day = (
        F.when(every(101), F.lit("not a date"))
        .when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k % 4 == 2, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    )
    customer = F.when(~every(53), F.when(every(59), "nan").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))))
    category = (
        F.when(k % 7 == 1, F.lower("p_type"))
        .when(k % 7 == 2, F.upper("p_type"))
        .when(k % 7 == 3, F.concat("p_type", F.lit(" ")))
        .otherwise(F.col("p_type"))
    )
    units = (
        F.when(every(97), 0).when(every(89) & ~returned, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    ).cast("bigint")
    cents = F.floor(F.col("unit_price") * 100).cast("bigint")
    price = F.when(every(71), "0").when(every(73), "n.a.").otherwise(F.concat(cents.cast("string"), F.lit("e-2")))
    discount = F.when(every(61), F.col("l_discount") * 100).otherwise(F.col("l_discount"))
    lines = order_lines(spark, folder).select(
        customer.alias("cust"),
        F.when(returned, F.concat(F.lit("C"), k.cast("string"))).otherwise(k.cast("string")).alias("inv"),
        day.alias("dt"),
        F.when(part % 113 == 0, "POST").otherwise(part.cast("string")).alias("sku"),
        F.col("p_name").alias("title"),
        category.alias("dept"),
        units.cast("string").alias("qty"),
        price.alias("px"),
        F.round(discount, 4).cast("decimal(18,4)").cast("string").alias("disc"),
        F.when(n % 3 == 0, "card").when(n % 3 == 1, " Card").otherwise("cash").alias("pay"),
        F.col("l_returnflag").alias("kind"),
        n.cast("string").alias("line_no"),
        k.alias("k"),
    )
    return lines.unionByName(lines.where(every_key(83))).drop("k")


def every_key(m):
    return F.col("k") % m == 0


EVENTS = with_defaults(
    {
        "name": "events",
        "columns": {
            "customer_id": "user_id",
            "transaction_id": "event_id",
            "date": "ts",
            "quantity": "units",
            "unit_price": "value",
        },
        "returns": {"method": "none"},
    }
)


def event_purchases(spark, folder):
    """Purchase events as a second schema: each event is its own order of one unit."""
    events = table(spark, folder, "events").where("event_type = 'purchase'")
    return events.select("user_id", "event_id", "ts", F.lit(1.0).alias("units"), "value")
