import itertools
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from staywise.config import with_defaults  # noqa: E402
from staywise.session import local_session  # noqa: E402
from staywise.sources import star  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

SHOP = with_defaults(
    {
        "name": "shop",
        "columns": {
            "customer_id": "cust",
            "order_id": "inv",
            "date": "dt",
            "product_id": "sku",
            "category": "dept",
            "quantity": "qty",
            "unit_price": "px",
            "discount": "disc_pct",
        },
        "date_format": "%d.%m.%Y",
        "discount": {"scale": "percent"},
        "returns": {"method": "flag_column", "column": "kind", "values": ["REFUND"]},
    }
)


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


@pytest.fixture(scope="session")
def shop(spark):
    """The bound lines in a third layout: other names, German dates, percent discounts, positive refunds."""
    lines = star.order_lines(spark, FOLDER)
    return lines.select(
        F.col("o_custkey").cast("double").alias("cust"),
        F.concat(F.when(F.col("l_returnflag") == "R", "R").otherwise("A"), F.col("l_orderkey")).alias("inv"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("dt"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("p_type").alias("dept"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("unit_price").alias("px"),
        (F.col("l_discount") * 100).alias("disc_pct"),
        F.when(F.col("l_returnflag") == "R", "REFUND").otherwise("SALE").alias("kind"),
    )


@pytest.fixture()
def folder(tmp_path_factory):
    counter = itertools.count()
    return lambda: str(tmp_path_factory.mktemp(f"d{next(counter)}"))
