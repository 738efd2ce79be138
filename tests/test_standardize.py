import pytest
from conftest import SHOP
from pyspark.sql import functions as F

from staywise.config import merge
from staywise.errors import DatasetError
from staywise.functions.values import clean_id, number, parse_date
from staywise.operators import standardize


def _with(section, values):
    return merge(SHOP, {section: values})


@pytest.mark.parametrize("name", ["customer_id", "date", "quantity", "unit_price"])
def test_unmapped_required_field(shop, name):
    with pytest.raises(DatasetError, match=name):
        standardize.check_lines(_with("columns", {name: None}), shop.columns)


def test_order_id_or_transaction_id_is_required(shop):
    with pytest.raises(DatasetError, match="order_id"):
        standardize.check_lines(_with("columns", {"order_id": None}), shop.columns)


def test_absent_column_gets_a_suggestion(shop):
    with pytest.raises(DatasetError, match=r"'custt'.*\n?.*Did you mean.*cust"):
        standardize.check_lines(_with("columns", {"customer_id": "custt"}), shop.columns)


def test_mapping_and_unavailable_fields(spark, shop):
    out = standardize.standardize(shop, SHOP)
    row = out.lines.agg(F.count("payment_method"), F.max("discount"), F.count_if(F.col("is_return"))).first()
    assert row[0] == 0 and 0 < row[1] <= 0.1 and row[2] > 0
    assert not out.availability["payment_method"] and out.availability["category"]
    assert out.lines.where("is_return and quantity > 0").count() == 0
    assert out.customers.columns[0] == "customer_id" and not out.availability["customer_table"]
    assert "." not in out.lines.first()["customer_id"]
    mapping = {r["canonical_column"]: r["original_column"] for r in standardize.mapping_table(spark, SHOP).collect()}
    assert mapping["order_id"] == "inv" and mapping["payment_method"] == "(unavailable)"


def test_ids_numbers_and_dates(spark):
    texts = [" 12346.0 ", "12.50", "nan", "NULL", "", "A7", None, "1e3", "1d", "-3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(clean_id(F.col("t")), number(F.col("t"))).collect()
    assert [r[0] for r in got] == ["12346", "12.50", None, None, None, "A7", None, "1e3", "1d", "-3"]
    assert [r[1] for r in got] == [12346.0, 12.5, None, None, None, None, None, 1000.0, None, -3.0]
    whole = spark.createDataFrame([(13085.0,), (1.5,), (None,), (float("nan"),)], "t double")
    assert [r[0] for r in whole.select(clean_id(F.col("t"), whole.schema["t"].dataType)).collect()] == ["13085", "1.5", None, None]


@pytest.mark.parametrize(
    "text, dayfirst, expected",
    [
        ("2020-03-04", False, "2020-03-04"),
        ("2020-03-04T10:11:12.5Z", False, "2020-03-04"),
        ("2020-03-04 10:11+01:00", False, "2020-03-04"),
        ("20200304", False, "2020-03-04"),
        ("2020/3/4", False, "2020-03-04"),
        ("2020-03", False, "2020-03-01"),
        ("3/4/2020", False, "2020-03-04"),
        ("3/4/2020", True, "2020-04-03"),
        ("13/4/2020", False, "2020-04-13"),
        ("4/13/2020 9:05", True, "2020-04-13"),
        ("03.04.2020", False, "2020-04-03"),
        ("03-04-2020", False, "2020-04-03"),
        ("31/02/2020", True, None),
        ("2020-02-30", False, None),
        ("3/4/2020 25:00", False, None),
        ("not a date", False, None),
        ("2020-03-04 junk", False, None),
    ],
)
def test_date_formats(spark, text, dayfirst, expected):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(parse_date(F.col("t"), dayfirst=dayfirst).cast("string")).first()[0]
    assert found == expected


def test_configured_format_only(spark):
    df = spark.createDataFrame([("04.03.20",), ("2020-03-04",)], "t string")
    found = [r[0] for r in df.select(parse_date(F.col("t"), date_format="%d.%m.%y").cast("string")).collect()]
    assert found == ["2020-03-04", None]


def test_unknown_return_rule_and_missing_prefixes(shop):
    with pytest.raises(DatasetError, match="Unknown returns.method"):
        standardize.standardize(shop, _with("returns", {"method": "guess"}))
    with pytest.raises(DatasetError, match="prefixes"):
        standardize.standardize(shop, _with("returns", {"method": "id_prefix", "column": "inv", "prefixes": []}))
    with pytest.raises(DatasetError, match="not found"):
        standardize.standardize(shop, _with("returns", {"method": "flag_column", "column": "kindd"}))


def test_auto_rule_needs_a_common_prefix(spark):
    schema = "cust string, inv string, dt string, qty double, px double"
    cfg = {"customer_id": "cust", "order_id": "inv", "date": "dt", "quantity": "qty", "unit_price": "px"}
    base = merge(SHOP, {"columns": {**{k: None for k in SHOP["columns"]}, **cfg}, "returns": {"method": "auto", "column": None}})
    lettered = spark.createDataFrame([("1", "c1", "x", -1.0, 1.0), ("1", "C2", "x", -2.0, 1.0), ("1", "3", "x", 1.0, 1.0)], schema)
    plain = spark.createDataFrame([("1", "1", "x", -1.0, 1.0), ("1", "C2", "x", -2.0, 1.0)], schema)
    none = spark.createDataFrame([("1", "1", "x", 1.0, 1.0)], schema)
    used = [standardize.standardize(df, base).availability["return_rule"]["method_used"] for df in (lettered, plain, none)]
    assert used == ["id_prefix", "negative_quantity", "negative_quantity"]


def test_line_ids_depend_on_content_and_number_copies(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "b"), ("a", "b"), ("a", "b")], "x string, y string")
    tagged = df.withColumn("id", standardize.content_id(df))
    assert tagged.select("id").distinct().count() == 3
    assert sorted(r[0] for r in tagged.collect()[0:1]) == sorted(r[0] for r in tagged.repartition(3).where("y is null").collect())
    numbered = standardize.number_copies(tagged, "id")
    assert numbered.count() == 5 and numbered.select("id").distinct().count() == 5


def test_customer_table_and_returns_table(spark, shop):
    people = spark.createDataFrame([(1.0, 33, "Rome"), (2.0, None, None)], "id double, age int, city string")
    cfg = merge(SHOP, {"customer_columns": {"customer_id": "id", "customer_age": "age", "customer_location": "city"},
                       "returns": {"method": "none"}})
    back = shop.where("kind = 'REFUND'").select("cust", "inv", "dt", "qty", "px")
    out = standardize.standardize(shop.where("kind <> 'REFUND'"), cfg, people, back)
    assert out.availability["age"] and out.availability["location"] and not out.availability["gender"]
    refunds = out.lines.where("is_return")
    assert refunds.count() == back.count() > 0
    assert refunds.where("order_id not like 'R%' or quantity >= 0 or discount <> 0 or category is not null").count() == 0
