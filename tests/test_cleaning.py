import pytest
from pyspark.sql import functions as F

from staywise.config import with_defaults
from staywise.operators import cleaning, standardize

CFG = with_defaults(
    {"columns": {"customer_id": "c", "order_id": "o", "date": "d", "product_id": "p", "category": "k", "quantity": "q",
                 "unit_price": "u", "discount": "x"}}
)
GOOD = [(f"c{i}", f"o{i}", "2020-01-%02d" % (i + 1), "p1", "Toys", "2", "10", "0") for i in range(8)]


def _clean(spark, rows, cfg=CFG):
    raw = spark.createDataFrame(rows, "c string, o string, d string, p string, k string, q string, u string, x string")
    return cleaning.clean(standardize.standardize(raw, cfg), cfg)


def _changed(**values):
    row = {"c": "z", "o": "oz", "d": "2020-02-01", "p": "p1", "k": "Toys", "q": "2", "u": "10", "x": "0"}
    return tuple({**row, **values}.values())


@pytest.mark.parametrize(
    "row, reason",
    [
        (_changed(c=None), cleaning.NO_CUSTOMER),
        (_changed(d="soon"), cleaning.BAD_DATE),
        (_changed(q="0"), cleaning.BAD_QUANTITY),
        (_changed(q="many"), cleaning.BAD_QUANTITY),
        (_changed(u="-1"), cleaning.BAD_PRICE),
        (_changed(u="free"), cleaning.BAD_PRICE),
        (GOOD[0], cleaning.DUPLICATE),
    ],
)
def test_each_defect_is_counted_once(spark, row, reason):
    out = _clean(spark, [*GOOD, row])
    account = out.account
    assert account["removed_by_reason"] == {reason: 1}
    assert account["rows_in"] == account["rows_out"] + account["rows_removed"] == 9
    assert out.lines.count() == account["rows_out"] == 8


def test_negative_quantity_without_a_matching_rule_is_removed_not_guessed(spark):
    cfg = with_defaults({**CFG, "returns": {"method": "none"}})
    out = _clean(spark, [*GOOD, _changed(q="-3")], cfg)
    assert out.account["removed_by_reason"] == {cleaning.BAD_QUANTITY: 1}
    log = {r["issue"]: r["rows_affected"] for r in out.log.collect()}
    assert log["Negative quantity not covered by the return rule"] == 1
    kept = _clean(spark, [*GOOD, _changed(q="-3")])
    assert kept.account["return_lines_kept"] == 1 and kept.lines.where("is_return").first()["transaction_value"] == -30.0


def test_discounts_and_spelling(spark):
    out = _clean(spark, [*GOOD, _changed(x="15", k=" toys"), _changed(o="o2z", x="150", k="TOYS ")])
    found = {r["order_id"]: (round(r["discount"], 6), r["category"]) for r in out.lines.collect()}
    assert found["oz"] == (0.15, "Toys") and found["o2z"] == (0.0, "Toys")


def test_duplicates_can_be_legitimate(spark):
    cfg = with_defaults({**CFG, "cleaning": {"drop_exact_duplicates": False}})
    assert _clean(spark, [*GOOD, GOOD[0]], cfg).lines.count() == 9


def test_price_imputed_from_the_product(spark):
    cfg = with_defaults({**CFG, "cleaning": {"nonpositive_price": "impute_product_median"}})
    rows = [*GOOD, _changed(u="20"), _changed(o="n1", u="0"), _changed(o="n2", u=None, p="p9")]
    out = _clean(spark, rows, cfg)
    assert out.account["removed_by_reason"] == {cleaning.NO_PRICE: 1}
    assert out.lines.where("order_id = 'n1'").first()["unit_price"] == 10.0


def test_repeated_ids_keep_one_and_missing_ids_count_as_equal(spark):
    cfg = with_defaults({**CFG, "columns": {**CFG["columns"], "transaction_id": "o", "order_id": "o"}})
    rows = [*GOOD, _changed(o="o1"), _changed(o=None), _changed(o=None, q="5")]
    out = _clean(spark, rows, cfg)
    assert out.account["removed_by_reason"] == {cleaning.REPEATED_ID: 2}
    assert out.account["rows_in"] == out.account["rows_out"] + 2 == 11


def test_registration_falls_back_to_first_purchase(spark):
    out = _clean(spark, GOOD)
    row = out.customers.where("customer_id = 'c3'").first()
    assert str(row["customer_registration_date"]) == "2020-01-04"
    assert (row["customer_gender"], row["customer_location"], row["customer_age"]) == ("Unknown", "Unknown", None)


def test_date_window_is_counted(spark):
    cfg = with_defaults({**CFG, "analysis": {"data_start": "2020-01-03"}})
    out = _clean(spark, GOOD, cfg)
    assert out.account["removed_by_reason"] == {cleaning.OUTSIDE_WINDOW: 2} and out.lines.count() == 6


def test_one_row_copied_into_a_third_of_the_table(spark):
    """Copies of one row are merged where they are read; the account still counts every one of them."""
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("c"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("o"),
        F.lit("2020-01-01").alias("d"), F.lit("p").alias("p"), F.lit("k").alias("k"), F.lit("1").alias("q"),
        F.lit("2.5").alias("u"), F.lit("0").alias("x"),
    )
    out = cleaning.clean(standardize.standardize(many, CFG), CFG)
    assert out.account["removed_by_reason"] == {cleaning.DUPLICATE: 9_999} and out.account["rows_out"] == 20_001


def test_kept_duplicates_have_ids_of_their_own(spark):
    cfg = with_defaults({**CFG, "cleaning": {"drop_exact_duplicates": False}})
    raw = spark.createDataFrame([*GOOD, GOOD[0], GOOD[0]], "c string, o string, d string, p string, k string, q string, u string, x string")
    lines = standardize.standardize(raw, cfg).lines
    assert lines.count() == 10 == lines.select("transaction_id").distinct().count()
    out = cleaning.clean(standardize.standardize(raw, cfg), cfg)
    assert out.lines.count() == 10 and out.account["rows_in"] == out.account["rows_out"] == 10


def test_of_repeated_customers_the_row_that_knows_more_stays(spark):
    rows = [("a", None, "30", "f", "X"), ("a", "2020-05-01", None, None, None), ("b", "2020-01-01", None, "m", "Y"), ("b", "2020-01-01", "40", None, None)]
    people = spark.createDataFrame(rows, "customer_id string, customer_registration_date string, customer_age string, customer_gender string, customer_location string")
    kept = {r["customer_id"]: r for r in cleaning.one_row_per_customer(people, {}).collect()}
    assert str(kept["a"]["customer_registration_date"]) == "2020-05-01" and kept["a"]["customer_age"] is None
    assert kept["b"]["customer_age"] == "40" and kept["b"]["customer_gender"] is None


def test_median_prices_in_one_map_and_split(spark, monkeypatch):
    prices = spark.range(4000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'many' ELSE concat('p', id % 5) END AS product_id", "double(id % 977) + 0.25 AS unit_price", "true AS alive"
    )
    expected = {r[0]: r[1] for r in prices.groupBy("product_id").agg(F.expr("percentile(unit_price, 0.5)")).collect()}
    assert {r["product_id"]: r["median"] for r in cleaning.median_prices(prices).collect()} == expected
    monkeypatch.setattr(cleaning, "PRICES_IN_ONE_MAP", 500)
    split = {r["product_id"]: r["median"] for r in cleaning.median_prices(prices).collect()}
    assert {k: round(v, 9) for k, v in split.items()} == {k: round(v, 9) for k, v in expected.items()}


def test_log_has_reasons_and_counts_from_the_write(spark):
    rows = [*GOOD, _changed(c=None), _changed(k=" toys"), _changed(o="big", u="99999")]
    out = _clean(spark, rows)
    log = {r["issue"]: r for r in out.log.collect()}
    assert all(r["decision"] and r["rationale"] for r in log.values())
    assert log["No customer"]["rows_affected"] == 1 and log["Spellings of category merged"]["rows_affected"] == 1
    assert log["Very large purchase"]["rows_affected"] == 1 and log["No registration date"]["rows_affected"] == 9
    assert [str(d) for d in out.span] == ["2020-01-01", "2020-02-01"]


def test_account_of_no_rows(spark):
    raw = spark.createDataFrame([], "c string, o string, d string, p string, k string, q string, u string, x string")
    standard = standardize.standardize(raw, CFG)
    out = cleaning.clean(standard, CFG)
    assert out.account["rows_in"] == out.account["rows_out"] == 0 and out.account["removed_by_reason"] == {}
    assert standard.facts["rows"] == 0 and standard.facts["return_share"] is None


def test_a_large_vocabulary_is_joined_with_the_missing_spread(spark, monkeypatch):
    from staywise.functions import values

    df = spark.createDataFrame([("Toys",), ("toys ",), ("Toys",), (None,), ("b",), (None,)], "category string").withColumn("n", F.monotonically_increasing_id())
    small = sorted(map(str, values.unify_spelling(df, ["category"]).collect()))
    monkeypatch.setattr(values, "SMALL_VOCABULARY", 0)
    assert sorted(map(str, values.unify_spelling(df, ["category"]).collect())) == small
    assert values.stored_spellings(df, ["category"])[2] == {"category": 1}
