import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staywise.functions import stats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the rest spans signs and nine orders of magnitude."""
    rng = np.random.default_rng(5)
    values = np.where(np.arange(6000) % 3 == 0, 7.0, np.round(rng.lognormal(2, 3, 6000) * rng.choice([-1, 1], 6000), 3))
    pdf = pd.DataFrame({"id": np.arange(6000), "v": values, "g": np.where(np.arange(6000) % 5 < 3, "hot", "cold")})
    pdf.loc[::97, "v"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return pdf, sdf.repartition(7)


def test_percentile_rank_equals_pandas(skewed):
    pdf, sdf = skewed
    table = stats.cumdist(sdf, "v", buckets=16).withColumn("pct", stats.percentile_rank()).toPandas()
    expected = pdf.assign(pct=pdf.v.rank(pct=True)).dropna().drop_duplicates("v").set_index("v").pct
    got = table.set_index("key").pct
    assert len(got) == len(expected) and (got.sort_index() == expected.sort_index()).all()


def test_running_sums(skewed):
    pdf, sdf = skewed
    table = stats.cumdist(sdf, "v", {"ids": F.col("id")}, buckets=5).toPandas().sort_values("key")
    per_value = pdf.dropna().groupby("v").id.sum()
    assert (table.ids.to_numpy() == per_value.to_numpy()).all()
    assert (table.ids_before.to_numpy() == (per_value.cumsum() - per_value).to_numpy()).all()


@pytest.mark.parametrize("qs", [[0.5], [0.0, 0.01, 0.333, 0.999, 1.0]])
def test_quantiles_equal_pandas(skewed, qs):
    pdf, sdf = skewed
    found = stats.global_quantiles(sdf, ["v", "id"], qs)
    assert np.allclose(found["v"], pdf.v.quantile(qs), rtol=1e-12)
    assert np.allclose(found["id"], pdf.id.quantile(qs), rtol=1e-12)
    grouped = stats.exact_quantiles(sdf, ["v"], qs, by=["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(grouped.loc[g, [f"q{i}" for i in range(len(qs))]].astype(float), part.v.quantile(qs), rtol=1e-12)


def test_finer_cells_are_used_where_values_crowd(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW_ROWS", 10)
    crowded = spark.range(2000).select((F.lit(0.5) + F.col("id") * 1e-9).alias("v"))
    (found,) = stats.global_quantiles(crowded, ["v"], [0.25])["v"]
    assert abs(found - (0.5 + 0.25 * 1999 * 1e-9)) < 1e-15


def test_empty_and_constant(spark):
    none = spark.createDataFrame([], "v double")
    assert stats.global_quantiles(none, ["v"], [0.5]) == {"v": [None]}
    same = spark.range(50).select(F.lit(3.0).alias("v"))
    assert stats.global_quantiles(same, ["v"], [0.1, 0.9]) == {"v": [3.0, 3.0]}
    assert stats.rank_cuts(same, "v", [0.2, 0.8]) == [None, 3.0]


def test_quintiles_share_ties(skewed):
    pdf, sdf = skewed
    score = stats.score_from_cuts(F.col("v"), stats.rank_cuts(sdf, "v", [0.2, 0.4, 0.6, 0.8]))
    got = sdf.select("id", score.alias("s")).toPandas().set_index("id").s.sort_index()
    pct = pdf.v.rank(pct=True)
    expected = pd.cut(pct, [0, 0.2, 0.4, 0.6, 0.8, 1.0], labels=[1, 2, 3, 4, 5], include_lowest=True).astype(float)
    assert (got.dropna().to_numpy() == expected.dropna().to_numpy()).all() and got.isna().sum() == expected.isna().sum()


def test_global_positions(skewed):
    pdf, sdf = skewed
    got = stats.global_row_number(sdf, [F.col("v").desc_nulls_last(), "id"]).toPandas().sort_values("position")
    expected = pdf.sort_values(["v", "id"], ascending=[False, True], na_position="last")
    assert got.position.tolist() == list(range(1, 6001)) and got.id.tolist() == expected.id.tolist()


def test_deciles_and_examples_with_ties_equal_a_full_sort(spark):
    import random

    from staywise.operators import evaluate, explain

    rng = random.Random(2)
    for levels, n in ((3, 200), (40, 333), (1000, 97), (1, 30)):
        rows = [(f"c{rng.randrange(10**6)}-{i}", rng.randrange(2), rng.randrange(levels) / 7) for i in range(n)]
        df = spark.createDataFrame(rows, "customer_id string, y int, p double").repartition(4)
        ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
        expected = {}
        for place, (_, y, _) in enumerate(ordered):
            expected.setdefault(max(1, -(-(place * 10) // (n - 1))), []).append(y)
        got = {r["decile"]: (r["customers"], round(r["churn_rate"], 9)) for r in evaluate.decile_lift(df).collect()}
        assert got == {d: (len(v), round(sum(v) / len(v), 9)) for d, v in expected.items()}, levels
        up = sorted(rows, key=lambda r: (r[2], r[0]))
        texts = df.select("customer_id", F.lit("t").alias("text"))
        found = {r["example"]: r["customer_id"] for r in explain.example_customers(df, texts).collect()}
        assert found == {"highest risk": up[-1][0], "low risk": up[n // 10][0]}
    assert evaluate.decile_lift(df.where("false")).count() == 0 and explain.example_customers(df.where("false"), texts).count() == 0
