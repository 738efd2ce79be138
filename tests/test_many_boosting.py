import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from staywise.operators import many_boosting, models

USED = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """2,400 rows at two cut-offs; ``b`` is missing in places, the label follows all three features."""
    number = lambda salt, m: f"pmod(xxhash64(id, {salt}), {m})"
    table = spark.range(2400).selectExpr(
        "cast(id AS string) AS customer_id", "date_add(date'2020-01-01', int(id % 2)) AS cutoff", f"double({number(1, 90)}) AS a",
        f"CASE WHEN {number(2, 5)} > 0 THEN double({number(3, 40)}) END AS b", f"double({number(4, 7)}) AS c", f"{number(5, 100)} AS noise",
    )
    return table.withColumn("churned", F.expr("int(a + 2 * coalesce(b, 60) + 5 * c + noise / 3 > 160)")).localCheckpoint()


def test_trees_are_those_of_sparks_classifier(spark, rows):
    grid = [(0.3, 3, 20), (0.3, 3, 90), (0.1, 2, 20)]
    pipeline = models.boosting_pipeline(rows, USED)
    found = many_boosting.fit_grid(rows, pipeline, grid, 6, models.TARGET)
    prepare, assembler = pipeline.getStages()[:2]
    scored = many_boosting.scores(found, prepare.transform(rows), assembler.getInputCols(), models.TARGET).toPandas()
    for i, (rate, depth, leaf) in enumerate(grid):
        expected = models.boosting_pipeline(rows, USED, rate, depth, leaf, 6).fit(rows)
        mine = found[i].model(spark)
        assert mine.stages[-1].treeWeights == expected.stages[-1].treeWeights
        both = models.probability(mine, rows).join(models.probability(expected, rows).withColumnRenamed("p", "q"), "customer_id").toPandas()
        assert len(both) == 2400 and np.allclose(both["p"], both["q"], atol=1e-9)
        assert np.allclose(np.sort(scored[f"p{i}"]), np.sort(both["p"]), atol=1e-9)


def test_stopping_keeps_the_best_trees_and_margins_are_written_on_the_way(spark, rows, monkeypatch):
    monkeypatch.setattr(many_boosting, "KEPT_EVERY", 3)
    noisy = rows.withColumn("churned", F.expr("int(pmod(xxhash64(customer_id, 9), 2))"))
    found = many_boosting.fit_grid(noisy, models.boosting_pipeline(noisy, USED), [(0.5, 4, 20), (0.05, 2, 400)], 12, models.TARGET)
    for boosted, (rate, depth, leaf) in zip(found, [(0.5, 4, 20), (0.05, 2, 400)], strict=True):
        expected = models.boosting_pipeline(noisy, USED, rate, depth, leaf, 12).fit(noisy).stages[-1]
        assert boosted.kept == len(expected.treeWeights) == len(boosted.model(spark).stages[-1].trees)


def test_rounds_cost_one_job_a_level_for_all_points(spark, rows):
    """F1 to F15: every point of the grid had jobs of its own in every round."""

    def jobs(rounds):
        context, name = spark.sparkContext, f"boosting of {rounds} rounds"
        context.setJobGroup(name, name)
        models.tune_boosting(rows, rows.where("cutoff = date'2020-01-01'"), USED, rounds=rounds, grid=[(r, 3, n) for r in (0.1, 0.3) for n in (20, 90)])
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(name))

    assert jobs(8) - jobs(3) <= 5 * 3


def test_edges_are_between_distinct_values():
    assert list(many_boosting.bin_edges(np.array([1.0, 1.0, 3.0, 7.0]), 63)) == [2.0, 5.0]
    assert len(many_boosting.bin_edges(np.array([5.0] * 9), 63)) == 0
    edges = many_boosting.bin_edges(np.arange(1000.0), 9)
    assert len(edges) == 9 and np.all(np.diff(edges) == 100)


def test_blocks_are_kept_as_they_are(spark, rows, monkeypatch):
    """F2 to F5, F13, F14: every job of a round unpacked all blocks, and every round packed them again."""
    levels, persist = [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda rdd, level: levels.append(level) or persist(rdd, level))
    many_boosting.fit_grid(rows, models.boosting_pipeline(rows, USED), [(0.3, 2, 20)], 2, models.TARGET)
    assert len(levels) == 3 and all(level.useMemory and level.useDisk and level.deserialized for level in levels)
