import inspect
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from staywise.operators import cluster, evaluate, explain, features as feats, many_kmeans, models, value
from staywise.plans.workspace import workspace

USED = ["recency_days", "frequency", "monetary", "gap_std_days", "orders_90d"]
GRID = [(0.1, 2, 40), (0.1, 3, 40)]


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, FOLDER)


@pytest.fixture(scope="module")
def chosen(ws):
    return models.select_model(ws.split("train"), ws.split("validation"), USED, rounds=4, grid=GRID, parallel=2)


def test_selection_is_the_best_validation_metric(chosen):
    best = max(chosen.table, key=lambda r: r["val_pr_auc"])["model"]
    assert chosen.best_name == best and len(chosen.grid) == 2
    assert "test" not in inspect.signature(models.select_model).parameters
    with pytest.raises(ValueError):
        models.select_model(None, None, USED, metric="accuracy")


def test_other_test_labels_change_metrics_only(ws, chosen):
    test = ws.split("test")
    flipped = test.withColumn("churned", F.pmod(F.xxhash64("customer_id"), F.lit(2)).cast("int"))
    a, b = (models.evaluate_on_test(chosen, t).collect() for t in (test, flipped))
    assert [r["val_pr_auc"] for r in a] == [r["val_pr_auc"] for r in b]
    assert [r["pr_auc"] for r in a] != [r["pr_auc"] for r in b] and a[-1]["recall"] == 1.0


def test_scaling_comes_from_train(ws, chosen):
    statement = chosen.models[models.ALL].stages[0].getStatement()
    mean = ws.split("train").agg(F.avg("recency_days")).first()[0]
    assert repr(float(mean)) in statement and "missing_gap_std_days" in statement and "missing_frequency" not in statement


@pytest.mark.parametrize("name", [models.RECENCY, models.ALL, models.BOOSTING])
def test_contributions_add_up_to_the_log_odds(ws, chosen, name):
    model, test = chosen.models[name], ws.split("test")
    used = ["recency_days"] if name == models.RECENCY else USED
    found, base = explain.contributions(model, test, used)
    total = F.lit(base) + sum((F.col(f"c_{f}") for f in used), F.lit(0.0))
    gap = found.join(models.probability(model, test), "customer_id").agg(
        F.max(F.abs(total - F.log(F.col("p") / (1 - F.col("p"))))).alias("gap"), F.count(F.lit(1)).alias("n")
    ).first()
    assert gap["gap"] < 1e-9 and gap["n"] == test.count()


def test_path_values_equal_the_definition():
    """Brute force over all orders in which a row's own features replace another's, for every pair of patterns."""
    kernel = explain.path_kernel(3)
    for own, other in itertools.product(range(8), repeat=2):
        pays = lambda inside: float(all((own if j in inside else other) >> j & 1 for j in range(3)))
        expected = np.zeros(3)
        for order in itertools.permutations(range(3)):
            inside = set()
            for j in order:
                expected[j] += (pays(inside | {j}) - pays(inside)) / 6
                inside.add(j)
        assert np.allclose(kernel[own, other], expected)


def test_tree_contributions_equal_all_coalitions_against_the_background(ws, chosen):
    """Every subset of features taken from the row, the rest from each background row in turn."""
    model, test = chosen.models[models.BOOSTING], ws.split("test")
    paths, constant = explain.path_list(model, USED)
    owner = np.array(models.boosting_features(model, USED))
    assert len(owner) > len(USED)  # gap_std_days has missing values in train
    prepared = lambda df: model.stages[1].transform(model.stages[0].transform(df)).select("customer_id", "inputs")
    matrix = lambda df: {r["customer_id"]: r["inputs"].toArray() for r in prepared(df).collect()}
    background = ws.split("validation")
    others, rows = np.array(list(matrix(background).values())), matrix(test)

    def value(z):
        flat = [(v, [c for of_feature in conditions for c in of_feature]) for v, _, conditions in paths]
        return constant + sum(v * np.all([(z[:, f] > a) & (z[:, f] <= b) for f, a, b in conditions], axis=0) for v, conditions in flat)

    found, base = explain.contributions(model, test, USED, background)
    assert abs(base - value(others).mean()) < 1e-9
    n = len(USED)
    for r in found.orderBy("customer_id").limit(6).collect():
        x, worth = rows[r["customer_id"]], {}
        for size in range(n + 1):
            for subset in itertools.combinations(range(n), size):
                z = others.copy()
                own = np.isin(owner, subset)
                z[:, own] = x[own]
                worth[subset] = value(z).mean()
        for j, feature in enumerate(USED):
            rest = [k for k in range(n) if k != j]
            expected = sum(
                math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n) * (worth[tuple(sorted((*s, j)))] - worth[s])
                for size in range(n) for s in itertools.combinations(rest, size)
            )
            assert abs(r[f"c_{feature}"] - expected) < 1e-9


def test_a_split_learns_the_side_of_missing_values(spark):
    """Missing values go with the high ones in one table and with the low ones in the other; one split separates both."""
    for bad in ("v IS NULL OR v > 10", "v IS NULL OR v <= 10"):
        rows = spark.range(400).selectExpr(
            "cast(id AS string) AS customer_id", "date'2020-01-01' AS cutoff", "CASE WHEN id % 4 > 0 THEN double(id % 21) END AS v"
        ).withColumn("churned", F.expr(f"cast(coalesce({bad}, false) AS int)"))
        model = models.boosting_pipeline(rows, ["v"], 0.5, 1, 5, 3, early_stopping=False).fit(rows)
        scored = models.outcomes(model, rows).agg(F.min(F.when(F.col("y") == 1, F.col("p"))), F.max(F.when(F.col("y") == 0, F.col("p")))).first()
        assert scored[0] > 0.5 > scored[1], bad


def test_saved_model_scores_the_same(ws, chosen, tmp_path):
    models.save(chosen.best, str(tmp_path / "m"))
    a = models.outcomes(chosen.best, ws.split("test")).orderBy("customer_id").collect()
    b = models.outcomes(models.load(str(tmp_path / "m")), ws.split("test")).orderBy("customer_id").collect()
    assert a == b


def test_missing_history_is_said(spark):
    df = spark.createDataFrame([(None, 0.255, 1234.5)], "avg_gap_days double, return_rate double, monetary double")
    row = df.select(*[explain.describe(c) for c in df.columns]).first()
    assert list(row) == ["avg_gap_days: not enough history", "26% of spend returned", "1,235 total spend"]


def test_permutation_uses_every_value_once(ws, chosen):
    table = explain.permutation_importance(chosen.models[models.RECENCY], ws.split("test"), ["recency_days"], repeats=2)
    assert table.count() == 1 and table.first()["std"] >= 0


def test_donors_are_a_shuffle_within_buckets(spark, monkeypatch):
    rows = spark.range(500).selectExpr("cast(id as string) AS customer_id", "date'2020-01-01' AS cutoff", "cast(id AS double) AS a", "id % 7 AS b")
    for size in (2048, 60):
        monkeypatch.setattr(explain, "DONOR_ROWS", size)
        given = explain.with_donors(rows.repartition(3), ["a", "b"], 2, 1)
        found = given.select("customer_id", "a", F.explode("donors").alias("d")).collect()
        for repeat in (0, 1):
            mine = {r["customer_id"]: r["d"] for r in found if r["d"]["repeat"] == repeat}
            assert sorted(d["a"] for d in mine.values()) == [float(i) for i in range(500)]
            assert all(d["a"] != float(c) and d["b"] == d["a"] % 7 for c, d in mine.items())
        again = explain.with_donors(rows.coalesce(1), ["a", "b"], 2, 1)
        assert sorted(map(str, again.collect())) == sorted(map(str, given.collect()))
    assert explain.with_donors(rows.where("false"), ["a"], 2, 1).count() == 0


def test_scores_of_lapsed_customers_stay_empty(ws, chosen):
    scored = models.score_customers(chosen.best, ws.segmented, 0.2, 0.8)
    assert scored.where("status = 'Lapsed' and (churn_prob is not null or risk_level <> 'Lapsed')").count() == 0
    assert scored.where("status = 'Active' and churn_prob is null").count() == 0
    final = value.value_and_priority(scored, ws.window)
    assert final.where("priority is null").count() == 0
    assert final.where("status = 'Lapsed' and priority not like 'W%'").count() == 0


def test_ranking_measures_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b), f"c{i:03d}") for i, (a, b) in enumerate(zip(y, p))], "y int, p double, customer_id string")
    table = evaluate.score_table(df)
    wins = (p[y == 1][:, None] > p[y == 0]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0]).sum()
    assert abs(evaluate.roc_auc(table).first()[0] - wins / (y.sum() * (1 - y).sum())) < 1e-12
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        flagged = p >= t
        recall = y[flagged].sum() / y.sum()
        ap, last = ap + (recall - last) * y[flagged].mean(), recall
    assert abs(evaluate.pr_auc(table).first()[0] - ap) < 1e-12
    f1 = {t: 2 * y[p >= t].sum() / ((p >= t).sum() + y.sum()) for t in sorted(set(p))}
    assert evaluate.best_f1(table).first()["threshold"] == max(f1, key=lambda t: (f1[t], -t))
    low, high, info = evaluate.risk_thresholds(df, table=table)
    assert low < high and not info["thresholds_crossed_used_terciles"]
    assert y[p >= high].mean() >= min(0.9, 2 * y.mean()) and y[p <= low].mean() <= 0.15
    text = evaluate.rule_text(low, high, y.mean())
    assert f"{high:.2f}" in text and f"{low:.2f}" in text


def test_unreachable_tiers_fall_back_to_quantiles(spark):
    df = spark.createDataFrame([(i % 2, i / 100) for i in range(100)], "y int, p double")
    low, high, info = evaluate.risk_thresholds(df)
    assert info["high_fallback_to_quantile"] and info["low_fallback_to_quantile"] and low < high


def test_choice_of_k():
    evaluated = [(2, 9.0, 0.9), (3, 8.0, 0.50), (4, 7.0, 0.54), (5, 6.0, 0.40)]
    assert cluster.choose_k(evaluated) == 3 and cluster.choose_k([(2, 1.0, 0.3), (7, 1.0, 0.4)]) == 7


def test_adjusted_rand_of_equal_and_permuted_labels(spark):
    df = spark.range(60).selectExpr("id % 3 as a", "(id + 1) % 3 as b", "id % 2 as c")
    assert cluster.adjusted_rand(df, "a", "b").first()[0] == 1.0
    assert abs(cluster.adjusted_rand(df, "a", "c").first()[0]) < 0.05


def test_small_tables_are_not_clustered(ws):
    usable, n = cluster.usable_features(ws.at_end)
    assert set(usable) == set(cluster.CLUSTER_FEATURES) and cluster.skip_reason(n, usable) is None
    assert "need >= 100" in cluster.skip_reason(99, usable) and cluster.skip_reason(500, usable[:2])


def test_selected_features_cover_the_bound_data(ws):
    used, excluded = feats.select_features(ws.split("train"), ws.available)
    assert list(excluded) == ["days_since_registration"] and len(used) == 24


@pytest.fixture(scope="module")
def blobs(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(m, 1, (150, 3)) for m in (0, 6, -7)])
    return points, spark.createDataFrame([(str(i), Vectors.dense(x)) for i, x in enumerate(points)], ["customer_id", "vector"]).repartition(5)


def test_many_fits_are_as_good_as_single_ones(spark, blobs):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    _, data = blobs
    scored = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster")
    for k, inertia, silhouette in cluster.evaluate_k(data, 450, ks=(2, 3, 5), restarts=30):
        single = min((KMeans(k=k, seed=s, featuresCol="vector", predictionCol="cluster").fit(data) for s in range(6)), key=lambda m: m.summary.trainingCost)
        assert inertia <= single.summary.trainingCost * 1.01
        if k == 3:
            assert abs(inertia - single.summary.trainingCost) < 1e-6 * inertia
            assert abs(silhouette - scored.evaluate(single.transform(data))) < 1e-9


def test_passes_equal_plain_kmeans(blobs):
    points, data = blobs
    fit = many_kmeans.fit_many(data, [(3, 1), (4, 9)])[1]
    near = many_kmeans._distances(points, fit.centres).argmin(axis=1)
    assert abs(fit.cost - ((points - fit.centres[near]) ** 2).sum()) < 1e-6
    for c in range(4):
        assert np.allclose(points[near == c].mean(axis=0), fit.centres[c], atol=1e-3)
    got = {int(r["customer_id"]): r["cluster"] for r in fit.transform(data).collect()}
    assert [got[i] for i in range(450)] == near.tolist()


def test_fits_do_not_depend_on_partitions_and_bear_few_points(spark, blobs):
    _, data = blobs
    a, b = (many_kmeans.fit_many(d, [(3, 5)])[0] for d in (data, data.coalesce(1)))
    assert np.allclose(a.centres, b.centres)
    same = data.limit(1).crossJoin(spark.range(5)).drop("id")
    fit = many_kmeans.fit_many(same, [(3, 1)])[0]
    assert fit.cost < 1e-9 and fit.centres.shape == (3, 3)
    with pytest.raises(ValueError, match="no points"):
        many_kmeans.fit_many(data.where("false"), [(2, 1)])


def test_stability_of_clear_clusters(blobs):
    assert cluster.stability(blobs[1], 3, restarts=2) > 0.999
