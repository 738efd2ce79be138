"""Why a customer has this score: contributions in log-odds, texts, and the two importance rankings."""
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession, Window, functions as F

from ..functions.stats import cumdist, numbered_ties
from ..session import shared_folder, stage
from . import models

# Printf texts per feature; a trailing scale of 100 turns a fraction into percent.
TEXTS = {
    "recency_days": ("%.0f days since last purchase", 1),
    "frequency": ("%.0f orders placed so far", 1),
    "monetary": ("%,.0f total spend", 1),
    "aov": ("average order value of %,.0f", 1),
    "purchase_frequency_30d": ("%.2f orders per 30 days of life", 1),
    "days_since_registration": ("%.0f days since registration", 1),
    "days_since_first_order": ("%.0f days since first order", 1),
    "avg_gap_days": ("usually %.0f days between orders", 1),
    "gap_std_days": ("order spacing varies by %.0f days", 1),
    "gap_cv": ("irregular ordering rhythm (variation %.2f)", 1),
    "recency_to_gap_ratio": ("silent %.1fx longer than their usual gap", 1),
    "orders_30d": ("%.0f orders in the last 30 days", 1),
    "orders_90d": ("%.0f orders in the last 90 days", 1),
    "orders_prev90d": ("%.0f orders in the 90 days before that", 1),
    "frequency_change": ("order count changed by %+.0f vs the previous 90 days", 1),
    "spend_90d": ("%,.0f spent in the last 90 days", 1),
    "spend_prev90d": ("%,.0f spent in the 90 days before that", 1),
    "spend_change": ("spend changed by %+,.0f vs the previous 90 days", 1),
    "active_months": ("bought in %.0f different months", 1),
    "n_unique_products": ("%.0f distinct products bought", 1),
    "n_unique_categories": ("%.0f product categories explored", 1),
    "avg_discount": ("average discount of %.0f%%", 100),
    "discount_order_share": ("%.0f%% of orders used a discount", 100),
    "avg_units_per_order": ("%.1f units per order", 1),
    "return_rate": ("%.0f%% of spend returned", 100),
}
TOP_FACTORS = 3


def describe(feature):
    """Text of a feature value; NULL reads as not enough history."""
    pattern, scale = TEXTS.get(feature, (feature + " = %.2f", 1))
    value = F.col(feature).cast("double") * scale
    return F.when(value.isNull(), f"{feature}: not enough history").otherwise(F.format_string(pattern, value))


# --- contributions ---------------------------------------------------------------------------------------------------


def contributions(model, df, features, background=None):
    """(table with ``customer_id``, the features and ``c_<feature>`` columns; base value). Base + sum = log-odds."""
    background = df if background is None else background
    explain_rows = tree_contributions if models.is_boosting(model) else linear_contributions
    return explain_rows(model, df, features, background)


def linear_contributions(model, df, features, background):
    """The logistic model is a sum of one term per feature, so its Shapley values are term minus background mean."""
    assembler, regression = model.stages[1], model.stages[2]
    weights = dict(zip(assembler.getInputCols(), regression.coefficients.toArray().tolist()))
    term = lambda f: sum(
        (F.col(c) * F.lit(weights[c]) for c in (f"z_{f}", f"missing_{f}") if c in weights), F.lit(0.0)
    )
    means = model.stages[0].transform(background).agg(*[F.avg(term(f)).alias(f) for f in features]).first()
    base = regression.intercept + sum(means[f] for f in features)
    placed = model.stages[0].transform(df)
    columns = [(term(f) - F.lit(means[f])).alias(f"c_{f}") for f in features]
    return placed.select("customer_id", *features, *columns), base


def _read_trees(model):
    """(weight, root) of every tree from the model's saved node table, which holds rounds x 2^(depth+1) rows at most."""
    boosted = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex[:12]}"
    boosted.write().save(path)
    nodes = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    return [(weight, _node(nodes[tree], 0)) for tree, weight in enumerate(boosted.treeWeights)]


def _node(nodes, key):
    data = nodes[key]
    cover = float(data["rawCount"])
    if data["leftChild"] < 0:
        return {"value": data["prediction"], "cover": cover}
    return {
        "feature": data["split"]["featureIndex"],
        "threshold": data["split"]["leftCategoriesOrThreshold"][0],
        "cover": cover,
        "left": _node(nodes, data["leftChild"]),
        "right": _node(nodes, data["rightChild"]),
    }


def _leaves(node, conditions):
    """(value, {column: (low, high)}) for every leaf: it pays its value to rows with all columns in low < x <= high."""
    if "value" in node:
        yield node["value"], conditions
        return
    for side in ("left", "right"):
        low, high = conditions.get(node["feature"], (-math.inf, math.inf))
        bounds = (low, min(high, node["threshold"])) if side == "left" else (max(low, node["threshold"]), high)
        yield from _leaves(node[side], {**conditions, node["feature"]: bounds})


def path_kernel(m):
    """Shapley values of a path of m conditions for every pair of patterns: array (own pattern, other's pattern, condition).

    A row is compared with another one: a coalition takes the row's own features, the rest comes from the other. The path pays 1
    when every condition holds. Conditions that only the row meets raise, those that only the other meets lower, and if one is met by
    neither the path never pays.
    """
    kernel = np.zeros((2**m, 2**m, m))
    for own in range(2**m):
        for other in range(2**m):
            if own | other != 2**m - 1:
                continue
            raising, lowering = own & ~other, other & ~own
            a, b = raising.bit_count(), lowering.bit_count()
            for j in range(m):
                if raising >> j & 1:
                    kernel[own, other, j] = math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
                elif lowering >> j & 1:
                    kernel[own, other, j] = -math.factorial(a) * math.factorial(b - 1) / math.factorial(a + b)
    return kernel


def path_list(model, features):
    """(value in log-odds, features used, per feature its conditions) of every leaf, and what leaves without conditions pay to all.

    A condition is (column, low, high). Columns of one feature belong together: it meets its condition if all of them hold.
    """
    owner = models.boosting_features(model, features)
    paths, constant = [], 0.0
    for weight, root in _read_trees(model):
        for value, conditions in _leaves(root, {}):
            by_feature = {}
            for column, (low, high) in sorted(conditions.items()):
                by_feature.setdefault(owner[column], []).append((column, low, high))
            scaled, used = 2.0 * weight * value, sorted(by_feature)
            if used:
                paths.append((scaled, used, [by_feature[f] for f in used]))
            else:
                constant += scaled
    return paths, constant


def _patterns(x, conditions):
    """Which features meet their conditions in each row, as bits."""
    pattern = np.zeros(len(x), dtype=np.int64)
    for j, of_feature in enumerate(conditions):
        met = np.ones(len(x), bool)
        for column, low, high in of_feature:
            met &= (x[:, column] > low) & (x[:, column] <= high)
        pattern |= met.astype(np.int64) << j
    return pattern


def _inputs(batch):
    column = batch.column("inputs")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def background_shares(prepared, paths):
    """For every path the share of background rows per pattern of met conditions.

    One pass: a task counts patterns, Spark adds them up, and as many numbers reach the driver as the model has patterns.
    """
    begins = np.append(0, np.cumsum([2 ** len(used) for _, used, _ in paths])).astype(np.int64)
    shared = prepared.sparkSession.sparkContext.broadcast(paths)

    def count(batches):
        total = np.zeros(begins[-1], np.int64)
        for batch in batches:
            x = _inputs(batch)
            for k, (_, used, conditions) in enumerate(shared.value):
                total[begins[k] : begins[k + 1]] += np.bincount(_patterns(x, conditions), minlength=2 ** len(used))
        slots = np.flatnonzero(total)
        yield pa.record_batch([pa.array(slots), pa.array(total[slots])], names=["slot", "n"])

    found = np.zeros(begins[-1])
    for r in prepared.select("inputs").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        found[r["slot"]] = r["n"]
    parts = [found[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
    return [p / max(p.sum(), 1.0) for p in parts]


def tree_tables(paths, shares):
    """Per path its features, conditions and the contributions of every pattern against the background; and the base value of the paths."""
    kernels = {m: path_kernel(m) for m in {len(used) for _, used, _ in paths}}
    tables = [
        (used, conditions, value * np.einsum("xbj,b->xj", kernels[len(used)], share))
        for (value, used, conditions), share in zip(paths, shares, strict=True)
    ]
    return tables, sum(value * share[-1] for (value, _, _), share in zip(paths, shares, strict=True))


def explain_matrix(x, tables, n_features):
    """Contributions of each row (n, features)."""
    out = np.zeros((len(x), n_features))
    for used, conditions, table in tables:
        pattern = _patterns(x, conditions)
        for j, feature in enumerate(used):
            out[:, feature] += table[pattern, j]
    return out


def tree_contributions(model, df, features, background):
    """Exact interventional Shapley values of the boosted trees in log-odds, against all rows of ``background``.

    A path's value for a row depends on the background only through how many of its rows meet which conditions, so those counts are taken
    in one pass and the rows are explained in another, however large the background.
    """

    def prepared(table):
        dated = table if "cutoff" in table.columns else table.withColumn("cutoff", F.lit(None).cast("date"))
        return model.stages[1].transform(model.stages[0].transform(dated)).withColumn("inputs", vector_to_array("inputs"))

    paths, constant = path_list(model, features)
    tables, base = tree_tables(paths, background_shares(prepared(background), paths))
    shared = df.sparkSession.sparkContext.broadcast(tables)
    names = [f"c_{f}" for f in features]

    def explain(batches):
        for batch in batches:
            found = explain_matrix(_inputs(batch), shared.value, len(names))
            columns = [*(batch.column(c) for c in ("customer_id", *features)), *(pa.array(found[:, j]) for j in range(len(names)))]
            yield pa.record_batch(columns, names=["customer_id", *features, *names])

    rows = prepared(df).select("customer_id", *[F.col(f).cast("double").alias(f) for f in features], "inputs")
    schema = "customer_id string, " + ", ".join(f"{c} double" for c in [*features, *names])
    return rows.mapInArrow(explain, schema), constant + base


# --- texts -----------------------------------------------------------------------------------------------------------


def top_factors(contributed, features, top=TOP_FACTORS):
    """``top_risk_factors`` and ``top_protective_factors``: the strongest raising and lowering factors as text."""
    entries = F.array(
        *[
            F.struct(F.col(f"c_{f}").alias("c"), F.lit(i).alias("i"), describe(f).alias("text"))
            for i, f in enumerate(features)
        ]
    )
    strongest = lambda keep, key: F.concat_ws(
        " | ",
        F.transform(
            F.slice(
                F.array_sort(F.transform(F.filter("_all", keep), lambda e: F.struct(key(e).alias("k"), e["i"], e["text"]))),
                1,
                top,
            ),
            lambda e: e["text"],
        ),
    )
    return contributed.withColumn("_all", entries).select(
        "customer_id",
        strongest(lambda e: e["c"] > 0, lambda e: -e["c"]).alias("top_risk_factors"),
        strongest(lambda e: e["c"] < 0, lambda e: e["c"]).alias("top_protective_factors"),
    )


# --- importances -----------------------------------------------------------------------------------------------------


def global_importance(contributed, features):
    """Mean absolute contribution per feature, strongest first."""
    row = contributed.agg(*[F.avg(F.abs(F.col(f"c_{f}"))).alias(f) for f in features])
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_contribution")) for f in features]
    return row.select(F.inline(F.array(*entries))).orderBy(F.col("mean_abs_contribution").desc(), "feature")


def _average_precision(scored, groups, buckets=1000):
    """Average precision within each group. Probability buckets keep every window small; few offsets per group."""
    per_score = scored.groupBy(*groups, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    binned = per_score.withColumn("bucket", F.floor(F.col("p") * buckets))
    above = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = binned.groupBy(*groups, "bucket").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bpos"))
    by_bucket = above(Window.partitionBy(*groups).orderBy(F.col("bucket").desc()))
    offsets = per_bucket.select(
        *groups,
        "bucket",
        F.coalesce(F.sum("bn").over(by_bucket), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("bpos").over(by_bucket), F.lit(0)).alias("pos_above"),
    )
    inside = Window.partitionBy(*groups, "bucket").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.join(offsets, [*groups, "bucket"])
    caught = F.col("pos_above") + F.sum("pos").over(inside)
    flagged = F.col("n_above") + F.sum("n").over(inside)
    steps = placed.select(*groups, "pos", (F.col("pos") * caught / flagged).alias("gain"))
    return steps.groupBy(*groups).agg(F.try_divide(F.sum("gain"), F.sum("pos")).alias("ap"))


DONOR_ROWS = 2048  # rows of a bucket on average


def with_donors(df, features, repeats, seed, key=("customer_id", "cutoff")):
    """Every row with ``donors``: for each repeat the features of another row, each row giving its values exactly once per repeat.

    Rows are dealt into buckets of bounded size and put in order there by a seeded digest of their key; the donor stands a fixed share of the
    bucket further on, round the end. One exchange, no sort of all rows, and partitioning changes nothing.
    """
    buckets = max(1, -(-df.count() // DONOR_ROWS))
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))).cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets
    packed = df.groupBy(place.alias("_bucket")).agg(F.array_sort(F.collect_list(F.struct(digest.alias("_digest"), *df.columns))).alias("_rows"))
    rows, size = F.col("_rows"), F.size("_rows")

    def donor(i, repeat):
        shift = F.greatest(F.lit(1), F.floor(size * repeat / (repeats + 1)))
        row = F.element_at(rows, ((i + shift) % size + 1).cast("int"))
        return F.struct(F.lit(repeat - 1).alias("repeat"), *[row[f].alias(f) for f in features])

    placed = F.transform(
        rows,
        lambda row, i: F.struct(*[row[c].alias(c) for c in df.columns], F.array(*[donor(i, r) for r in range(1, repeats + 1)]).alias("donors")),
    )
    return packed.select(F.inline(placed))


def importance_by_permutation(score, df, features, repeats=5, seed=42, target=models.TARGET):
    """Drop in average precision when one feature comes from a donor row; mean and deviation over repeats.

    ``score(rows, keep)`` gives the columns ``keep`` and the probability ``p``. All features and repeats are scored in one pass, in which a row is
    widened only between its donors and its score.
    """
    keep = df.select("customer_id", "cutoff", F.col(target).cast("bigint").alias("y"), *features)
    given = with_donors(keep, features, repeats, seed).withColumn("donor", F.explode("donors")).drop("donors")
    each = given.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = [F.when(F.col("feature") == f, F.col(f"donor.{f}")).otherwise(F.col(f)).alias(f) for f in features]
    variants = each.select("customer_id", "cutoff", "y", "feature", F.col("donor.repeat").alias("repeat"), *swapped)
    permuted = _average_precision(score(variants, ("feature", "repeat", "y")), ["feature", "repeat"])
    plain = _average_precision(score(keep, (F.lit("all").alias("feature"), "y")), ["feature"]).select("ap").scalar()
    drops = permuted.withColumn("drop", plain - F.col("ap"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("pr_auc_drop"), F.stddev_pop("drop").alias("std")).orderBy(
        F.col("pr_auc_drop").desc(), "feature"
    )


def permutation_importance(model, df, features, repeats=5, seed=42, target=models.TARGET):
    """``importance_by_permutation`` of a fitted model."""
    return importance_by_permutation(lambda rows, keep: models.probability(model, rows, keep), df, features, repeats, seed, target)


def agreement(importance, permutation):
    """The two rankings side by side: rank in each, feature by feature (one row per feature)."""
    ranked = lambda df, column, name: df.withColumn(
        name, F.row_number().over(Window.orderBy(F.col(column).desc(), "feature"))
    )
    a = ranked(importance, "mean_abs_contribution", "contribution_rank")
    b = ranked(permutation, "pr_auc_drop", "permutation_rank")
    return a.join(b, "feature")


def example_customers(scored, texts):
    """The highest score and the one a tenth of the way up, with their factors; inside ties the order is by id.

    The two positions are found among distinct scores; only the ties that hold them are sorted.
    """
    keyed = scored.withColumn("_p", F.col("p").cast("double"))
    ties = stage(cumdist(keyed, "_p"), "example-ties")
    n = ties.agg(F.sum("n")).first()[0] or 0
    wanted = [n, n // 10 + 1]
    holds = lambda position: (F.col("n_before") < position) & (F.lit(position) <= F.col("n_before") + F.col("n"))
    groups = ties.where(holds(wanted[0]) | holds(wanted[1])).collect()  # two at most
    if not groups:
        return scored.withColumn("example", F.lit("")).join(texts, "customer_id").limit(0)
    numbered = numbered_ties(keyed, "_p", groups, [F.col("customer_id")]).where(F.col("position").isin(wanted))
    label = F.when(F.col("position") == n, "highest risk").otherwise("low risk")
    return numbered.withColumn("example", label).join(texts, "customer_id").drop("position", "_p")
