"""Global ranks, running sums and exact quantiles without a single-partition sort and without driver-side rows.

Ties are always collapsed first (one row per distinct value, counted on the map side), so a value that holds a third of
all rows costs one row. Everything after that works on buckets of distinct values.
"""
from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, Window, functions as F

from ..session import checkpointed, stage

_BEFORE = (Window.unboundedPreceding, -1)
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def cumdist(df, key, measures=None, buckets=None):
    """One row per distinct ``key`` with counts and sums of everything strictly below it, and the totals.

    Columns: ``key, n, n_before, n_total`` and for each measure ``m, m_before, m_total`` (sums of the given column
    expressions). NULL keys are left out. Buckets follow approximate quantiles of the distinct keys, so they are balanced
    whatever the distribution; the result is exact whatever the boundaries.
    """
    measures = dict(measures or {})
    names = ["n", *measures]
    distinct = stage(
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(k) for k, m in measures.items()]),
        f"cumdist-{key}",
    )
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(distinct, "key", buckets)
    binned = (
        Bucketizer(splits=bounds, inputCol="_position", outputCol="bucket")
        .transform(distinct.withColumn("_position", F.col("key").cast("double")))
        .drop("_position")
    )
    # at most ``buckets`` + 2 rows: the window without partitioning and the broadcast are both bounded by that
    per_bucket = binned.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    running = Window.orderBy("bucket").rowsBetween(*_BEFORE)
    everything = Window.orderBy("bucket").rowsBetween(*_ALL)
    offsets = per_bucket.select(
        "bucket",
        *[F.coalesce(F.sum(c).over(running), F.lit(0)).alias(f"{c}_offset") for c in names],
        *[F.sum(c).over(everything).alias(f"{c}_total") for c in names],
    )
    within = Window.partitionBy("bucket").orderBy("key").rowsBetween(*_BEFORE)
    return binned.join(F.broadcast(offsets), "bucket").select(
        "key",
        *names,
        *[
            (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{c}_offset")).alias(f"{c}_before")
            for c in names
        ],
        *[f"{c}_total" for c in names],
    )


def _bounds(distinct, key, buckets):
    """Bucket boundaries for Bucketizer: open-ended, strictly increasing, at most ``buckets`` + 1 of them."""
    inner = []
    if buckets > 1:
        steps = [i / buckets for i in range(1, buckets)]
        position = distinct.select(F.col(key).cast("double").alias("x"))
        inner = sorted(set(position.approxQuantile("x", steps, 0.25 / buckets)))
    return [float("-inf"), *(inner or [0.0]), float("inf")]  # Bucketizer wants one boundary inside


def percentile_rank() -> Column:
    """Average-tie percentile rank on a ``cumdist`` table (pandas ``rank(pct=True)``)."""
    return (F.col("n_before") + (F.col("n") + 1) / 2) / F.col("n_total")


def average_rank() -> Column:
    return F.col("n_before") + (F.col("n") + 1) / 2


def rank_cuts(df, key, cuts):
    """For each cut the largest key whose percentile rank is at most the cut, or None. Few numbers, any data size."""
    table = cumdist(df, key)
    row = table.agg(
        *[F.max(F.when(percentile_rank() <= F.lit(c), F.col("key"))).alias(f"c{i}") for i, c in enumerate(cuts)]
    ).first()
    return list(row)


def score_from_cuts(column: Column, cuts) -> Column:
    """1 for values up to the first cut, 2 up to the second, ... NULL for NULL."""
    above = [F.when(column > F.lit(c), 1).otherwise(0) if c is not None else F.lit(1) for c in cuts]
    return F.when(column.isNotNull(), reduce(lambda a, b: a + b, above, F.lit(1)))


# --- exact quantiles -----------------------------------------------------------------------------------------------

_DIGITS = [4096, 4096 * 4096]
FEW_ROWS = 1_000_000


def _cell(resolution) -> Column:
    """Order-preserving integer cell of ``value``; cells get finer with ``resolution``."""
    return F.floor(F.signum("value") * F.log1p(F.abs("value")) * F.lit(float(resolution))).cast("bigint")


def _ranks(quantiles):
    """Zero-based ranks a quantile interpolates between, as expressions on the group size."""
    pairs = []
    for q in quantiles:
        position = (F.col("size") - 1) * F.lit(float(q))
        low = F.floor(position)
        pairs.append((low, F.least(low + 1, F.col("size") - 1), position - low))
    return pairs


def _holds_a_rank(quantiles) -> Column:
    inside = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    return reduce(or_, [inside(r) for low, high, _ in _ranks(quantiles) for r in (low, high)])


def _long(df, columns, by, weight="1L"):
    """``*by, feature, value, weight``: one row per value that counts ``weight`` times."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    stacked = df.selectExpr(
        *[f"`{b}`" for b in by], f"stack({len(columns)}, {pairs}) as (feature, value)", f"{weight} as weight"
    )
    return stacked.where("value is not null")


def _select_cells(values, here, scope, quantiles, first):
    """Cells of one level that hold a wanted rank, with the number of group values before each and inside it."""
    carried = [] if first else ["size", "start"]
    counted = values.groupBy(*scope, here, *carried).agg(F.sum("weight").alias("n"))
    group = Window.partitionBy(*scope)
    running = group.orderBy(here).rowsBetween(*_BEFORE)
    start = F.lit(0) if first else F.col("start")
    size = F.sum("n").over(group.rowsBetween(*_ALL)) if first else F.col("size")
    placed = counted.withColumn("size", size).withColumn(
        "before", start + F.coalesce(F.sum("n").over(running), F.lit(0))
    )
    return placed.where(_holds_a_rank(quantiles)).select(*scope, here, "size", F.col("before").alias("start"), "n")


def _values_at_ranks(values, scope, keys, quantiles):
    """Interpolated quantiles from the values of the selected cells."""
    last = values.groupBy(*scope, "value", "size", "start").agg(F.sum("weight").alias("n"))
    order = Window.partitionBy(*scope).orderBy("value").rowsBetween(*_BEFORE)
    placed = last.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    at = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n")), F.col("value")))
    ranks = _ranks(quantiles)
    ends = placed.groupBy(*keys, "size").agg(
        *[at(low).alias(f"low{i}") for i, (low, _, _) in enumerate(ranks)],
        *[at(high).alias(f"high{i}") for i, (_, high, _) in enumerate(ranks)],
    )
    between = lambda i, part: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * part
    return ends.select(*keys, "size", *[between(i, part).alias(f"q{i}") for i, (_, _, part) in enumerate(ranks)])


def exact_quantiles(df, columns, quantiles, by=(), weight="1L"):
    """Linear-interpolation quantiles (as pandas and ``percentile``): one row per group and column.

    Output: ``*by, feature, size, q0, q1, ...``. Equal values of a group are counted on the map side first, so a group or
    a value that holds a third of the rows is not a hot key afterwards. Then a radix select: count coarse cells, keep the
    cells that hold a wanted rank, count finer cells inside them, and sort only the values of the last cells.
    ``weight`` is an expression for rows that stand for several equal ones.
    """
    keys = [*by, "feature"]
    counted = _long(df, columns, by, weight).groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))
    values, cells, scope = counted, None, keys
    for level, resolution in enumerate(_DIGITS):
        here = f"cell{level}"
        values = values.withColumn(here, _cell(resolution))
        source = values if cells is None else values.join(cells, scope)
        cells = _select_cells(source, here, scope, quantiles, cells is None).drop("n")
        scope = [*scope, here]
    return _values_at_ranks(values.join(cells, scope), scope, keys, quantiles)


def global_quantiles(df, columns, quantiles):
    """The same for the whole table, as ``{column: [values]}`` on the driver.

    The selected cells (two per column and quantile) come to the driver between passes, so a second, finer pass runs only
    where a cell holds more than ``FEW_ROWS`` rows.
    """
    spark, keys = df.sparkSession, ["feature"]
    values, cells, scope = _long(df, columns, []), None, keys
    for level, resolution in enumerate(_DIGITS):
        here = f"cell{level}"
        values = values.withColumn(here, _cell(resolution))
        source = values if cells is None else values.join(F.broadcast(cells), scope)
        selected = _select_cells(source, here, scope, quantiles, cells is None)
        rows = selected.collect()
        cells = spark.createDataFrame(rows, selected.schema).drop("n")
        scope = [*scope, here]
        if max((r["n"] for r in rows), default=0) <= FEW_ROWS:
            break
    found = {
        r["feature"]: [r[f"q{i}"] for i in range(len(quantiles))]
        for r in _values_at_ranks(values.join(F.broadcast(cells), scope), scope, keys, quantiles).collect()
    }
    return {c: found.get(c, [None] * len(quantiles)) for c in columns}


# --- ties that an edge cuts ----------------------------------------------------------------------------------------


def numbered_ties(df, key, groups, order, name="position"):
    """Rows of ``df`` whose ``key`` is one of a few, with their 1-based position in the whole order by ``key`` and, inside ties, ``order``.

    ``groups``: rows of a ``cumdist`` table of bounded number. Only the rows of these ties are sorted, and a large tie over many tasks.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(g["key"], g["n_before"]) for g in groups], "_key double, _before bigint")
    smaller = spark.createDataFrame([(g["key"], sum(o["n"] for o in groups if o["key"] < g["key"])) for g in groups], "_key double, _skipped bigint")
    mine = df.join(F.broadcast(table.join(F.broadcast(smaller), "_key")), F.col(key) == F.col("_key"))
    numbered = global_row_number(mine, [F.col("_key"), *order], name)
    return numbered.withColumn(name, F.col(name) - F.col("_skipped") + F.col("_before")).drop("_key", "_before", "_skipped")


# --- positions -----------------------------------------------------------------------------------------------------


def global_row_number(df, order, name="position"):
    """1-based position in a total order. Range-partitioned sort (a hot value spreads over the tie-break columns),
    checkpointed so that partitions stay as they are, then one offset per partition."""
    ordered = checkpointed(df.orderBy(*order))
    placed = ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_id", 33).cast("int")
    )
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _offset bigint")
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + within + 1)
        .drop("_id", "_part", "_offset")
    )
