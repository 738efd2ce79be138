"""Tables laid out for looking up one key: hash buckets as folders, sorted by the key inside.

A lookup reads one folder, and there only the row groups whose statistics can hold the key. The bucket column is named
``<key>_of_<buckets>``, so a reader finds the layout in the schema. Buckets are dealt out by a rebalancing shuffle: a bucket
that is too large for one task (a key with a third of all rows) is written by several, small ones share a task.
"""
import re

from pyspark.sql import Column, functions as F

ROWS_PER_BUCKET = 4_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096


def bucket_count(rows):
    """A power of two, so that a bucket has at most about ``ROWS_PER_BUCKET`` rows when keys are even."""
    needed = max(-(-rows // ROWS_PER_BUCKET), LEAST_BUCKETS)
    return min(1 << (needed - 1).bit_length(), MOST_BUCKETS)


def bucket_of(key: Column, buckets) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_keyed(df, path, key, buckets, order=(), mode="errorifexists"):
    """Writes ``df`` in ``buckets`` folders by ``key`` (NULL has its bucket, too); rows are sorted by key and ``order`` in each file.

    Returns the table as it lies there.
    """
    name = f"{key}_of_{buckets}"
    placed = df.withColumn(name, bucket_of(F.col(key), buckets)).hint("rebalance", F.col(name))
    placed.sortWithinPartitions(name, key, *order).write.mode(mode).partitionBy(name).parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def rows_of(table, key, value):
    """Rows of ``table`` with one value of ``key`` (None finds the NULLs). A keyed table is read in its bucket only."""
    found = table.where(F.col(key).eqNullSafe(F.lit(value)) if value is None else F.col(key) == F.lit(value))
    for name in table.columns:
        layout = re.fullmatch(rf"{re.escape(key)}_of_(\d+)", name)
        if layout:
            typed = F.lit(value).cast(table.schema[key].dataType)
            found = found.where(F.col(name) == bucket_of(typed, int(layout[1]))).drop(name)
    return found
