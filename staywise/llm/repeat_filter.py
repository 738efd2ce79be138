"""Bit tables that say which 64-bit keys may occur more often than given limits, and the counts behind them in few bytes a key."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .tables import arrays

FILTER_BITS = 25
MOST_BITS = 29  # of a table that is sized by its keys: 64 MB
BITS_PER_KEY = 16
KEPT_BITS, PART_BITS = 40, 8  # of a key that is counted, and of these the ones by which keys are dealt out
KEYS_AT_ONCE = 1 << 20


def repeat_filter(counts, above=(1,)):
    """One table per limit for ``counts`` (key, n), n summed in parts. Keys at or below a limit are mostly told apart, those above it always pass."""
    again = counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = again.groupBy(F.floor(place / 64).alias("word"))
    word, *bits = arrays(words.agg(*[F.coalesce(F.bit_or(F.when(F.col("n") > k, bit)), F.lit(0)).alias(f"above_{k}") for k in above]))
    tables = np.zeros((len(above), 1 << (FILTER_BITS - 6)), np.int64)
    for table, values in zip(tables, bits, strict=True):
        table[word] = values
    return tables.view(np.uint8)


def sized_filter(keys, above=(1,)):
    """``repeat_filter`` for ``keys`` (key, n) that are summed and stored already; each table has ``BITS_PER_KEY`` bits a key, up to 2^``MOST_BITS``.

    Keys beyond that only pass more often.
    """
    sizes = keys.agg(*[F.count(F.when(F.col("n") > k, 1)).alias(f"above_{k}") for k in above]).first()
    bits = [min(MOST_BITS, max(16, int(BITS_PER_KEY * size - 1).bit_length())) for size in sizes]
    levels = F.filter(F.array(*[F.when(F.col("n") > k, i) for i, k in enumerate(above)]), lambda level: level.isNotNull())
    shift = F.element_at(F.array(*[F.lit(64 - b) for b in bits]), F.col("level") + 1)
    placed = keys.select("key", F.explode(levels).alias("level")).select("level", F.call_function("shiftrightunsigned", "key", shift).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    words = placed.groupBy("level", F.shiftrightunsigned("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    level, word, values = arrays(words)
    tables = [np.zeros(1 << (b - 6), np.int64) for b in bits]
    for i, table in enumerate(tables):
        table[word[level == i]] = values[level == i]
    return [table.view(np.uint8) for table in tables]


def limits_passed(tables, keys):
    """How many of the tables' limits each key (unsigned) may exceed."""

    def passed(table):
        place = (keys >> np.uint64(64 - (8 * len(table)).bit_length() + 1)).astype(np.int64)
        return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1

    return sum(passed(table) for table in tables)


def repeated(df, keys_of, most):
    """(key, n) of the keys that occur more than once, n > 1; ``keys_of(record batch)`` yields arrays of keys (unsigned).

    Of a key a block sends ``most`` copies at the most, so n is too low where more stand in one block, but never below ``most`` then.

    Keys are cut to their first ``KEPT_BITS`` bits (the rest is 0 in the result), so different keys may be counted as one. They travel
    sorted in blocks, the first byte of all keys of a block before the second, which takes about three bytes a key instead of eleven.
    """
    rest_bits = KEPT_BITS - PART_BITS

    def packed(held):
        kept = np.sort(np.concatenate(held) >> np.uint64(64 - KEPT_BITS))
        kept = kept[np.concatenate((np.ones(min(most, len(kept)), bool), kept[most:] != kept[:-most]))]
        ends = np.searchsorted(kept, np.arange(1, (1 << PART_BITS) + 1, dtype=np.uint64) << np.uint64(rest_bits))
        starts = np.concatenate(([0], ends[:-1]))
        parts = np.flatnonzero(ends > starts)
        blocks = [kept[starts[p] : ends[p]].astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts]
        return pa.record_batch([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size >= KEYS_AT_ONCE:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def counted(part, blocks):
        kept = np.sort(np.concatenate([np.ascontiguousarray(b.reshape(4, -1).T).view(">u4").ravel().astype(np.uint32) for b in blocks]))
        edges = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1])))
        n = np.diff(np.append(edges, len(kept)))
        keys = (kept[edges[n > 1]].astype(np.uint64) | np.uint64(part << rest_bits)) << np.uint64(64 - KEPT_BITS)
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["key", "n"])

    def count(batches):
        current, held = None, []
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != current and held:
                    yield counted(current, held)
                    held = []
                current = part
                held.append(np.frombuffer(block, np.uint8))
        if held:
            yield counted(current, held)

    blocks = df.mapInArrow(pack, "part int, block binary").repartition("part").sortWithinPartitions("part")
    return blocks.mapInArrow(count, "key long, n long")
