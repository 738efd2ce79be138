"""Best-two-fit packing of documents into sequences of fixed length, planned on the histogram of piece lengths.

A plan needs the number of pieces of each length only: at most ``capacity`` numbers, whatever the corpus holds. Each planned bin is filled
greedily with the largest lengths that fit; then its smallest piece is exchanged for two unpacked ones when they fill the
bin more tightly. The bin is repeated as often as the counts allow, so the plan has about as many steps as there are lengths. Spark numbers
the pieces of each length and reads every piece's sequence and offset from the plan.

Null and empty texts are one end token. Repeated rows are packed each. No rows give no pieces. Other columns are dropped.
"""
import zlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .bpe import END_ID, encoder, vocabulary_path
from .bytescan import binary_values, slices
from .tables import per_batch, stage

CAPACITY = 2048
BUCKET_ROWS = 1_000  # pieces of one length numbered by one window group, about
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoded_pieces(docs, capacity=CAPACITY, vocabulary=None):
    """The pieces of every document: its ids and an end id, cut only where longer than ``capacity``; the first piece takes the rest."""
    vocabulary = vocabulary or vocabulary_path()

    def cut(batch):
        keys, values = batch.column(0).to_pylist(), binary_values(batch.column(1))
        out = {c.split()[0]: [] for c in PIECES.split(", ")}
        for a, b in slices(values):
            ids, bounds = encoder(vocabulary).encode(values[a:b])
            for k in range(b - a):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END_ID)).astype("<u4")
                count = -(-len(own) // capacity)
                begin, end = 0, len(own) - capacity * (count - 1)
                for piece in range(count):
                    for name, value in zip(out, (keys[a + k], piece, begin, end - begin, zlib.crc32(own[begin:end].tobytes())), strict=True):
                        out[name].append(value)
                    begin, end = end, end + capacity
        yield out

    return per_batch(docs.select("doc_id", "text"), cut, PIECES)


def _largest(counts, limit):
    """The largest length up to ``limit`` that still has pieces, or 0."""
    left = np.flatnonzero(counts[: limit + 1])
    return int(left[-1]) if len(left) else 0


def _best_two(counts, room):
    """Two lengths with pieces left whose sum comes closest to ``room`` from below; (0, 0) if none."""
    lengths = np.flatnonzero(counts[: room + 1])
    if not len(lengths):
        return 0, 0
    at = np.searchsorted(lengths, room - lengths, "right") - 1
    partner = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    twice = (partner == lengths) & (counts[lengths] < 2)
    partner = np.where(twice, np.where(at >= 1, lengths[np.maximum(at - 1, 0)], 0), partner)
    total = np.where(partner > 0, lengths + partner, 0)
    best = int(np.argmax(total))
    return (int(lengths[best]), int(partner[best])) if total[best] else (0, 0)


def plan_bins(histogram, capacity=CAPACITY):
    """[(times, {length: pieces in the bin})] that uses up ``histogram`` ({length: pieces})."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while counts.any():
        left, inside, gap = counts.copy(), {}, capacity
        while length := _largest(left, gap):
            n = int(min(left[length], gap // length))
            inside[length] = inside.get(length, 0) + n
            left[length] -= n
            gap -= n * length
        smallest = min(inside)
        if gap and len(inside) + inside[smallest] > 2:
            a, b = _best_two(left, gap + smallest)
            if a + b > smallest:
                inside[smallest] -= 1
                for x in (a, b):
                    inside[x] = inside.get(x, 0) + 1
                inside = {x: n for x, n in inside.items() if n}
        times = int(min(counts[x] // n for x, n in inside.items()))
        for x, n in inside.items():
            counts[x] -= times * n
        plan.append((times, inside))
    return plan


def _slots(plan):
    """(length, [(first rank, pieces, pieces per bin, first sequence, offset)]) of a plan."""
    taken, slots, sequence = {}, {}, 0
    for times, inside in plan:
        offset = 0
        for length, n in sorted(inside.items(), reverse=True):
            rank = taken.get(length, 0)
            slots.setdefault(length, []).append((rank, times * n, n, sequence, offset))
            taken[length] = rank + times * n
            offset += n * length
        sequence += times
    return sorted(slots.items())


def pack(pieces, capacity=CAPACITY):
    """``pieces`` with sequence_id and offset. Runs one aggregation to plan; ``pieces`` should be a stored table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slot = "array<struct<rank:bigint,n:bigint,each:bigint,sequence:bigint,base:bigint>>"
    slots = [(n, 1 + histogram[n] // BUCKET_ROWS, of) for n, of in _slots(plan_bins(histogram, capacity))]
    plan = F.broadcast(spark.createDataFrame(slots, f"length long, buckets long, slots {slot}"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("buckets"))
    rows = pieces.join(plan.drop("slots"), "length").withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        rows.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1).join(firsts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("place")).join(plan.drop("buckets"), "length")
    fits = F.filter("slots", lambda s: (s["rank"] <= F.col("rank")) & (F.col("rank") < s["rank"] + s["n"]))[0]
    within = F.col("rank") - F.col("slot.rank")
    return ranked.withColumn("slot", fits).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("slot.sequence") + F.floor(within / F.col("slot.each"))).alias("sequence_id"),
        (F.col("slot.base") + (within % F.col("slot.each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs, capacity=CAPACITY, vocabulary=None):
    """Encode, cut and pack ``docs`` (doc_id, text)."""
    return pack(stage(encoded_pieces(docs, capacity, vocabulary), "pieces"), capacity)
