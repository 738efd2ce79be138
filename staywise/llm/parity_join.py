"""Exact Jaccard join of shingle sets with parity sketches.

A set's sketch has p cells; every shingle's hash is XORed into one cell. Two cells can differ only if the symmetric difference has a shingle there, so
the number of differing cells never exceeds the symmetric difference, which the threshold bounds by the sets' sizes. Within a
size band all sketches have the same p, larger than that bound d, so at least p - d cells of a linked pair are equal (pigeonhole).
Cells are ordered, values of one set only before all others, and each set joins by its d + 1 first cells only: the first equal cell of
a pair is among these on both sides. Cells of one set need no join, so a set with more than d of them joins nowhere. A filter of fixed
size tells them apart; its errors only move cells to the back of the order, which is a total order of the values like any other.

Equal sets are merged first. Sets that meet in a cell are compared with that cell's most central set, the one with the fewest cells of its
own (the original among its copies), and with its smallest; linked ones are
united; only sets that still lie in different components, meet in a cell and do not have too many cells of their own are then compared with
each other. So a large group costs about its size, and no link between components is lost. All comparisons are exact intersections of shingle hashes
(64 bits; equal hashes of different shingles or sets are taken as equal).

A text of fewer words than a shingle is one shingle; null, empty and wordless texts have no shingles and stand alone. Repeated
rows and rows with the same id get a row each. No rows give none. Other columns are dropped.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytescan import Block, binary_values, in_row_windows, mix, slices, span_hashes, window_hashes
from .components import components
from .repeat_filter import limits_passed, repeated, sized_filter
from .tables import per_batch, small, stage, text_key

BAND_GROWTH = 1.25
SPARE_CELLS = 2
ROWS_AT_ONCE = 1_000
BYTES_AT_ONCE = 1 << 18
MARK_BITS = 256
OFTEN = (1, 3, 8, 24, 100, 1000)  # sets that share a cell: classes of the order of cells


def shingle_sets(values, width):
    """Sorted distinct shingle hashes of every text (list of bytes or None)."""
    out = []
    for a, b in slices(values, BYTES_AT_ONCE):
        block = Block(values[a:b], lower=True)
        starts, ends, first = block.words()
        words = span_hashes(block.codes, starts, ends)
        counts = np.diff(first)
        windows = window_hashes(words, width)
        places, _ = in_row_windows(first, width)
        hashes, until = windows[places], np.cumsum(np.maximum(counts - width + 1, 0))
        for k in range(b - a):
            n = int(counts[k])
            if n >= width:
                out.append(np.unique(hashes[until[k] - (n - width + 1) : until[k]]))
            else:
                out.append(window_hashes(words[first[k] : first[k + 1]], n) if n else np.zeros(0, np.uint64))
    return out


def set_hash(hashes):
    """One number for a set of shingle hashes, None for an empty set."""
    if not len(hashes):
        return None
    total = mix(hashes).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes))
    return int(mix(total).view(np.int64)[0])


class Scheme:
    """Sizes of bands, sketches and prefixes for the threshold num / den."""

    def __init__(self, num, den):
        self.num, self.den = num, den

    def band(self, n):
        """Number of the size band of ``n`` and the largest size in it."""
        number, low = 0, 1
        while True:
            high = max(low, int(low * BAND_GROWTH) - 1)
            if n <= high:
                return number, high
            number, low = number + 1, high + 1

    def plan(self, n):
        """[(band, cells, prefix)] in which a set of ``n`` shingles takes part."""
        if n not in _plans.setdefault((self.num, self.den), {}):
            out = []
            number, high = self.band(n)
            last, _ = self.band(n * self.den // self.num)
            while number <= last:
                bound = 2 * high * (self.den - self.num) // (self.den + self.num)
                own = min(n * (self.den - self.num) // self.num, bound)
                out.append((number, int(SPARE_CELLS * (bound + 1)) + 1, own + 1))
                number, high = self.band(high + 1)
            _plans[(self.num, self.den)][n] = out
        return _plans[(self.num, self.den)][n]


_plans = {}


def sketch(hashes, band, cells):
    """The join keys of all cells of a set's sketch."""
    salted = mix(hashes + np.uint64(band * 2 + 1))
    order = np.argsort((salted % np.uint64(cells)).astype(np.int32), kind="stable")
    cell = (salted % np.uint64(cells)).astype(np.int64)[order]
    parity = np.zeros(cells, np.uint64)
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    parity[cell[begin]] = np.bitwise_xor.reduceat(mix(salted[order]), begin)
    return mix(parity + mix(np.arange(cells, dtype=np.uint64) + np.uint64(band << 32)))


def sized_sets(docs, width):
    """One row per row of ``docs``: id and text key, hash of the row, size and hash of its set."""

    def build(batch):
        ids, texts, keys, rows = batch.columns
        values = binary_values(texts)
        for a, b in slices(values, BYTES_AT_ONCE):
            sets = shingle_sets(values[a:b], width)
            known = {name: column.slice(a, b - a) for name, column in (("doc_id", ids), ("tkey", keys), ("h", rows))}
            yield {**known, "n_shingles": [len(s) for s in sets], "e": [set_hash(s) for s in sets]}

    asked = docs.select("doc_id", "text", text_key(F.col("text")), _row_hash())
    return per_batch(asked, build, "doc_id long, tkey string, h long, n_shingles long, e long")


def _row_hash():
    return F.xxhash64("doc_id", "text")


def hash_filter(hashes):
    """A table of bits for ``hashes`` (key, all different), sent to all executors."""
    keys = stage(hashes.select("key", F.lit(2).alias("n")), "hashes")
    return hashes.sparkSession.sparkContext.broadcast(sized_filter(keys))


def _marked(shared, column):
    return limits_passed(shared.value, column.fill_null(0).to_numpy().view(np.uint64)) > 0


def marked_rows(docs, hashes):
    """``docs`` with ``may_be``: whether a row's hash may be among ``hashes`` (key, all different). Rows without it are surely not."""
    shared, kept = hash_filter(hashes), docs.columns
    schema = docs.withColumn("may_be", F.lit(True)).schema

    def test(batches):
        for batch in batches:
            columns = [*batch.columns[: len(kept)], pa.array(_marked(shared, batch.column(len(kept))))]
            yield pa.record_batch(columns, names=[*kept, "may_be"])

    return docs.withColumn("row_hash", _row_hash()).mapInArrow(test, schema)


def distinct_texts(docs, rows, width):
    """(table, function): one text for each set of ``rows``, the sizes and hashes of the sets of ``docs``.

    A set's text is read again where it has one row, stored where it has more; only the latter (and the few that a table of bits takes
    for such) are shuffled. The table has (text, row_hash), the function gives the texts of a batch of it, without rows that are stored.
    """
    many = rows.where("e IS NOT NULL").groupBy("e").agg(F.count("*").alias("n")).where("n > 1").select("e")
    marked = hash_filter(rows.join(many, "e", "left_semi").select(F.col("h").alias("key")).distinct())

    def hashed(batch):
        values = binary_values(batch.column(0).filter(pa.array(_marked(marked, batch.column(1)))))
        for a, b in slices(values, BYTES_AT_ONCE):
            yield {"e": [set_hash(s) for s in shingle_sets(values[a:b], width)], "text": values[a:b]}

    given = docs.select("text", _row_hash().alias("row_hash"))
    again = per_batch(given, hashed, "e long, text binary").where("e IS NOT NULL")
    stored = stage(again.groupBy("e").agg(F.first("text").cast("string").alias("text")).select("text"), "texts-met-again")

    def values_of(batch):
        stored = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        return binary_values(batch.column(0).filter(pa.array(stored | ~_marked(marked, batch.column(1)))))

    return given.unionByName(stored.withColumn("row_hash", F.lit(None).cast("long"))), values_of


def _sets(batch, values_of, width):
    """The sets that have shingles, of a batch of ``distinct_texts``."""
    for start in range(0, len(batch), ROWS_AT_ONCE):
        values = values_of(batch.slice(start, ROWS_AT_ONCE))
        for a, b in slices(values, BYTES_AT_ONCE):
            yield from (s for s in shingle_sets(values[a:b], width) if len(s))


def _sketched(batch, values_of, width, scheme):
    """(set, [(cells of one sketch, prefix)]) of the sets that have shingles."""
    for s in _sets(batch, values_of, width):
        yield s, [(sketch(s, band, p), prefix) for band, p, prefix in scheme.plan(len(s))]


def cell_counts(texts, values_of, width, scheme):
    """(key, n): cell values that more than one sketch may have (cut, see ``repeated``); ``texts``, ``values_of``: see ``distinct_texts``."""

    def keys(batch):
        for _, cells in _sketched(batch, values_of, width, scheme):
            yield from (c for c, _ in cells)

    return repeated(texts, keys, OFTEN[-1] + 1)


def prefixes(texts, values_of, repeats, width, scheme):
    """(e, n, band, own, marks, cells): the cells by which each set joins in a band, and how many and which cells of that sketch no other set has.

    Those come first in the order and need no join; then cells of few sets before cells of many. Sketches without cells to join by are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(repeats)

    def choose(batch):
        out = {name: [] for name in ("e", "n", "band", "own", "marks", "cells")}
        for s, cells in _sketched(batch, values_of, width, scheme):
            for (part, prefix), (band, _, _) in zip(cells, scheme.plan(len(s)), strict=True):
                rank = limits_passed(shared.value, part)
                single = int((rank == 0).sum())
                chosen = part[np.lexsort((part, rank))[single : max(single, prefix)]]
                folded = np.zeros(MARK_BITS, bool)
                folded[np.flatnonzero(rank == 0) % MARK_BITS] = True
                found = (set_hash(s), len(s), band, single, np.packbits(folded).view(np.int64).tolist(), chosen.view(np.int64))
                for column, value in zip(out.values(), found, strict=True):
                    column.append(value)
        yield out

    return per_batch(texts, choose, "e long, n long, band int, own long, marks array<long>, cells array<long>").where(F.size("cells") > 0)


def sets_of(texts, values_of, wanted, width):
    """(e, shingles) of the sets in ``wanted`` (e, all different), read again from ``texts`` (see ``distinct_texts``); a few more that a table of bits takes for such."""
    shared = hash_filter(wanted.select(F.col("e").alias("key")))

    def build(batch):
        kept = [(e, s.tobytes()) for s in _sets(batch, values_of, width) if limits_passed(shared.value, np.array([e := set_hash(s)]).view(np.uint64))[0]]
        yield {"e": [e for e, _ in kept], "shingles": [s for _, s in kept]}

    return per_batch(texts, build, "e long, shingles binary")


def verified(pairs, shingles, scheme):
    """The (a, b) of ``pairs`` whose sets reach the threshold."""
    joined = pairs.join(shingles.select(F.col("e").alias("a"), F.col("shingles").alias("x")), "a").join(
        shingles.select(F.col("e").alias("b"), F.col("shingles").alias("y")), "b"
    )

    def compare(batch):
        a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
        keep = []
        for k in range(len(a)):
            left, right = np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64)
            if len(left) > len(right):
                left, right = right, left
            at = np.minimum(np.searchsorted(right, left), len(right) - 1)
            common = int((right[at] == left).sum())
            if scheme.den * common >= scheme.num * (len(left) + len(right) - common):
                keep.append(k)
        yield {"a": [a[k] for k in keep], "b": [b[k] for k in keep]}

    return per_batch(joined.select("a", "b", "x", "y"), compare, "a long, b long")


def _identity():
    """What tells a row apart, ordered by id and text key with null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("tkey"))


def _sizes_fit(scheme, n, m):
    return scheme.den * F.least(n, m) >= scheme.num * F.greatest(n, m)


def _cells_fit(scheme):
    """Cells that only x or only y has differ between them, so there are no more of these than the threshold lets differ (folded to MARK_BITS)."""
    words = range(MARK_BITS // 64)
    differing = sum((F.bit_count(F.col("x.marks")[k].bitwiseOR(F.col("y.marks")[k])) for k in words), F.lit(0))
    return differing * (scheme.den + scheme.num) <= (F.col("x.n") + F.col("y.n")) * (scheme.den - scheme.num)


def jaccard_components(docs, width=3, num=90, den=100):
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text); component_id is the smallest doc_id reachable."""
    return jaccard_groups(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs, width=3, num=90, den=100):
    """``jaccard_components`` with ``first``: the smallest (doc_id, text key) reachable, null ids last, and the text key and hash of every row."""
    scheme = Scheme(num, den)
    rows = stage(sized_sets(docs, width), "set-sizes")
    sets = rows.where("e IS NOT NULL").groupBy("e").agg(F.min("doc_id").alias("rep"), F.min(_identity()).alias("first"))
    texts = distinct_texts(docs, rows, width)
    repeats = sized_filter(stage(cell_counts(*texts, width, scheme), "cells-repeated"), OFTEN)
    chosen = stage(prefixes(*texts, repeats, width, scheme), "sketch-prefixes")
    keyed = chosen.select("e", "n", "band", "own", F.explode("cells").alias("key"))
    of_key = Window.partitionBy("key")
    met = keyed.select(
        *("key", "e", "n", "band"),
        F.min(F.struct("own", "e", "n")).over(of_key).alias("middle"),
        F.min(F.struct(F.lit(0).cast("long").alias("own"), "e", "n")).over(of_key).alias("low"),
        F.max("e").over(of_key).alias("high"),
    )
    met = stage(met.where("low.e <> high").drop("high"), "cells-shared")
    ends = F.explode(F.array("middle", "low")).alias("end")
    first = met.select("e", "n", ends).where((F.col("e") != F.col("end.e")) & _sizes_fit(scheme, F.col("n"), F.col("end.n")))
    first = stage(first.select(F.least("e", "end.e").alias("a"), F.greatest("e", "end.e").alias("b")).distinct(), "first-pairs")
    shingles = stage(sets_of(*texts, met.select("e").distinct(), width), "shingle-sets")
    links = stage(verified(first, shingles, scheme), "first-links")
    roots = stage(components(links), "first-components")
    grouped = met.select("key", "e", "n", "band").join(roots.select(F.col("node").alias("e"), "root"), "e", "left")
    grouped = grouped.select("key", "e", "n", "band", F.coalesce("root", "e").alias("root"))
    mixed = grouped.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l <> h").select("key")
    apart = stage(grouped.join(mixed, "key").join(chosen.select("e", "band", "marks"), ["e", "band"]), "cells-apart")
    x, y = apart.alias("x"), apart.alias("y")
    met_again = (F.col("x.key") == F.col("y.key")) & (F.col("x.e") < F.col("y.e")) & (F.col("x.root") != F.col("y.root"))
    again = x.join(y, met_again & _sizes_fit(scheme, F.col("x.n"), F.col("y.n")) & _cells_fit(scheme))
    again = again.select(F.col("x.e").alias("a"), F.col("y.e").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionByName(verified(stage(again, "second-pairs"), shingles, scheme))
    roots = stage(components(links), "components")
    reps = sets.join(roots.select(F.col("node").alias("e"), "root"), "e", "left")
    reps = reps.select("e", "rep", "first", F.coalesce("root", "e").alias("root"))
    smallest = reps.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("first").alias("first"))
    of_set = stage(reps.select("e", "root").join(smallest, "root").select("e", "component_id", "first"), "set-components")
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    return rows.join(of_set, "e", "left").select("doc_id", "n_shingles", component, F.coalesce("first", _identity()).alias("first"), "tkey", "h")
