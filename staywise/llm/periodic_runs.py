"""Periodic runs of words: stretches that repeat with a period, found by longest common extensions on a difference cover.

A text is a sequence of words ``[^\\x20\\x09-\\x0D]+``. A run is a stretch with smallest period q, at least ``max(least, 2 * q)`` words long,
that no neighbouring word extends keeping the period. Every run of period p holds a pair of places (i, i + p) on the grid i = 0, p, 2p, ...
with i among its first p words, so the harmonic grid asks about n/1 + n/2 + ... pairs of neighbours only. A pair of equal words is
extended to both sides: a few words are compared until both places reach a sample of the difference cover, then the range minimum
over the common prefixes of the sorted samples tells the rest. Only suffixes at sampled places are sorted. A stretch that is found
under several periods is kept under the smallest, which is its own.

Spark deals out the rows; inside a task, texts are scanned in blocks of about 2 MB (a longer text makes a block of its own), so memory
follows the block. Words are numbered within their text by 64-bit hashes, taken as equal when equal, so no comparison crosses texts.

Null and empty texts have no words and no runs, their ``collapsed`` is an empty string. Rows are independent: null ids, repeated rows and ties
of any kind give a row each; no rows give none. Columns other than the id and the text are not read.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .bytescan import Block, binary_values, mix, slices, span_hashes
from .tables import per_batch

COVER = 64  # words; a sample lies within this distance of any pair of places
FEW = 8  # words compared to either side before a text is given sorted samples
CHUNK = 1 << 20  # grid pairs extended at once
WORD = r"[^\x20\x09-\x0D]+"


def difference_cover(v):
    """Residues such that any two places move by one distance below ``v`` onto two of them: 0..r-1 and the multiples of r, r = sqrt(v) up."""
    r = int(np.ceil(np.sqrt(v)))
    inside = np.zeros(v, bool)
    inside[:r] = True
    inside[::r] = True
    residues = np.flatnonzero(inside)
    step_to = np.full(v, -1)  # for each difference d a residue x with x and x + d in the cover
    for x in residues:
        step_to[(residues - x) % v] = x
    return inside, residues, step_to


class CommonExtensions:
    """Longest common prefixes of suffixes of one sequence of numbers. ``codes`` >= 1; every suffix must be unique (separators see to it)."""

    def __init__(self, codes, v=COVER):
        self.v, self.n = v, len(codes)
        self.codes = np.append(codes, np.zeros(2 * v, codes.dtype))
        self.inside, residues, self.step_to = difference_cover(v)
        places = (np.arange(0, self.n, v)[:, None] + residues[None, :]).ravel()
        self.rank_in_period = np.cumsum(self.inside) - 1
        self.per_period = len(residues)
        self.places = places[places < self.n]  # ascending; the sample v words later is per_period samples later
        names = [self._window_names()]
        hop = self.per_period
        while names[-1].max(initial=0) < len(self.places):
            now = names[-1].astype(np.int64)
            later = np.zeros(len(now), np.int64)
            later[: max(len(now) - hop, 0)] = now[hop:]
            names.append(np.unique(now * (len(now) + 1) + later, return_inverse=True)[1] + 1)
            hop *= 2
        self.rank = (names[-1] - 1).astype(np.int64)
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(order))
        self._minima(self._neighbours(order, names))

    def _window_names(self):
        """Numbers from 1 of the sampled windows of ``v`` words in lexicographic order; words are packed into 64-bit keys, last first."""
        bits = max(int(self.codes.max(initial=1)).bit_length(), 1)
        per_key = max(63 // bits, 1)

        def key(at):
            packed = np.zeros(len(self.places), np.int64)
            for k in range(at, at + per_key):
                packed = (packed << bits) | (self.codes[self.places + k] if k < self.v else 0)
            return packed

        order = np.arange(len(self.places))
        for at in reversed(range(0, self.v, per_key)):
            order = order[np.argsort(key(at)[order], kind="stable")]
        changed = np.zeros(len(order), bool)
        for at in range(0, self.v, per_key):
            ordered = key(at)[order]
            changed[1:] |= ordered[1:] != ordered[:-1]
        names = np.empty(len(order), np.int64)
        names[order] = np.cumsum(changed) + 1
        return names

    def _neighbours(self, order, names):
        """Common prefixes of samples next to each other in sorted order, from the widest equal windows down to single words."""
        a, b = order[:-1].copy(), order[1:].copy()
        total = np.zeros(len(a), np.int64)
        for level in reversed(range(len(names) - 1)):
            hop = self.per_period << level
            name = np.append(names[level], 0)
            both = (a < len(order)) & (b < len(order))
            equal = both & (name[np.minimum(a, len(order))] == name[np.minimum(b, len(order))])
            total[equal] += self.v << level
            a[equal] += hop
            b[equal] += hop
        place = np.append(self.places, self.n)
        return total + self.compare(place[np.minimum(a, len(order))], place[np.minimum(b, len(order))], np.full(len(a), self.v))

    def _minima(self, values):
        self.table = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def compare(self, i, j, limit):
        """Equal words from places ``i`` and ``j`` on, at most ``limit`` (an array) of them, one by one."""
        length = np.zeros(len(i), np.int64)
        alive = np.flatnonzero(limit > 0)
        step = 0
        while len(alive):
            alive = alive[self.codes[i[alive] + step] == self.codes[j[alive] + step]]
            step += 1
            length[alive] = step
            alive = alive[limit[alive] > step]
        return length

    def lce(self, i, j):
        """Longest common prefix of the suffixes at ``i`` and ``j`` (arrays, i < j)."""
        toward = (self.step_to[(j - i) % self.v] - i) % self.v
        near = self.compare(i, j, np.minimum(toward, self.n - j))
        length = near.copy()
        far = np.flatnonzero((near == toward) & (j + toward < self.n))
        if len(far):
            a, b = self._sample(i[far] + toward[far]), self._sample(j[far] + toward[far])
            low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                row = self.table[k]
                least[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
            length[far] += least
        return length

    def _sample(self, place):
        return place // self.v * self.per_period + self.rank_in_period[place % self.v]


def grid_pairs(codes, longest, chunk=CHUNK):
    """Pairs (i, p) of equal codes at i and i + p, i a multiple of p, for all periods p up to ``longest``, in chunks.

    Short periods are compared period by period, long ones by the number of the grid place: the places k*p of all p are one slice of step k.
    """
    n = len(codes)
    longest = min(longest, n - 1)
    turn = min(int(np.sqrt(n)), longest)

    def equal():
        for p in range(1, turn + 1):
            at = np.flatnonzero(codes[: n - p : p] == codes[p::p])
            yield at * p, np.full(len(at), p)
        low = turn + 1
        for k in range(n // low if low <= longest else 0):
            high = min(longest, (n - 1) // (k + 1))
            if high < low:
                break
            here = codes[k * low : k * high + 1 : k] if k else codes[0]
            p = np.flatnonzero(here == codes[(k + 1) * low : (k + 1) * high + 1 : k + 1]) + low
            yield k * p, p

    size, held = 0, []
    for i, p in equal():
        if len(i):
            held.append((i, p))
            size += len(i)
        if size >= chunk:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            size, held = 0, []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _few_equal(codes, i, j, step):
    """Equal codes from ``i`` and ``j`` on in one direction, at most ``FEW``. The ends of ``codes`` are separators."""
    length = np.zeros(len(i), np.int64)
    alive = np.arange(len(i))
    for k in range(FEW):
        alive = alive[codes[i[alive] + step * k] == codes[j[alive] + step * k]]
        if not len(alive):
            break
        length[alive] = k + 1
    return length


def may_repeat(codes, longest, least):
    """Places whose pair has enough equal words around it to need the sorted samples; texts without any have no run."""
    found = []
    for i, p in grid_pairs(codes, longest):
        ahead, behind = _few_equal(codes, i, i + p, 1), _few_equal(codes, i - 1, i + p - 1, -1)
        open_end = (ahead == FEW) | (behind == FEW)
        both = ahead + behind
        found.append(i[open_end | ((both >= p) & (both + p >= least))])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def find_runs(codes, longest, least):
    """(start, end, period) of all runs of a sequence of texts, each between separators that occur once."""
    forward, backward = CommonExtensions(codes), CommonExtensions(codes[::-1])
    n = len(codes)
    runs = np.zeros((0, 3), np.int64)
    for i, p in grid_pairs(codes, longest):
        ahead = forward.lce(i, i + p)
        behind = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        behind[inner] = backward.lce(n - i[inner] - p[inner], n - i[inner])
        good = (ahead + behind >= p) & (behind < p) & (ahead + behind + p >= least)
        new = np.stack([i - behind, i + p + ahead, p], axis=1)[good]
        runs = np.concatenate([runs, new])
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        first = np.ones(len(runs), bool)
        first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[first]
    return runs


def _codes(words, rows, starts_of_rows, extra):
    """Numbers of words within their text, from 1, with a separator of its own before each text and one at the end."""
    keys = mix(words ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    codes = np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1
    base = int(codes.max(initial=0)) + 1
    separators = np.arange(base, base + extra + 1)
    return np.insert(codes, np.append(starts_of_rows, len(words)), separators)


def block_runs(hashes, first, least):
    """(text, start, end, period) of the runs of a block: word hashes and the first word of each text (one more at the end)."""
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(hashes) or counts.max() < max(least, 2):
        return np.zeros((0, 4), np.int64)
    codes = _codes(hashes, rows, first[:-1], len(counts))
    places = may_repeat(codes, int(counts.max()) // 2, least)
    if not len(places):
        return np.zeros((0, 4), np.int64)
    begins = first[:-1] + np.arange(len(counts))  # of each text's separator
    texts = np.unique(np.searchsorted(begins, places, "right") - 1)
    chosen = np.isin(rows, texts)
    sizes = counts[texts]
    begin = np.cumsum(sizes) - sizes
    codes = _codes(hashes[chosen], rows[chosen], begin, len(texts))
    runs = find_runs(codes, int(sizes.max()) // 2, least)
    begins = begin + np.arange(len(texts))
    text = np.searchsorted(begins, runs[:, 0], "right") - 1
    offset = begins[text] + 1
    return np.column_stack([texts[text], runs[:, 0] - offset, runs[:, 1] - offset, runs[:, 2]])


def periodic_runs(docs, least=12, doc_id="doc_id", text="text"):
    """One row per row of ``docs``: doc_id, ``runs`` (start and length in words, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the words that some run repeats: all of a run after its first period. Words are joined by one space.
    """

    def scan(batch):
        ids, values = batch.column(0), binary_values(batch.column(1))
        for low, high in slices(values):
            block = Block(values[low:high])
            starts, ends, first = block.words()
            runs = block_runs(span_hashes(block.codes, starts, ends), first, least)
            repeated = np.zeros(len(starts) + 1, np.int64)
            np.add.at(repeated, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
            np.add.at(repeated, first[runs[:, 0]] + runs[:, 2], -1)
            kept = np.cumsum(repeated)[:-1] == 0
            per_row = np.bincount(runs[:, 0], minlength=high - low)
            entry = pa.StructArray.from_arrays(
                [pa.array(x) for x in (runs[:, 1], runs[:, 2] - runs[:, 1], runs[:, 3])], names=["start", "length", "period"]
            )
            yield {
                "doc_id": ids.slice(low, high - low),
                "runs": pa.ListArray.from_arrays(np.append(0, np.cumsum(per_row)).astype(np.int32), entry),
                "collapsed": joined_words(block, starts, ends, first, kept),
            }

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return per_batch(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scan, schema)


def joined_words(block, starts, ends, first, kept):
    """The kept words of each row joined by one space, as an Arrow array of strings."""
    place = np.flatnonzero(kept)
    last_of_row = np.zeros(len(place), bool)
    row_of = np.searchsorted(first, place, "right") - 1
    if len(place):
        last_of_row[-1] = True
        last_of_row[:-1] = row_of[1:] != row_of[:-1]
    until = ends[place] + ~last_of_row  # with the byte after the word, which becomes the space
    edges = np.zeros(len(block.codes) + 1, np.int8)
    edges[starts[place]] += 1
    edges[until] -= 1
    bytes_kept = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    codes = block.codes.copy()
    codes[ends] = 32
    sizes = np.bincount(row_of, weights=until - starts[place], minlength=block.rows).astype(np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    return pa.LargeStringArray.from_buffers(
        block.rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(codes[bytes_kept])
    ).cast(pa.string())


def with_planted_periods(docs):
    """Texts of every tenth document (by the checksum of its id) made periodic from some word on; the others as they are."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return (
        docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))
        .withColumn("words", F.when(F.col("planted"), words))
        .withColumn("n", F.size("words"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
        .withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
        .withColumn("tail", F.col("n") - F.col("a"))
        .withColumn("period", F.slice("words", F.col("a") + 1, F.col("p")))
        .withColumn("copies", F.flatten(F.array_repeat("period", F.ceil(F.col("tail") / F.col("p")).cast("int"))))
        .withColumn("edited", F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice("copies", F.lit(1), F.col("tail"))))
        .select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", "edited")).otherwise(F.col("text")).alias("text"))
    )


def run_digests(runs):
    """Per document the number of runs, the longest one and digests of all runs and of the collapsed text."""
    by_size = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    longest = runs.withColumn("longest", F.array_min(by_size))
    length = -F.col("longest.l")
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(length * 1000 / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
