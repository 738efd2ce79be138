"""Spelling variants by permuterm rotations: words that differ by one inserted, deleted or replaced code point.

A word ``w`` marked with a terminator, ``w$``, is written in all its rotations. Take ``w = x c y``: the rotation that starts after c is
``y$x`` followed by c, so skipping its last character leaves the range ``y$x``, which is shared by exactly the words ``x ? y`` with another
character in c's place and, as a whole rotation, by the word ``x y`` without it. Sorted by these ranges, near words stand side by side:
one scan over the groups counts every word's neighbours and names its best one. A group holds one word per character of the alphabet and
one more, and each member sends one row (never all pairs). Deleting any letter of a run of equal letters gives the same word; only the
first one counts, so no pair of words is met twice.

Words are numbered by falling count, then code-point order, so the smaller number is the better form and only numbers are shuffled with the
ranges. Ranges of more than ``LONG`` characters stand as 127-bit rolling digests, taken as equal when equal, so a word of any length
makes rows of bounded size.

Null and empty texts hold no words. A null id keeps its words unedited. Repeated rows count each. Ties between forms go to the
smallest word. No rows, or no word frequent enough, give an empty result. Other columns are not read.
"""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bytescan import Block, binary_values, slices, span_hashes
from .tables import per_batch, stage

TERMINATOR = "\0"
LONG = 128  # characters of a range that is kept as it is
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
EDITED = 199  # in the query, one word in so many of a document loses a letter
FAR, ANYWHERE, FIRST_OF_RUN = 0, 1, 2  # a whole rotation; a skipped letter; a skipped letter that differs from the one before
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), 0xC3]] = True


def _crc_table():
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def _crc32(codes, starts, ends, seeds):
    """crc32 of every span, continued from ``seeds`` (crc32 of what stands before it); long spans one by one."""
    sizes = ends - starts
    state = seeds.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    long = int((sizes > 64).sum())
    short = order[long:]
    ordered, at = sizes[short], starts[short]
    now = state[short]
    for k in range(int(ordered.max(initial=0))):
        n = int(np.searchsorted(-ordered, -k, "left"))  # spans of more than k bytes
        now[:n] = _CRC[(now[:n] ^ codes[at[:n] + k]) & 255] ^ (now[:n] >> np.uint32(8))
    state[short] = now
    state ^= np.uint32(0xFFFFFFFF)
    for k in order[:long]:
        state[k] = zlib.crc32(codes[starts[k] : ends[k]].tobytes(), int(seeds[k]))
    return state


def _words_of(block, least):
    """Starts, ends and code points of the runs of letters a-z and U+00C0..U+00FF of at least ``least`` code points."""
    inside = _LETTER[block.codes]
    lead = block.codes == 0xC3
    inside[1:] |= lead[:-1]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    wide = np.append(0, np.cumsum(lead))
    points = ends - starts - (wide[ends] - wide[starts])
    good = points >= least
    return starts[good], ends[good], points[good]


def word_counts(docs, least_length=LEAST_LENGTH, edited=None, doc_id="doc_id", text="text"):
    """(word, n) over all texts, for words of at least ``least_length`` code points; A-Z are lower-cased.

    ``edited``: a test edit that deletes code point h % length of each word of a document whose h = crc32 of ``<id>:<word>`` it divides.
    """

    def count(batch):
        ids, values = batch.column(0).to_pylist(), binary_values(batch.column(1))
        for low, high in slices(values):
            block = Block(values[low:high], lower=True)
            starts, ends, points = _words_of(block, least_length)
            plain, n_edited = np.ones(len(starts), bool), {}
            if edited:
                row = np.searchsorted(block.row_ends, starts, "right")
                known = np.array([i is not None for i in ids[low:high]], bool)
                seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[low:high]], np.uint32)
                h = _crc32(block.codes, starts, ends, seeds[row])
                plain = (h % edited != 0) | ~known[row]
                for k in np.flatnonzero(~plain):
                    word = block.blob[starts[k] : ends[k]].decode()
                    gone = int(h[k]) % len(word)
                    if len(word) > least_length:
                        word = word[:gone] + word[gone + 1 :]
                        n_edited[word] = n_edited.get(word, 0) + 1
            starts, ends = starts[plain], ends[plain]
            _, first, n = np.unique(span_hashes(block.codes, starts, ends), return_index=True, return_counts=True)
            spans = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
            words = [block.blob[a:b].decode() for a, b in spans]
            yield {"word": words + list(n_edited), "n": n.tolist() + list(n_edited.values())}

    local = per_batch(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), count, "word string, n long")
    return local.groupBy("word").agg(F.sum("n").alias("n"))


def numbered(counts):
    """The words with ``rank``: ascending by falling count, then code-point order."""
    ordered = counts.repartitionByRange(F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word"))
    return stage(ordered.withColumn("rank", F.monotonically_increasing_id()), "spelling-words")


class _Ranges:
    """Parts of a word's doubled, marked text as keys; long ones as rolling digests in constant time each."""

    def __init__(self, word):
        self.text = word + TERMINATOR + word
        self.sums = None
        if len(word) >= LONG:
            self.sums, self.powers = [0], [1]
            for c in self.text:
                self.sums.append((self.sums[-1] * _BASE + ord(c) + 1) % _PRIME)
                self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def key(self, a, b):
        if b - a <= LONG:
            return self.text[a:b]
        return f"{b - a}:{(self.sums[b] - self.sums[a] * self.powers[b - a]) % _PRIME:x}"


def rotation_rows(words):
    """(range, rank, kind) for every rotation of every word: once whole, once without its last character."""

    def rotate(batch):
        keys, ranks, kinds = [], [], []
        for word, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ranges, size = _Ranges(word), len(word)
            for i in range(size + 1):
                keys.append(ranges.key(i, i + size + 1))
                kinds.append(FAR)
            for i in range(size):
                keys.append(ranges.key(i + 1, i + 1 + size))
                kinds.append(FIRST_OF_RUN if i == 0 or word[i - 1] != word[i] else ANYWHERE)
            ranks += [rank] * (2 * size + 1)
            if len(keys) > 200_000:
                yield {"range": keys, "rank": ranks, "kind": kinds}
                keys, ranks, kinds = [], [], []
        yield {"range": keys, "rank": ranks, "kind": kinds}

    return per_batch(words.select("word", "rank"), rotate, "range string, rank long, kind byte")


def _scan(same_as_before, rank, kind):
    """Neighbours of the rows of whole groups, each group sorted by rank: (rows with any, how many, rank of the best one)."""
    n, none = len(rank), np.iinfo(np.int64).max
    group = np.cumsum(~same_as_before) - 1
    size = int(group[-1]) + 1
    place = np.arange(n)
    skipped, far, first = kind != FAR, kind == FAR, kind == FIRST_OF_RUN

    def lowest(rows):
        out = np.full(size, none)
        np.minimum.at(out, group[rows], place[rows])
        return out

    members = np.flatnonzero(skipped)
    top = lowest(members)
    second = lowest(members[place[members] != top[group[members]]])
    whole, top_first = lowest(np.flatnonzero(far)), lowest(np.flatnonzero(first))
    n_skipped, n_first = np.bincount(group[skipped], minlength=size), np.bincount(group[first], minlength=size)
    has_whole = whole[group] != none
    near = np.where(skipped, n_skipped[group] - 1 + (first & has_whole), n_first[group])
    other = np.where(place == top[group], second[group], top[group])
    best = np.where(skipped, np.where(first, np.minimum(other, whole[group]), other), top_first[group])
    found = np.flatnonzero(near > 0)
    return found, near[found], rank[best[found]]


def neighbours(words):
    """(rank, n_near, best): for every word with near words, how many and the rank of the most frequent one."""
    rows = rotation_rows(words).repartition("range").sortWithinPartitions("range", "rank")
    schema = "rank long, n_near long, best long"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def scan(batches):
        held = None
        for batch in batches:
            table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            held = table.combine_chunks()
            if not len(held):
                continue
            keys = held.column("range").chunk(0)
            begins = _group_starts(keys)
            last = int(begins[-1])
            if last:
                yield from found(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield from found(held)

    def found(table):
        table = table.combine_chunks()
        same = np.ones(len(table), bool)
        same[_group_starts(table.column("range").chunk(0))] = False
        rank, kind = (table.column(c).to_numpy() for c in ("rank", "kind"))
        at, near, best = _scan(same, rank, kind)
        yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (rank[at], near, best)], schema=target)

    return rows.mapInArrow(scan, schema).groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _group_starts(keys):
    import pyarrow.compute as pc

    changed = np.ones(len(keys), bool)
    if len(keys) > 1:
        changed[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def roots(links, steps):
    """``links`` (rank, form) with every form followed to the last one, by doubling: chains of up to 2^steps links."""
    for _ in range(steps):
        further = links.select(F.col("rank").alias("form"), F.col("form").alias("next"))
        links = stage(links.join(further, "form", "left").select("rank", F.coalesce("next", "form").alias("form")), "spelling-roots")
    return links


def spelling_groups(counts, ratio=FORM_RATIO):
    """One row per word of ``counts`` (word, n): its form (the most frequent near word, if ``ratio`` times as frequent), the root its forms
    lead to (itself without one), n, n_near and form_n."""
    words = numbered(counts)
    near = stage(
        words.join(neighbours(words), "rank", "left").select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best"),
        "spelling-near",
    )
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = stage(
        near.where("best is not null").join(best, "best").where(F.col("form_n") >= ratio * F.col("n")).select("rank", "best", "form", "form_n"),
        "spelling-forms",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    links = 1  # a chain multiplies the count by the ratio at each link
    while ratio ** (links + 1) <= most:
        links += 1
    ends = roots(linked.select("rank", F.col("best").alias("form")), (links - 1).bit_length())
    last = words.select(F.col("rank").alias("end"), F.col("word").alias("last"))
    named = ends.select("rank", F.col("form").alias("end")).join(last, "end").select("rank", "last")
    whole = near.select("rank", "word", "n", "n_near").join(linked.drop("best"), "rank", "left").join(named, "rank", "left")
    return whole.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, edited=None):
    """Spelling groups of the words of ``docs`` with enough code points and occurrences."""
    return spelling_groups(word_counts(docs, least_length, edited).where(F.col("n") >= least_count))
