"""Benchmark decontamination as a prefix-filtered set join in DataFrame operations only.

An item is cut into windows of ``WINDOW`` words (a shorter item is one window). A window occurs only where all its words occur, so its
necessary prefix is its rarest word: words are ordered by how often they occur in the documents, and every window is looked up by the rarest of
its words alone. A document position with such a word becomes a candidate together with the words around it; the position of the
word in the window gives the only possible start (positional bound), the document's length limits it (length bound), and the
words are then compared one by one.

The rarest words are tested inside the document row, in blocks of ``BLOCK_ANCHORS`` words, so what every task holds is bounded
for benchmarks of any size; nothing of the documents is broadcast, and documents are shuffled only as hits.

Null and empty texts have no words and no hits. Items without words are ignored. Rows with the same id are told apart by their text; exactly
repeated rows get the same result each. Ties in rarity go to the smaller word. Other columns are dropped.
"""
from pyspark.sql import functions as F

from .tables import LOWER, UPPER, same, small, stage, text_key

WINDOW = 10
BLOCK_ANCHORS = 4_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(column):
    """Array of the words of a text: lower case, runs of digits, letters and anything beyond ASCII."""
    parts = F.split(F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER), GAP)
    return F.array_remove(parts, "")


def item_windows(benchmark, window=WINDOW):
    """(item_id, win, words): the windows of every item; ``win`` is the words joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = items.where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("s"))
    words = F.slice("w", F.col("s") + 1, F.least(F.size("w"), F.lit(window)))
    return cut.select("item_id", words.alias("words")).withColumn("win", F.array_join("words", " ")).distinct()


def anchored(windows, docs):
    """(win, words, anchor, place): every window with its rarest word among ``docs``; windows with an unseen word can't occur and are left out."""
    vocabulary = stage(windows.select(F.explode("words").alias("word")).distinct(), "benchmark-words")
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(small(vocabulary, ["word"]), "word")
    rarity = seen.groupBy("word").agg(F.count("*").alias("seen"))
    placed = windows.select("win", "words").distinct().select("win", "words", F.posexplode("words").alias("place", "word"))
    ranked = placed.join(rarity, "word", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    first = F.min(F.struct("seen", F.col("word").alias("anchor"), "place")).alias("a")
    return ranked.groupBy("win", "words").agg(first).where("a.seen > 0").select("win", "words", "a.anchor", "a.place")


def _blocks(anchors):
    """The anchor words in driver-side blocks of about ``BLOCK_ANCHORS`` words, one block at a time."""
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    for block in range(blocks):
        yield [r["anchor"] for r in anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block).collect()]


def candidates(docs, anchors, window=WINDOW):
    """One row per document with its word count and, for each position of one of ``anchors``, the words around it."""
    listed = ", ".join(f"'{a}'" for a in anchors) or "NULL"
    reach = window - 1
    tokens = docs.select("doc_id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("w"))
    found = f"filter(sequence(1, size(w)), i -> w[i - 1] IN ({listed}))"
    around = f"named_struct('at', i, 'from', greatest(i - {reach}, 1), 'words', slice(w, greatest(i - {reach}, 1), {2 * reach + 1}))"
    spots = F.expr(f"CASE WHEN size(w) = 0 THEN NULL ELSE transform({found}, i -> {around}) END")
    return tokens.select("doc_id", "key", F.size("w").alias("n_words"), spots.alias("spots"))


def occurrences(spotted, windows):
    """(doc_id, key, win, start, width): every occurrence of a window, ``start`` counted from 1."""
    rows = spotted.select("doc_id", "key", "n_words", F.explode("spots").alias("s"))
    rows = rows.withColumn("anchor", F.col("s.words")[F.col("s.at") - F.col("s.from")])
    joined = rows.join(windows, "anchor")
    start, width = F.col("s.at") - F.col("place"), F.size("words")
    bounded = joined.where((start >= 1) & (start + width - 1 <= F.col("n_words")))
    here = F.slice("s.words", start - F.col("s.from") + 1, width)
    return bounded.where(here == F.col("words")).select("doc_id", "key", "win", start.alias("start"), width.alias("width"))


def decontamination(docs, benchmark, window=WINDOW):
    """One row per document: word count, words hit, items hit."""
    windows = stage(item_windows(benchmark, window), "benchmark-windows")
    chosen = stage(anchored(windows, docs), "anchored-windows")
    spotted = hits = None
    for block in _blocks(stage(chosen.select("anchor").distinct(), "anchors")):
        part = stage(candidates(docs, block, window), "candidates")
        of_block = small(stage(chosen.where(F.col("anchor").isin(block)), "block"), ["win", "win"])
        found = occurrences(part, of_block)
        spotted, hits = spotted or part, found if hits is None else hits.unionByName(found)
    hits = stage(hits.distinct(), "occurrences")
    items = small(stage(windows.select("win", "item_id"), "window-items"), ["win", "item_id"])
    by_item = hits.select("doc_id", "key", "win").distinct().join(items, "win").groupBy("doc_id", "key")
    listed = by_item.agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    places = hits.select("doc_id", "key", F.explode(F.expr("sequence(start, start + width - 1)")).alias("at")).distinct()
    counted = places.groupBy("doc_id", "key").agg(F.count("*").alias("n_hit"))
    left = spotted.select("doc_id", "key", "n_words").alias("d")
    for name, part in (("l", listed), ("c", counted)):
        part = part.alias(name)
        left = left.join(part, same(F.col("d.doc_id"), F.col(f"{name}.doc_id")) & (F.col("d.key") == F.col(f"{name}.key")), "left")
    items = F.coalesce("l.items", F.array().cast("array<string>"))
    n_hit = F.coalesce("c.n_hit", F.lit(0))
    return left.select(
        "d.doc_id",
        "d.key",
        F.col("d.n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.s, g.n, i.item_id FROM g JOIN i ON g.win = i.win AND g.n = i.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
