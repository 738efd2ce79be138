"""Language spans: scripts narrow the candidates, then Viterbi over per-word scores with a price for switching.

The model is a table of log probabilities of hashed byte trigrams (words lower-cased in ASCII, with their borders) for each language and the
scripts each language uses. It is counted by Spark over a bounded sample of labelled rows: at most about ``SAMPLE_ROWS`` rows of
each language, chosen by a hash of the id. A word scores under every language that uses its script; words of a script that no
language uses, and words without letters, speak for none. The best sequence of labels pays ``SWITCH_COST`` for each change of language,
so single odd words do not break a span while a quoted sentence does.

A text's language is the one of most letters; its score is the share of all its letters in it, so a text in scripts that no language uses
has the first language with score 0 and a span ``und``. ``und`` with score 0: null, empty or without a letter, or when nothing could be
learned. A null id is never held out. Repeated rows get a row each; ties go to the language first in alphabetical order; other
columns are dropped.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .bytescan import SEPARATORS, Block, binary_values, slices
from .scripts import SCRIPTS, script_table
from .tables import arrays, per_batch, small, stage

SAMPLE_ROWS = 4_000
SWITCH_COST = 20.0
TABLE_BITS = 16
LEAST_SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
LEAST_SHARE = 0.5
SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<first_word:long,n_words:long,lang:string>>"


def in_fold(column, folds):
    """crc32 of the id as text, modulo ``folds``, is 0; not so for a null id."""
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "utf-8")) % folds == 0, F.lit(False))


def letter_scripts(codes):
    """Script number at the first byte of every letter of a UTF-8 buffer, 0 elsewhere."""
    table = script_table()
    out = np.where(codes < 128, table[codes & 127], 0).astype(np.uint8)
    padded = np.concatenate((codes, np.zeros(3, np.uint8))).astype(np.uint32)
    for low, high, width, lead in ((0xC2, 0xDF, 2, 0x1F), (0xE0, 0xEF, 3, 0x0F), (0xF0, 0xF4, 4, 0x07)):
        at = np.flatnonzero((codes >= low) & (codes <= high))
        point = padded[at] & lead
        for k in range(1, width):
            point = (point << 6) | (padded[at + k] & 0x3F)
        out[at] = table[np.minimum(point, 0x10FFFF)]
    return out


def trigram_places(codes):
    """Table place of the byte trigram around each byte; white space counts as one kind of border."""
    plain = np.where(SEPARATORS[codes], np.uint8(32), codes).astype(np.uint32)
    before = np.concatenate(([np.uint32(32)], plain[:-1]))
    after = np.concatenate((plain[1:], [np.uint32(32)]))
    packed = (before << np.uint32(16)) | (plain << np.uint32(8)) | after
    return (packed * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)


def learn(labelled, sample_rows=SAMPLE_ROWS):
    """The model as plain arrays from (doc_id, text, lang) rows."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(float(sample_rows)) / F.col("n")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = rows.join(small(stage(sizes, "languages"), ["lang"]), "lang").where(chance < F.col("share"))

    def count(batch):
        texts, langs = binary_values(batch.column(0)), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, of in zip(texts, langs, strict=True) if of == lang]
            for a, b in slices(own):
                block = Block(own[a:b], lower=True)
                used = ~SEPARATORS[block.codes]
                grams = np.bincount(trigram_places(block.codes)[used], minlength=1 << TABLE_BITS)
                scripts = np.bincount(letter_scripts(block.codes), minlength=len(SCRIPTS))
                scripts[0] = 0
                kept, seen = np.flatnonzero(grams), np.flatnonzero(scripts)
                yield {
                    "lang": [lang] * (len(kept) + len(seen)),
                    "place": np.concatenate((kept, -seen)),
                    "n": np.concatenate((grams[kept], scripts[seen])),
                }

    counted = per_batch(sample.select("text", "lang"), count, "lang string, place long, n long")
    lang, place, n = arrays(counted.groupBy("lang", "place").agg(F.sum("n").alias("n")))  # at most 2^TABLE_BITS rows a language
    langs = sorted(set(lang.tolist()))
    grams = np.zeros((len(langs), 1 << TABLE_BITS))
    scripts = np.zeros((len(langs), len(SCRIPTS)))
    for k, name in enumerate(langs):
        own = lang == name
        gram = own & (place >= 0)
        grams[k, place[gram]] = n[gram]
        scripts[k, -place[own & ~gram]] = n[own & ~gram]
    logs = np.log(grams + SMOOTHING) - np.log(grams.sum(1, keepdims=True) + SMOOTHING * (1 << TABLE_BITS))
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    masks = ((share >= LEAST_SCRIPT_SHARE) << np.arange(len(SCRIPTS))).sum(1)
    logs -= logs.mean(0, keepdims=True) if len(langs) else 0
    return {"langs": langs, "logs": logs.astype(np.float32), "masks": masks.astype(np.int64)}


def word_scores(block, model):
    """(scores of every word under every language, its letters, those of them in a script that some language uses, first word of each row)."""
    starts, _, first = block.words()
    scripts = letter_scripts(block.codes)
    places = trigram_places(block.codes)
    inside = ~SEPARATORS[block.codes]
    if not len(starts):
        return np.zeros((0, len(model["langs"])), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), first
    letters = np.add.reduceat((scripts > 0).astype(np.int64), starts)
    used = np.bitwise_or.reduceat(np.where(scripts > 0, np.int64(1) << scripts.astype(np.int64), 0), starts)
    allowed = (used[:, None] & model["masks"][None, :]) != 0
    scores = np.empty((len(starts), len(model["langs"])), np.float32)
    for k in range(len(model["langs"])):
        scores[:, k] = np.add.reduceat(np.where(inside, model["logs"][k][places], np.float32(0)), starts)
    scores[(letters == 0) | ~allowed.any(1)] = 0
    worst = np.where(allowed, scores, np.float32(0)).min(1, initial=0) - np.float32(SWITCH_COST)
    return np.where(allowed | ~allowed.any(1)[:, None], scores, worst[:, None]), letters, np.where(allowed.any(1), letters, 0), first


def _may_switch(scores, rows, best, cost):
    """Rows in which some stretch of words prefers another language by more than half the cost; only there can a switch pay."""
    marked = np.zeros(int(rows[-1]) + 1 if len(rows) else 0, bool)
    for k in range(scores.shape[1]):
        gain = scores[:, k].astype(np.float64) - scores[np.arange(len(rows)), best[rows]]
        total = np.cumsum(gain)
        apart = rows * (4.0 * np.abs(gain).sum() + 1.0)
        lowest = np.minimum.accumulate(total - gain - apart)
        marked[rows[(total - apart - lowest) > cost / 2]] = True
    return marked


def _viterbi(scores, begin, lengths, cost):
    """Best labels of several rows at once; ``begin`` and ``lengths`` say where the rows' words lie in ``scores``."""
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    labels = np.zeros(len(scores), np.int16)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left") if len(lengths) else []
    value = scores[begin].astype(np.float64)
    came = []
    for t in range(1, int(lengths[0])):
        n = active[t]
        top = value[:n].argmax(1)
        jump = value[np.arange(n), top] - cost
        stay = value[:n] >= jump[:, None]
        came.append(np.where(stay, np.int16(-1), top[:, None].astype(np.int16)))
        value[:n] = np.where(stay, value[:n], jump[:, None]) + scores[begin[:n] + t]
    label = value.argmax(1).astype(np.int16)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = active[t]
        labels[begin[:n] + t] = label[:n]
        if t:
            back = came[t - 1][np.arange(n), label[:n]]
            label[:n] = np.where(back >= 0, back, label[:n])
    return labels


def label_words(block, model, cost=SWITCH_COST):
    """(label of every word, its letters, those in a script of the languages, first word of each row)."""
    scores, letters, known, first = word_scores(block, model)
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    sums = np.zeros((len(counts), scores.shape[1]))
    for k in range(scores.shape[1]):
        sums[:, k] = np.bincount(rows, weights=scores[:, k], minlength=len(counts))
    best = sums.argmax(1)
    labels = best[rows].astype(np.int16)
    if len(rows):
        marked = np.flatnonzero(_may_switch(scores, rows, best, cost))
        if len(marked):
            found = _viterbi(scores, first[:-1][marked], counts[marked], cost)
            inside = np.isin(rows, marked)
            labels[inside] = found[inside]
    return labels, letters, known, first


def text_languages(block, model, cost=SWITCH_COST):
    """Per text: the number of its language (the one after the last for none), the share of its letters in it, the share of its letters in any
    language, its letters; then labels and first words as ``label_words``. Words of a script that no language uses count for none."""
    n = len(model["langs"])
    labels, letters, known, first = label_words(block, model, cost) if n else _unlabelled(block)
    rows = np.repeat(np.arange(block.rows), np.diff(first))
    total = np.bincount(rows, weights=letters, minlength=block.rows)
    weight = np.bincount(rows * max(n, 1) + labels, weights=known, minlength=block.rows * max(n, 1)).reshape(-1, max(n, 1))
    share = lambda part: np.where(total > 0, part / np.maximum(total, 1), 0.0)
    top = np.where(total > 0, weight.argmax(1), n) if n else np.zeros(block.rows, np.int64)
    labels = np.where((weight.sum(1) > 0)[rows], labels, n).astype(np.int16)
    return top, share(weight.max(1, initial=0)), share(weight.sum(1)), total, labels, first


def _unlabelled(block):
    """What ``label_words`` gives when there is no language: the letters alone."""
    starts, _, first = block.words()
    scripts = letter_scripts(block.codes)
    letters = np.add.reduceat((scripts > 0).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return np.zeros(len(starts), np.int16), letters, np.zeros_like(letters), first


def identify(docs, model, cost=SWITCH_COST):
    """(doc_id, lang_pred, score, spans) for every row of ``docs`` (doc_id, text)."""
    langs = np.array([*model["langs"], "und"], object)

    def label(batch):
        keys, values = np.array(batch.column(0).to_pylist(), object), binary_values(batch.column(1))
        for a, b in slices(values):
            block = Block(values[a:b], lower=True)
            top, share, _, _, labels, first = text_languages(block, model, cost)
            rows = np.repeat(np.arange(b - a), np.diff(first))
            edge = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(rows, prepend=-1) != 0))
            width = np.diff(np.append(edge, len(rows)))
            spans = [[] for _ in range(b - a)]
            for r, f, w, of in zip(rows[edge].tolist(), (edge - first[:-1][rows[edge]]).tolist(), width.tolist(), labels[edge].tolist(), strict=True):
                spans[r].append({"first_word": f, "n_words": w, "lang": langs[of]})
            yield {"doc_id": keys[a:b], "lang_pred": langs[top], "score": share, "spans": spans}

    return per_batch(docs.select("doc_id", "text"), label, SCHEMA)


def learn_and_identify(docs, folds=5):
    """Learns from the rows of ``docs`` outside fold 0 and identifies all rows; ``held_out`` marks fold 0."""
    model = learn(docs.where(~in_fold(F.col("doc_id"), folds)))
    found = identify(docs, model)
    return found.select("doc_id", in_fold(F.col("doc_id"), folds).alias("held_out"), "lang_pred", "score", "spans")


def keep_identified(docs, model, least_share=LEAST_SHARE):
    """The rows of ``docs``, all columns as they are, with at least ``least_share`` of their letters in recognised languages, however many.

    When nothing could be learned, every row with a letter stays. Rows without letters go: null, empty, digits or signs alone.
    """
    text = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            values, kept = binary_values(batch.column(text)), []
            for a, b in slices(values):
                _, _, known, letters = text_languages(Block(values[a:b], lower=True), model)[:4]
                kept.append((letters > 0) & ((known >= least_share) | (not model["langs"])))
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(keep, docs.schema)
