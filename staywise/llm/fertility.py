"""Quality verdicts from how public vocabularies cut a text.

Per text: code points per token under the vocabulary that suits it best, the share of tokens that are fragments of characters (byte
fallback), and the entropy of its tokens. Upper-case noise and random strings lower the characters per token, filler and
attached symbols lower the entropy. A text is rejected outside its group's band: centre (median) plus or minus ``WIDTH`` robust
deviations, where the groups are language (script where the language is null) and length octave, measured over all different texts, so copies
have no weight. Near copies may still crowd a group; its deviation is therefore at least the language's over all lengths and the middle one of its
octaves. The centre of a group of fewer than ``LEAST_GROUP`` texts says nothing; there the characters per token are held against the
language's own band. The fixed bands by script hold everywhere.

Base measures come from words (runs without ASCII white space) and ``\\n``-split lines. Null and empty texts have zero measures
and fail. Repeated rows each get a row; no rows give none; other columns are dropped.
"""
import base64
import os

import numpy as np
from pyspark.sql import functions as F

from .bpe import Cut, encoder, vocabulary_path
from .bytescan import Block, binary_values, in_row_windows, mix, slices, span_hashes, window_hashes
from .scripts import SCRIPTS, script_table
from .tables import per_batch, small, stage

VOCABULARIES = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")
#: Fixed bands: least and most code points per token, most fallback share, least entropy share. "other" holds for scripts not listed.
BANDS = {
    "latin": (1.75, 8.0, 0.15, 0.45),
    "cyrillic": (0.9, 8.0, 0.30, 0.45),
    "greek": (0.6, 8.0, 0.60, 0.45),
    "none": (0.8, 8.0, 0.15, 0.45),
    "other": (0.3, 8.0, 0.90, 0.40),
}
WIDTH = 4.0
LEAST_GROUP = 30
LEAST_OCTAVE = 5  # texts of an octave whose spread counts for the language's floor
ENTROPY_SLOPE = 0.3  # bits of token entropy that a text gains when it doubles, about
LEAST_DEVIATION = 0.02
MAX_REPEAT_PERCENT, MIN_WORDS, REPEAT_WINDOW = 30, 20, 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "within_fixed boolean, fallback_ok boolean, script string, chars_per_token double, fallback_share double, token_entropy double, entropy_share double"
)


def repeated_within_rows(hashes, rows):
    """Marks of the items whose hash occurs more than once in their row, and how many items of each repeat an earlier one."""
    keys = mix(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    marked, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    marked[order[1:][same]] = True
    again[order[1:][same]] = True
    marked[order[:-1][same]] = True
    return marked, again


def base_measures(block):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends, first = block.words()
    n_words = np.diff(first)
    lead = np.concatenate(([0], np.cumsum((block.codes & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(lead[ends] - lead[starts])))
    line_ends = np.flatnonzero(block.codes == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_rows = np.searchsorted(block.row_ends, line_starts, "right")
    _, again = repeated_within_rows(span_hashes(block.codes, line_starts, line_ends), line_rows)
    windows = window_hashes(span_hashes(block.codes, starts, ends), REPEAT_WINDOW)
    places, rows = in_row_windows(first, REPEAT_WINDOW)
    marked, _ = repeated_within_rows(windows[places], rows)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, places[marked], 1)
    np.add.at(cover, places[marked] + REPEAT_WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return (
        n_words,
        chars[first[1:]] - chars[first[:-1]],
        block.per_row(SYMBOLS[block.codes]),
        np.bincount(line_rows[again], minlength=block.rows),
        covered[first[1:]] - covered[first[:-1]],
    )


def row_entropies(ids, bounds):
    """Entropy in bits of the ids of each row."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys = np.sort((rows << 32) | ids)
    edge = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(np.append(edge, len(keys)))
    per_row = np.bincount(keys[edge] >> 32, weights=counts * np.log2(counts), minlength=len(bounds) - 1)
    n = np.maximum(np.diff(bounds), 1)
    return np.maximum(np.log2(n) - per_row / n, 0)


def _fragments(vocabulary):
    """Marks of the ids whose bytes are not whole characters, for a rank file."""
    marks = np.zeros(1 << 17, bool)
    with open(os.path.splitext(vocabulary)[0] + ".tiktoken", "rb") as file:
        for word, rank in map(bytes.split, file):
            word = base64.b64decode(word)
            marks[int(rank)] = word.decode("utf-8", "ignore").encode() != word
    return marks


def dominant_scripts(cut):
    """The script of most letters of each text, "none" without letters."""
    scripts = script_table()[cut.codes]
    rows = np.repeat(np.arange(len(cut.lengths)), cut.lengths)
    counts = np.bincount(rows * len(SCRIPTS) + scripts, minlength=len(cut.lengths) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    counts[:, 0] = 0
    return np.where(counts.sum(1) > 0, counts.argmax(1), 0)


def measure(docs, vocabularies=None, bands=BANDS):
    """One row per row of ``docs`` (doc_id, lang, text): all measures and how they stand against the fixed bands."""
    paths = vocabularies or [vocabulary_path(v) for v in VOCABULARIES]
    limits = np.array([bands.get("none" if k == 0 else name, bands["other"]) for k, name in enumerate(SCRIPTS)])
    marks = {}

    def judge(batch):
        keys, langs, values = *(np.array(batch.column(k).to_pylist(), object) for k in (0, 1)), binary_values(batch.column(2))
        for path in paths:
            if path not in marks:
                marks[path] = _fragments(path)
        for a, b in slices(values):
            block = Block(values[a:b])
            measures = base_measures(block)
            hashes = span_hashes(block.codes, block.row_starts, block.row_ends).view(np.int64)
            cut = Cut(values[a:b])
            best, fallback, entropy, share = None, None, None, None
            for path in paths:
                ids, bounds = encoder(path).encode_cut(cut)
                n = np.diff(bounds)
                per_token = cut.lengths / np.maximum(n, 1)
                fragments = np.concatenate(([0], np.cumsum(marks[path][ids])))
                found = (fragments[bounds[1:]] - fragments[bounds[:-1]]) / np.maximum(n, 1)
                bits = row_entropies(ids, bounds)
                part = np.where(n > 1, bits / np.log2(np.maximum(n, 2)), 1.0)
                if best is None:
                    best, fallback, entropy, share = per_token, found, bits, part
                else:
                    best, fallback, share = np.maximum(best, per_token), np.minimum(fallback, found), np.minimum(share, part)
            scripts = dominant_scripts(cut)
            low, high, most_fallback, least_entropy = limits[scripts].T
            n_words, _, _, _, repeats = measures
            failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
            fixed = (best >= low) & (best <= high) & (share >= least_entropy)
            names = np.array(["none", *SCRIPTS[1:]], object)[scripts]
            columns = (keys[a:b], langs[a:b], hashes, *measures, failed, fixed, fallback <= most_fallback, names, best, fallback, entropy, share)
            yield dict(zip((c.split()[0] for c in SCHEMA.split(", ")), columns, strict=True))

    return per_batch(docs.select("doc_id", "lang", "text"), judge, SCHEMA)


def _bands(texts, group, names):
    """Size, centres and spreads of the groups of ``texts``, a stored table with one row per text."""
    centres = stage(
        texts.groupBy(group).agg(F.count("*").alias("size"), *[F.percentile_approx(c, 0.5, 10_000).alias(f"{c}_centre") for c in names]), "band-centres"
    )
    distances = [F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_centre")), 0.5, 10_000).alias(f"{c}_spread") for c in names]
    spreads = texts.join(small(centres, ["band_group"]), group).groupBy(group).agg(*distances)
    return stage(centres.join(spreads, group), "bands")


def _inside(names, width):
    """Whether all measures lie in the band; the spread is at least the language's own and the one usual in its octaves."""
    inside = F.lit(True)
    for c in names:
        spread = F.greatest(*(1.4826 * F.col(f"{c}_{kind}") for kind in ("spread", "wide", "usual")), F.lit(LEAST_DEVIATION))
        inside = inside & (F.abs(F.col(c) - F.col(f"{c}_centre")) <= width * spread)
    return inside


def with_verdicts(measures, width=WIDTH, least_group=LEAST_GROUP):
    """``measures`` with the bands of their groups and ``kept``. Reads ``measures`` twice: pass a stored table."""
    level = F.col("token_entropy") - ENTROPY_SLOPE * F.log2(F.greatest("n_words", F.lit(1)))
    rows = measures.withColumn("entropy_level", level).withColumn("band_group", F.coalesce("lang", F.concat(F.lit("script "), "script"))).withColumn(
        "octave", F.floor(F.log2(F.greatest("n_words", F.lit(1))))
    )
    names = ("chars_per_token", "entropy_level")
    texts = stage(rows.select("band_group", "octave", "text_hash", *names).dropDuplicates(["band_group", "octave", "text_hash"]), "band-texts")
    fine, coarse = _bands(texts, ["band_group", "octave"], names), _bands(texts, ["band_group"], names)
    usual = fine.where(F.col("size") >= LEAST_OCTAVE).groupBy("band_group")
    usual = usual.agg(*[F.percentile_approx(f"{c}_spread", 0.5, 10_000).alias(f"{c}_usual") for c in names])
    wide = coarse.select("band_group", *[F.col(f"{c}_spread").alias(f"{c}_wide") for c in names]).join(usual, "band_group", "left")
    wide = stage(wide, "band-floors")
    for bands, of, kind in ((fine, names, "fine"), (coarse, names[:1], "coarse")):
        group = ["band_group", "octave"] if kind == "fine" else ["band_group"]
        limits = stage(bands.withColumnRenamed("size", f"{kind}_size").join(wide, "band_group"), f"{kind}-limits")
        rows = rows.join(small(limits, ["band_group"]), group).withColumn(kind, _inside(of, width))
        rows = rows.drop(*[f"{c}_{x}" for c in names for x in ("centre", "spread", "wide", "usual")])
    near = F.when(F.col("fine_size") >= least_group, F.col("fine")).otherwise(F.col("coarse") | (F.col("coarse_size") < least_group))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("fallback_ok") & F.col("within_fixed") & near)


def verdicts(docs, vocabularies=None, bands=BANDS, width=WIDTH):
    """Measures and verdict of every row of ``docs`` (doc_id, lang, text)."""
    return with_verdicts(stage(measure(docs, vocabularies, bands), "fertility"), width).select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
        *("script", "chars_per_token", "fallback_share", "token_entropy"),
    )
