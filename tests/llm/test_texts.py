"""Operators over documents against their plain versions, and the odd inputs: nulls, empty and long texts, repeats, empty tables."""
import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staywise.llm import bpe, bytescan, decontaminate, fertility, language_id, packing, parity_join, repeat_filter, stages, suffix_dedup, suffix_tree_lm, token_counts
from staywise.llm.bwt import Shard, common_windows
from staywise.llm.components import components
from staywise.session import staging

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, e long"
LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, "é😀 漢字"), (7, "ab" * 300), (8, LONG), (9, LONG + " end"),
    (10, "the same line of text\n" * 40), (11, "<|endoftext|> 's 've don't"), (12, "x" * 99), (13, "x" * 250), (14, "12 34 !!"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None if k % 3 else "xx", None, None, "clash", 5) for k, t in ODD]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


# suffix-array dedup


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=8), st.integers(1, 6), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_merged_transforms_find_all_common_windows(strings, width, parts):
    chunks = [strings[k::parts] for k in range(parts) if strings[k::parts]]
    interval, shard, place = common_windows([Shard(c) for c in chunks], width)
    got = {}
    for i, s, p in zip(interval, shard, place, strict=True):
        own = Shard(chunks[s])
        string = int(np.searchsorted(own.begins, p, "right") - 1)
        got.setdefault(int(i), set()).add((int(s), string, int(p - own.begins[string])))
    want = {}
    for s, chunk in enumerate(chunks):
        for k, string in enumerate(chunk):
            for at in range(len(string) - width + 1):
                want.setdefault(string[at : at + width], set()).add((s, k, at))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("hot", [1, suffix_dedup.HOT_SEGMENTS])
def test_repeated_bytes(docs, pairs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5_000)
    found = by_id(suffix_dedup.account(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == brute.repeats(pairs)


def test_repeated_bytes_of_odd_texts(odd, empty):
    found = by_id(suffix_dedup.account(odd), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == brute.repeats(ODD)
    assert suffix_dedup.account(empty).count() == 0
    twice = suffix_dedup.account(odd.unionByName(odd))
    assert sorted(map(tuple, twice.drop("doc_id").collect())) == sorted(v for v in found.values() for _ in range(2))


def test_repeated_bytes_of_null_id_rows(spark):
    passage = " ".join(f"word{k * 7919 % 1009}" for k in range(60))
    rows = [(None, "one other start, then " + passage + " and an end"), (5, "again: " + passage + " but not the same end")]
    found = by_id(suffix_dedup.account(spark.createDataFrame(rows, "doc_id long, text string")), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute.repeats([(-1, rows[0][1]), rows[1]])  # null ids come first
    assert want[5][1] > 0 and found == {None: want[-1], 5: want[5]}


def test_cut_texts_keep_columns_and_whole_characters(odd):
    rows = {r["doc_id"]: r for r in suffix_dedup.cut_texts(odd).collect()}
    assert rows[9]["text"] == " end" or len(rows[9]["text"]) < 200
    assert rows[1]["text"] is None and rows[1]["n_chars"] is None and rows[6]["text"] == "é😀 漢字" and rows[6]["key"] == "clash"


# n-gram Jaccard join


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard_components(docs, pairs, width, num, den):
    found = by_id(parity_join.jaccard_components(docs, width, num, den), "n_shingles", "component_id")
    assert found == brute.jaccard_components(pairs, width, num, den)


def test_jaccard_components_of_odd_texts(odd, empty):
    found = by_id(parity_join.jaccard_components(odd), "n_shingles", "component_id")
    assert found == brute.jaccard_components(ODD, 3, 90, 100)
    assert found[5] == (1, 4) and found[2] == (0, 2) and found[9][1] == 8
    assert parity_join.jaccard_components(empty).count() == 0
    assert parity_join.jaccard_components(odd.unionByName(odd)).count() == 2 * len(ODD)


def test_repeated_keys(spark):
    """Keys of 40 bits in blocks: those met twice or more in all, whatever block they stand in, in about three bytes each."""
    keys = [*range(1, 3000), *range(1, 300), *range(1, 30), (1 << 40) - 1, (1 << 40) - 1]
    df = spark.createDataFrame([(k << 24,) if k < 1 << 39 else ((k << 24) - (1 << 64),) for k in keys], "key long").repartition(5)
    found = repeat_filter.repeated(df, lambda batch: [batch.column(0).to_numpy().view(np.uint64)], 9)
    found = {((r["key"] + (1 << 64)) % (1 << 64)) >> 24: r["n"] for r in found.collect()}
    assert found == {k: n for k, n in Counter(keys).items() if n > 1}
    assert repeat_filter.repeated(df.where("key = 0"), lambda batch: [batch.column(0).to_numpy().view(np.uint64)], 9).count() == 0


def test_tables_of_bits_follow_the_number_of_keys(spark):
    rng = np.random.default_rng(7)
    keys, other = rng.integers(-(1 << 63), 1 << 63, 40_000), rng.integers(-(1 << 63), 1 << 63, 40_000)
    stored = spark.createDataFrame([(int(k), 2 + 5 * (i % 2)) for i, k in enumerate(keys)], "key long, n long")
    tables = repeat_filter.sized_filter(stored, (1, 3, 100))
    assert [8 * len(t) for t in tables] == [1 << 20, 1 << 19, 1 << 16]
    passed = repeat_filter.limits_passed(tables, keys.view(np.uint64))
    assert (passed >= 1).all() and (passed[1::2] >= 2).all() and (passed[0::2] >= 2).mean() < 0.1
    assert (repeat_filter.limits_passed(tables, other.view(np.uint64)) > 0).mean() < 0.15


def test_sketches_are_not_stored(spark, docs, pairs, tmp_path):
    """What the join writes stays below the texts; with the cells (8 bytes a shingle and more) it was nearly three times as much."""
    with staging(spark) as scope:
        found = by_id(parity_join.jaccard_groups(docs, 5, 8, 10), "component_id")
        folder = Path(scope.removeprefix("file://"))
        written = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
        assert {k: v[0] for k, v in found.items()} == {k: v[1] for k, v in brute.jaccard_components(pairs, 5, 8, 10).items()}
    assert 0 < written < sum(len(t or "") for _, t in pairs)


def test_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(0, 120)] + [" ".join(base)]
    rows = list(enumerate(texts, 1))
    found = by_id(parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert found == brute.jaccard_components(rows, 3, 90, 100)


@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=60), st.sets(st.integers(0, 2**63), max_size=4), st.integers(2, 30))
@settings(max_examples=100, deadline=None)
def test_sketch_distance_is_a_lower_bound(common, more, cells):
    a, b = (np.array(sorted(s), np.uint64) for s in (common, common | more))
    differing = (parity_join.sketch(a, 3, cells) != parity_join.sketch(b, 3, cells)).sum()
    assert differing <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 120)}}


# benchmark decontamination


def test_decontamination(spark, empty):
    items = [("b1", "A quick brown fox jumps over the lazy dog near the old river bank"), ("b2", "short item"), (None, None), ("b4", ""), ("b5", "!!")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [
        (1, "x A QUICK, brown fox jumps over the lazy dog near the end a quick brown fox"), (2, "nothing"), (3, None), (4, ""), (5, "a SHORT item; short-item"),
        (6, "brown fox jumps over the lazy dog near the old river bank brown fox jumps over the lazy dog near the old"),
    ]
    rows = spark.createDataFrame([(k, t, "x", "y") for k, t in texts], "doc_id long, text string, words string, win string")
    found = by_id(decontaminate.decontamination(rows.unionByName(rows), bench), "n_words", "n_hit", "items_sha256", "contaminated")
    for doc, text in texts:
        n, hit, listed = brute.leaks(text, [i for i in items if i[0]])
        assert found[doc] == (n, hit, hashlib.sha256(listed.encode()).hexdigest(), hit > 0)
    assert decontaminate.decontamination(rows.unionByName(rows), bench).count() == 12
    assert decontaminate.decontamination(empty, bench).count() == 0
    assert decontaminate.decontamination(rows, bench.limit(0)).where("contaminated").count() == 0


# tokens, packing


@given(st.lists(st.text(alphabet="a b'stdmrevl\n\t\r 12٣é½_-…  　ßX😀'漢", max_size=40), max_size=12))
@settings(max_examples=100, deadline=None)
def test_ids_are_the_librarys(texts):
    encoder = bpe.encoder(bpe.vocabulary_path())
    ids, bounds = encoder.encode([t.encode() for t in texts])
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_packing(odd, empty, docs):
    library = bpe.encoder(bpe.vocabulary_path()).library
    rows = packing.pack_documents(odd).collect()
    for doc, text in ODD:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert sum(r["length"] for r in pieces) == len(ids) and all(r["length"] == 2048 for r in pieces[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    assert packing.pack_documents(empty).count() == 0
    packed = packing.pack_documents(docs.unionByName(docs)).toPandas().sort_values(["sequence_id", "offset"])
    groups = packed.groupby("sequence_id")
    assert (packed["offset"] == groups["length"].cumsum() - packed["length"]).all() and groups["length"].sum().max() <= 2048
    assert groups.ngroups <= math.ceil(packed["length"].sum() / 2048) + 1


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_uses_every_piece_once(histogram):
    plan, used = packing.plan_bins(histogram, 50), {}
    for times, inside in plan:
        assert sum(x * n for x, n in inside.items()) <= 50
        for x, n in inside.items():
            used[x] = used.get(x, 0) + times * n
    assert used == histogram


def test_two_small_documents_replace_one():
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == (1, {6: 1, 2: 2})


def test_token_counts(odd, empty):
    library = bpe.encoder(bpe.vocabulary_path()).library
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    table = token_counts.context_table(token_counts.length_histogram(odd))
    for r in table.collect():
        limit = r["context_limit"]
        assert r["n_docs"] == lengths.count(limit) and r["docs_from"] == sum(n >= limit for n in lengths)
        assert r["tokens_from"] == sum(n for n in lengths if n >= limit) and r["total_tokens"] == sum(lengths)
        assert r["tokens_cut_at"] == sum(min(n, limit) for n in lengths)
        assert r["share_within"] == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    cut = {r["limit"]: r["tokens"] for r in token_counts.truncated_totals(table, [1, 7, 10**9]).collect()}
    assert cut == {k: sum(min(n, k) for n in lengths) for k in (1, 7, 10**9)}
    assert token_counts.length_quantiles(table, [0.5]).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.context_table(token_counts.length_histogram(empty)).count() == 0


# quality


def test_base_measures(docs, pairs):
    values = [(t or "").encode() for _, t in pairs] + [(t or "").encode() for _, t in ODD]
    want = [brute.base_quality(t) for _, t in pairs] + [brute.base_quality(t) for _, t in ODD]
    got = [row for a, b in bytescan.slices(values) for row in zip(*(m.tolist() for m in fertility.base_measures(bytescan.Block(values[a:b]))), strict=True)]
    assert got == want


def test_verdicts(spark, odd, empty):
    found = by_id(fertility.verdicts(odd), "base_failed", "kept", "n_words")
    assert all(found[k] == (True, False, 0) for k in (1, 2, 3)) and found[4][:2] == (True, False)
    assert fertility.verdicts(empty).count() == 0 and fertility.verdicts(odd.unionByName(odd)).count() == 2 * len(ODD)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = fertility.verdicts(docs).join(labels, "doc_id").where("NOT base_failed").toPandas()
    good, bad = judged[judged["quality"] == 1], judged[judged["quality"] == 0]
    assert good["kept"].mean() > 0.97 and bad["kept"].mean() < 0.5


def test_copies_of_one_text_have_no_weight_in_the_bands(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").join(labels, "doc_id", "left_semi")
    rows = [tuple(r) for r in docs.collect()]
    longest = [r for r in rows if r[1] == "en" and 128 <= len((r[2] or "").split()) < 256]
    copied = longest[0][2].split()
    exact = [(10**6 + k, "en", longest[0][2]) for k in range(len(rows))]
    near = [(2 * 10**6 + k, "en", " ".join([*copied[: k % len(copied)], f"x{k}", *copied[k % len(copied) + 1 :]])) for k in range(len(rows) // 2)]  # a third of all
    schema = "doc_id long, lang string, text string"
    plain = by_id(fertility.verdicts(spark.createDataFrame(rows, schema)), "kept")
    for more in (exact, near):
        found = by_id(fertility.verdicts(spark.createDataFrame([*rows, *more], schema)), "kept", "base_failed")
        clean = [k for k, v in plain.items() if v[0]]
        assert sum(found[k][0] for k in clean) >= 0.97 * len(clean)
    # a fixed band counts in groups of any size
    odd = [(k, "zz", " ".join(f"{(k * 131 + j * 977) % 10**6:06d}" for j in range(140))) for k in range(40)]
    assert not any(v[0] for v in by_id(fertility.verdicts(spark.createDataFrame(odd, schema), bands={**fertility.BANDS, "none": (50.0, 60.0, 0.15, 0.45)}), "kept").values())


# language model


def test_suffix_tree(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = suffix_tree_lm.learn_and_score(docs).toPandas()
    counts = {}
    texts = {r["doc_id"]: [*brute.words(r["text"]), None] for r in docs.collect()}
    for doc, tokens in texts.items():
        if zlib.crc32(str(doc).encode()) % 10:
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
    total = sum(counts.values())
    norm = total + 0.1 * (len(counts) + 1)
    for r in found.itertuples():
        tokens = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(t, 0) + 0.1) / norm) for t in tokens))
    held = found[found["held_out"]]
    assert held["score"].sum() > 0.95 * held["base_score"].sum() and (held["score"] > held["base_score"]).mean() > 0.8
    rows = by_id(suffix_tree_lm.learn_and_score(odd), "n_tokens", "score")
    assert rows[1][0] == 1 and len(rows) == len(ODD) and all(r[1] <= 0 for r in rows.values())
    assert suffix_tree_lm.learn_and_score(empty).count() == 0


def test_distributions_sum_to_one(spark, docs):
    train = docs.select("text")
    counts = suffix_tree_lm.word_counts(train)
    tree = suffix_tree_lm.learn(train, counts, least_joint=1e-4, least_context=1e-3)
    everything = suffix_tree_lm.Tree(*(lambda w, n: (w.view(np.uint64), n))(*suffix_tree_lm.arrays(counts)), *counts.selectExpr("sum(n)", "count(*)").first())
    inside = tree.symbols(everything.words)
    for first in range(-1, min(8, len(tree.words))):
        for second in range(0, min(8, len(tree.words))):
            n = len(everything.words)
            symbols = np.stack((np.full(n, first), np.full(n, second), inside), 1).reshape(-1)
            value = tree.log_probability(symbols, np.repeat(np.arange(n), 3))[2::3]
            value = np.where(inside >= 0, value, value + everything.root)
            unseen = tree.log_probability(np.array([first, second, -1]), np.zeros(3, int))[2] + np.log10(0.1 / tree.norm)
            assert (10**value).sum() + 10**unseen == pytest.approx(1, abs=1e-6)


def test_sequences_met_once_are_not_counted(spark, docs, pairs):
    """Transitions that occur twice are all counted; of those that occur once hardly any is sent to be counted."""
    train = docs.select("text")
    n = Counter()
    for _, text in pairs:
        tokens, rows = suffix_tree_lm.token_hashes([(text or "").encode()])
        for places, contexts, _ in suffix_tree_lm.sequences(tokens, rows, 4):
            n.update((int(c), int(t)) for c, t in zip(contexts.view(np.int64), tokens[places].view(np.int64), strict=True))
    found = {(r["context"], r["symbol"]): r["n"] for r in suffix_tree_lm.transition_counts(train, 3, 2).collect()}
    assert found == {k: v for k, v in n.items() if v > 1}
    tables, sent = suffix_tree_lm.recurring_tables(train, 3), 0
    for _, text in pairs:
        sent += sum(len(hashes) for _, _, hashes in suffix_tree_lm.recurring(*suffix_tree_lm.token_hashes([(text or "").encode()]), 4, tables))
    repeats, single = sum(v for v in n.values() if v > 1), sum(v for v in n.values() if v == 1)
    assert repeats <= sent < repeats + 0.1 * single


def test_tree_grows_with_the_corpus_and_depth(spark):
    """A context of 30 occurrences in 1.1 million tokens is a share below any fixed one that bounds the tree, and still tested."""
    filler = [" ".join(f"f{(j * 7919 + k * 31) % 5003}" for k in range(1000)) for j in range(1100)]
    rare = [f"rare deep{j % 2} middle word follows{j % 2}" for j in range(60)]
    rows = [(j, t) for j, t in enumerate([*filler, *rare])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    train = docs.select("text")
    counts = suffix_tree_lm.stage(suffix_tree_lm.word_counts(train), "word-counts")
    asked = spark.createDataFrame([(0, "deep0 middle word follows0"), (1, "deep1 middle word follows0"), (None, "middle")], "doc_id long, text string")
    for depth in (2, 3):
        found = by_id(suffix_tree_lm.scores(asked, suffix_tree_lm.grow(train, counts, depth), counts, depth), "score")
        assert len(found) == 3
        # only three words of context tell the two apart
        assert (found[0][0] - found[1][0] > 0.8) == (depth == 3)


# language


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) BETWEEN 600 AND 3000 AND doc_id > 300").collect()}
    mixed = " ".join(texts["en"].split()[:80] + texts["de"].split()[:60] + texts["en"].split()[80:160])
    rows = [*ODD, (50, mixed), (51, "漢字 漢字 漢字")]
    model = language_id.learn(docs)
    labelled = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model), "lang_pred", "score", "spans")
    assert all(labelled[k][:2] == ("und", 0.0) for k in (1, 2, 3, 14))
    spans = labelled[50][2]
    assert [s["lang"] for s in spans] == ["en", "de", "en"] and abs(spans[1]["first_word"] - 80) <= 3 and abs(spans[1]["n_words"] - 60) <= 5
    assert language_id.learn_and_identify(empty).count() == 0
    assert {r[0] for r in by_id(language_id.learn_and_identify(docs.limit(5).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")), "lang_pred").values()} == {"und"}


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 7, 3)
    scores = rng.normal(0, 4, (int(lengths.sum()), 3)).astype(np.float32)
    begin = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(3), lengths)
    labels = language_id._viterbi(scores, begin, lengths, 5.0)
    sums = np.stack([np.bincount(rows, weights=scores[:, k], minlength=3) for k in range(3)], 1)
    marked = language_id._may_switch(scores, rows, sums.argmax(1), 5.0)
    for r in range(3):
        own = scores[begin[r] : begin[r] + lengths[r]].astype(float)

        def value(path, own=own):
            return sum(own[k][p] for k, p in enumerate(path)) - 5.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        best = max(value([int(d) for d in np.base_repr(code, 3).zfill(len(own))]) for code in range(3 ** len(own)))
        assert value(labels[begin[r] : begin[r] + lengths[r]].tolist()) == pytest.approx(best, abs=1e-4)
        if not marked[r]:
            assert sums[r].max() == pytest.approx(best, abs=1e-4)


# pipeline


def test_pipeline_stages(spark, odd, empty):
    for _, stage in __import__("corpus_pipeline").STAGES[:-1]:
        assert stage(spark, empty, FOLDER).columns == empty.columns
        assert stage(spark, odd, FOLDER).columns == odd.columns
    kept = {r["doc_id"] for r in stages.keep_one_per_group(spark, odd.unionByName(odd), FOLDER).collect()}
    assert kept == {k for k, _ in ODD} - {5, 9}


def test_near_duplicates_of_null_and_reused_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, a), (7, a + " end"), (7, c), (9, c), (9, d), (None, None), (None, ""), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted((tuple(r) for r in stages.keep_one_per_group(spark, docs, FOLDER).collect()), key=str)
    assert kept == sorted([(None, b), (7, a + " end"), (7, c), (9, d), (None, None), (None, ""), (3, None)], key=str)


def test_pipeline_run(spark, docs, pairs):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, FOLDER).toPandas()
    groups = brute.jaccard_components(pairs, 5, 8, 10)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    first = [(d, t) for d, t in pairs if groups[d][1] == d]
    seen, kept = set(), set()
    for doc, text in sorted(first):
        raw = (text or "").encode()
        marks = bytearray(len(raw))
        for at in range(len(raw) - 99):
            window = raw[at : at + 100]
            if window in seen:
                marks[at : at + 100] = b"\1" * 100
            seen.add(window)
        left = bytes(c for c, m in zip(raw, marks, strict=True) if not m).decode("utf-8", "ignore")
        if not brute.leaks(left, items)[1]:
            kept.add(doc)
    assert set(packed["doc_id"]) == kept
