"""Periodic runs, SentencePiece encoding and spelling groups against plain versions and the public library."""
import hashlib
import random
from types import SimpleNamespace

import brute_new as brute
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from staywise.llm import catalog, periodic_runs as runs, piece_encoding as pieces, spelling_variants as spellings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def odd_rows(spark, texts):
    """Null and repeated ids, null texts, repeated rows, and other columns whose names the operators use inside."""
    rows = [(None, t) for t in texts] + [(7, t) for t in texts] + [(8, None), (8, None), (9, "")] + [(10, texts[0])] * 3
    return rows, spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], "doc_id long, text string, runs int, word string, rank long").repartition(3)


# --- periodic runs ---------------------------------------------------------------------------------------------------


def found_runs(texts, least):
    """Runs of lists of numbers, scanned as one block."""
    first = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    hashes = np.array([x + 7 for t in texts for x in t], np.uint64)
    return [tuple(map(int, r)) for r in runs.block_runs(hashes, first, least)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_of_small_alphabets(texts, least):
    want = [(t, s, s + n, p) for t, words in enumerate(texts) for s, n, p in brute.runs(words, least)]
    assert found_runs(texts, least) == want


def test_runs_longer_than_the_cover():
    rng = random.Random(4)
    for trial in range(60):
        texts = []
        for _ in range(4):
            n, k = rng.choice([0, 1, 200, 500, 900]), rng.choice([1, 2, 40])
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // (2 + rng.randrange(5))
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
                if rng.random() < 0.5:
                    words[rng.randrange(n)] = 99
            texts.append(words)
        want = [(t, s, s + n, p) for t, words in enumerate(texts) for s, n, p in brute.runs(words, 12)]
        assert found_runs(texts, 12) == want, trial


def test_words_rich_in_runs():
    a, b = [1], [1, 2]
    while len(b) < 1000:
        a, b = b, b + a
    assert found_runs([b], 2) == [(0, s, s + n, p) for s, n, p in brute.runs(b, 2)]


@pytest.mark.parametrize("v", [1, 2, 16, 64])
def test_cover_reaches_every_distance(v):
    inside, _, step_to = runs.difference_cover(v)
    for d in range(v):
        assert inside[step_to[d]] and inside[(step_to[d] + d) % v]


def test_run_query_on_all_documents(spark, documents):
    got = {tuple(r) for r in catalog.op11_periodic_runs(spark, SF).collect()}
    assert got == {brute.run_row(*d) for d in documents} and sum(r[1] > 0 for r in got) > len(documents) // 20


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{i % 5}" for i in range(60_000))
    texts = ["a\tb " * 30, "no run at all here", "ä b\x0b" * 40, "x" * 100_000, long, " \n\t "]
    rows, docs = odd_rows(spark, texts)
    planted = [(*r, *brute.run_row(*r)[1:]) for r in rows if r[1] != long]
    digests = runs.run_digests(runs.periodic_runs(runs.with_planted_periods(docs)))
    assert digests.count() == len(rows)
    got = sorted(map(str, (tuple(r) for r in digests.collect() if r["length"] is None or r["length"] < 5000)))
    assert got == sorted(str((r[0], *r[2:])) for r in planted if r[3] is None or r[4] < 5000)
    plain = runs.periodic_runs(docs).where("size(runs) > 0").collect()
    whole = [r for r in plain if r["runs"][0]["length"] == 60_000]
    assert len(whole) == 2 and whole[0]["runs"][0]["period"] == 5 and whole[0]["collapsed"] == "w0 w1 w2 w3 w4"
    assert runs.run_digests(runs.periodic_runs(runs.with_planted_periods(docs.where("false")))).collect() == []


# --- SentencePiece ---------------------------------------------------------------------------------------------------

BITS = ["a", "b", "the", " ", "  ", "\n", "é", "漢", "▁", "\0", "😀", "the ", "ing", "<s>", "</s>", "<unk>", "<0x41>", "\t", "é", "Ω",
        " ", " ", "1", "22", "()", "�", "​", "ﬁ", "\U0010ffff", "\r\n", "."]


def mixed(seed, n, size=60):
    rng = random.Random(seed)
    return ["", " ", "  a", "▁", "the the"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_ids_spans_and_texts_are_the_librarys(library):
    texts = [*mixed(1, 1500), "a" * 5000, "▁" * 3000, "漢" * 700, "x=()" * 999]
    model, encoder = pieces.load(pieces.model_path())
    ids, begins, ends, bounds = pieces.encode_block(model, encoder, [t.encode() for t in texts])
    numbers, _, last, whole = pieces.with_ends(model, ids, begins, ends, bounds)
    data, edges = pieces.decode_block(model, numbers, whole)
    for k, text in enumerate(texts):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert numbers[whole[k] : whole[k + 1]].tolist() == want, text
        assert data[edges[k] : edges[k + 1]].tobytes().decode() == library.decode(want)
        spans = zip(begins[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]], strict=True)
        surfaces = [text.encode()[a:b].decode() for a, b in spans]
        assert surfaces == [p.surface for p in library.encode(text, return_type="proto").pieces], text
        assert last[whole[k + 1] - 1] == len(text.encode())


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(2)
    model, _ = pieces.load(pieces.model_path())
    rows = [[rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    bounds = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    data, edges = pieces.decode_block(model, np.array([i for r in rows for i in r], np.int64), bounds)
    for k, row in enumerate(rows):
        assert data[edges[k] : edges[k + 1]].tobytes().decode() == library.decode(row), row


def test_character_map_with_rules():
    """The library's own map of compatibility forms: longest prefixes, trimmed and marked spaces, and where characters came from."""
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(pieces._message(dict(pieces._message(normaliser.serialized_model_proto()))[3]))
    model = SimpleNamespace(map=pieces.CharacterMap(spec[2]), trim=True, dummy_prefix=True)
    rng = random.Random(3)
    odd = [chr(c) for c in (*range(0x20, 0x250), *range(0xF900, 0xFB00), *range(0xFF00, 0xFFF0))] + ["각", "ｶﾞ", "㍿"]
    for text in mixed(4, 1500, 20) + ["".join(rng.choice(BITS + odd) for _ in range(8)) for _ in range(3000)]:
        got, source = pieces.PieceModel.normalised(model, text.encode())
        assert got == normaliser.normalize(text), text
        assert len(source) == len(got) + 1 and (np.diff(source) >= 0).all()
    got, source = pieces.PieceModel.normalised(model, "ａ ﬁ".encode())
    assert got == "▁a▁fi" and source.tolist() == [0, 0, 3, 4, 4, 7]


def test_both_ways_of_joining_agree():
    model, _ = pieces.load(pieces.model_path())
    for text in [*mixed(5, 300), "the" * 60, "in" * 90]:
        assert list(model._joined_pairs(text)) == list(model._joined_by_queue(text))


def test_encoding_query_on_all_documents(spark, documents, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for doc_id, text in documents:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.add((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    got = catalog.op12_sentencepiece_spans(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert {tuple(r) for r in got.collect()} == want


def test_encoding_of_odd_rows(spark, library):
    texts = ["a b", "漢 \n", "x" * 300_000, " "]
    rows, docs = odd_rows(spark, texts)
    got = pieces.encode_documents(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, np.array(library.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()) for i, t in rows]
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=key) == sorted(want, key=key)
    assert all(np.frombuffer(r["ends"], "<u4")[-1] == len((r["decoded"] or "").encode()) for r in got)
    assert pieces.encoding_digests(pieces.encode_documents(docs.where("false"))).collect() == []


def test_models_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="merges"):
        pieces.PieceModel(b"")


# --- spelling groups -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed, ratio", [(0, 5), (1, 2)])
def test_groups_equal_comparing_all_words(spark, seed, ratio):
    rng = random.Random(seed)
    counts = {}
    for _ in range(400):
        word = "".join(rng.choice("abé" if rng.random() < 0.9 else "cÿz") for _ in range(rng.randint(1, 8)))
        counts[word] = rng.choice([1, 2, 5, 10, 25, 30, 100, 125, 150, 625, 700])
    long = "".join(rng.choice("ab") for _ in range(300))
    counts |= {long: 7, long[:100] + "c" + long[100:]: 50, long[:-1]: 7, "b" + long[1:]: 99}
    counts |= {"a" * 126: 1, "a" * 127: 5, "a" * 128: 25, "a" * 129: 125}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert {tuple(r) for r in spellings.spelling_groups(table, ratio).collect()} == brute.spelling_groups(counts, ratio)


def test_a_word_shared_by_a_whole_alphabet(spark):
    letters = [chr(c) for c in range(0xE0, 0x100)]
    counts = {f"sever{c}l": 5 for c in letters} | {"several": 500, "severl": 7}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spellings.spelling_groups(table).collect()} == brute.spelling_groups(counts, 5)


def test_counts_with_and_without_the_edit(spark):
    rng = random.Random(6)
    bits = ["Abcdef ", "ÀÉxyzwv-", "Straße,", " ÷×ééééé", "zzzzzzz" * 30 + " ", "abcdefgĀghijkl", "ZZZ9"]
    texts = ["".join(rng.choice(bits) for _ in range(40)) for _ in range(60)]
    rows, docs = odd_rows(spark, [*texts, "q" * 200_000])
    for edited in (None, 3):
        got = {r["word"]: r["n"] for r in spellings.word_counts(docs, 6, edited).collect()}
        assert got == dict(brute.word_counts(rows, 6, edited))
    assert spellings.group_spellings(docs.where("false")).collect() == []
    assert spellings.group_spellings(docs, least_count=10**9).collect() == []


def test_spelling_query_on_all_documents(spark, documents):
    got = {tuple(r) for r in catalog.op13_permuterm_spellings(spark, SF).collect()}
    counts = {w: n for w, n in brute.word_counts(documents, 6, 199).items() if n >= 5}
    assert {(r[0], r[3]) for r in got} == set(counts.items())
    by_shape = {}
    for word in counts:
        for k in {word} | {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + "*" + word[i + 1 :] for i in range(len(word))}:
            by_shape.setdefault(k, set()).add(word)
    for word, form, _, n, n_near, form_n in got:
        shapes = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + "*" + word[i + 1 :] for i in range(len(word))}
        others = {v for k in shapes for v in by_shape.get(k, ()) if brute.near(word, v)}
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is None or counts[best] < 5 * n:
            best = None
        assert (len(others), best, counts.get(best)) == (n_near, form, form_n)
    forms = {r[0]: r[1] for r in got}
    for word, _, root, *_ in got:
        while forms[word]:
            word = forms[word]
        assert word == root
