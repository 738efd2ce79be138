"""Rows that share an id, and texts in scripts or languages that were not learned."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.llm import catalog, language_id, stages, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
EN = "and the other of these were there when he would not that which about them "
FR = "et les autres de ces choses qui ne sont pas dans la maison avec nous pour "
DE = "und die anderen von diesen Sachen sind nicht mehr bei uns gewesen als wir "


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, text * 3, lang) for i, (text, lang) in enumerate([(EN, "en"), (FR, "fr"), (DE, "de")] * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, EN * 4), (2, "漢字 漢字 漢字"), (3, "αυτό είναι ένα ελληνικό κείμενο"), (4, EN + FR + DE), (5, "12345 !!"), (6, None), (7, ""),
        (None, FR * 2), (None, FR * 2), (8, "漢字漢字漢字漢字漢字漢字 the and of"), (9, "the and of these other 漢字"),
    ]
    return spark.createDataFrame([(i, t, "zz", 5, True) for i, t in rows], "doc_id long, text string, lang string, letters int, known boolean")


def test_unknown_scripts_have_no_certainty(labelled, odd):
    found = {(r["doc_id"], r["lang_pred"]): r for r in language_id.identify(odd, language_id.learn(labelled)).collect()}
    by_id = {i: r for (i, _), r in found.items()}
    assert by_id[1]["lang_pred"] == "en" and by_id[1]["score"] == 1.0
    for i in (2, 3):
        assert by_id[i]["score"] == 0.0 and by_id[i]["lang_pred"] in ("de", "en", "fr")
        assert [s["lang"] for s in by_id[i]["spans"]] == ["und"]
    assert {s["lang"] for s in by_id[4]["spans"]} == {"en", "fr", "de"} and by_id[4]["score"] < 0.5
    for i in (5, 6, 7):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0.0
    assert 0 < by_id[8]["score"] < 0.5 < by_id[9]["score"] < 1 and by_id[9]["lang_pred"] == "en"


def test_null_ids_are_not_held_out(spark, labelled):
    rows = labelled.unionByName(labelled.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    found = language_id.learn_and_identify(rows).collect()
    assert len(found) == 123 and all(r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_stage_keeps_mixed_texts_and_drops_what_it_cannot_read(spark, labelled, odd):
    kept = language_id.keep_identified(odd, language_id.learn(labelled))
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 4, 9]
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    everything = stages.keep_identified(spark, unlabelled, SF)
    assert sorted((r["doc_id"] or 0) for r in everything.collect()) == [0, 0, 1, 2, 3, 4, 8, 9]
    assert stages.keep_identified(spark, labelled.where("false"), SF).count() == 0


def test_texts_of_one_id_with_equal_crc32_keep_their_bytes(spark):
    """Two texts under one id, and under no id, whose crc32 are equal: only the one that repeats something loses bytes."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    passage = noise(300)
    a, b = noise(150) + passage, noise(600)
    ends = {}
    for _ in range(3):
        for k in rng.integers(0, 26**9, 200_000).tolist():
            tail = f"{k:09x}"
            ends.setdefault(zlib.crc32(tail.encode(), zlib.crc32(a.encode())), tail)
    pair = None
    while pair is None:
        for k in rng.integers(0, 26**9, 200_000).tolist():
            tail = f"{k:09x}"
            hit = ends.get(zlib.crc32(tail.encode(), zlib.crc32(b.encode())))
            if hit:
                pair = a + hit, b + tail
                break
    assert zlib.crc32(pair[0].encode()) == zlib.crc32(pair[1].encode())
    for doc_id in (2, None):
        docs = spark.createDataFrame([(1, passage + noise(200)), (doc_id, pair[0]), (doc_id, pair[1])], "doc_id long, text string")
        removed = {r["n_bytes"]: r["n_removed"] for r in suffix_dedup.account(docs).where(F.col("doc_id").eqNullSafe(F.lit(doc_id))).collect()}
        assert removed[len(pair[1])] == 0
        assert removed[len(pair[0])] == (300 if doc_id else removed[len(pair[0])])


def test_texts_are_encoded_once(spark, capsys):
    catalog.op6_length_histogram(spark, SF).explain()
    assert "MapInArrow" not in capsys.readouterr().out
    assert token_counts.length_histogram(spark.createDataFrame([(None,)], "text string")).collect()[0]["length"] == 0
