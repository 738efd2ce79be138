"""The pipeline's stages: ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of ``docs``."""
from pyspark.sql import functions as F

from . import decontaminate, language_id, packing, parity_join, suffix_dedup
from .tables import read, same, small, stage, text_key


def keep_identified(spark, docs, sf_dir):
    """Drops documents without letters and those with more than half of their letters in scripts that no learned language uses.

    Texts in several languages stay. Without usable labels every document with a letter stays. Null texts go; ids may be null or
    repeated, equal rows stay or go together, no rows give none.
    """
    return language_id.keep_identified(docs, language_id.learn(docs))


def keep_one_per_group(spark, docs, sf_dir):
    """Keeps the document of smallest (id, text key), null ids last, of every group of near duplicates (five-word shingles, similarity 0.8 or more).

    Documents are told apart by id and text, so other texts under a kept id go with their own group; of rows equal in both one stays.
    """
    groups = stage(parity_join.jaccard_groups(docs, width=5, num=8, den=10), "groups")
    first = groups.select(F.col("first.doc_id").alias("kept_id"), F.col("first.tkey").alias("kept_key")).distinct()
    # most documents are met once and kept, so only the others are dealt out by their key
    documents = groups.groupBy("doc_id", "tkey").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.collect_set("h").alias("h"))
    plain = (F.col("n") == 1) & same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("tkey") == F.col("first.tkey"))
    marked = parity_join.marked_rows(docs, documents.where(~plain).select(F.explode("h").alias("key")).distinct())
    keyed = marked.where("may_be").withColumn("kept_text_key", text_key(F.col("text")))
    kept = keyed.join(first, same(F.col("doc_id"), F.col("kept_id")) & (F.col("kept_text_key") == F.col("kept_key")), "left_semi")
    kept = kept.dropDuplicates(["doc_id", "kept_text_key"]).drop("kept_text_key")
    return marked.where("NOT may_be").unionByName(kept).drop("may_be")


def remove_repeated_bytes(spark, docs, sf_dir):
    """Cuts every passage of 100 bytes or more that also starts earlier in the corpus out of the texts.

    Null texts stay null, shorter ones whole. Earlier is by id, null ids first, then by the text's hash; rows equal in id and text are one
    document and are cut alike. Other columns stay, ``n_chars`` is counted anew. No rows give none.
    """
    return suffix_dedup.cut_texts(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Drops documents in which a window of a benchmark item occurs.

    Null and wordless texts hold none and stay. Rows are told apart by id and text, so a null or repeated id drops no other text; rows equal in both
    go together. Without benchmark items or documents nothing is dropped.
    """
    found = decontaminate.decontamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated")
    bad = small(stage(found.select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")), "contaminated"), ["bad_key"])
    return docs.join(bad, same(docs["doc_id"], bad["bad_id"]) & (text_key(docs["text"]) == bad["bad_key"]), "left_anti")


def pack_sequences(spark, docs, sf_dir):
    """Packs all documents into sequences of 2048 tokens.

    Null and empty texts are one token, the end. Every row is packed for itself, whatever its id; ties of length may take any order. No rows
    give no sequences.
    """
    return packing.pack_documents(docs)
