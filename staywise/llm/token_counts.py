"""Exact token accounts of a corpus from the histogram of encoded lengths.

Every text is encoded once; only (length, documents) pairs are shuffled. Suffix sums over the distinct lengths then answer, without
another pass over the texts, how many documents and tokens lie at or beyond any context limit, what is left when every text is
cut there, and which length holds a given share of the documents.

Null and empty texts have length 0 and are counted. Repeated rows count each. No rows give an empty histogram. Other columns are not read.
"""
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .bytescan import binary_values, slices
from .tables import per_batch

SPAN = 1024  # distinct lengths summed by one window group


def length_histogram(docs, text="text", vocabulary=None):
    """(length, n_docs): documents of each encoded length."""
    vocabulary = vocabulary or vocabulary_path()

    def count(batch):
        values, lengths = binary_values(batch.column(0)), []
        for a, b in slices(values):
            lengths.append(np.diff(encoder(vocabulary).encode(values[a:b])[1]))
        distinct, n = np.unique(np.concatenate(lengths), return_counts=True) if lengths else ([], [])
        yield {"length": distinct, "n_docs": n}

    local = per_batch(docs.select(F.col(text).alias("text")), count, "length long, n_docs long")
    return local.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_table(histogram):
    """One row per distinct length L, read as a context limit.

    ``docs_from`` and ``tokens_from`` count the documents of at least L tokens, ``docs_cut`` those longer than L, ``tokens_cut_at`` all tokens
    when every text is cut at L, ``share_within`` the share of documents that fit whole.
    """
    rows = histogram.withColumn("span", F.floor(F.col("length") / SPAN)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = (
        rows.groupBy("span")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "span",
            F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
            F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
            F.sum("d").over(everything).alias("n_all"),
            F.sum("t").over(everything).alias("total_tokens"),
        )
    )
    inside = Window.partitionBy("span").orderBy(F.desc("length"))
    docs_from = F.sum("n_docs").over(inside) + F.col("docs_after")
    tokens_from = F.sum("tokens").over(inside) + F.col("tokens_after")
    table = rows.join(spans, "span").withColumn("docs_from", docs_from).withColumn("tokens_from", tokens_from)
    docs_cut = F.col("docs_from") - F.col("n_docs")
    return table.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_from",
        "tokens_from",
        docs_cut.alias("docs_cut"),
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("tokens_cut_at"),
        (1 - docs_cut / F.col("n_all")).alias("share_within"),
    )


def truncated_totals(table, limits):
    """Total tokens when every text is cut at each of the given limits, whether or not some text has that length."""
    below = F.when(F.col("context_limit") < F.col("limit"), F.col("context_limit")).otherwise(F.col("limit"))
    listed = table.withColumn("limit", F.explode(F.array(*[F.lit(int(x)) for x in limits])))
    return listed.groupBy("limit").agg(F.sum(below * F.col("n_docs")).alias("tokens"))


def length_quantiles(table, shares):
    """Smallest length within which at least each share of the documents fits whole."""
    return table.select(
        *[F.min(F.when(F.col("share_within") >= F.lit(q) - 1e-12, F.col("context_limit"))).alias(f"q{q}") for q in shares]
    )
