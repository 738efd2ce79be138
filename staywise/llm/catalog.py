"""The registered queries of this package."""
from . import (
    decontaminate,
    fertility,
    language_id,
    packing,
    parity_join,
    periodic_runs,
    piece_encoding,
    spelling_variants,
    style_tree,
    suffix_dedup,
    suffix_tree_lm,
    token_counts,
    url_filter,
)
from .tables import read, stage


def op1_suffix_array_dedup(spark, folder):
    return suffix_dedup.account(read(spark, folder, "documents"))


def op2_site_style_tree(spark, folder):
    return style_tree.main_text(read(spark, folder, "pages"))


def op3_probabilistic_suffix_tree(spark, folder):
    return suffix_tree_lm.learn_and_score(read(spark, folder, "documents"))


def op4_tokeniser_fertility(spark, folder):
    return fertility.verdicts(read(spark, folder, "documents"))


def op5_best_two_fit(spark, folder):
    return packing.pack_documents(read(spark, folder, "documents"))


def op6_length_histogram(spark, folder):
    return token_counts.context_table(stage(token_counts.length_histogram(read(spark, folder, "documents")), "lengths"))


def op10_prefix_filtered_decontamination(spark, folder):
    return decontaminate.decontamination(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("key")


def op7_blocked_bloom_url_filter(spark, folder):
    pages = read(spark, folder, "pages")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules, url_filter.unwanted_urls(pages))


def op8_parity_sketch_join(spark, folder):
    return parity_join.jaccard_components(read(spark, folder, "documents"), width=3, num=90, den=100)


def op9_script_viterbi(spark, folder):
    return language_id.learn_and_identify(read(spark, folder, "documents"))


def op11_periodic_runs(spark, folder):
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(read(spark, folder, "documents"))))


def op12_sentencepiece_spans(spark, folder):
    return piece_encoding.encoding_digests(piece_encoding.encode_documents(read(spark, folder, "documents")))


def op13_permuterm_spellings(spark, folder):
    return spelling_variants.group_spellings(read(spark, folder, "documents"), edited=spelling_variants.EDITED)


_ALL = (
    op1_suffix_array_dedup,
    op2_site_style_tree,
    op3_probabilistic_suffix_tree,
    op4_tokeniser_fertility,
    op5_best_two_fit,
    op6_length_histogram,
    op7_blocked_bloom_url_filter,
    op8_parity_sketch_join,
    op9_script_viterbi,
    op10_prefix_filtered_decontamination,
    op11_periodic_runs,
    op12_sentencepiece_spans,
    op13_permuterm_spellings,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op7_blocked_bloom_url_filter": url_filter.ORACLE,
    "op10_prefix_filtered_decontamination": decontaminate.ORACLE,
}
