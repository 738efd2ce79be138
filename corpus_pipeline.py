"""The training-data pipeline: language, near duplicates, repeated passages, benchmark leaks, packing."""
import uuid

from staywise.llm import stages
from staywise.session import shared_folder

STAGES = [
    ("language_id", stages.keep_identified),
    ("ngram_jaccard_join", stages.keep_one_per_group),
    ("suffix_array_dedup", stages.remove_repeated_bytes),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("best_fit_packing", stages.pack_sequences),
]
ORACLE_SQL = None  # language model, shingle components and packing are not SQL; tests compare with a brute-force version


def run(spark, sf_dir):
    """All stages in order over ``documents``; each result is written as Parquet and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (name, function) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
