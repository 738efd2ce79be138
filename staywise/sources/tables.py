"""Reading raw order data: CSV, TSV (plain or gzip) and parquet, files, folders and globs stacked by column name.

Paths are expanded by Spark's own listing. Delimited files are grouped by their header record (see ``headers``), and each group is one scan
that refuses a file with another header; parquet is read with merged schemas. Columns missing in some files are NULL there.
"""
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..errors import DatasetError
from .headers import header_records

# Texts that mean "no value" in delimited files.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]


# Read options of the configuration and the reader's options they set.
OPTIONS = {"sep": "sep", "encoding": "encoding", "quote": "quote", "escape": "escape", "comment": "comment", "multi_line": "multiLine"}
CONTROL = {"format", "same_header", "null_texts"}


def read_table(spark, paths, read_options=None):
    """All files as one table. Delimited text stays text: coercion is explicit and counted later.

    ``read_options``: those of ``OPTIONS``, ``format`` (csv, tsv or parquet; else by file name), ``same_header`` (trust that all files
    of a kind have the first one's header, saving a job; a file that differs stops the read) and ``null_texts`` (more texts that
    mean "no value").
    """
    paths = [paths] if isinstance(paths, str) else list(paths or [])
    if not paths:
        raise DatasetError("No input files configured: source.transactions is empty.")
    options = dict(read_options or {})
    unknown = sorted(set(options) - set(OPTIONS) - CONTROL)
    if unknown:
        raise DatasetError(f"Unsupported read options: {', '.join(unknown)}. Supported: {', '.join(sorted({*OPTIONS, *CONTROL}))}.")
    null_texts = [*MISSING_TEXTS, *map(str, options.get("null_texts") or [])]
    by_kind = {}
    for path in _files(spark, paths):
        by_kind.setdefault(options.get("format") or _kind(path), []).append(path)
    frames = []
    if files := by_kind.pop("parquet", None):
        # whole paths keep the columns that folder names carry
        frames.append(spark.read.option("mergeSchema", True).parquet(*(files if by_kind else paths)))
    for kind, files in sorted(by_kind.items()):
        settings = _settings(kind, options)
        groups = [files] if options.get("same_header") else _by_header(spark, files, settings)
        frames += [_delimited(spark, group, settings, null_texts) for group in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _files(spark, paths):
    """Every file below ``paths``, from the listing alone."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path").collect()
    except AnalysisException as error:
        raise DatasetError(f"Input file not found: {', '.join(paths)}. Check source.transactions in the configuration.") from error
    if not listed:
        raise DatasetError(f"Input file not found: {', '.join(paths)} holds no file. Check source.transactions in the configuration.")
    return sorted(r["path"] for r in listed)


def _kind(path):
    """By the file's suffix, or else by that of the nearest folder that has one."""
    for part in reversed(path.lower().split("/")):
        for kind in ("parquet", "tsv", "csv"):
            if part.removesuffix(".gz").endswith(f".{kind}") and not (kind == "csv" and part.startswith("part-")):
                return kind
    return "csv"


def _by_header(spark, files, settings):
    """``files`` grouped by their header record."""
    groups = {}
    for file, header in sorted(header_records(spark, files, settings).items()):
        groups.setdefault(header, []).append(file)
    groups.pop((), None)  # empty files
    if not groups:
        raise DatasetError(f"No header in {', '.join(files)}: the input files are empty.")
    return list(groups.values())


def _settings(kind, options):
    """Reader options of a kind of delimited file."""
    return {"sep": "\t" if kind == "tsv" else ",", "escape": '"', **{OPTIONS[k]: v for k, v in options.items() if k in OPTIONS}}


def _delimited(spark, files, settings, null_texts):
    table = spark.read.options(header=True, enforceSchema=False, **settings).csv(files)
    present = lambda c: F.when(~F.trim(F.col(f"`{c}`")).isin(null_texts), F.col(f"`{c}`"))
    return table.select(*[present(c).alias(c) for c in table.columns])
