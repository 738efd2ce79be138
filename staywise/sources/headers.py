"""The header record of many delimited files: each file is opened by a task that reads a few KB and closes it.

Files are dealt out to tasks by name, whatever their sizes. The first record is parsed with the reader's own separator, quote, escape and
encoding, so a quoted line break may stand inside a name; empty lines and comment lines before it are skipped.
Stores that Arrow cannot open are left to Spark's reader, file by file and a few at a time, which also stops after the header.
"""
import csv
import io
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

FILES_PER_TASK = 64
READ_AT_ONCE = 8192  # bytes fetched from a remote store at a time
JOBS_AT_ONCE = 8


def open_stream(path):
    """A decompressed byte stream of a file that Spark has listed, or None if Arrow knows no such store."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    try:
        store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    except (pa.ArrowInvalid, OSError):  # unknown here, or its client is not installed
        return None
    return store.open_input_stream(inner, buffer_size=READ_AT_ONCE)


def first_record(stream, settings):
    """Names in the first record of a delimited byte stream; an empty file has none."""
    text = io.TextIOWrapper(stream, encoding=settings.get("encoding", "utf-8"), newline="")
    quote, escape = settings.get("quote", '"'), settings.get("escape")
    comment = settings.get("comment")
    lines = (line for line in text if line.strip() and not (comment and line.startswith(comment)))
    if settings.get("multiLine") in (True, "true"):
        lines = _from_first(text, comment)
    doubled = escape in (None, quote)
    rows = csv.reader(
        lines, delimiter=settings.get("sep", ","), quotechar=quote or None, escapechar=None if doubled else escape,
        doublequote=doubled, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE,
    )
    names = tuple(name.removeprefix("\ufeff") for name in next(rows, ()))
    text.detach()  # the caller closes the stream
    return names


def _from_first(text, comment):
    """Lines from the first one with content on: later empty lines may stand inside a quoted name."""
    for line in text:
        if line.strip() and not (comment and line.startswith(comment)):
            yield line
            break
    for line in text:
        yield line


def header_records(spark, files, settings):
    """``{file: names}``. One job for all files, and one row per file to the driver."""
    def read(batches):
        for batch in batches:
            found = []
            for path in batch.column("file").to_pylist():
                stream = open_stream(path)
                if stream is None:
                    found.append(None)
                    continue
                with stream:
                    found.append(list(first_record(stream, settings)))
            yield pa.record_batch([batch.column("file"), pa.array(found, pa.list_(pa.string()))], names=["file", "names"])

    tasks = -(-len(files) // FILES_PER_TASK)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks, F.col("file"))
    rows = listed.mapInArrow(read, "file string, names array<string>").collect()
    known = {r["file"]: tuple(r["names"]) for r in rows if r["names"] is not None}
    rest = [f for f in files if f not in known]
    if rest:
        by_spark = lambda f: tuple(spark.read.options(header=True, **settings).csv(f).columns)
        with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
            known.update(zip(rest, pool.map(by_spark, rest), strict=True))
    return known
