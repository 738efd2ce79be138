"""Where intermediate tables live, and how much may come to the driver."""
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Observation, SparkSession

ROWS_PER_PARTITION = 500_000
PARTITION_SIZE = "16m"

_local_folders = {}
_scopes = []


def shared_folder(spark):
    """The cluster's checkpoint folder. Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="staywise-")
    return _local_folders[application]


def size_shuffles(spark, rows):
    """Lets the shuffles of ``spark`` follow the input, so that what a task sorts or hashes keeps its size and is not spilled.

    A fixed number of partitions gives tasks that grow with the data. The number is only ever raised; adaptive execution still puts small
    partitions together, up to ``PARTITION_SIZE`` of compressed rows, unless the session names a size of its own.
    """
    wanted = -(-rows // ROWS_PER_PARTITION)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", wanted)
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_SIZE)


def stage(df, label, partition_by=None):
    """Write ``df`` once to the shared folder and read it back: short lineage, survives lost executors, prunable."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_path(spark, label):
    """A new path for a staged table, inside the innermost open scope."""
    top = _scopes[-1] if _scopes else f"{shared_folder(spark).rstrip('/')}/staywise/{spark.sparkContext.applicationId}"
    return f"{top}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def staging(spark):
    """Everything staged inside is removed at the end, also after a failure. Results must be written elsewhere by then."""
    scope = staged_path(spark, "scope")
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        remove(spark, scope)


def remove(spark, path):
    """Deletes a folder that this library has written, if it is there. In a store that Arrow cannot reach, Spark empties it instead."""
    try:
        store, inner = fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):  # unknown here, or its client is not installed
        spark.createDataFrame([], "empty int").write.mode("overwrite").parquet(path)
        return
    if store.get_file_info(inner).type == fs.FileType.Directory:
        store.delete_dir(inner)


def observed(df, **metrics):
    """(``df`` that counts ``metrics`` (name = aggregate) when it is next written, a function that then gives them as a dictionary)."""
    seen = Observation(uuid.uuid4().hex)
    return df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), lambda: dict(seen.get)


def staged_observed(df, label, **metrics):
    """``stage`` that also takes metrics while writing: (table, values). No second scan."""
    counting, values = observed(df, **metrics)
    table = stage(counting, label)
    return table, values()


def checkpointed(df):
    """A reliable checkpoint that keeps partition order, for jobs that number rows by position."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def collect_if_small(df, limit):
    """All rows of a summary if there are at most ``limit``, otherwise None (the caller then joins instead)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def local_session(cores="*", partitions=8, memory="8g", **settings):
    """A session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("staywise")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
