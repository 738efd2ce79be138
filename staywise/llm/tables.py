"""Shared Spark helpers of the operators in this package."""
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stage

__all__ = ["arrays", "read", "stage", "per_batch", "text_key", "same", "small"]
BROADCAST_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark, folder, table):
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def per_batch(df, function, schema):
    """``function(record batch)`` yields dictionaries of column arrays named as in ``schema``."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for columns in function(batch):
                yield pa.record_batch([pa.array(columns[f.name], f.type, from_pandas=True) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def text_key(column):
    """128 bits that stand for a text when rows of one id are told apart."""
    return F.concat_ws("-", F.xxhash64(column), F.crc32(F.encode(column, "utf-8")), F.octet_length(column))


def same(a, b):
    """Equality that also holds between nulls."""
    return a.eqNullSafe(b)


def small(df, text_columns):
    """``df`` (a stored table) marked for broadcast if its text is within ``BROADCAST_BYTES``."""
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text_columns]
    size = sum(texts, F.count("*") * 64)
    return F.broadcast(df) if df.select(size.alias("n")).first()["n"] <= BROADCAST_BYTES else df


def arrays(df):
    """The columns of a result of bounded size as numpy arrays."""
    table = df.toArrow()
    return [table.column(name).to_numpy() for name in df.columns]
