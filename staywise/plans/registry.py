"""Registration of a query together with its oracle, both finished by the same column specification.

A specification lists output columns as ``name:kind`` with kind ``s`` text, ``i`` whole number, ``b`` boolean (as 0/1),
``d`` date (as ISO text) or a digit, the decimals kept of a double. Sums of doubles depend on the order of addition, so
doubles are published rounded half up. Averages of cents often lie exactly between two rounded values, where the noise of addition
would decide, so the double first becomes a decimal with ``GUARD_DIGITS`` more digits.
"""
from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}
GUARD_DIGITS = 4


def _spark_column(name, kind):
    c = F.col(f"`{name}`")
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "b":
        return c.cast("int").cast("bigint").alias(name)
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    exact = F.round(c.cast("double").try_cast(f"decimal(38,{int(kind) + GUARD_DIGITS})"), int(kind))
    return (exact.cast("double") + F.lit(0.0)).alias(name)


def _sql_column(name, kind):
    quoted = f'"{name}"'
    if kind in "ib":
        return f"CAST({quoted} AS BIGINT) AS {quoted}"
    if kind == "d":
        return f"strftime({quoted}, '%Y-%m-%d') AS {quoted}"
    if kind == "s":
        return f"CAST({quoted} AS VARCHAR) AS {quoted}"
    exact = f"round(TRY_CAST(CAST({quoted} AS DOUBLE) AS DECIMAL(38, {int(kind) + GUARD_DIGITS})), {kind})"
    return f"CAST({exact} AS DOUBLE) + 0.0 AS {quoted}"


def _parse(spec):
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def register(name, spec, build, ctes=None, select=None):
    """``build(workspace)`` gives the DataFrame; ``ctes`` + ``select`` the same result in plain SQL, if SQL can say it."""
    from .workspace import workspace

    columns = _parse(spec)

    def query(spark, folder):
        return build(workspace(spark, folder)).select(*[_spark_column(n, k) for n, k in columns])

    QUERIES[name] = query
    if select is not None:
        prefix = f"WITH {ctes} " if ctes else ""
        listed = ", ".join(_sql_column(n, k) for n, k in columns)
        ORACLES[name] = f"{prefix}SELECT {listed} FROM ({select}) AS answer"
