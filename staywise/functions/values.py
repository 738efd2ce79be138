"""Column expressions that turn raw text into ids, numbers, dates and canonical spellings."""
from pyspark.sql import Column, functions as F, types as T

from ..session import staged_observed

# Texts that mean "no id".
EMPTY_IDS = ["", "nan", "none", "null", "<na>"]

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_ISO_CLOCK = r"(?:[T ](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?(?: ?(?:Z|[+-]\d{2}(?::?\d{2})?))?)?"
_ISO = r"^(?:\d{8}|\d{4}(?:[-/.]\d{1,2}){0,2})" + _ISO_CLOCK + "$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])"

# Shapes tried after ISO. Slashed dates may carry a clock and be day or month first; the others are day first.
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d)?)?$"
_DASHED_OR_DOTTED = r"^(\d{1,2})([-.])(\d{1,2})\2(\d{4})$"

# Strptime directives and their datetime-pattern letters.
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "M",
    "%b": "MMM",
    "%B": "MMMM",
    "%d": "d",
    "%H": "H",
    "%I": "h",
    "%M": "m",
    "%S": "s",
    "%f": "SSSSSS",
    "%p": "a",
}


def text(column: Column, dtype=None) -> Column:
    """Trimmed text; whole doubles print as integers so that 12346.0 and 12346 are the same id."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < F.lit(9e15))
        printed = F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
        return F.when(~F.isnan(column), printed)
    return F.trim(column.cast("string"))


def clean_id(column: Column, dtype=None) -> Column:
    bare = F.regexp_replace(text(column, dtype), r"\.0+$", "")
    return F.when(~F.lower(bare).isin(EMPTY_IDS), bare)


def number(column: Column, dtype=None) -> Column:
    """Double, or NULL where the text is not a plain number."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    bare = F.trim(column.cast("string"))
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def iso_date(column: Column, dtype=None) -> Column:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("date")
    bare = F.trim(column.cast("string"))
    dashed = F.translate(F.regexp_replace(bare, _COMPACT, "$1-$2-$3"), "/.", "--")
    return F.when(bare.rlike(_ISO), dashed.try_cast("date"))


def looks_iso(column: Column, dtype=None) -> Column:
    """Whether the text starts with a year; native dates always count as ISO."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.isNotNull()
    return F.trim(column.cast("string")).rlike(r"^\d{4}")


def spark_pattern(strptime_format: str) -> str:
    out, i = "", 0
    while i < len(strptime_format):
        two = strptime_format[i : i + 2]
        if two in DIRECTIVES:
            out, i = out + DIRECTIVES[two], i + 2
        else:
            letter = strptime_format[i]
            out, i = out + (f"'{letter}'" if letter.isalpha() else letter), i + 1
    return out


def parse_date(column: Column, dtype=None, date_format=None, dayfirst=False) -> Column:
    """Calendar day: the configured format only, or ISO first and then the day-first / month-first patterns."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("date")
    bare = F.trim(column.cast("string"))
    if date_format:
        return F.try_to_timestamp(bare, F.lit(spark_pattern(date_format))).cast("date")
    reordered = lambda pattern, order: F.regexp_replace(bare, pattern, order).try_cast("date")
    day_first, month_first = reordered(_SLASHED, "$3-$2-$1"), reordered(_SLASHED, "$3-$1-$2")
    slashed = F.coalesce(day_first, month_first) if dayfirst else F.coalesce(month_first, day_first)
    return (
        F.when(bare.rlike(r"^\d{4}"), iso_date(column))
        .when(bare.rlike(_SLASHED), slashed)
        .when(bare.rlike(_DASHED_OR_DOTTED), reordered(_DASHED_OR_DOTTED, "$4-$3-$1"))
    )


def spelling_key(column: Column) -> Column:
    return F.lower(F.trim(column))


def canonical_spellings(df, columns):
    """``field, spelling_key, canonical, spellings``: the commonest surface form of each spelling (the smallest text on ties) and how many
    forms it has. All columns are counted in one pass."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    texts = df.selectExpr(f"stack({len(columns)}, {pairs}) as (field, text)").where("text is not null")
    counted = texts.groupBy("field", spelling_key(F.col("text")).alias("spelling_key"), F.trim("text").alias("surface")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.groupBy("field", "spelling_key").agg(
        F.min_by("surface", F.struct(-F.col("n"), "surface")).alias("canonical"), F.count(F.lit(1)).alias("spellings")
    )


SMALL_VOCABULARY = 8 << 20  # bytes of text
SPREAD = 1024


def stored_spellings(df, columns):
    """The vocabulary written once, its size in bytes, and per column how many spellings are replaced by another."""
    merged = {c: F.sum(F.when(F.col("field") == c, F.col("spellings") - 1)) for c in columns}
    size = F.sum(F.octet_length("spelling_key") + F.octet_length("canonical") + 16)
    words, n = staged_observed(canonical_spellings(df, columns), "spellings", _bytes=size, **merged)
    return words, n.pop("_bytes") or 0, {c: v or 0 for c, v in n.items()}


def unify_spelling(df, columns, vocabulary=None):
    """Replace every spelling by its canonical form, learned from ``df`` or given as ``stored_spellings``.

    A vocabulary of checked size is broadcast, a larger one is joined like any table; missing texts, which match nothing, are then spread over
    ``SPREAD`` keys, so they do not meet in one task.
    """
    words, size, _ = vocabulary or stored_spellings(df, columns)
    for column in columns:
        mine = words.where(F.col("field") == column).select("spelling_key", "canonical")
        key = spelling_key(F.col(column))
        if size <= SMALL_VOCABULARY:
            mine = F.broadcast(mine)
        else:
            nowhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)).cast("string"))
            key = F.coalesce(key, nowhere)
        names = [c if c != column else F.col("canonical").alias(column) for c in df.columns]
        df = df.withColumn("spelling_key", key).join(mine, "spelling_key", "left").select(*names)
    return df
