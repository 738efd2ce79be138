"""Cleaning with a full account: every input line is either kept or counted under exactly one reason."""
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import exact_quantiles, global_quantiles
from ..functions.values import looks_iso, number, parse_date, stored_spellings, unify_spelling
from ..schema import CUSTOMER_FIELDS, LINE_FIELDS
from ..session import stage, staged_observed
from .standardize import content_id

# Removal reasons.
BAD_DATE = "unparseable date"
NO_CUSTOMER = "missing customer id"
DUPLICATE = "exact duplicate row"
REPEATED_ID = "repeated transaction_id"
BAD_QUANTITY = "invalid quantity (zero / missing / negative but not a return)"
BAD_PRICE = "invalid price (<= 0 or missing)"
NO_PRICE = "unrecoverable price"
OUTSIDE_WINDOW = "outside configured date window"
NON_PRODUCT = "non-product line (configured filter, e.g. postage / fees)"

GENDERS = {"f": "Female", "female": "Female", "m": "Male", "male": "Male"}
AGE_RANGE = (16, 100)
SUSPICIOUS_QUANTILE = 0.999


# --- steps on lines ------------------------------------------------------------------------------------------------


def parse_dates(lines, cfg):
    """``date`` as a day, ``non_iso`` for dates only a fallback pattern could read, ``drop_reason`` for the rest."""
    dtype = lines.schema["date"].dataType
    day = parse_date(F.col("date"), dtype, cfg.get("date_format"), cfg.get("dayfirst", False))
    flagged = lines.select(
        *[(day if c == "date" else F.col(c)).alias(c) for c in lines.columns],
        (day.isNotNull() & ~looks_iso(F.col("date"), dtype)).alias("non_iso"),
    )
    reason = F.when(F.col("date").isNull(), BAD_DATE).when(F.col("customer_id").isNull(), NO_CUSTOMER)
    return flagged.withColumn("drop_reason", reason)


def _alive():
    return F.col("drop_reason").isNull()


def stored_line_spellings(lines, columns):
    """Vocabulary of the lines still in play."""
    return stored_spellings(lines.where(_alive()), columns)


def unify_lines(lines, columns):
    """Canonical spellings learned from the lines still in play."""
    return unify_spelling(lines, columns, stored_line_spellings(lines, columns))


def collapse_duplicates(lines, subset):
    """Rows equal in ``subset`` become one with a ``copies`` count.

    An aggregation, not a row_number window: copies are merged on the map side, so one row repeated in a third of the
    table never meets in one task. All buffers are fixed-width, so it is a hash aggregation. NULLs are equal here, as in
    the rule this implements. A line id that is not part of ``subset`` is derived from the kept content.
    """
    kept = lines.groupBy(*subset, "drop_reason").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum(F.col("non_iso").cast("bigint")).alias("non_iso_rows"),
        F.min("is_return").alias("is_return"),
    )
    return kept if "transaction_id" in subset else kept.withColumn("transaction_id", content_id(kept.select(*subset)))


def collapse_repeated_ids(lines):
    """One line per transaction id (missing ids count as equal), the smallest by content; others are counted."""
    carried = [c for c in lines.columns if c not in ("transaction_id", "drop_reason")]
    by_content = [c for c in carried if c not in ("copies", "non_iso_rows")]
    kept = lines.groupBy("transaction_id", "drop_reason").agg(
        F.count(F.lit(1)).alias("_with_id"),
        F.sum("copies").alias("_all_copies"),
        F.sum("non_iso_rows").alias("_non_iso"),
        F.min(F.struct(*by_content, "copies")).alias("_kept"),
    )
    repeated = F.when(_alive(), F.col("_with_id") - 1).otherwise(0)
    copies = F.when(_alive(), F.col("_all_copies") - repeated).otherwise(F.col("_all_copies"))
    return kept.select(
        "transaction_id",
        *[F.col(f"_kept.{c}").alias(c) for c in by_content],
        "drop_reason",
        copies.alias("copies"),
        repeated.alias("repeated"),
        F.col("_non_iso").alias("non_iso_rows"),
    )


def quantity_ok() -> Column:
    q, returned = F.col("quantity"), F.col("is_return")
    return F.coalesce(F.when(returned, q < 0).otherwise(q > 0), F.lit(False))


def price_ok() -> Column:
    return F.coalesce(F.col("unit_price") > 0, F.lit(False))


PRICES_IN_ONE_MAP = 1_000_000


def median_prices(lines):
    """``product_id, median``: of the valid prices of each named product.

    Prices are counted per product and value on the map side, and the counts are stored. ``percentile`` then merges the counts of a
    product into one map; products with more distinct prices than ``PRICES_IN_ONE_MAP`` go through the distributed selection instead.
    Both are exact.
    """
    valid = lines.where(price_ok() & F.col("product_id").isNotNull())
    counts = stage(valid.groupBy("product_id", "unit_price").agg(F.count(F.lit(1)).alias("n")), "price-counts")
    sizes = counts.groupBy("product_id").agg(F.count(F.lit(1)).alias("prices"))
    in_one = lambda df: df.groupBy("product_id").agg(F.expr("percentile(unit_price, 0.5D, n)").alias("median"))
    if (sizes.agg(F.max("prices")).first()[0] or 0) <= PRICES_IN_ONE_MAP:
        return in_one(counts)
    large = sizes.where(F.col("prices") > PRICES_IN_ONE_MAP).select("product_id")
    split = exact_quantiles(counts.join(large, "product_id", "left_semi"), ["unit_price"], [0.5], by=["product_id"], weight="n")
    rest = in_one(counts.join(large, "product_id", "left_anti"))
    return rest.unionByName(split.select("product_id", F.col("q0").alias("median")))


def impute_prices(lines):
    """Median valid price of the product, joined only to the lines that need it. Adds ``price_imputed``."""
    alive = _alive() if "drop_reason" in lines.columns else F.lit(True)
    needs = alive & ~price_ok()
    bad, named = lines.where(needs), F.col("product_id").isNotNull()
    medians = median_prices(lines.where(alive))
    repaired = bad.where(named).join(medians, "product_id", "left").withColumn("unit_price", F.col("median"))
    nameless = bad.where(~named).withColumn("unit_price", F.lit(None).cast("double"))
    touched = repaired.select(*lines.columns).unionByName(nameless).withColumn("price_imputed", F.lit(True))
    return lines.where(~needs).withColumn("price_imputed", F.lit(False)).unionByName(touched)


def percent_discount() -> Column:
    return F.coalesce((F.col("discount") > 1) & (F.col("discount") <= 100), F.lit(False))


def fixed_discount() -> Column:
    scaled = F.when(percent_discount(), F.col("discount") / 100).otherwise(F.col("discount"))
    return F.when((scaled < 0) | (scaled > 1), 0.0).otherwise(scaled)


def discount_beyond_repair() -> Column:
    return F.coalesce((F.col("discount") < 0) | (F.col("discount") > 100), F.lit(False))


def line_value() -> Column:
    return F.col("quantity") * F.col("unit_price") * (1 - F.col("discount"))


def flag_suspicious(lines):
    """Purchases strictly above the 99.9% quantile of purchase values."""
    purchases = lines.where(~F.col("is_return"))
    (cut,) = global_quantiles(purchases, ["transaction_value"], [SUSPICIOUS_QUANTILE])["transaction_value"]
    above = F.col("transaction_value") > F.lit(cut) if cut is not None else F.lit(False)
    return lines.withColumn("suspicious_value", F.coalesce(~F.col("is_return") & above, F.lit(False)))


# --- steps on customers --------------------------------------------------------------------------------------------


def one_row_per_customer(customers, cfg):
    """Registration date parsed; of repeated ids one row stays: the one that knows more from left to right, then the smallest.

    Files have no order here that could name a first row. An aggregation, so no id is a hot window."""
    parsed = customers.withColumn(
        "customer_registration_date",
        parse_date(
            F.col("customer_registration_date"),
            customers.schema["customer_registration_date"].dataType,
            cfg.get("date_format"),
            cfg.get("dayfirst", False),
        ),
    )
    rest = CUSTOMER_FIELDS[1:]
    known_first = F.struct(*[x for c in rest for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    kept = parsed.groupBy("customer_id").agg(F.min(known_first).alias("_kept"))
    return kept.select("customer_id", *[F.col(f"_kept.{c}").alias(c) for c in rest])


def add_unlisted_customers(customers, lines):
    """``unlisted`` marks the customers that only the lines know."""
    unlisted = lines.select("customer_id").distinct().join(customers.select("customer_id"), "customer_id", "left_anti")
    listed = customers.withColumn("unlisted", F.lit(False))
    return listed.unionByName(unlisted.withColumn("unlisted", F.lit(True)), allowMissingColumns=True)


def fill_registration(customers, lines):
    first = lines.where(~F.col("is_return")).groupBy("customer_id").agg(F.min("date").alias("_first"))
    known = F.coalesce("customer_registration_date", "_first")
    return (
        customers.join(first, "customer_id", "left")
        .withColumn("registration_filled", F.col("customer_registration_date").isNull())
        .withColumn("customer_registration_date", known)
        .drop("_first")
    )


def plausible_age(column: Column, dtype=None) -> Column:
    age = number(column, dtype)
    return F.when(age.between(*AGE_RANGE), age)


def gender_label(column: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in GENDERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(column.cast("string")))), F.lit("Unknown"))


def locations(customers, vocabulary=None):
    as_text = customers.withColumn("customer_location", F.col("customer_location").cast("string"))
    unified = unify_spelling(as_text, ["customer_location"], vocabulary)
    return unified.withColumn("customer_location", F.coalesce("customer_location", F.lit("Unknown")))


def stored_locations(customers):
    return stored_spellings(customers.select(F.col("customer_location").cast("string")), ["customer_location"])


def before_registration(lines, customers):
    """Lines are counted per customer and day before the join, so a customer's size does not matter to it."""
    registered = customers.select("customer_id", "customer_registration_date")
    early = F.col("date") < F.col("customer_registration_date")
    per_day = lines.groupBy("customer_id", "date").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum(F.when(early, F.col("n"))), F.lit(0))
    return per_day.join(registered, "customer_id").agg(total.alias("before_registration"))


# --- the whole chain -----------------------------------------------------------------------------------------------


@dataclass
class Cleaned:
    customers: DataFrame
    lines: DataFrame
    log: DataFrame
    account: dict
    span: tuple  # first and last day of the clean lines


def graded_with_account(lines, cfg, available):
    """All line steps as one staged table, and what was counted while it was written.

    The table has the canonical columns, ``drop_reason`` (NULL = kept), ``copies`` and flags. Rows are never counted step by step: the reason
    is a column, and the account is taken along by the write. ``lines`` should be a stored table: it is read for the spellings (two columns
    and what they depend on) and for the grading.
    """
    collapse = cfg["cleaning"].get("drop_exact_duplicates", True)
    subset = [c for c in LINE_FIELDS if c != "transaction_id" or available.get("transaction_id", True)]
    if collapse:
        lines = lines.select(*subset, "is_return")
    graded = parse_dates(lines, cfg)
    spelled, merged = [c for c in ("category", "payment_method") if available.get(c)], {}
    if spelled:
        vocabulary = stored_line_spellings(graded, spelled)
        graded, merged = unify_spelling(graded, spelled, vocabulary), vocabulary[2]
    if collapse:
        graded = collapse_duplicates(graded, subset)
    else:
        graded = graded.withColumn("copies", F.lit(1).cast("bigint")).withColumn(
            "non_iso_rows", F.col("non_iso").cast("bigint")
        )
        graded = graded.drop("non_iso")
    if available.get("transaction_id", True):
        graded = collapse_repeated_ids(graded)
    else:
        graded = graded.withColumn("repeated", F.lit(0).cast("bigint"))
    reason = F.when(_alive() & ~quantity_ok(), BAD_QUANTITY).otherwise(F.col("drop_reason"))
    graded = graded.withColumn("drop_reason", reason)
    if cfg["cleaning"].get("nonpositive_price", "drop") == "impute_product_median" and available.get("product_id"):
        graded = impute_prices(stage(graded, "before-prices"))
        price_reason = NO_PRICE
    else:
        graded = graded.withColumn("price_imputed", F.lit(False))
        price_reason = BAD_PRICE
    reason = F.when(_alive() & ~price_ok(), price_reason).otherwise(F.col("drop_reason"))
    graded = (
        graded.withColumn("drop_reason", reason)
        .withColumn("percent_discount", percent_discount())
        .withColumn("discount_reset", discount_beyond_repair())
        .withColumn("discount", fixed_discount())
        .withColumn("transaction_value", line_value())
    )
    window = cfg["analysis"]
    graded = graded.withColumn("in_window", date_window(window.get("data_start"), window.get("data_end")))
    table, counted = staged_observed(graded, "graded-lines", **account_metrics())
    return table, {**counted, **{f"spellings_{c}": n for c, n in merged.items()}}


def grade_lines(lines, cfg, available):
    return graded_with_account(lines, cfg, available)[0]


def date_window(start, end) -> Column:
    bounds = [F.col("date") >= F.lit(str(start)).cast("date")] if start else []
    bounds += [F.col("date") <= F.lit(str(end)).cast("date")] if end else []
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


ROW_REASONS = [BAD_DATE, NO_CUSTOMER, BAD_QUANTITY, BAD_PRICE, NO_PRICE]


def account_metrics():
    """Everything the account and the log count on graded lines; duplicates are the extra copies of groups that passed the first checks."""
    alive, copies = _alive(), F.col("copies")
    compared = alive | F.col("drop_reason").isin(BAD_QUANTITY, BAD_PRICE, NO_PRICE)
    groups = F.when(compared, F.lit(1)).otherwise(copies)
    counted = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0))
    shown = alive & F.col("in_window")
    return {
        "kept": counted(alive, groups),
        **{f"reason_{i}": counted(F.col("drop_reason") == r, groups) for i, r in enumerate(ROW_REASONS)},
        "duplicates": counted(compared, copies - 1),
        "repeated": F.coalesce(F.sum("repeated"), F.lit(0)),
        "non_iso": F.coalesce(F.sum("non_iso_rows"), F.lit(0)),
        "returns": F.count_if(alive & F.col("is_return")),
        "imputed": F.count_if(alive & F.col("price_imputed")),
        "percent": F.count_if(alive & F.col("percent_discount")),
        "reset": F.count_if(alive & F.col("discount_reset")),
        "outside": F.count_if(alive & ~F.col("in_window")),
        "outside_returns": F.count_if(alive & ~F.col("in_window") & F.col("is_return")),
        "uncovered_negatives": F.count_if((F.col("drop_reason") == BAD_QUANTITY) & (F.col("quantity") < 0) & ~F.col("is_return")),
        "first_day": F.min(F.when(shown, F.col("date"))),
        "last_day": F.max(F.when(shown, F.col("date"))),
    }


def removal_counts(counted):
    """``{reason: rows}`` of what was counted, with the rows kept; reasons without rows are left out."""
    rows = {"kept": counted["kept"], **{r: counted[f"reason_{i}"] for i, r in enumerate(ROW_REASONS)}}
    rows |= {DUPLICATE: counted["duplicates"], REPEATED_ID: counted["repeated"]}
    return {reason: n for reason, n in rows.items() if n}


def account_table(spark, counted):
    return spark.createDataFrame(list(removal_counts(counted).items()), "reason string, rows bigint")


KEPT_COLUMNS = [*LINE_FIELDS, "is_return", "transaction_value"]


def kept_lines(graded):
    return graded.where(_alive()).select(*KEPT_COLUMNS, "in_window")


def clean(standardized, cfg):
    """Clean lines, clean customers, log of decisions and row account."""
    available = standardized.availability
    graded, counted = graded_with_account(standardized.lines, cfg, available)
    counts = removal_counts(counted)
    kept = counts.pop("kept", 0)
    everything = sum(counts.values()) + kept
    if counted["outside"]:
        counts[OUTSIDE_WINDOW] = counted["outside"]
    if available.get("non_product_lines"):
        counts[NON_PRODUCT] = available["non_product_lines"]
        everything += available["non_product_lines"]
    returns_kept = counted["returns"] - counted["outside_returns"]
    rows_out = kept - counted["outside"]
    account = {
        "rows_in": everything,
        "rows_out": rows_out,
        "rows_removed": everything - rows_out,
        "normal_lines_kept": rows_out - returns_kept,
        "return_lines_kept": returns_kept,
        "removed_by_reason": counts,
        "invalid_rows_removed": sum(
            n for r, n in counts.items() if r.startswith(("invalid", "unrecoverable", "unparseable", "repeated"))
        ),
    }
    everyone = flag_suspicious(kept_lines(graded))
    customers, customer_log = clean_customers(standardized.customers, everyone, cfg, available)
    lines = everyone.where("in_window").drop("in_window")
    suspicious = everyone.where("suspicious_value").count()
    log = log_table(graded.sparkSession, line_log(counts, {**counted, "suspicious": suspicious}, available) + customer_log)
    return Cleaned(customers, lines, log, account, (counted["first_day"], counted["last_day"]))


def log_table(spark, entries):
    return spark.createDataFrame(entries, "issue string, rows_affected bigint, decision string, rationale string")


def line_log(counts, counted, available):
    """What was found in the lines, how many rows it touched, what was done and why."""
    rows = counts.get
    log = [
        ("Dates not in ISO form", counted["non_iso"], "read by the fallback patterns", "the order of day and month follows the configuration"),
        ("No date can be read", rows(BAD_DATE, 0), "row removed", "nothing can be placed in time without its day"),
        ("No customer", rows(NO_CUSTOMER, 0), "row removed, share in the report", "guests cannot return as themselves"),
    ]
    for column in ("category", "payment_method"):
        if f"spellings_{column}" in counted:
            log.append(
                (f"Spellings of {column} merged", counted[f"spellings_{column}"], "commonest spelling taken", "case and outer spaces carry no meaning")
            )
    log += [
        ("Copies of a row", rows(DUPLICATE, 0), "one stays", "a row equal in every field was booked twice"),
        ("Line id used again for other content", rows(REPEATED_ID, 0), "smallest content stays", "an id names one line"),
        ("Return lines", counted["returns"], "kept and flagged", "they lower the net revenue but are no purchases"),
        ("Quantity of no sale", rows(BAD_QUANTITY, 0), "row removed", "a sale has a positive quantity, a return a negative one"),
        (
            "Negative quantity not covered by the return rule", counted["uncovered_negatives"], "row removed",
            "the true quantity is unknown; another returns.method may fit",
        ),
        ("No price above zero", rows(BAD_PRICE, 0), "row removed", "its value would be invented"),
        ("Price filled in", counted["imputed"], "median price of the product", "a product's price changes little"),
        ("No price for the product at all", rows(NO_PRICE, 0), "row removed", "there is nothing to fill it in from"),
        ("Discount out of range", counted["reset"], "taken as none", "no share of a price lies outside 0 to 1"),
    ]
    if available.get("discount", True):
        log.append(("Discount given in percent", counted["percent"], "scaled to a share", "values above 1 and up to 100 are percent"))
    why = "real bulk orders are rare but real; the flag lets a reader look"
    log.append(("Very large purchase", counted["suspicious"], f"kept, flagged above the {SUSPICIOUS_QUANTILE:.1%} quantile", why))
    return log


def clean_customers(customers, lines, cfg, available):
    """Customer steps in order; returns the table and its log rows, counted while the table is written."""
    listed = one_row_per_customer(customers, cfg)
    table = add_unlisted_customers(listed, lines)
    table = fill_registration(table, lines)
    age = plausible_age(F.col("customer_age"), table.schema["customer_age"].dataType)
    raw_age = number(F.col("customer_age"), table.schema["customer_age"].dataType)
    table = table.withColumn("age_impossible", raw_age.isNotNull() & age.isNull()).withColumn(
        "customer_age", age if available.get("age") else F.lit(None).cast("double")
    )
    raw_gender = F.col("customer_gender").cast("string")
    gender = gender_label(F.col("customer_gender")) if available.get("gender") else F.lit("Unknown")
    table = table.withColumn("gender_changed", ~raw_gender.eqNullSafe(gender)).withColumn("customer_gender", gender)
    merged = 0
    if available.get("location"):
        vocabulary = stored_locations(customers)
        merged, table = vocabulary[2]["customer_location"], locations(table, vocabulary)
    else:
        table = table.withColumn("customer_location", F.lit("Unknown"))
    table, n = staged_observed(
        table,
        "customers",
        unlisted=F.count_if("unlisted"),
        registration=F.count_if("registration_filled"),
        age=F.count_if("age_impossible"),
        no_age=F.count_if(F.col("customer_age").isNull()),
        gender=F.count_if("gender_changed"),
        location=F.count_if(F.col("customer_location") == "Unknown"),
    )
    log = []
    if available.get("customer_table", True):
        log.append(("Customer in the lines only", n["unlisted"], "added", "whoever bought is a customer, listed or not"))
    log.append(("No registration date", n["registration"], "first purchase taken", "the earliest day on which the customer is known"))
    if available.get("age"):
        low, high = AGE_RANGE
        log += [
            ("Age out of range", n["age"], "taken as unknown", f"buyers are {low} to {high} years old"),
            ("No age", n["no_age"], "stays unknown", "a guess would shift the tables by age"),
        ]
    if available.get("gender"):
        log.append(("Gender spelled differently or missing", n["gender"], "one of Female, Male, Unknown", "one label per meaning"))
    if available.get("location"):
        log += [
            ("Spellings of customer_location merged", merged, "commonest spelling taken", "case and outer spaces carry no meaning"),
            ("No location", n["location"], "called Unknown", "the customer stays in the tables by place"),
        ]
    if available.get("registration_date"):
        early = before_registration(lines, table).first()["before_registration"]
        log.append(("Purchases before registration", early, "kept", "people buy as guests and register later"))
    return table.select(*CUSTOMER_FIELDS), log
