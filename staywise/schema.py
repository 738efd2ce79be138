"""The canonical schema: one row per order line, one row per customer."""
from pyspark.sql import types as T

# Canonical fields, in output order.
LINE_TYPES = {
    "transaction_id": T.StringType(),
    "order_id": T.StringType(),
    "customer_id": T.StringType(),
    "date": T.DateType(),
    "product_id": T.StringType(),
    "product_name": T.StringType(),
    "category": T.StringType(),
    "quantity": T.DoubleType(),
    "unit_price": T.DoubleType(),
    "discount": T.DoubleType(),
    "payment_method": T.StringType(),
}
CUSTOMER_TYPES = {
    "customer_id": T.StringType(),
    "customer_registration_date": T.DateType(),
    "customer_age": T.DoubleType(),
    "customer_gender": T.StringType(),
    "customer_location": T.StringType(),
}
LINE_FIELDS = list(LINE_TYPES)
CUSTOMER_FIELDS = list(CUSTOMER_TYPES)
REQUIRED_LINE_FIELDS = ["customer_id", "date", "quantity", "unit_price"]
TEXT_FIELDS = ["product_id", "product_name", "category", "payment_method"]
DEMOGRAPHICS = {
    "registration_date": "customer_registration_date",
    "age": "customer_age",
    "gender": "customer_gender",
    "location": "customer_location",
}

DESCRIPTIONS = {
    "customer_id": "who bought; lines without one cannot be attributed and are removed with a count",
    "order_id": "the purchase event; several lines share it",
    "transaction_id": "the order line; derived from the line's content when not mapped",
    "date": "calendar day of the purchase",
    "quantity": "units; negative only on lines flagged as returns",
    "unit_price": "price of one unit before discount",
    "product_id": "product key; needed for the distinct-products feature",
    "product_name": "descriptive only",
    "category": "product group; needed for category features and the favourite category",
    "discount": "fraction of the price, 0 to 1",
    "payment_method": "descriptive only",
    "customer_registration_date": "account creation day; the first purchase day stands in when unknown",
    "customer_age": "years; descriptive only",
    "customer_gender": "Female, Male or Unknown; descriptive only",
    "customer_location": "free text place; descriptive only",
}


def _struct(types):
    return T.StructType([T.StructField(n, t, True, {"comment": DESCRIPTIONS[n]}) for n, t in types.items()])


LINES_SCHEMA = _struct(LINE_TYPES)
CUSTOMERS_SCHEMA = _struct(CUSTOMER_TYPES)


def describe(df):
    """The same table with the canonical descriptions attached as column comments."""
    return df.select(
        *[df[c].alias(c, metadata={"comment": DESCRIPTIONS[c]}) if c in DESCRIPTIONS else df[c] for c in df.columns]
    )
