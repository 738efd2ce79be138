"""The chain of tables behind the registered queries, built from one folder of star-schema tables.

Each table is a lazy DataFrame; the few that many queries share (activity, features at the end of the data, snapshots, scored
customers) are written once per session and state of the folder to the shared folder, as a run writes its result tables.
"""
from functools import cached_property

from pyspark.sql import functions as F

from ..operators import cleaning, cluster, explain, features, models, orders, rfm, standardize, value
from ..operators.evaluate import risk_level, risk_thresholds
from ..session import size_shuffles, stage, staged_path
from ..sources import star
from ..sources.keyed import bucket_count, write_keyed

_spaces = {}


def workspace(spark, folder):
    """The chain over a folder as it is now: tables that changed since the last call start a new one."""
    key = (spark.sparkContext.applicationId, folder)
    now = _contents(spark, folder)
    if key not in _spaces or _spaces[key][0] != now:
        _spaces[key] = now, Workspace(spark, folder)
    return _spaces[key][1]


_TABLES = ("nation", "customer", "part", "orders", "lineitem", "events")


def _contents(spark, folder):
    """Paths, sizes and times of the tables' files, from their listing alone."""
    paths = [f"{folder.rstrip('/')}/{name}.parquet" for name in _TABLES]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return sorted(map(tuple, listed.select("path", "length", "modificationTime").collect()))


class Workspace:
    available = {
        "transaction_id": False, "product_id": True, "product_name": True, "category": True, "discount": True,
        "payment_method": False, "registration_date": False, "age": False, "gender": False, "location": True,
    }

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self._contributions, self._splits = {}, {}
        size_shuffles(spark, self.table("lineitem").count())  # from the files' footers

    def table(self, name):
        return star.table(self.spark, self.folder, name)

    # --- clean binding -------------------------------------------------------------------------------------------

    @cached_property
    def raw(self):
        return star.order_lines(self.spark, self.folder)

    @cached_property
    def lines(self):
        """Canonical lines with their value. The bound tables have no defects, so no cleaning step is needed."""
        mapped, _ = standardize.mapped_lines(self.raw, star.ORDER_LINES)
        return mapped.withColumn("date", F.col("date").cast("date")).withColumn(
            "transaction_value", cleaning.line_value()
        )

    @cached_property
    def keyed_lines(self):
        """The lines laid out for looking up one customer, as a run writes them."""
        buckets = bucket_count(self.table("lineitem").count())
        return write_keyed(self.lines, staged_path(self.spark, "lines-by-customer"), "customer_id", buckets, ["date"])

    @cached_property
    def customers(self):
        mapped = standardize.mapped_customers(star.customers(self.spark, self.folder), star.ORDER_LINES)
        first = features.first_orders(self.activity)
        return mapped.drop("customer_registration_date").join(first, "customer_id", "left").select(
            "customer_id",
            F.col("first").alias("customer_registration_date"),
            F.col("customer_age").cast("double").alias("customer_age"),
            F.lit("Unknown").alias("customer_gender"),
            "customer_location",
        )

    @cached_property
    def orders(self):
        return orders.build_orders(self.lines)

    @cached_property
    def gaps(self):
        return orders.interpurchase_gaps(self.orders)

    @cached_property
    def span(self):
        row = self.lines.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        return row["a"], row["b"]

    @cached_property
    def window(self):
        return orders.choose_churn_window(self.gaps)[0]

    @cached_property
    def schedule(self):
        return orders.cutoff_schedule(self.window, *self.span)

    # --- features, snapshots -------------------------------------------------------------------------------------

    @cached_property
    def activity(self):
        """What features need to know, from one pass over the lines."""
        return features.stored(features.activity(self.lines))

    @cached_property
    def extended_activity(self):
        """The same in two parts: the lines up to the middle of the data, extended by those of the later days."""
        first, last = self.span
        early = F.col("date") <= F.lit(first + (last - first) / 2)
        before = features.stored(features.activity(self.lines.where(early)))
        return features.stored(features.merged_activity(before, features.activity(self.lines.where(~early))))

    def features_at(self, cutoffs, window=None, activity=None):
        days = features.spread_days_of(self.activity if activity is None else activity)
        return features.features_from_days(days, self.customers, cutoffs, window, self.available)

    @cached_property
    def at_end(self):
        """Features of every customer at the end of the data."""
        return stage(self.features_at([self.span[1]]).drop("next_order"), "features-at-end")

    def snapshots(self, only=None):
        """All snapshots, or those of the split ``only``."""
        train, validation, test = self.schedule
        days, cuts = features.spread_days_of(self.activity), [*train, validation, test]
        wanted = {None: cuts, "train": train, "validation": [validation], "test": [test]}[only]
        found = features.snapshots_from_days(days, self.customers, cuts, self.window, self.span[1], self.available, wanted)
        split = F.when(F.col("cutoff") == F.lit(validation), "validation").when(F.col("cutoff") == F.lit(test), "test")
        return found.withColumn("split", F.coalesce(split, F.lit("train")))

    @cached_property
    def staged_snapshots(self):
        return stage(self.snapshots(), "snapshots")

    def split(self, name):
        """The snapshots of one split. Where no query has needed all of them, only these are written."""
        if "staged_snapshots" in self.__dict__:
            return self.staged_snapshots.where(F.col("split") == name)
        if name not in self._splits:
            self._splits[name] = stage(self.snapshots(name), f"snapshots-{name}")
        return self._splits[name]

    @cached_property
    def outcomes(self):
        """A rule-of-thumb score (share of the window already silent) against what happened, on validation."""
        silent = F.col("recency_days") / F.lit(float(self.window))
        return self.split("validation").select(
            "customer_id", F.col("churned").alias("y"), silent.alias("p"), "monetary", "days_since_first_order"
        )

    # --- scored customers ----------------------------------------------------------------------------------------

    @cached_property
    def segmented(self):
        scored = rfm.rfm_segments(rfm.rfm_scores(self.at_end))
        return stage(rfm.with_status(scored, self.window), "segmented")

    @cached_property
    def labelled(self):
        """Segmented customers with a fixed partition standing in for clusters."""
        return self.segmented.withColumn("cluster", F.pmod(F.col("frequency").cast("int"), F.lit(3)))

    @cached_property
    def rated(self):
        """Active customers with the rule-of-thumb score and fixed tier limits."""
        silent = F.when(F.col("status") == "Active", F.col("recency_days") / F.lit(2.0 * self.window))
        level = F.coalesce(risk_level(F.col("churn_prob"), 0.15, 0.35), F.lit("Lapsed"))
        return self.labelled.withColumn("churn_prob", silent).withColumn("risk_level", level)

    @cached_property
    def scored(self):
        valued = value.value_and_priority(self.rated, self.window)
        named = valued.withColumn("cluster_name", F.concat(F.lit("C"), F.col("cluster").cast("string")))
        with_people = value.with_demographics(named, self.customers)
        return stage(
            with_people.join(value.favourite_category(self.lines), "customer_id", "left"), "scored"
        )

    @cached_property
    def keyed_scored(self):
        path = staged_path(self.spark, "scored-by-customer")
        return write_keyed(self.scored, path, "customer_id", bucket_count(self.table("customer").count()))

    # --- models --------------------------------------------------------------------------------------------------

    @cached_property
    def used_features(self):
        return features.select_features(self.split("train"), self.available)[0]

    @cached_property
    def selection(self):
        self.staged_snapshots  # all splits are needed: written in one pass
        return models.select_model(self.split("train"), self.split("validation"), self.used_features)

    @cached_property
    def test_scores(self):
        """Every candidate on test: ``model, customer_id, y, p``."""
        parts = [
            models.outcomes(m, self.split("test")).withColumn("model", F.lit(name))
            for name, m in self.selection.models.items()
        ]
        return stage(parts[0].unionByName(parts[1]).unionByName(parts[2]), "test-scores")

    @cached_property
    def thresholds(self):
        scores = models.outcomes(self.selection.best, self.split("validation"))
        return risk_thresholds(stage(scores, "validation-scores"))

    def scored_by_model(self):
        low, high, _ = self.thresholds
        return models.score_customers(self.selection.best, self.segmented, low, high)

    def contributions(self, name):
        """Contributions of one candidate on the test customers, staged per candidate."""
        if name not in self._contributions:
            used = ["recency_days"] if name == models.RECENCY else self.used_features
            found, base = explain.contributions(self.selection.models[name], self.split("test"), used)
            self._contributions[name] = stage(found, "contributions"), base, used
        return self._contributions[name]

    @cached_property
    def cluster_vectors(self):
        usable, _ = cluster.usable_features(self.at_end)
        return stage(cluster.vectors(cluster.prepared_columns(self.at_end, usable), usable), "cluster-vectors")

    @cached_property
    def evaluated_k(self):
        return cluster.evaluate_k(self.cluster_vectors, self.cluster_vectors.count())

    @cached_property
    def chosen_k(self):
        return cluster.choose_k(self.evaluated_k)

    # --- dirty binding -------------------------------------------------------------------------------------------

    @cached_property
    def dirty(self):
        return star.dirty_lines(self.spark, self.folder)

    @cached_property
    def dirty_mapped(self):
        return standardize.mapped_lines(self.dirty, star.DIRTY_LINES)[0]

    @cached_property
    def dirty_standard(self):
        return self.dirty_mapped.where(~F.col("is_non_product")).drop("is_non_product", "bad_numbers")

    dirty_available = {**available, "payment_method": True}

    @cached_property
    def dirty_stored(self):
        """The standardised lines as a run has them: mapped, filtered, counted and written in one pass."""
        return standardize.standardize(self.dirty, star.DIRTY_LINES)

    @cached_property
    def dirty_account(self):
        return cleaning.graded_with_account(self.dirty_stored.lines, star.DIRTY_LINES, self.dirty_available)

    @property
    def dirty_graded(self):
        return self.dirty_account[0]
