"""Behavioural clusters: prepared features, k-means with restarts, choice of k, stability, profile and names."""
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from ..functions.stats import global_quantiles
from .many_kmeans import best_fits, fit_many, labelled, silhouettes

# Fixed values.
CLUSTER_FEATURES = ["recency_days", "frequency", "monetary", "aov", "purchase_frequency_30d", "n_unique_categories"]
MIN_CUSTOMERS = 100
MIN_FEATURES = 3
K_RANGE = range(2, 9)
CUSTOMERS_PER_CLUSTER = 20
ACTIONABLE_K = (3, 6)
SILHOUETTE_TOLERANCE = 0.10
NAMED_BEYOND = 0.4
STABILITY_SEEDS = (1, 2, 3, 4, 5)


def usable_features(df, candidates=CLUSTER_FEATURES):
    """(usable features, number of customers): a feature needs two different values."""
    row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(c).alias(f"{c}__min") for c in candidates],
        *[F.max(c).alias(f"{c}__max") for c in candidates],
    ).first()
    varies = lambda c: row[f"{c}__min"] is not None and row[f"{c}__min"] < row[f"{c}__max"]
    return [c for c in candidates if varies(c)], row["_n"]


def skip_reason(n_customers, usable):
    if n_customers >= MIN_CUSTOMERS and len(usable) >= MIN_FEATURES:
        return None
    return f"only {n_customers} customers / {len(usable)} usable features (need >= {MIN_CUSTOMERS} / {MIN_FEATURES})"


def prepared_columns(df, features=CLUSTER_FEATURES):
    """log1p, winsorised at P1 and P99, standardised with the population deviation, as plain columns."""
    logged = df.select("customer_id", *[F.log1p(F.col(c).cast("double")).alias(c) for c in features])
    limits = global_quantiles(logged, features, [0.01, 0.99])
    clipped = logged.select(
        "customer_id",
        *[F.greatest(F.least(F.col(c), F.lit(limits[c][1])), F.lit(limits[c][0])).alias(c) for c in features],
    )
    stats = clipped.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in features], *[F.stddev_pop(c).alias(f"{c}__std") for c in features]
    ).first()
    scaled = lambda c: (F.col(c) - F.lit(stats[f"{c}__mean"])) / F.lit(stats[f"{c}__std"] or 1.0)
    return clipped.select("customer_id", *[scaled(c).alias(c) for c in features])


def vectors(prepared, features):
    assembled = VectorAssembler(inputCols=list(features), outputCol="vector", handleInvalid="error").transform(prepared)
    return assembled.select("customer_id", "vector")


def fit_kmeans(data, k, seed=42, restarts=20):
    """Best of several seeded starts by training cost, all fitted in the same passes."""
    return best_fits(fit_many(data, [(k, seed + start) for start in range(restarts)]))[0]


def evaluate_k(data, n, ks=K_RANGE, seed=42, restarts=10):
    """``[(k, inertia, silhouette)]`` for every k that leaves about twenty customers per cluster; all starts of all k share the passes.

    The silhouette is of squared Euclidean distances over all rows in linear work. The pairwise Euclidean one would compare
    every customer with every other.
    """
    wanted = [k for k in ks if k < n // CUSTOMERS_PER_CLUSTER]
    if not wanted:
        return []
    best = best_fits(fit_many(data, [(k, seed + start) for k in wanted for start in range(restarts)]))
    return [(f.k, f.cost, s) for f, s in zip(best, silhouettes(data, best), strict=True)]


def choose_k(evaluated, low=ACTIONABLE_K[0], high=ACTIONABLE_K[1], tolerance=SILHOUETTE_TOLERANCE):
    """Smallest actionable k within ten percent of the best actionable silhouette; otherwise the best of all."""
    actionable = [(k, s) for k, _, s in evaluated if low <= k <= high]
    if not actionable:
        return max(evaluated, key=lambda e: e[2])[0]
    best = max(s for _, s in actionable)
    return min(k for k, s in actionable if s >= best * (1 - tolerance))


def adjusted_rand(labels, a, b):
    """Adjusted Rand index of two label columns from their contingency table (k x k rows)."""
    pairs = lambda n: n * (n - 1) / 2
    table = labels.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    within = lambda side: table.groupBy(side).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m")))).scalar()
    both = table.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("n")).select(
        "both", "n", within(a).alias("in_a"), within(b).alias("in_b")
    )
    expected = F.col("in_a") * F.col("in_b") / pairs(F.col("n"))
    ceiling = (F.col("in_a") + F.col("in_b")) / 2
    index = F.when(ceiling == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (ceiling - expected))
    return both.select(index.alias("ari"))


def stability(data, k, seeds=STABILITY_SEEDS, restarts=5):
    """Mean adjusted Rand index of the clusterings of other seeds against the first."""
    fits = fit_many(data, [(k, seed * 1000 + start) for seed in seeds for start in range(restarts)])
    best = [best_fits(fits[i * restarts : (i + 1) * restarts])[0] for i in range(len(seeds))]
    labels = labelled(data, {f"label{i}": f for i, f in enumerate(best)})
    scores = [adjusted_rand(labels, "label0", f"label{i}").first()["ari"] for i in range(1, len(seeds))]
    return sum(scores) / len(scores)


def cluster_profile(df, features=CLUSTER_FEATURES):
    """Feature means, size, revenue share and lapsed share per cluster."""
    parts = df.groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in features],
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary").alias("_revenue"),
        F.avg((F.col("status") == "Lapsed").cast("double")).alias("lapsed_share"),
    )
    everything = df.agg(F.sum("monetary")).scalar()
    return parts.withColumn("revenue_share", F.col("_revenue") / everything).drop("_revenue")


def cluster_names(profile, population):
    """Activity and value words from the cluster means in standard deviations of all customers."""
    whole = lambda measure, c: population.agg(measure(c)).scalar()
    z = lambda c: F.try_divide(F.col(c) - whole(F.avg, c), whole(F.stddev_pop, c))
    worth = (z("frequency") + z("monetary")) / 2
    activity = F.when(z("recency_days") < -NAMED_BEYOND, "Active").when(z("recency_days") > NAMED_BEYOND, "Dormant")
    tier = F.when(worth > NAMED_BEYOND, "high-value").when(worth < -NAMED_BEYOND, "low-value").otherwise("mid-value")
    name = F.format_string("C%d: %s, %s", F.col("cluster"), activity.otherwise("Cooling"), tier)
    return profile.select("cluster", name.alias("cluster_name"))


def cluster_heat(profile, features=CLUSTER_FEATURES):
    """Each cluster mean relative to the other clusters; the profile has one row per cluster (eight at most)."""
    every = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = lambda c: F.stddev_pop(c).over(every)
    z = lambda c: (F.col(c) - F.avg(c).over(every)) / F.when(spread(c) == 0, F.lit(1.0)).otherwise(spread(c))
    return profile.select("cluster", *[z(c).alias(c) for c in features])


def leading_clusters(profile):
    return profile.agg(
        F.min_by("cluster", F.struct(-F.col("revenue_share"), "cluster")).alias("most_revenue"),
        F.min_by("cluster", F.struct(-F.col("lapsed_share"), "cluster")).alias("most_lapsed"),
    )


def pca_projection(data):
    """Two principal components of the prepared vectors."""
    model = PCA(k=2, inputCol="vector", outputCol="_pc").fit(data)
    both = vector_to_array("_pc")
    return model.transform(data).select("customer_id", both[0].alias("pc1"), both[1].alias("pc2")), list(
        model.explainedVariance
    )
