"""Churn models: fitted on train, chosen on validation, scored once on test."""
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.stats import global_quantiles
from ..session import stage
from . import evaluate, many_boosting

# Fixed values.
LOG_FEATURES = [
    "frequency", "monetary", "aov", "purchase_frequency_30d", "orders_30d", "orders_90d", "orders_prev90d", "spend_90d",
    "spend_prev90d", "avg_units_per_order", "n_unique_products",
]
RECENCY, ALL, BOOSTING, NAIVE = (
    "Logistic (recency only)",
    "Logistic (all features)",
    "Gradient boosting",
    "Flag everyone as churn (naive)",
)
SELECTION_METRICS = ("pr_auc", "roc_auc")
INVERSE_PENALTY = 0.3
GRID = [(rate, depth, leaf) for rate in (0.03, 0.06) for depth in (3, 5) for leaf in (40, 120)]
ROUNDS = 250
TARGET = "churned"


def _number(value):
    return repr(float(value)) + "D"


# --- candidates ------------------------------------------------------------------------------------------------------


def logistic_pipeline(train, features, inverse_penalty=INVERSE_PENALTY, target=TARGET):
    """log1p on heavy tails, median imputation with flags for what is missing in train, scaling, L2 logistic regression.

    Medians, means and deviations come from train only and become literals of one SQL projection, so the fitted model is
    an ordinary PipelineModel and scoring stays in generated code.
    """
    shown = {f: f"ln(1 + {f})" if f in LOG_FEATURES else f"cast({f} as double)" for f in features}
    logged = train.selectExpr(*[f"{e} as {f}" for f, e in shown.items()])
    medians = global_quantiles(logged, features, [0.5])
    filled = {f: f"coalesce({e}, {_number(medians[f][0] or 0.0)})" for f, e in shown.items()}
    counts = train.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f) for f in features]).first()
    columns = {f"z_{f}": e for f, e in filled.items()}
    columns.update(
        {f"missing_{f}": f"cast({f} is null as double)" for f in features if counts[f] < counts["_n"]}
    )
    stats = train.selectExpr(*[f"{e} as {c}" for c, e in columns.items()]).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns]
    ).first()
    scaled = [
        f"({e} - {_number(stats[f'{c}__mean'])}) / {_number(stats[f'{c}__std'] or 1.0)} as {c}"
        for c, e in columns.items()
    ]
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
            VectorAssembler(inputCols=list(columns), outputCol="inputs"),
            LogisticRegression(
                featuresCol="inputs",
                labelCol=target,
                standardization=False,
                elasticNetParam=0.0,
                regParam=1.0 / (inverse_penalty * counts["_n"]),
                maxIter=2000,
            ),
        ]
    )


def boosting_pipeline(train, features, rate=0.05, depth=4, leaf=80, rounds=ROUNDS, seed=42, target=TARGET, early_stopping=True):
    """Gradient-boosted trees; every split learns the side of missing values.

    A feature with missing values in train enters twice: ``x_`` puts them below every real value, ``h_`` above. A split on the first sends them
    left, on the second right, so choosing between the two is choosing their side. With ``early_stopping`` a tenth of train (chosen
    by hash) stops the boosting when it no longer helps, whatever the size.
    """
    ends = [F.count(F.lit(1)).alias("_n"), *[m(f).alias(f"{p}_{f}") for f in features for p, m in (("n", F.count), ("low", F.min), ("high", F.max))]]
    row = train.agg(*ends).first()
    end = lambda f, side, step: (row[f"{side}_{f}"] if row[f"{side}_{f}"] is not None else 0.0) + step
    filled = {f"x_{f}": f"coalesce(cast({f} as double), {_number(end(f, 'low', -1.0))})" for f in features}
    filled |= {f"h_{f}": f"coalesce(cast({f} as double), {_number(end(f, 'high', 1.0))})" for f in features if 0 < row[f"n_{f}"] < row["_n"]}
    classifier = GBTClassifier(
        featuresCol="inputs",
        labelCol=target,
        stepSize=rate,
        maxDepth=depth,
        minInstancesPerNode=leaf,
        maxIter=rounds,
        seed=seed,
        maxBins=64,
    )
    if early_stopping:
        classifier = classifier.setValidationIndicatorCol("held_out").setParams(validationTol=0.0)
    held_out = "pmod(xxhash64(customer_id, cutoff), 10) = 0 as held_out" if "cutoff" in train.columns else "false as held_out"
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {', '.join(f'{e} as {c}' for c, e in filled.items())}, {held_out} FROM __THIS__"),
            VectorAssembler(inputCols=list(filled), outputCol="inputs"),
            classifier,
        ]
    )


def is_boosting(model):
    return hasattr(model.stages[-1], "treeWeights")


def boosting_features(model, features):
    """Number of the feature behind each input column of a boosted model."""
    return [features.index(c.removeprefix("x_").removeprefix("h_")) for c in model.stages[1].getInputCols()]


def probability(model, df, keep=("customer_id",)):
    """``keep`` columns and ``p``, the probability of churn.

    The logistic model is written out as plain columns: its ``transform`` would carry the training summary, and with it the session, to
    every task.
    """
    dated = df if "cutoff" in df.columns else df.withColumn("cutoff", F.lit(None).cast("date"))
    if is_boosting(model):
        return model.transform(dated).select(*keep, vector_to_array("probability")[1].alias("p"))
    prepared, assembler, linear = model.stages
    terms = [F.col(c) * F.lit(float(w)) for c, w in zip(assembler.getInputCols(), linear.coefficients, strict=True)]
    margin = sum(terms, F.lit(float(linear.intercept)))
    return prepared.transform(dated).select(*keep, (1.0 / (1.0 + F.exp(-margin))).alias("p"))


def outcomes(model, df, target=TARGET):
    return probability(model, df, ("customer_id", F.col(target).alias("y")))


def tune_boosting(train, validation, features, seed=42, rounds=ROUNDS, grid=GRID):
    """Every grid point scored by average precision on validation; ``[(score, rate, depth, leaf, trees)]``, best first.

    All points are boosted in the same passes over train (``many_boosting``) and scored in one pass over validation.
    """
    pipeline = boosting_pipeline(train, features, rounds=rounds, seed=seed)
    fitted = many_boosting.fit_grid(train, pipeline, grid, rounds, TARGET)
    prepare, assembler = pipeline.getStages()[:2]
    scored = stage(many_boosting.scores(fitted, prepare.transform(validation), assembler.getInputCols(), TARGET), "grid-scores")
    tried = []
    for i, (point, trees) in enumerate(zip(grid, fitted, strict=True)):
        table = evaluate.score_table(scored.select("y", F.col(f"p{i}").alias("p")))
        tried.append((evaluate.pr_auc(table).first()["pr_auc"], *point, trees))
    return sorted(tried, key=lambda t: -t[0])


# --- selection and test ----------------------------------------------------------------------------------------------


@dataclass
class Selection:
    models: dict
    table: list
    best_name: str
    metric: str
    grid: list = field(default_factory=list)

    @property
    def best(self):
        return self.models[self.best_name]

    @property
    def thresholds(self):
        return {r["model"]: r["threshold"] for r in self.table}

    def table_df(self, spark):
        rows = [(r["model"], r["val_pr_auc"], r["val_roc_auc"], r["threshold"]) for r in self.table]
        return spark.createDataFrame(rows, "model string, val_pr_auc double, val_roc_auc double, threshold double")

    def grid_df(self, spark):
        return spark.createDataFrame(
            [(float(r), int(d), int(n), float(s)) for s, r, d, n, _ in self.grid],
            "learning_rate double, max_depth int, min_samples_leaf int, val_pr_auc double",
        )


def validation_row(name, model, validation):
    table = evaluate.score_table(outcomes(model, validation))
    best = evaluate.best_f1(table).first()
    return {
        "model": name,
        "val_pr_auc": evaluate.pr_auc(table).first()["pr_auc"],
        "val_roc_auc": evaluate.roc_auc(table).first()["roc_auc"],
        "threshold": best["threshold"],
    }


def select_model(train, validation, features, metric="pr_auc", seed=42, rounds=ROUNDS, grid=GRID, parallel=4):
    """Fit the three candidates on train and choose by the validation metric. Test data is not an argument.

    ``parallel`` is kept for callers; all grid points are boosted in the same passes.
    """
    if metric not in SELECTION_METRICS:
        raise ValueError(f"selection_metric must be one of {SELECTION_METRICS}")
    tried = tune_boosting(train, validation, features, seed, rounds, grid)
    models = {
        RECENCY: logistic_pipeline(train, ["recency_days"]).fit(train),
        ALL: logistic_pipeline(train, features).fit(train),
        BOOSTING: tried[0][-1].model(train.sparkSession),
    }
    table = [validation_row(name, model, validation) for name, model in models.items()]
    best = max(table, key=lambda r: r[f"val_{metric}"])["model"]
    return Selection(models, table, best, metric, tried)


def evaluate_on_test(selection, test, target=TARGET):
    """One row per candidate on test, plus the rule that flags everyone."""
    spark = test.sparkSession
    rows = []
    for row in selection.table:
        scored = outcomes(selection.models[row["model"]], test, target)
        table = evaluate.score_table(scored)
        m = evaluate.confusion(scored, row["threshold"]).first()
        rows.append(
            (
                row["model"], row["val_pr_auc"], row["val_roc_auc"],
                evaluate.roc_auc(table).first()["roc_auc"], evaluate.pr_auc(table).first()["pr_auc"],
                m["brier"], m["threshold"], m["precision"], m["recall"], m["f1"], m["accuracy"],
                m["tn"], m["fp"], m["fn"], m["tp"], m["base_rate"],
            )
        )
    base = test.agg(F.avg(F.col(target).cast("double"))).first()[0]
    rows.append((NAIVE, None, None, 0.5, base, None, 0.0, base, 1.0, 2 * base / (1 + base), base, *[None] * 4, base))
    return spark.createDataFrame(
        rows,
        "model string, val_pr_auc double, val_roc_auc double, roc_auc double, pr_auc double, brier double, "
        "threshold double, precision double, recall double, f1 double, accuracy double, tn bigint, fp bigint, fn bigint, "
        "tp bigint, base_rate double",
    )


def save(model, path):
    model.write().overwrite().save(path)


def load(path):
    return PipelineModel.load(path)


def score_customers(model, customers, t_low, t_high):
    """Churn probability and risk level of today's active customers; lapsed ones keep NULL and the level Lapsed."""
    p = probability(model, customers.where("status = 'Active'")).withColumnRenamed("p", "churn_prob")
    level = evaluate.risk_level(F.col("churn_prob"), t_low, t_high)
    return customers.join(p, "customer_id", "left").withColumn("risk_level", F.coalesce(level, F.lit("Lapsed")))
