"""A complete run: files or tables in, result tables out, one published version per run (see ``run_folder``).

The driver only sees summaries (counts, dates, thresholds, fitted models); rows stay in Spark. Tables that several steps
read are written as results first and read back from there; what is only staged is removed when the run ends.
"""
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..operators import (
    cleaning,
    cluster,
    evaluate,
    explain,
    features as feats,
    models,
    orders as ordering,
    quality,
    reports,
    rfm,
    standardize,
    value,
)
from ..session import staging
from ..sources.keyed import bucket_count
from ..sources.tables import read_table
from . import named_queries
from .run_folder import VALIDATION, RunFolder, finished_runs  # noqa: F401


def read_sources(spark, cfg, inputs=None):
    """Raw lines, customers and returns; ``inputs`` (paths or a DataFrame) replaces the configured line files."""
    source = cfg["source"]
    options = source.get("read_options")
    optional = lambda name: read_table(spark, source[name], options) if source.get(name) else None
    if inputs is None or isinstance(inputs, (str, list, tuple)):
        lines = read_table(spark, inputs or source["transactions"], options)
    else:
        lines = inputs
    return lines, optional("customers"), optional("returns")


def run(spark, cfg, root, name=None, inputs=None, customers=None, returns=None, validate_only=False, settings=None):
    """Everything from raw lines to the value-ranked worklist. ``settings`` tunes restarts, rounds and parallel fits."""
    settings = {"restarts": 10, "final_restarts": 20, "rounds": models.ROUNDS, "parallel": 4, **(settings or {})}
    out = RunFolder.begin(spark, root, name or cfg.get("run") or "default")
    with staging(spark):
        return _run(spark, cfg, out, inputs, customers, returns, validate_only, settings)


def _run(spark, cfg, out, inputs, customers, returns, validate_only, settings):
    raw, customers_raw, returns_raw = read_sources(spark, cfg, inputs)
    customers_raw = customers if customers is not None else customers_raw
    returns_raw = returns if returns is not None else returns_raw

    standard = standardize.standardize(raw, cfg, customers_raw, returns_raw, write=lambda df, name: out.write(name, df))
    cleaned = cleaning.clean(standard, cfg)
    buckets = bucket_count(cleaned.account["rows_out"])
    lines = out.write("transactions_clean", cleaned.lines, key="customer_id", buckets=buckets, order=["date"])
    lines = lines.select(*cleaned.lines.columns)
    people = out.write("customers_clean", cleaned.customers)
    cleaned.lines, cleaned.customers = lines, people
    orders = out.write("orders", ordering.build_orders(lines))

    report = quality.validate(cfg["name"], cfg, standard, cleaned, orders)
    if validate_only or report.at("error"):
        return _stopped(out, report)
    out.write("raw_data_issues", quality.line_issues(standard.lines, cfg))
    out.write("cleaning_log", cleaned.log)
    out.write("column_mapping", standardize.mapping_table(spark, cfg))
    out.write("monthly_summary", reports.monthly_summary(lines, orders))

    analysis, available, facts = cfg["analysis"], standard.availability, report.facts
    start, end, window = facts["data_start"], facts["data_end"], facts["churn_window"]
    sensitivity = out.write(
        "churn_window_sensitivity", feats.window_sensitivity(orders, start, end, window)
    )
    train_cuts, validation_cut, test_cut = ordering.cutoff_schedule(
        window, start, end, analysis["snapshot_step_days"], analysis["min_observation_days"]
    )

    activity = out.write("customer_activity", feats.activity(lines), "grain")
    days = out.write("customer_days", feats.days_of(activity))
    days = feats.spread(days, days.count())
    at_end = feats.with_registration(feats.features_from_states(feats.states_at(days, [end]), available), people)
    at_end = out.write("features_at_end", at_end.drop("next_order", "cutoff"))
    segmented = rfm.with_status(
        rfm.rfm_segments(rfm.rfm_scores(at_end), analysis["new_customer_days"]), window
    )
    segmented = out.write("customers_segmented", segmented)
    out.write("rfm_segment_summary", rfm.segment_summary(segmented))
    quality_row = rfm.rfm_quality(segmented).first()

    clustered, clustering = _clusters(out, segmented, cfg, settings)

    snapshots = _snapshots(days, people, [*train_cuts, validation_cut, test_cut], window, end, available)
    split = F.when(F.col("cutoff") == F.lit(validation_cut), "validation").when(
        F.col("cutoff") == F.lit(test_cut), "test"
    )
    snapshots = out.write("snapshots", snapshots.withColumn("split", F.coalesce(split, F.lit("train"))), "split")
    quality.check_target(report, quality.target_table(snapshots).collect(), window, sensitivity.collect())
    if report.at("error"):
        return _stopped(out, report)
    _save_report(out, report)
    train, validation, test = (snapshots.where(F.col("split") == s) for s in ("train", "validation", "test"))

    used, excluded = feats.select_features(train, available)
    metric, seed = cfg["modeling"]["selection_metric"], cfg["modeling"]["seed"]
    chosen = models.select_model(
        train, validation, used, metric, seed, settings["rounds"], parallel=settings["parallel"]
    )
    comparison = out.write("model_comparison", models.evaluate_on_test(chosen, test))
    out.write("boosting_grid", chosen.grid_df(spark))
    models.save(chosen.best, out.path("churn_model"))
    columns = ["recency_days"] if chosen.best_name == models.RECENCY else used

    tiers = cfg["risk_tiers"]
    on_validation = out.write("validation_scores", models.outcomes(chosen.best, validation))
    on_test = out.write("test_scores", models.outcomes(chosen.best, test))
    t_low, t_high, tier_info = evaluate.risk_thresholds(on_validation, tiers["high_min_lift"], tiers["low_max_churn"])
    out.write("risk_tiers_validation", evaluate.risk_table(on_validation, t_low, t_high))
    out.write("risk_tiers_test", evaluate.risk_table(on_test, t_low, t_high))
    out.write("decile_lift_test", evaluate.decile_lift(on_test))
    out.write("calibration_test", evaluate.calibration(on_test))
    out.write("curve_points_test", evaluate.curve_points(evaluate.score_table(on_test)))
    permuted = out.write(
        "permutation_importance_test", explain.permutation_importance(chosen.best, test, columns, seed=seed)
    )

    scored = models.score_customers(chosen.best, clustered, t_low, t_high)
    contributed, base = explain.contributions(chosen.best, clustered.where("status = 'Active'"), columns)
    contributed = out.write("contributions", contributed)
    importance = out.write("contribution_importance", explain.global_importance(contributed, columns))
    out.write("importance_agreement", explain.agreement(importance, permuted))
    texts = explain.top_factors(contributed, columns)
    scored = value.with_demographics(scored.join(texts, "customer_id", "left"), people)
    if available.get("category"):
        scored = scored.join(value.favourite_category(lines), "customer_id", "left")
    else:
        scored = scored.withColumn("favorite_category", F.lit("Not available"))
    scored = out.write("scored_without_value", scored)
    valued = value.value_and_priority(scored, window, cfg["business"]["gross_margin"])
    scored = out.write("customers_scored", valued, key="customer_id", buckets=bucket_count(segmented.count()))
    scored = scored.select(*valued.columns)
    named_queries.register(lines, scored)

    headline = value.headline(people, orders, lines, scored).first().asDict()
    rates = {s: facts.get(f"{s}_churn_rate") for s in ("train", "validation", "test")}
    best_row = comparison.where(F.col("model") == chosen.best_name).first().asDict()
    out.write_json(
        "metrics",
        {
            **headline,
            "dataset_name": cfg["name"],
            "data_start": start,
            "data_end": end,
            "H": window,
            "churn_window_source": facts["churn_window_source"],
            "gap_quantiles": facts.get("gap_quantiles", {}),
            "train_cutoffs": train_cuts,
            "val_cutoff": validation_cut,
            "test_cutoff": test_cut,
            "churn_rates": rates,
            "best_model": chosen.best_name,
            "selection_metric": f"validation {metric}",
            "t_low": t_low,
            "t_high": t_high,
            "t_f1": chosen.thresholds[chosen.best_name],
            "test_metrics": best_row,
            "clustering": clustering,
            "explanation_base": base,
        },
    )
    out.write_json(
        "run_metadata",
        {
            "name": cfg["name"],
            "kind": cfg["kind"],
            "description": cfg["description"],
            "run": out.name,
            "availability": {k: v for k, v in available.items() if isinstance(v, (bool, str))},
            "return_rule": available["return_rule"],
            "cleaning": cleaned.account,
            "features_used": columns,
            "features_excluded": excluded,
            "model_selected": chosen.best_name,
            "seed": seed,
            "gross_margin": cfg["business"]["gross_margin"],
            "risk_rule": evaluate.rule_text(
                t_low, t_high, rates["validation"], tiers["high_min_lift"], tiers["low_max_churn"]
            ),
            "risk_rule_info": tier_info,
            "shift_note": reports.shift_note(rates["train"], rates["test"]),
            "warnings": [f"{c['title']}: {c['detail']}" for c in report.at("warn")] + rfm.rfm_warnings(quality_row),
        },
    )
    out.publish()
    return report


def _stopped(out, report):
    """A run that ends with its validation report, which is published as such; an earlier result stays the newest one."""
    _save_report(out, report)
    out.publish(VALIDATION)
    report.raise_if_errors()
    return report


def _save_report(out, report):
    out.write("validation_checks", report.checks_table(out.spark))
    out.write_json("validation_facts", report.facts)


def _snapshots(days, people, cuts, window, end, available):
    return feats.snapshots_from_days(days, people, cuts, window, end, available)


def _clusters(out, segmented, cfg, settings):
    """Clustered customers and what was done; skipped where there are too few customers or features."""
    usable, n = cluster.usable_features(segmented)
    reason = cluster.skip_reason(n, usable)
    if reason:
        none = segmented.withColumn("cluster", F.lit(-1)).withColumn("cluster_name", F.lit("Not clustered"))
        return none, {"ran": False, "reason": reason}
    seed = cfg["modeling"]["seed"]
    data = out.write("cluster_inputs", cluster.vectors(cluster.prepared_columns(segmented, usable), usable)).persist()
    tried = cluster.evaluate_k(data, n, seed=seed, restarts=settings["restarts"])
    k = cluster.choose_k(tried)
    model = cluster.fit_kmeans(data, k, seed, settings["final_restarts"])
    labels = model.transform(data).select("customer_id", "cluster")
    labelled = segmented.join(labels, "customer_id")
    profile = out.write("cluster_profile", cluster.cluster_profile(labelled, usable))
    names = out.write("cluster_names", cluster.cluster_names(profile, segmented))
    out.write("cluster_heat", cluster.cluster_heat(profile, usable))
    out.write("k_selection", out.spark.createDataFrame(tried, "k int, inertia double, silhouette double"))
    projection, explained = cluster.pca_projection(data)
    out.write("cluster_projection", projection)
    score = cluster.stability(data, k, restarts=max(1, settings["restarts"] // 2))
    clustered = out.write("customers_clustered", labelled.join(F.broadcast(names), "cluster"))  # one row per cluster
    data.unpersist()
    silhouette = next(s for kk, _, s in tried if kk == k)
    return clustered, {
        "ran": True, "k": k, "silhouette": silhouette, "cluster_stability_ari": score, "features": usable,
        "explained_variance": explained,
    }


def main(arguments=None):
    """``python -m staywise.plans.retention_run --config X --out DIR``; exit code 2 for an unusable dataset."""
    import argparse
    import sys

    from pyspark.sql import SparkSession

    from ..config import load_config

    parser = argparse.ArgumentParser()
    parser.add_argument("--config", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--run")
    parser.add_argument("--input", nargs="*")
    parser.add_argument("--validate-only", action="store_true")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("staywise").getOrCreate()
    try:
        report = run(
            spark, load_config(args.config), args.out, args.run, args.input or None, validate_only=args.validate_only
        )
    except DatasetError as problem:
        print(problem, file=sys.stderr)
        return 2
    print(report.render())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
