import pytest
from conftest import FOLDER, SHOP

from staywise.config import merge
from staywise.errors import DatasetError
from staywise.operators import quality
from staywise.plans import named_queries, retention_run
from staywise.sources import star

FAST = {"restarts": 1, "final_restarts": 1, "rounds": 3}
# 150 customers only give thirty of each class with a longer window than the data suggests
WIDE = merge(SHOP, {"analysis": {"churn_window_days": 270}})


@pytest.fixture(scope="module")
def finished(spark, shop, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("runs"))
    report = retention_run.run(spark, WIDE, root, "shop", inputs=shop, settings=FAST)
    return root, report


def test_run_writes_every_result(spark, finished):
    root, report = finished
    out = retention_run.RunFolder(spark, root, "shop")
    metrics, meta = out.read_json("metrics"), out.read_json("run_metadata")
    assert metrics["H"] == 270 and metrics["best_model"] == meta["model_selected"]
    assert metrics["n_active"] + metrics["n_lapsed"] == metrics["n_customers_with_orders"]
    assert meta["availability"]["registration_date_source"] == "derived_from_first_purchase"
    assert "days_since_registration" in meta["features_excluded"] and not meta["availability"]["payment_method"]
    account = meta["cleaning"]
    assert account["rows_in"] == account["rows_out"] + account["rows_removed"]
    scored = out.read("customers_scored")
    assert scored.count() == metrics["n_customers_with_orders"]
    for table in ("model_comparison", "risk_tiers_test", "decile_lift_test", "permutation_importance_test", "monthly_summary",
                  "contribution_importance", "k_selection", "cluster_profile", "boosting_grid", "column_mapping", "cleaning_log"):
        assert out.read(table).count() > 0, table
    assert retention_run.finished_runs(spark, root) == ["shop"]
    assert not report.at("error") and "churn_window" in report.render()
    named_queries.register(out.read("transactions_clean"), scored)
    assert named_queries.run(spark, "high_value_high_risk").count() <= 10


def test_two_runs_agree(spark, shop, finished, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("again"))
    retention_run.run(spark, WIDE, root, "shop", inputs=shop, settings=FAST)
    a, b = (retention_run.RunFolder(spark, r, "shop").read_json("metrics") for r in (finished[0], root))
    same = ["H", "best_model", "n_active", "n_orders", "val_cutoff", "gap_quantiles"]
    assert {k: a[k] for k in same} == {k: b[k] for k in same}
    assert abs(a["test_metrics"]["pr_auc"] - b["test_metrics"]["pr_auc"]) < 1e-6


def test_validate_only_and_unusable_data(spark, shop, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("check"))
    report = retention_run.run(spark, SHOP, root, "v", inputs=shop, validate_only=True)
    assert report.facts["sufficient_history"] and retention_run.finished_runs(spark, root) == []
    few = shop.where("cust < 20")
    with pytest.raises(DatasetError, match="Too few customers"):
        retention_run.run(spark, SHOP, root, "few", inputs=few)


def test_events_have_too_little_history(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("events"))
    cfg = merge(star.EVENTS, {"analysis": {"churn_window_days": 30}})
    with pytest.raises(DatasetError, match="(?s)Not enough history|Too few customers"):
        retention_run.run(spark, cfg, root, inputs=star.event_purchases(spark, "/root/testdata/sf0.01"))


def test_readable_failure_has_exit_code_two(tmp_path):
    config = tmp_path / "c.yaml"
    config.write_text("name: x\nsource: {transactions: [missing.csv]}\n")
    assert retention_run.main(["--config", str(config), "--out", str(tmp_path / "out")]) == 2


def test_report_rules():
    report = quality.Report("r")
    account = {"rows_in": 100, "rows_removed": 60, "removed_by_reason": {quality.cleaning.BAD_QUANTITY: 10}}
    quality.removal_checks(report, account, 12.0)
    assert len(report.at("warn")) == 3
    quality.window_stability(report, 90, [{"H_days": 60, "churn_rate": 0.5}, {"H_days": 90, "churn_rate": 0.3}])
    assert "depends much" in report.at("warn")[-1]["title"]
    quality.window_stability(report, 90, [{"H_days": 60, "churn_rate": 0.31}, {"H_days": 90, "churn_rate": 0.3}])
    assert report.at("ok")
    quality.check_target(report, [{"split": "train", "rows": 10, "churned": 3, "retained": 7, "churn_rate": 0.3}], 90)
    with pytest.raises(DatasetError, match="lacks customers of one kind"):
        report.raise_if_errors()
