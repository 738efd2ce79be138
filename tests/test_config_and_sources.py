import pytest

from staywise.config import DEFAULTS, load_config, merge, with_defaults
from staywise.errors import DatasetError
from staywise.schema import LINES_SCHEMA, DESCRIPTIONS, describe
from staywise.sources.tables import read_table


def test_merge_is_recursive_and_leaves_its_inputs_alone():
    base = {"a": {"x": 1, "y": 2}, "b": 1}
    assert merge(base, {"a": {"y": 3}, "b": None}) == {"a": {"x": 1, "y": 3}, "b": None}
    assert base == {"a": {"x": 1, "y": 2}, "b": 1}


def test_inheritance_by_extends(tmp_path):
    (tmp_path / "base.yaml").write_text("name: base\ncolumns: {customer_id: c, order_id: o}\nmodeling: {seed: 7}\n")
    (tmp_path / "child.yaml").write_text("extends: base.yaml\nname: child\ncolumns: {order_id: other}\n")
    cfg = load_config(tmp_path / "child.yaml")
    assert cfg["name"] == "child" and cfg["modeling"]["seed"] == 7
    assert cfg["columns"]["customer_id"] == "c" and cfg["columns"]["order_id"] == "other"
    assert cfg["modeling"]["selection_metric"] == "pr_auc" and cfg["columns"]["date"] is None


def test_defaults_are_not_shared():
    with_defaults({})["columns"]["date"] = "changed"
    assert DEFAULTS["columns"]["date"] is None


def test_schema_carries_descriptions(spark):
    assert all(f.metadata["comment"] == DESCRIPTIONS[f.name] for f in LINES_SCHEMA)
    assert describe(spark.range(1).withColumnRenamed("id", "order_id")).schema["order_id"].metadata["comment"]


def test_delimited_files_are_stacked_by_name_and_stay_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,qty,note\n1,2,"x, y"\n2,NA,\n')
    (tmp_path / "b.csv").write_text("qty,id\n7,3\n")
    (tmp_path / "c.tsv").write_text("id\tqty\n4\t9\n")
    table = read_table(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.tsv")])
    rows = {r["id"]: (r["qty"], r["note"]) for r in table.collect()}
    assert rows == {"1": ("2", "x, y"), "2": (None, None), "3": ("7", None), "4": ("9", None)}
    assert dict(table.dtypes)["qty"] == "string"


def test_read_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;qty\n1;2\n")
    assert read_table(spark, str(tmp_path / "a.csv"), {"sep": ";"}).first()["qty"] == "2"


def test_missing_files_are_a_readable_error(spark, tmp_path):
    with pytest.raises(DatasetError, match="not found"):
        read_table(spark, [str(tmp_path / "nowhere.csv")])
    with pytest.raises(DatasetError, match="No input files"):
        read_table(spark, [])


def _written(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w") as file:
        file.write(text)
    return path


def test_columns_keep_their_names_across_files_of_a_glob(spark, folder):
    where = folder()
    _written(where, "a.csv", "cust,qty\n1,5\n")
    _written(where, "b.csv", "qty,cust\n7,2\n")
    _written(where, "c.csv", "cust,note\n3,\"two\nlines\"\n")
    table = read_table(spark, f"{where}/*.csv", {"multi_line": True})
    assert {tuple(r[c] for c in ("cust", "qty", "note")) for r in table.collect()} == {("1", "5", None), ("2", "7", None), ("3", None, "two\nlines")}


def test_parquet_folders_and_mixed_schemas(spark, folder):
    where = folder()
    spark.range(3).selectExpr("id AS cust").write.parquet(f"{where}/table/day=1")
    spark.range(2).selectExpr("id AS cust", "id * 2 AS qty").write.parquet(f"{where}/table/day=2")
    table = read_table(spark, f"{where}/table")
    assert table.count() == 5 and set(table.columns) == {"cust", "qty", "day"} and table.where("qty IS NULL").count() == 3


def test_unknown_read_options_are_refused(spark, folder):
    path = _written(folder(), "a.csv", "cust\n1\n")
    with pytest.raises(DatasetError, match="skiprows"):
        read_table(spark, path, {"skiprows": 2})


def test_other_header_stops_a_trusting_read(spark, folder):
    where = folder()
    _written(where, "a.csv", "cust,qty\n1,5\n")
    _written(where, "b.csv", "qty,cust\n7,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, where, {"same_header": True}).collect()
