"""Keyed tables, header records, published runs and staged tables."""
import io
import os

import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from staywise import session
from staywise.operators import reports
from staywise.plans.run_folder import VALIDATION, RunFolder, finished_runs
from staywise.plans.workspace import Workspace
from staywise.session import shared_folder, stage, staged_observed, staging
from staywise.sources.headers import first_record, header_records
from staywise.sources.keyed import bucket_count, bucket_of, rows_of, write_keyed
from staywise.sources.tables import read_table


@pytest.fixture()
def hot(spark):
    """A third of the rows under one key, some under none."""
    key = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 7 THEN NULL ELSE CAST(id % 500 AS STRING) END"
    return spark.range(6000).selectExpr(f"{key} AS customer_id", "id AS v", "date'2020-01-01' AS date")


def test_lookup_finds_all_rows_and_reads_one_bucket(spark, hot, folder, capsys):
    table = write_keyed(hot, folder() + "/t", "customer_id", 16, ["v"])
    for key in ("hot", "77", None, "absent", "7'7"):
        expected = hot.where(F.col("customer_id").eqNullSafe(F.lit(key)))
        found = rows_of(table, "customer_id", key)
        assert found.columns == hot.columns
        assert sorted(found.collect()) == sorted(expected.collect()), key
    rows_of(table, "customer_id", "77").explain()
    bucket = spark.range(1).select(bucket_of(F.lit("77"), 16)).first()[0]
    assert f"(customer_id_of_16#" in (plan := capsys.readouterr().out) and f"= {bucket})]" in plan.split("PartitionFilters")[1]
    assert rows_of(hot, "customer_id", "77").count() == hot.where("customer_id = '77'").count()


def test_keyed_table_may_be_empty_or_keyed_by_numbers(spark, folder):
    numbers = spark.range(100).withColumnRenamed("id", "customer_id")
    table = write_keyed(numbers, folder() + "/n", "customer_id", 16)
    assert [r[0] for r in rows_of(table, "customer_id", 42).collect()] == [42]
    empty = write_keyed(numbers.where("false"), folder() + "/e", "customer_id", 16)
    assert rows_of(empty, "customer_id", 1).count() == 0
    assert [bucket_count(n) for n in (0, 10, 100_000_000, 10**12)] == [16, 16, 32, 4096]


def test_history_reads_a_keyed_table(spark, hot, folder):
    lines = hot.withColumn("is_return", F.lit(False)).withColumn("transaction_value", F.lit(2.0))
    table = write_keyed(lines, folder() + "/t", "customer_id", 16)
    assert reports.customer_history(table, "77").count() == lines.where("customer_id = '77'").count()
    assert reports.customer_months(table, "hot").first()["spend"] == 4000.0


def test_header_needs_the_first_few_kilobytes_only():
    big = io.BytesIO(b"\n# made today\nid,\"two\n\nlines\",x\n" + b"1,2,3\n" * 2_000_000)
    assert first_record(big, {"sep": ",", "comment": "#", "multiLine": True}) == ("id", "two\n\nlines", "x")
    assert big.tell() <= 16384
    assert first_record(io.BytesIO("﻿ä;b'c\n".encode("utf-16-le")), {"sep": ";", "encoding": "utf-16-le"}) == ("ä", "b'c")
    assert first_record(io.BytesIO(b"a\\\"b,c\n"), {"quote": '"', "escape": "\\"}) == ('a"b', "c")
    assert first_record(io.BytesIO(b""), {}) == ()


def test_headers_of_folders_with_gzip_and_empty_files(spark, folder):
    where = folder()
    spark.createDataFrame([("1", "2")], "id string, x string").coalesce(1).write.option("header", True).csv(f"{where}/a b.csv")
    spark.createDataFrame([("3", "4")], "x string, id string").coalesce(1).write.options(header=True, compression="gzip").csv(f"{where}/z.csv")
    with open(f"{where}/empty.csv", "w"):
        pass
    files = [f"{d}/{n}" for d, _, names in os.walk(where) for n in names if n.endswith((".csv", ".gz"))]
    assert sorted(header_records(spark, files, {"sep": ","}).values()) == [(), ("id", "x"), ("x", "id")]
    table = read_table(spark, where)
    assert sorted((r["id"], r["x"]) for r in table.collect()) == [("1", "2"), ("4", "3")]
    with pytest.raises(Exception, match="empty"):
        read_table(spark, f"{where}/empty.csv")


def test_a_store_that_arrow_does_not_know_is_left_to_spark(spark, folder):
    where = folder()
    with open(f"{where}/a.csv", "w") as file:
        file.write("id,x\n1,2\n")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.there.link./in", f"file://{where}")
    spark.conf.set("fs.viewfs.mounttable.there.link./in", f"file://{where}")
    path = "viewfs://there/in/a.csv"
    assert header_records(spark, [path], {"sep": ","}) == {path: ("id", "x")}


def test_more_texts_for_no_value(spark, folder):
    where = folder()
    with open(f"{where}/a.csv", "w") as file:
        file.write("id,x\n1,-\n2,NA\n3,k.A.\n4,0\n")
    rows = read_table(spark, where, {"null_texts": ["-", "k.A."]}).orderBy("id").collect()
    assert [r["x"] for r in rows] == [None, None, None, "0"]


def test_killed_run_leaves_the_old_result(spark, folder):
    root = folder()
    assert finished_runs(spark, root) == []
    with pytest.raises(FileNotFoundError):
        RunFolder(spark, root, "r")
    first = RunFolder.begin(spark, root, "r")
    first.write("t", spark.range(3))
    first.publish()
    killed = RunFolder.begin(spark, root, "r")
    killed.write("t", spark.range(99))  # and no more
    assert RunFolder(spark, root, "r").read("t").count() == 3 and finished_runs(spark, root) == ["r"]
    checked = RunFolder.begin(spark, root, "r")
    checked.write("u", spark.range(1))
    checked.publish(VALIDATION)
    assert RunFolder(spark, root, "r").read("t").count() == 3
    for n in (5, 6):
        later = RunFolder.begin(spark, root, "r")
        later.write("t", spark.range(n))
        later.publish()
    assert RunFolder(spark, root, "r").read("t").count() == 6
    left = set(os.listdir(f"{root}/r"))
    assert first.version not in left and later.version in left and killed.version in left


def test_staged_tables_go_with_their_scope(spark):
    with staging(spark) as scope:
        table = stage(spark.range(5), "x")
        assert table.count() == 5 and os.path.isdir(scope.removeprefix("file:"))
    assert not os.path.exists(scope.removeprefix("file:"))
    with pytest.raises(ZeroDivisionError), staging(spark) as scope:
        stage(spark.range(5), "x")
        1 / 0
    assert not os.path.exists(scope.removeprefix("file:"))
    assert stage(spark.range(2), "outside").inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark).removeprefix("file:"))


def test_metrics_are_taken_while_writing(spark):
    table, seen = staged_observed(spark.range(1000).repartition(7), "m", rows=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    assert seen == {"rows": 1000, "even": 500} and table.count() == 1000


def test_changed_tables_start_a_new_chain(spark, folder):
    import shutil

    from staywise.plans.workspace import workspace

    where = folder() + "/sf"
    shutil.copytree("/root/testdata/sf0.001", where)
    os.chmod(where, 0o755)
    first = workspace(spark, where)
    assert workspace(spark, where) is first
    os.chmod(f"{where}/nation.parquet", 0o644)
    os.utime(f"{where}/nation.parquet", (1, 1))
    assert workspace(spark, where) is not first


@pytest.fixture()
def settings(spark):
    """The session's shuffle settings, put back afterwards."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name, None) for name in names}
    spark.conf.unset(names[1])
    yield names
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_shuffle_partitions_follow_the_rows_and_own_settings_stay(spark, settings):
    partitions, size, *_ = settings
    spark.conf.set(partitions, 5)
    session.size_shuffles(spark, 6 * session.ROWS_PER_PARTITION + 1)
    assert (spark.conf.get(partitions), spark.conf.get(size)) == ("7", session.PARTITION_SIZE)
    spark.conf.set(size, "1m")
    session.size_shuffles(spark, 10)
    assert (spark.conf.get(partitions), spark.conf.get(size)) == ("7", "1m")


def test_joined_lines_of_more_rows_are_dealt_over_more_tasks(spark, settings, folder, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 50)
    source, found = folder(), []
    tables = {
        "nation": "0 AS n_nationkey, 'N' AS n_name",
        "customer": "id AS c_custkey, 0 AS c_nationkey",
        "part": "id AS p_partkey, 'p' AS p_name, 't' AS p_type",
        "orders": "id AS o_orderkey, id AS o_custkey, date'2020-01-01' AS o_orderdate",
        "lineitem": "id AS l_orderkey, id AS l_partkey, 1 AS l_linenumber, 1D AS l_quantity, 2D AS l_extendedprice, 0D AS l_discount, 'N' AS l_returnflag",
        "events": "id AS event_id",
    }
    for rows in (100, 500):
        for name, columns in tables.items():
            spark.range(1 if name == "nation" else rows).selectExpr(*columns.split(", ")).write.parquet(f"{source}/{rows}/{name}.parquet")
        for name, value in zip(settings[0:1] + settings[2:], (2, "false", -1), strict=True):
            spark.conf.set(name, value)
        lines = Workspace(spark, f"{source}/{rows}").lines
        found.append(lines.rdd.getNumPartitions())
        assert lines.count() == rows and lines.agg(F.sum("transaction_value")).first()[0] == 2.0 * rows
    assert found == [2, 10]
