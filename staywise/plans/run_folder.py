"""Where a run's result tables lie, and when others see them.

``<root>/<run>/<version>/<table>``: a run writes into a version of its own and is published by one small file in
``<root>/<run>/published``, which Spark's committer shows whole or not at all. Readers take the newest published
version, so a run that fails or is killed leaves the earlier result as it was. Publishing removes versions before the last ``KEPT``.
"""
import json
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException

from ..session import remove
from ..sources.keyed import write_keyed

RESULT, VALIDATION = "result", "validation"
KEPT = 2  # the new version, and the one that readers may still hold


class RunFolder:
    """Tables of one version of a run; without ``version`` the newest published result (or else validation)."""

    def __init__(self, spark, root, name="default", version=None):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.version = version or self._newest()

    @classmethod
    def begin(cls, spark, root, name="default"):
        now = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
        return cls(spark, root, name, f"{now}-{uuid.uuid4().hex[:8]}")

    @property
    def manifest(self):
        return f"{self.root}/{self.name}/published"

    def _newest(self):
        entries = published(self.spark, self.manifest)
        best = max(entries, key=lambda e: (e["kind"] == RESULT, e["version"]), default=None)
        if best is None:
            raise FileNotFoundError(f"no published run {self.name!r} below {self.root}")
        return best["version"]

    def path(self, table):
        return f"{self.root}/{self.name}/{self.version}/{table}"

    def write(self, table, df, partition_by=None, key=None, buckets=1, order=()):
        """Writes a result table and reads it back; with ``key`` laid out for lookups (see ``sources.keyed``)."""
        if key:
            return write_keyed(df, self.path(table), key, buckets, order)
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(table))
        return self.read(table)

    def read(self, table):
        return self.spark.read.parquet(self.path(table))

    def write_json(self, table, values):
        text = json.dumps(values, default=str)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(self.path(table))

    def read_json(self, table):
        return json.loads(self.spark.read.text(self.path(table), wholetext=True).first()[0])

    def publish(self, kind=RESULT):
        """Shows this version to readers, then removes what it replaces: results replace everything, validations only validations."""
        entry = json.dumps({"run": self.name, "version": self.version, "kind": kind})
        before = published(self.spark, self.manifest)
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("append").text(self.manifest)
        replaced = [e["version"] for e in before if kind == RESULT or e["kind"] == kind]
        for version in sorted(replaced, reverse=True)[KEPT - 1 :]:
            remove(self.spark, f"{self.root}/{self.name}/{version}")


def published(spark, manifest):
    """Entries of all manifests at a path or glob; none where nothing was published."""
    try:
        rows = spark.read.text(manifest).collect()
    except AnalysisException:
        return []
    return [json.loads(r["value"]) for r in rows]


def finished_runs(spark, root):
    """Names of the runs below ``root`` with a published result."""
    entries = published(spark, f"{root.rstrip('/')}/*/published")
    return sorted({e["run"] for e in entries if e["kind"] == RESULT})
