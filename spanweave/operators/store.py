"""The span table: versioned snapshots by stream, a job table beside them, integrity checks.

A table is a folder of written parts that never change and of manifests.  A manifest names, for each of ``PARTITIONS`` buckets of streams, the part that holds its
spans, and the part of the job table.  A commit writes new parts for the buckets it touches and then puts the next manifest in place by one rename that does not
replace: readers see one version, whole, for as long as they hold it, and of two writers the later one starts anew from the version that won.  (The file system must rename atomically, as HDFS does.)

Jobs: ``uploaded -> processing -> completed | failed``, and from either of these to ``processing`` again.  ``start`` takes only streams that are not being processed;
``finish`` replaces their spans, also by none; ``fail`` clears them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged

#: Streams share a bounded number of partitions, so that a table of many streams has few folders.
PARTITIONS = 64
JOBS = "stream_id long, status string, note string"
_TRIES = 5


class Conflict(RuntimeError):
    """Other writers won every time."""


class SpanStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._path("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions ---------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """The named version's manifest, or the newest."""
        there = self.versions()
        if not there:
            return {"version": 0, "buckets": {}, "jobs": None, "schema": None}
        stream = self._fs.open(self._path(f"manifests/{there[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> bool:
        """The next version; false if another writer has put it."""
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._path("manifests"))
        won = not self._fs.exists(final) and self._fs.rename(draft, final)
        if not won:
            self._fs.delete(draft, False)
        return won

    def commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Applies ``change`` to the newest manifest until no other writer came between; ``None`` changes nothing."""
        for _ in range(_TRIES):
            old = self.manifest()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old
            new["version"] = old["version"] + 1
            if self._put(new):
                return new
        raise Conflict(f"{self.path}: {_TRIES} commits were overtaken")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest ``keep`` versions, and parts that none of these names (of a commit that is under way too)."""
        there = self.versions()
        used = set()
        for v in there[-keep:]:
            m = self.manifest(v)
            used |= {p.split("/")[1] for p in [*m["buckets"].values(), *([m["jobs"]] if m["jobs"] else [])]}
        for v in there[:-keep]:
            self._fs.delete(self._path(f"manifests/{v}.json"), False)
        if self._fs.exists(self._path("parts")):
            for s in self._fs.listStatus(self._path("parts")):
                if s.getPath().getName() not in used:
                    self._fs.delete(s.getPath(), True)

    # --- spans ------------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame | None:
        """All spans of a version (the newest); None where nothing was written so far."""
        m = self.manifest(version)
        return self._rows(m, list(m["buckets"]))

    def _rows(self, m: dict, buckets: list[str]) -> DataFrame | None:
        if m["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(m["schema"]))
        parts = [f"{self.path}/{m['buckets'][b]}" for b in buckets if b in m["buckets"]]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _replaced(self, m: dict, spans: DataFrame, streams: DataFrame) -> dict:
        """``m`` with the spans of ``streams`` (rows ``stream_id``) replaced by those in ``spans``."""
        bucket = F.pmod(F.hash("stream_id"), F.lit(PARTITIONS)).cast("string")
        touched = sorted(r["b"] for r in streams.select(bucket.alias("b")).distinct().collect())  # PARTITIONS at most
        rows, old = spans.join(streams, "stream_id", "left_semi"), self._rows(m, touched)
        if old is not None:
            rows = rows.unionByName(old.join(streams, "stream_id", "left_anti"), allowMissingColumns=True)
        part = f"parts/{uuid.uuid4().hex}"
        rows.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{part}")
        written = [s.getPath().getName() for s in self._fs.listStatus(self._path(part))]
        for b in touched:
            m["buckets"].pop(b, None)
        m["buckets"] |= {n.split("=")[1]: f"{part}/{n}" for n in written if n.startswith("__bucket=")}
        m["schema"] = json.dumps(json.loads(rows.schema.json()))
        return m

    def replace(self, spans: DataFrame, streams: DataFrame | None = None) -> dict:
        """Replaces the spans of ``streams`` (rows ``stream_id``; those that ``spans`` holds, if not given), also by none; other streams stay."""
        spans = staged(spans, "spans")
        ids = staged((spans if streams is None else streams).select("stream_id").distinct(), "streams")
        return self.commit(lambda m: self._replaced(m, spans, ids))

    # --- jobs -------------------------------------------------------------------------------------------------------

    def jobs(self, m: dict | None = None) -> DataFrame:
        at = (m or self.manifest())["jobs"]
        return self.spark.read.schema(JOBS).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], JOBS)

    def _with_jobs(self, m: dict, changed: DataFrame) -> dict:
        """``m`` with the rows of ``changed`` in place of those of the same streams."""
        part = f"parts/{uuid.uuid4().hex}"
        kept = self.jobs(m).join(changed, "stream_id", "left_anti")
        kept.unionByName(changed.select("stream_id", "status", "note")).write.parquet(f"{self.path}/{part}")
        m["jobs"] = part
        return m

    def register(self, streams: DataFrame) -> None:
        """New streams are ``uploaded``; those that are there stay as they are."""
        ids = staged(streams.select("stream_id").distinct(), "streams")
        self.commit(lambda m: self._with_jobs(m, _job(ids.join(self.jobs(m), "stream_id", "left_anti"), "uploaded")))

    def start(self, streams: DataFrame) -> DataFrame:
        """Marks streams ``processing``; returns (rows ``stream_id``) those that were not so already, which the caller is to analyse."""
        ids = staged(streams.select("stream_id").distinct(), "streams")
        mine: list[DataFrame] = []

        def change(m: dict) -> dict | None:
            free = staged(ids.join(self.jobs(m).where("status = 'processing'"), "stream_id", "left_anti"), "started")
            mine[:] = [free]
            return None if free.isEmpty() else self._with_jobs(m, _job(free, "processing"))

        self.commit(change)
        return mine[0]

    def finish(self, streams: DataFrame, spans: DataFrame) -> None:
        """The streams' spans and their status ``completed``, in one version."""
        ids, spans = staged(streams.select("stream_id").distinct(), "streams"), staged(spans, "spans")
        self.commit(lambda m: self._with_jobs(self._replaced(m, spans, ids), _job(ids, "completed")))

    def fail(self, streams: DataFrame, note: str) -> None:
        """No spans are left of the streams, and their status is ``failed``, in one version."""
        ids = staged(streams.select("stream_id").distinct(), "streams")

        def change(m: dict) -> dict:
            old = self._rows(m, list(m["buckets"]))
            if old is not None:
                m = self._replaced(m, old.limit(0), ids)
            return self._with_jobs(m, _job(ids, "failed", note))

        self.commit(change)


def _job(ids: DataFrame, status: str, note: str | None = None) -> DataFrame:
    return ids.select("stream_id", F.lit(status).alias("status"), F.lit(note).cast("string").alias("note"))


def replace_streams(spans: DataFrame, path: str, streams: DataFrame | None = None) -> None:
    """Replaces all spans of ``streams`` (of those in ``spans``, if not given); other streams stay."""
    SpanStore(spans.sparkSession, path).replace(spans, streams)


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    rows = SpanStore(spark, path).read()
    if rows is None:
        raise FileNotFoundError(path)
    return rows


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is not there."""
    return children.join(parents.select(F.col(parent_key).alias("__p")), F.col(child_key) == F.col("__p"), "left_anti")


def append_checked(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, path: str) -> None:
    """Appends children, or nothing at all if one is an orphan."""
    if not orphans(children, parents, child_key, parent_key).isEmpty():
        raise ValueError("a row refers to a parent that is not there")
    children.write.mode("append").parquet(path)


def cascade(children: DataFrame, gone: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children that stay when the parents in ``gone`` are deleted."""
    return orphans(children, gone, child_key, parent_key)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
