"""Keyed results that outlive a run: what was computed once is read back until it expires.

Every run that adds rows writes one new folder, whose name tells when it was written and when the last of its rows
expires. A folder counts only once Spark's committer has marked it whole, so a job that dies or a task that is
retried leaves nothing half-written behind, and readers never see a folder change. Folders whose rows have all
expired are skipped by name, without being opened.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.skew import skew_safe_join
from ..schemas import RESPONSE
from ..session import cut_lineage


def now_millis() -> int:
    return int(time.time() * 1000)


class ExpiringTable:
    """key and value columns (`values`, DDL); a row lives `ttl_s` seconds, or less where it brings its own `expires_at`."""

    def __init__(self, spark: SparkSession, path: str, values: str, ttl_s: int) -> None:
        self.spark, self.path, self.ttl_s = spark, path.rstrip("/"), ttl_s
        self.schema = f"key string, {values}, written_at long, expires_at long"
        self.names = [f.name for f in spark.createDataFrame([], values).schema]

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _runs(self, now_ms: int) -> tuple[list[str], list[str]]:
        """Whole folders that may hold live rows, and whole folders that hold none any more."""
        place, files = self._place(self.path)
        live, dead = [], []
        if files.exists(place):
            for status in files.listStatus(place):
                name = status.getPath().getName()
                if name.startswith("run-") and files.exists(self._place(f"{self.path}/{name}/_SUCCESS")[0]):
                    (live if int(name.split("-")[2]) > now_ms else dead).append(f"{self.path}/{name}")
        return sorted(live), sorted(dead)

    def live(self, now_ms: int | None = None) -> DataFrame:
        """key and values, one row per key: the newest that has not expired."""
        now_ms = now_millis() if now_ms is None else now_ms
        runs, _ = self._runs(now_ms)
        if not runs:
            return self.spark.createDataFrame([], self.schema).select("key", *self.names)
        rows = self.spark.read.schema(self.schema).parquet(*runs).where(F.col("expires_at") > now_ms)
        if len(runs) == 1:  # a folder holds each key once
            return rows.select("key", *self.names)
        newest = F.max_by(F.struct(*self.names), "written_at").alias("_of")
        return rows.groupBy("key").agg(newest).select("key", "_of.*")

    def put(self, rows: DataFrame, now_ms: int | None = None) -> DataFrame:
        """Add rows (key, values, and expires_at if they bring one) as one new folder; return what was written.

        Rows without a key are not kept; of rows that share one, any one is. Adding no rows leaves no folder.
        """
        now_ms = now_millis() if now_ms is None else now_ms
        until = now_ms + self.ttl_s * 1000
        own = F.least(F.col("expires_at").cast("long"), F.lit(until)) if "expires_at" in rows.columns else F.lit(until)
        kept = rows.where("key is not null").select("key", *self.names, F.lit(now_ms).cast("long").alias("written_at"), own.cast("long").alias("expires_at"))
        path = f"{self.path}/run-{now_ms:015d}-{until:015d}-{uuid.uuid4().hex}"
        kept.dropDuplicates(["key"]).write.parquet(path)
        written = self.spark.read.schema(self.schema).parquet(path)
        if written.isEmpty():
            place, files = self._place(path)
            files.delete(place, True)
            return self.spark.createDataFrame([], self.schema).select("key", *self.names)
        return written.select("key", *self.names)

    def split(self, rows: DataFrame, key: str = "key", now_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows with their live values, rows that have none). Rows without a key have none."""
        live = self.live(now_ms).withColumnRenamed("key", "_live_key")
        same = F.col(key) == F.col("_live_key")
        return rows.join(live, same).drop("_live_key"), rows.join(live.select("_live_key"), same, "left_anti")

    def compact(self, now_ms: int | None = None) -> None:
        """Gather the live rows in one folder and remove the others; rows keep their own times."""
        now_ms = now_millis() if now_ms is None else now_ms
        runs, dead = self._runs(now_ms)
        if len(runs) > 1:
            rows = self.spark.read.schema(self.schema).parquet(*runs).where(F.col("expires_at") > now_ms)
            newest = rows.groupBy("key").agg(F.max_by(F.struct(*self.names, "written_at", "expires_at"), "written_at").alias("_of"))
            until = max(int(run.rsplit("/", 1)[1].split("-")[2]) for run in runs)
            newest.select("key", "_of.*").write.parquet(f"{self.path}/run-{now_ms:015d}-{until:015d}-{uuid.uuid4().hex}")
            dead = dead + runs
        for path in dead:
            place, files = self._place(path)
            files.delete(place, True)

    def read_through(self, rows: DataFrame, key: Column, text: str, compute: Callable[[DataFrame], DataFrame], now_ms: int | None = None) -> DataFrame:
        """`rows` with the values of their text, computed only where no live row has them.

        `compute` turns (key, text), one row per distinct missing text, into (key, values), or (key, values, error): a
        row with an error is given back with this result and not kept. It runs once, in the job that writes; the rows are
        then read from what was committed. Texts without a result have null values. Adds the values, and `error`.
        """
        keyed = cut_lineage(rows.withColumn("_key", key))
        distinct = keyed.where(F.col(text).isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.any_value(text).alias("text"))
        held = self.live(now_ms)
        missing = distinct.join(held.select("key"), "key", "left_anti")
        made = compute(missing)
        none = F.lit(None).cast("string").alias("error")
        if "error" in made.columns:
            made = cut_lineage(made.select("key", *self.names, "error"))
            self.put(made.where("error is null"), now_ms)
            fresh = made
        else:
            fresh = self.put(made, now_ms).select("key", *self.names, none)
        known = held.select("key", *self.names, none).unionByName(fresh).withColumnRenamed("key", "_key")
        return skew_safe_join(keyed, known, "_key", "left").drop("_key")


@dataclass(frozen=True)
class Memory:
    """What the jobs remember between runs: responses, vectors, drafted passages."""

    responses: ExpiringTable
    vectors: ExpiringTable
    passages: ExpiringTable

    @classmethod
    def at(cls, spark: SparkSession, folder: str, settings: Settings = Settings()) -> "Memory":
        return cls(
            ExpiringTable(spark, f"{folder}/responses", RESPONSE, settings.response_ttl_s),
            ExpiringTable(spark, f"{folder}/vectors", "vector array<double>", settings.embedding_ttl_s),
            ExpiringTable(spark, f"{folder}/passages", "passages array<string>", settings.blend_ttl_s),
        )
