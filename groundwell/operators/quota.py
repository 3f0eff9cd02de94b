"""Fixed-window request quotas and failure breakers over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.bind import offset
from ..session import cut_lineage

BREAKER_FAILURES = 3  # fixed value: failures in a row that open the breaker


def quota(
    requests: DataFrame, limit: int, width_s: int = Settings.rate_limit_window_s,
    subject: str = "subject", ts: str = "ts", key: str = "id",
) -> DataFrame:
    """Adds window, allowed, remaining and retry_after_s to every request.

    Windows are fixed, counted from the epoch. Only the first `limit` requests of a subject and
    window have to be found; each task keeps no more than that before the shuffle, and every later
    request is refused with nothing remaining. A subject sending a third of all requests is
    therefore never sorted in one place.
    """
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    number = F.floor(second / width_s)
    numbered = requests.withColumn("window", number).withColumn(
        "retry_after_s", (F.col("window") + 1) * width_s - second
    )
    if limit <= 0:
        return numbered.withColumn("allowed", F.lit(True)).withColumn("remaining", F.lit(-1)).withColumn(
            "retry_after_s", F.lit(0).cast("bigint")
        )
    order = W.partitionBy(subject, "window").orderBy(ts, key)
    # ids may repeat under other subjects or windows, so rows are told apart by a number of their own
    numbered = cut_lineage(numbered.withColumn("_row", F.monotonically_increasing_id()))
    first = (
        numbered.select(subject, "window", ts, key, "_row")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= limit)
        .select("_row", "_n")
    )
    return (
        numbered.join(first, "_row", "left")
        .withColumn("allowed", F.col("_n").isNotNull())
        .withColumn("remaining", F.coalesce(F.lit(limit) - F.col("_n"), F.lit(0)))
        .drop("_n", "_row")
    )


def window_counts(requests: DataFrame, limit: int, width_s: int, subject: str = "subject", ts: str = "ts") -> DataFrame:
    """subject, window, n, refused: requests per fixed window; combined map-side."""
    number = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / width_s)
    counted = requests.groupBy(F.col(subject), number.alias("window")).agg(F.count("*").alias("n"))
    return counted.withColumn("refused", F.greatest(F.col("n") - limit, F.lit(0)))


def failure_runs(calls: DataFrame, failed: str = "failed", subject: str = "subject", ts: str = "ts", key: str = "id") -> DataFrame:
    """subject, run_start, run_end, failures, trips: unbroken runs of failed calls.

    A run is named by the number of successes before it. Those are summed per hour first, then
    over hours, so a busy subject is spread over its hours.
    """
    marked = calls.select(
        subject, ts, key, F.col(failed).alias("_failed"), F.date_trunc("hour", ts).alias("_hour"),
        (~F.col(failed)).cast("long").alias("_ok"),
    )
    runs = offset(marked, [subject], "_hour", [ts, key], "_ok", "_run")
    return (
        runs.where("_failed").groupBy(subject, "_run")
        .agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count("*").alias("failures"))
        .withColumn("trips", F.floor(F.col("failures") / BREAKER_FAILURES))
        .drop("_run")
    )


def fresh_entries(entries: DataFrame, now, ttl_s: int, key: str = "key", stored: str = "stored_at") -> DataFrame:
    """The latest entry per key that has not outlived its time."""
    alive = entries.where(F.col(stored) + F.make_dt_interval(secs=F.lit(float(ttl_s))) > now)
    others = [c for c in entries.columns if c != key]
    return alive.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(stored), F.xxhash64(*others))).alias("_e")).select(key, "_e.*")
