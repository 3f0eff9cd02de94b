"""Structured Streaming forms of the time and state operators.

Event times must be TIMESTAMP for a watermark, so they are cast here. State is bounded: windows and
duplicates by the watermark, breakers and histories by a fixed record per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings
from ..functions.text import TokenCounter, count_tokens
from ..operators.chunking import chunk_sections
from ..operators.quota import BREAKER_FAILURES
from ..operators.sections_text import explode_sections, parse_text

BREAKER_COOLDOWN_S = 60.0  # fixed value: how long an open breaker stays open


def quota_counts(
    requests: DataFrame, width_s: int = Settings.rate_limit_window_s, lateness: str = "10 minutes",
    subject: str = "subject", ts: str = "ts",
) -> DataFrame:
    """subject, window, n per fixed window, updated as requests arrive."""
    return (
        requests.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, f"{width_s} seconds").alias("_w"), subject)
        .agg(F.count("*").alias("n"))
        .select(F.col(subject), F.floor(F.unix_seconds("_w.start") / width_s).alias("window"), "n")
    )


def first_requests(requests: DataFrame, key: str, lateness: str, ts: str = "ts") -> DataFrame:
    """Requests without repeats of a key that arrive within the lateness allowed."""
    return (
        requests.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, lateness)
        .dropDuplicatesWithinWatermark([key])
    )


def breaker(
    calls: DataFrame, subject: str = "subject", ts: str = "ts", failed: str = "failed", key: str = "id"
) -> DataFrame:
    """Every call with `attempted` and `opened`: three failures in a row stop attempts for a minute.

    The state of a subject is its failures in a row and the moment its breaker closes again. Calls
    of one micro-batch are taken in time order; the trigger bounds how many there are.
    """
    kinds = {f.name: f.dataType for f in calls.schema}
    out = T.StructType([
        T.StructField(subject, kinds[subject]), T.StructField(key, kinds[key]),
        T.StructField("attempted", T.BooleanType()), T.StructField("opened", T.BooleanType()),
    ])
    state = T.StructType([T.StructField("failures", T.IntegerType()), T.StructField("closed_at", T.DoubleType())])

    def walk(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        failures, closed_at = held.get if held.exists else (0, 0.0)
        rows = []
        for call in pd.concat(list(frames)).sort_values(["at", key]).itertuples(index=False):
            attempted, opened = call.at >= closed_at, False
            if attempted:
                failures = failures + 1 if call.failed else 0
                if failures >= BREAKER_FAILURES:
                    failures, closed_at, opened = 0, call.at + BREAKER_COOLDOWN_S, True
            rows.append((name[0], getattr(call, key), attempted, opened))
        held.update((failures, closed_at))
        yield pd.DataFrame(rows, columns=[subject, key, "attempted", "opened"])

    shaped = calls.select(
        subject, key, F.col(failed).alias("failed"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at")
    )
    return shaped.groupBy(subject).applyInPandasWithState(
        walk, out, state, "append", GroupStateTimeout.NoTimeout
    )


def pruned_turns(turns: DataFrame, keep: int) -> DataFrame:
    """user_id, id of turns that drop out as newer ones arrive; each user's state is `keep` turns."""
    kinds = {f.name: f.dataType for f in turns.schema}
    out = T.StructType([T.StructField("user_id", kinds["user_id"]), T.StructField("id", T.StringType())])
    state = T.StructType([T.StructField("kept", T.ArrayType(T.StringType()))])

    def walk(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(held.get[0]) if held.exists else []
        dropped: list[str] = []
        for frame in frames:
            pool = sorted(kept + (frame["created_at"] + "|" + frame["id"]).tolist(), reverse=True)
            kept = pool[:keep]
            dropped += [x.split("|", 1)[1] for x in pool[keep:]]
        held.update((kept,))
        yield pd.DataFrame({"user_id": [name[0]] * len(dropped), "id": dropped})

    return turns.select("user_id", "id", "created_at").groupBy("user_id").applyInPandasWithState(
        walk, out, state, "append", GroupStateTimeout.NoTimeout
    )


def write_batches(stream: DataFrame, table: str, checkpoint: str, mode: str = "append"):
    """Write every micro-batch to its own part of a table; a repeated batch replaces itself."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(store).start()
    )


def ingest_stream(
    texts: DataFrame, table: str, checkpoint: str, settings: Settings = Settings(),
    counter: TokenCounter = count_tokens,
):
    """Chunk documents (doc_id, text) as they arrive; a changed document comes again as a whole."""
    return write_batches(
        chunk_sections(explode_sections(parse_text(texts)), settings, counter), table, checkpoint
    )


def latest_rows(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The rows of the newest batch that holds each key."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"], "left_semi").drop("batch")
