"""Reading the given tables, and the views derived from them that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.bind import unroll
from groundwell.functions.keys import iso_millis
from groundwell.functions.text import sentences, strip
from groundwell.session import cut_lineage


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A table with only the wanted columns."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input that arrives as a few large pieces.

    Parsing costs far more than reading, so a small table in one file is dealt out first. Where
    the scan already gives each core several pieces, as a large table does, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents", *(columns or ("doc_id", "text"))))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages asked as questions: qid, text."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def typeset_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as typeset lines; page, size, weight and block follow from each line itself."""
    docs = documents(spark, sf)
    rows = unroll(
        docs.select("doc_id", F.split("text", "\n").alias("_l")), "_l", "raw", "at"
    ).select("doc_id", F.col("at").cast("bigint").alias("line_no"), strip(F.col("raw")).alias("text"))
    n = F.length("text")
    return cut_lineage(rows.where(F.col("text") != "").select(
        "doc_id", "line_no", "text",
        (F.floor(F.col("line_no") / 8) + 1).cast("int").alias("page"),
        F.when(n % 7 == 0, 14.0).when(n % 5 == 0, 12.0).when(n % 3 == 0, 11.0).otherwise(10.0).alias("size"),
        (n % 2 == 0).alias("bold"),
        F.when(n % 4 == 0, 1).otherwise(3).alias("block_lines"),
    ))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Events as history turns: user_id, id, created_at as text with milliseconds."""
    return table(spark, sf, "events", "event_id", "user_id", "ts").select(
        "user_id", F.format_string("%012d", "event_id").alias("id"), iso_millis(F.col("ts")).alias("created_at")
    )


def drafted_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as drafted answers to the turn before them, which is the one passage.

    Every sentence is a claim; citations run through the passage's id, its marker, and every
    seventh one a marker that does not exist.
    """
    talk = spread(table(spark, sf, "conversations"))
    said = talk.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    asked = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    source = F.format_string("%d::%d", "conv_id", F.col("turn") - 1)
    n = F.length("answer")
    cited = F.when((F.col("conv_id") % 7 == 0), F.lit("C9")).when(n % 2 == 0, F.lit("C1")).otherwise(source)
    return said.join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn", "query", "answer",
        F.transform(
            sentences(F.col("answer")),
            lambda s: F.struct(s.alias("text"), F.array(cited).alias("chunk_ids")),
        ).alias("claims"),
        (F.col("conv_id") % 11 == 0).alias("insufficient_context"),
        F.array(
            F.struct(
                source.alias("chunk_id"), F.lit("C1").alias("marker"),
                F.when(n % 3 == 0, F.col("query")).otherwise(F.col("answer")).alias("text"),
            )
        ).alias("passages"),
    )
