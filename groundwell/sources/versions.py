"""Tables whose rows were written under older schemas.

Rows lie in one folder per schema version. A column that came later is null in older files; its back-fill holds for
rows of versions before it and for them alone: a null that a newer program wrote means something and stays. Reading
is therefore a projection over the version column, the same however often it is done, and `migrate` only spares
later readers that work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "schema_version"


@dataclass(frozen=True)
class Step:
    """A column added in a version, and what rows written before it hold: nothing unless `fill`, an expression, says so."""

    version: int
    column: str
    kind: str
    fill: str | None = None


def account_steps() -> tuple[Step, ...]:
    """Accounts from before verification count as verified when they were made; no password has changed since."""
    return Step(2, "verified_at", "string", "created_at"), Step(3, "password_changed_at", "string")


def newest(steps: tuple[Step, ...]) -> int:
    return max((s.version for s in steps), default=1)


def write_version(rows: DataFrame, folder: str, version: int, steps: tuple[Step, ...], base: list[str]) -> None:
    """Append rows as a program of that version writes them: with the first columns and those of steps up to it."""
    known = [*base, *[s.column for s in steps if s.version <= version]]
    rows.select(*known).write.mode("append").parquet(f"{folder}/{VERSION}={version}")


def read_migrated(spark: SparkSession, folder: str, steps: tuple[Step, ...], base: str) -> DataFrame:
    """All rows in the newest schema. `base` is the first version's schema; files of any mix of versions are read at once.

    Steps apply in order, so a fill may use columns of earlier steps. A folder of a version beyond the newest step is
    an error: an old program must not read rows it does not know. Filters on first columns reach the scan.
    """
    fields = [*T._parse_datatype_string(base).fields, *[T.StructField(s.column, T._parse_datatype_string(s.kind)) for s in steps]]
    schema = T.StructType([*fields, T.StructField(VERSION, T.IntegerType())])
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    known = F.col(VERSION) <= newest(steps)
    rows = rows.withColumn(VERSION, F.when(known, F.col(VERSION)).otherwise(
        F.raise_error(F.concat(F.lit("rows of a newer schema version: "), F.col(VERSION).cast("string"))).cast("int")))
    for step in sorted(steps, key=lambda s: s.version):
        if step.fill is not None:
            old = F.col(VERSION) < step.version
            rows = rows.withColumn(step.column, F.when(old, F.expr(step.fill).cast(step.kind)).otherwise(F.col(step.column)))
    return rows


def migrate(spark: SparkSession, folder: str, into: str, steps: tuple[Step, ...], base: str) -> None:
    """Write all rows under the newest version into another folder; readers move to it when the job has ended.

    A run that is repeated, or cut off and repeated, gives the same rows: it writes the folder anew from the old one.
    """
    rows = read_migrated(spark, folder, steps, base).drop(VERSION)
    rows.write.mode("overwrite").parquet(f"{into}/{VERSION}={newest(steps)}")
