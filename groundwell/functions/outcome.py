"""A worker's failure as data: each row comes back with a value or with an error, and no row fails another."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of an error that are kept.
ERROR_LENGTH = 200


def guarded(call: Callable[[list[tuple]], list], value: str, batch: int = 32) -> Callable[..., Column]:
    """Column function (arguments...) -> struct(value, error) around a provider that takes a list of rows.

    The provider is called in batches. Where a batch fails, or does not return one result per row, its rows are tried one by
    one, so that an error belongs to the row that caused it. Rows whose first argument is null are not asked about:
    neither value nor error. A provider that returns None for a row gave no value, which is no error.
    """
    kind = T.StructType([T.StructField("value", T._parse_datatype_string(value)), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.DataFrame:
        cells = [c.to_dict("records") if isinstance(c, pd.DataFrame) else c.tolist() for c in columns]
        rows = list(zip(*cells))
        asked = [i for i, row in enumerate(rows) if row[0] is not None and row[0] == row[0]]
        values, errors = [None] * len(rows), [None] * len(rows)
        for start in range(0, len(asked), batch):
            some = asked[start:start + batch]
            try:
                got = list(call([rows[i] for i in some]))
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} results for {len(some)} rows")
            except Exception:
                got = []
                for i in some:
                    try:
                        (one,) = call([rows[i]])
                        got.append(one)
                    except Exception as error:
                        got.append(None)
                        errors[i] = f"{type(error).__name__}: {error}"[:ERROR_LENGTH]
            for i, one in zip(some, got):
                values[i] = one
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    # calls must not be repeated or moved into other expressions by the optimizer
    return run.asNondeterministic()


def unwrap(df: DataFrame, column: str, error: str) -> DataFrame:
    """`df` with the value in `column` and its error in `error`; a column that is no such struct has no errors."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType) and set(kind.names) == {"value", "error"}:
        return df.withColumn(error, F.col(column)["error"]).withColumn(column, F.col(column)["value"])
    return df.withColumn(error, F.lit(None).cast("string"))
