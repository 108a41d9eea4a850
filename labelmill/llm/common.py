"""Shared small helpers: tables, settings, staged tables, text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from labelmill.session import delete, scratch_dir, ship

#: Bytes of one Arrow batch; a batch holds one row at least, so a long text stays alone.
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and bound the Arrow batches by bytes, as texts differ in length by orders of magnitude."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._kept_at)


def text_column(schema: str, worker: Callable[[list[str | None]], dict[str, list]], make: Callable[[], object] | None = None):
    """A column function text -> struct<schema>, evaluated in Arrow batches.

    ``make`` runs once per task and its result is the worker's second argument.
    The function counts as non-deterministic so that a filter on its result is
    not pushed below it, which would evaluate it twice.
    """

    @pandas_udf(schema)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        state = make() if make else None
        for texts in batches:
            rows = texts.tolist()
            yield pd.DataFrame(worker(rows, state) if make else worker(rows))

    return column.asNondeterministic()


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def with_text_column(df: DataFrame, column, text: str, fields: list[str], prefix: str = "") -> DataFrame:
    """``df`` with the fields of ``column(text)``, named with ``prefix``; columns of ``df`` with such names are replaced."""
    names, made = {(prefix + f).lower() for f in fields}, free_prefix(df) + "made"
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    found = df.withColumn(made, column(F.col(text)))
    return found.select(*own, *[F.col(made)[f].alias(prefix + f) for f in fields])


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % modulus
