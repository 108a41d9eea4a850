"""Join operators: salted key join, substring join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(
    rows: DataFrame, lookup: DataFrame, key: str, spread: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``rows`` to a ``lookup`` that holds few rows per key.

    The rows of one key are spread over ``salts`` partitions by a hash of the
    ``spread`` columns, and each lookup row is repeated once per salt, so a key
    that holds a third of ``rows`` is not joined in one task.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    right = lookup.withColumn("_salt", copies)
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _grams(text: Column) -> Column:
    """Distinct substrings of one to three characters."""
    sized = [
        F.when(
            F.length(text) >= n,
            F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: text.substr(i, F.lit(n))),
        )
        for n in (1, 2, 3)
    ]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*sized))))


def _longest_grams(text: Column) -> Column:
    size = F.least(F.length(text), F.lit(3))
    positions = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(positions, lambda i: text.substr(i, size)))


def substring_pairs(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """Distinct (needle, text) pairs where the text contains the needle.

    An exact substring join without a cross product: every needle is looked up
    through its rarest gram of up to three characters among the distinct texts,
    and the hits are then verified.  Blank needles match nothing.
    """
    wanted = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct()
    distinct_texts = texts.select(F.col(text).alias("text")).filter("text is not null").distinct()
    text_grams = distinct_texts.select("text", F.explode(_grams(F.col("text"))).alias("gram"))
    needle_grams = wanted.select("needle", F.explode(_longest_grams(F.col("needle"))).alias("gram"))
    # counted map-side before the join: a common gram is one row per task, not one per text
    counts = text_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        needle_grams.join(counts, "gram")
        .groupBy("needle")
        .agg(F.min(F.struct("n", "gram")).alias("best"))
        .select("needle", F.col("best.gram").alias("gram"))
    )
    hits = salted_join(text_grams, rarest, "gram", ["text"])
    return hits.filter(F.contains("text", F.col("needle"))).select("needle", "text")
