"""Order-dependent operators that hold up when one key owns much of the table.

``first_per_key`` is a rank-limited window: Spark trims every map task to one
row per key before the shuffle.  ``number_rows`` and ``previous_value`` cut a
key's rows into spans of an integer order column, solve each span in a task of
its own and stitch the spans with one small row per span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.text import as_column

SPAN = 1 << 16
BANDS = 256


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key under ``order`` (a total order)."""
    w = Window.partitionBy(*[as_column(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def last_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """The last row of every key under ascending ``order``."""
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    leading: Sequence[Column],
    seq: str,
    name: str,
    span: int = SPAN,
) -> DataFrame:
    """Row number per key ordered by ``leading`` columns, then integer ``seq``.

    A key is cut into bands at approximate quantiles of the first leading
    column (a number), and a band into (leading values, seq span) groups; sizes
    are counted with map-side combining and turned into offsets in two steps,
    over the groups of a band and over the bands of a key.  So no task sorts a
    whole key, whether its leading values are few or all distinct.
    """
    lead = [f"_lead{i}" for i in range(len(leading))]
    # sort direction travels with the column; the value itself is the grouping key
    parts = df.select("*", *[c.alias(n) for c, n in zip(leading, lead)]).withColumn(
        "_span", F.expr(f"{seq} div {span}")
    )
    cuts = parts.groupBy(*keys).agg(
        F.percentile_approx(lead[0], [i / BANDS for i in range(1, BANDS)], 20 * BANDS).alias("_cuts")
    ).select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_cuts")
    parts = parts.join(cuts, _same([F.col(k) for k in keys], [F.col(f"_of_{k}") for k in keys]))
    below = F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(lead[0]))
    parts = parts.withColumn("_band", F.size(below)).drop("_cuts", *[f"_of_{k}" for k in keys])
    group = [*keys, "_band", *lead, "_span"]
    sizes = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    before = (
        Window.partitionBy(*keys, "_band")
        .orderBy(*[F.col(c).asc_nulls_first() for c in lead], F.col("_span"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_in_band"))
    bands = sizes.groupBy(*keys, "_band").agg(F.sum("_size").alias("_held"))
    lower = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_band").alias("_at"),
        F.coalesce(F.sum("_held").over(lower), F.lit(0)).alias("_below"),
    )
    same = _same([F.col(k) for k in keys] + [F.col("_band")], [F.col(f"_of_{k}") for k in keys] + [F.col("_at")])
    offsets = offsets.join(bands, same).select(*group, (F.col("_in_band") + F.col("_below")).alias("_before"))
    inside = Window.partitionBy(*group).orderBy(F.col(seq))
    numbered = parts.withColumn("_inside", F.row_number().over(inside))
    joined = numbered.join(offsets, _same([numbered[c] for c in group], [offsets[c] for c in group]))
    return joined.select(
        *[numbered[c] for c in df.columns],
        (F.col("_before") + F.col("_inside")).cast("bigint").alias(name),
    )


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Pairwise equality, NULL being equal to NULL."""
    condition = F.lit(True)
    for x, y in zip(a, b):
        condition = condition & x.eqNullSafe(y)
    return condition


def previous_value(df: DataFrame, key: str, order: str, name: str, span: int = SPAN) -> DataFrame:
    """Add the next lower ``order`` value of the same key (NULL for the lowest).

    ``order`` is an integer that is unique within the key.
    """
    parts = df.withColumn("_span", F.expr(f"{order} div {span}"))
    tops = parts.groupBy(key, "_span").agg(F.max(order).alias("_top"))
    tops = tops.select(
        F.col(key).alias("_key"),
        F.col("_span").alias("_at"),
        F.lag("_top").over(Window.partitionBy(key).orderBy("_span")).alias("_carry"),
    )
    inside = Window.partitionBy(key, "_span").orderBy(order)
    local = parts.withColumn("_local", F.lag(order).over(inside))
    joined = local.join(tops, (local[key] == tops["_key"]) & (local["_span"] == tops["_at"]))
    return joined.select(*[local[c] for c in df.columns], F.coalesce("_local", "_carry").alias(name))
