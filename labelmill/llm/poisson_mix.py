"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its target share of the characters divided by
its share now.  A document's number of copies is the inverse of the Poisson
distribution with that mean at a uniform number made from a hash of the seed
and the document id, so the mix does not depend on partitions, order or
retries.  Copies are ordered by another hash: a global shuffle that is one
range exchange.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import free_prefix, keep

#: A larger mean is drawn as a sum of draws with equal means up to this one.
PIECE = 500.0
#: Sources whose rates are broadcast; more are joined by Spark's choice.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _inverse_poisson(u: Column, mean: Column) -> Column:
    """The number of k = 0, 1, ... whose cumulative probability is at most ``u``."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(20.0)).cast("int")
    p0 = F.exp(-mean)

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        reached = state["c"] <= u
        return F.struct(p.alias("p"), (state["c"] + p).alias("c"), (state["n"] + reached.cast("int")).alias("n"))

    begin = F.struct(p0.alias("p"), p0.alias("c"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), last), begin, step, lambda s: s["n"])


def rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, smoothing: float = 0.5, epochs: float = 1.0,
    source: str = "source", text: str = "text",
) -> DataFrame:
    """(source, chars, rate) of every source, counted over all documents.

    ``weights`` names target weights (a source that it does not name has
    weight 0); without it a source's weight is its share of the characters to
    the power ``smoothing``.  ``epochs`` is the size of the mix as a multiple of
    the input.  A null source is a source of its own (named by '').  A source
    without characters has rate 0.
    """
    name = F.coalesce(F.col(source), F.lit(""))
    counted = docs.groupBy(name.alias("source")).agg(
        F.coalesce(F.sum(F.char_length(text)), F.lit(0)).cast("double").alias("chars")
    )
    if weights is None:
        weight = F.when(F.col("chars") > 0, F.pow("chars", F.lit(smoothing))).otherwise(0.0)
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(0.0))
        weight = F.when(F.col("chars") > 0, weight.cast("double")).otherwise(0.0)
    counted = keep(counted.withColumn("weight", weight), "sources")
    chars, weighed = counted.agg(F.sum("chars"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(weighed or 1.0) * F.lit(chars or 0.0) * F.lit(epochs)
    rate = F.when(F.col("chars") > 0, share / F.col("chars")).otherwise(0.0)
    return counted.select("source", "chars", rate.alias("rate"))


def mix(
    docs: DataFrame, seed: int = 0, weights: Mapping[str, float] | None = None, smoothing: float = 0.5, epochs: float = 1.0,
    doc_id: str = "doc_id", source: str = "source", text: str = "text", prefix: str = "",
) -> DataFrame:
    """Copies of the rows of ``docs`` in shuffled order, with copy_no (from 1), rate and shuffle_key, named with ``prefix``.

    The result is globally ordered by shuffle_key.  Equal rows draw equal
    numbers of copies; a row without an id draws by its text.  Rows of a source
    with rate 0 do not appear.  An empty table gives an empty table; columns of
    ``docs`` with the names of the new ones are replaced.
    """
    free = free_prefix(docs)
    name, rate, drawn = free + "source", free + "rate", free + "drawn"
    found = rates(docs, weights, smoothing, epochs, source, text).select(F.col("source").alias(name), F.col("rate").alias(rate))
    if found.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    key = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.join(found, F.coalesce(F.col(source), F.lit("")) == F.col(name)).drop(name)
    pieces = F.greatest(F.ceil(F.col(rate) / F.lit(PIECE)), F.lit(1)).cast("int")
    draw = lambda n, j: n + _inverse_poisson(
        _uniform(F.lit(str(seed)), key, j.cast("string")), F.col(rate) / pieces
    )
    rows = rows.withColumn(drawn, F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), draw)).filter(F.col(drawn) > 0)
    rows = rows.withColumn(drawn, F.explode(F.sequence(F.lit(1), F.col(drawn))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), key, F.col(drawn).cast("string")))
    new = {prefix + "copy_no": F.col(drawn), prefix + "rate": F.col(rate), prefix + "shuffle_key": order}
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return rows.select(*own, *[c.alias(n) for n, c in new.items()]).orderBy(prefix + "shuffle_key")
