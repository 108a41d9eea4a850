"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
turns a unit vector, and its hash is the nearest signed axis.  A table's key
joins the hash of one rotation over all axes with the hash of another over as
few axes as make the mean bucket hold ``MEAN_BUCKET`` vectors, whatever the
number of vectors.  A query looks into the bucket of its own key and into the
next likely ones; all vectors found are reranked by exact cosine in double
precision.  How many buckets it looks into is at least ``PROBES`` and grows
until the true neighbours of ``SAMPLE`` queries, found by brute force at run
time, lie in them with a share of ``AIM``; looking into all is the bound.

Every vector is indexed.  Equal vectors are one entry with their smallest ids
(one more than are asked for, as a query leaves itself out), so copies neither
fill buckets nor hide others.  Bucket keys of entries and queries meet by
partition and sort; a query's best are kept while a bucket streams by, so pairs
are never stored.  Buckets beyond ``SPLIT`` entries or queries are dealt out in
pieces that meet each other exactly once: nothing is capped.

Vectors that are null, zero, or hold null or non-finite components, and rows
without an id take no part; vectors of another length than most are padded
with zeros.  Rows with the same id and vector count once.  Ties go to the
smaller id.  No valid vector or no query: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import keep, prepare

TABLES = 10
PROBES = 20
MEAN_BUCKET = 100
#: Queries of which the true neighbours are found to choose the probes, and their share to be found.
SAMPLE = 200
AIM = 0.95
SPLIT = 4096
#: Crowded buckets (16 bytes each) that are broadcast.
BROADCAST_BUCKETS = 500_000
SEED = 17
HITS = "q1 long, q2 long, v1 long, v2 long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, width)


class Tables:
    """Keys of ``tables`` tables for unit vectors of ``width`` components (a power of two)."""

    def __init__(self, width: int, entries: int, tables: int = TABLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.width, self.tables = width, tables
        self.signs = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), size=(tables, 2, 3, width))
        # buckets = 2 width * axes (or axes alone while few are enough)
        wanted = max(1.0, entries / MEAN_BUCKET)
        self.first_axes = int(min(2 * width, max(1, round(wanted))))
        self.second_axes = int(min(2 * width, max(1, round(wanted / (2 * width)))))

    def _costs(self, x: np.ndarray, table: int, which: int, axes: int) -> np.ndarray:
        """Distance of every used signed axis from the nearest one, per row."""
        for signs in self.signs[table, which]:
            x = hadamard(x * signs) / np.float32(np.sqrt(self.width))
        signed = np.concatenate([x, -x], axis=1)
        if axes < 2 * self.width:  # pairs of opposite axes first
            used = np.concatenate([[i, i + self.width] for i in range(-(-axes // 2))])[:axes]
            signed = signed[:, used]
        return signed.max(axis=1, keepdims=True) - signed

    def keys(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, tables, probes): bucket keys by increasing cost, -1 beyond the number of buckets."""
        out = np.full((len(x), self.tables, probes), -1, dtype=np.int64)
        for t in range(self.tables):
            a = self._costs(x, t, 0, self.first_axes)
            b = self._costs(x, t, 1, self.second_axes)
            near_a, near_b = _best(a, probes), _best(b, probes)
            cost = (np.take_along_axis(a, near_a, 1) ** 2)[:, :, None] + (np.take_along_axis(b, near_b, 1) ** 2)[:, None]
            cost = cost.reshape(len(x), -1)
            chosen = _best(cost, probes)
            i, j = chosen // near_b.shape[1], chosen % near_b.shape[1]
            key = np.take_along_axis(near_a, i, 1).astype(np.int64) * self.second_axes + np.take_along_axis(near_b, j, 1)
            out[:, t, : key.shape[1]] = key + (t << 40)
        return out


def _best(cost: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n smallest of each row, ascending."""
    if n >= cost.shape[1]:
        return np.argsort(cost, axis=1, kind="stable")
    some = np.argpartition(cost, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(cost, some, 1), axis=1, kind="stable"), 1)


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares of extreme components stay finite
    x = x / scale
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def search(
    vectors: DataFrame, queries: Column, nearest: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row for which ``queries`` holds, itself left out.

    ``probes`` is chosen from the recall of a sample of the queries where it is not given.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.filter(_valid(F.col(vector)) & F.col(vec_id).isNotNull())
    rows = rows.withColumn("_asked", queries).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.col("_asked").alias("asked")
    )
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # the smallest ids of every distinct vector
    few = Window.partitionBy("h1", "h2").orderBy("id")
    least = rows.select("h1", "h2", "id", "v").withColumn("nth", F.dense_rank().over(few)).filter(F.col("nth") <= nearest + 1)
    first = least.groupBy("h1", "h2", "id").agg(F.first("v").alias("v"))
    asked = rows.filter("asked").select("id", "h1", "h2").distinct()
    entries = first.groupBy("h1", "h2").agg(F.min_by("v", "id").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    entries = keep(entries.join(asked.select("h1", "h2", F.lit(True).alias("asked")).distinct(), ["h1", "h2"], "left"), "vectors")
    count, longest = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = keep(asked, "queries")
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = probes or _enough_probes(entries, longest, count, nearest, tables)
    hits = _hits(entries, longest, count, nearest, tables, probes)
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least")
    ids = entries.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), "ids", F.element_at("ids", 1).alias("least"))
    # a vector of many buckets is found many times
    hits = hits.groupBy("q1", "q2", "v1", "v2").agg(F.max("score").alias("score")).join(ids, ["v1", "v2"])
    hits = hits.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= nearest + 1)
    found = hits.select("q1", "q2", "score", F.explode("ids").alias("id"))
    lists = found.groupBy("q1", "q2").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "id")).alias("found"))
    own = asked.join(lists, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
    others = F.filter(F.sort_array("found"), lambda x: x["id"] != F.col("id"))
    own = own.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, nearest)).alias("at", "x"))
    return own.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _enough_probes(entries: DataFrame, longest: int, count: int, nearest: int, tables: int) -> int:
    """Probes with which the true neighbours of a sample of the queries are found with a share of ``AIM``."""
    width = 1 << max(0, longest - 1).bit_length()
    some = entries.filter("asked").orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    if not len(some):
        return PROBES
    asked = _unit(_matrix(some, width, np.float64))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = vectors = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                units = _unit(_matrix(batch.column(0).slice(lo, 1024), width, np.float64))
                new = np.broadcast_to(units, (len(asked), *units.shape))
                both = asked @ units.T
                if scores is not None:
                    both = np.concatenate([scores, both], axis=1)
                    new = np.concatenate([vectors, new], axis=1)
                chosen = _best(-both, nearest + 1)
                scores, vectors = np.take_along_axis(both, chosen, 1), np.take_along_axis(new, chosen[:, :, None], 1)
        if scores is not None:
            flat = vectors.reshape(-1, width)
            query = np.repeat(np.arange(len(asked)), scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(scores.ravel()), pa.array(list(flat))], names=["query", "score", "v"])

    found = entries.select("v").mapInArrow(best, "query long, score double, v array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    found = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth").between(2, nearest + 1)).toArrow()  # the first is itself
    if not found.num_rows:
        return PROBES
    index = Tables(width, count, tables)
    own = index.keys(_matrix(found.column("v").combine_chunks(), width, np.float32), 1)[:, :, 0]
    query = found.column("query").to_numpy()
    probes, most = PROBES, index.first_axes * index.second_axes
    while probes < most:
        looked = index.keys(asked.astype(np.float32), probes)
        if (looked[query] == own[:, :, None]).any(axis=(1, 2)).mean() >= AIM:
            break
        probes = min(2 * probes, most)
    return probes


def _hits(entries: DataFrame, longest: int, count: int, nearest: int, tables: int, probes: int) -> DataFrame:
    """(query, vector, score) of the best of every query in every bucket that it looks into."""
    width = 1 << max(0, longest - 1).bit_length()
    index = Tables(width, count, tables)

    def keyed(with_vectors: bool) -> DataFrame:
        """Bucket keys of entries (their own) and of queries (those they look into)."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    names = (part.column(0).to_numpy(), part.column(1).to_numpy())
                    units = _unit(_matrix(part.column(2), width, np.float64)).astype(np.float32)
                    own = index.keys(units, 1)[:, :, 0]
                    rows = np.repeat(np.arange(len(own)), tables)
                    yield _keyed(own.ravel(), rows, names, part.column(2) if with_vectors else None, False)
                    at = np.flatnonzero(part.column(3).fill_null(False).to_numpy(zero_copy_only=False))
                    if len(at):
                        looked = index.keys(units[at], probes)
                        rows = at[np.nonzero(looked >= 0)[0]]
                        yield _keyed(looked[looked >= 0], rows, names, part.column(2) if with_vectors else None, True)

        more = f", h1 long, h2 long, v {dict(entries.dtypes)['v']}" if with_vectors else ""
        return entries.select("h1", "h2", "v", "asked").mapInArrow(emit, "key long, query boolean" + more)

    # crowded buckets are dealt out: every piece of the entries meets every piece of the queries
    crowded = keyed(False).groupBy("key").agg(F.count_if(~F.col("query")).alias("entries"), F.count_if("query").alias("queries"))
    crowded = crowded.select(
        F.col("key").alias("_key"),
        F.greatest(F.ceil(F.col("entries") / SPLIT), F.lit(1)).cast("int").alias("ep"),
        F.greatest(F.ceil(F.col("queries") / SPLIT), F.lit(1)).cast("int").alias("qp"),
    )
    crowded = keep(crowded.filter("ep > 1 or qp > 1"), "crowded")
    if crowded.count() <= BROADCAST_BUCKETS:
        crowded = F.broadcast(crowded)
    placed = keyed(True).join(crowded, F.col("key") == F.col("_key"), "left").drop("_key").na.fill(1, ["ep", "qp"])
    own = F.pmod(F.xxhash64("h1", "h2"), F.when(F.col("query"), F.col("qp")).otherwise(F.col("ep"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("ep")).otherwise(F.col("qp")) - 1)
    placed = placed.withColumn("own", own).withColumn("other", F.explode(others))
    e = F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("e")
    q = F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("q")
    placed = placed.select("key", e, q, "query", "h1", "h2", "v")
    ordered = placed.repartition("key", "e", "q").sortWithinPartitions("key", "e", "q", F.desc("query"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(nearest + 1)
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            query = np.array(batch.column(3).to_pylist())
            names = np.stack([batch.column(4).to_numpy(), batch.column(5).to_numpy()], axis=1)
            units = _unit(_matrix(batch.column(6), width, np.float64))
            edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(place)]):
                done = best.take(tuple(place[lo]), bool(query[lo]), names[lo:hi], units[lo:hi])
                if done is not None:
                    yield done
        done = best.close()
        if done is not None:
            yield done

    return ordered.mapInArrow(meet, HITS)


def _keyed(keys: np.ndarray, rows: np.ndarray, names: tuple, vectors: pa.Array | None, query: bool) -> pa.RecordBatch:
    columns = {"key": pa.array(keys), "query": pa.array(np.full(len(keys), query))}
    if vectors is not None:
        columns |= {"h1": pa.array(names[0][rows]), "h2": pa.array(names[1][rows]), "v": vectors.take(pa.array(rows))}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class _Best:
    """The best entries of the queries of a bucket piece, while its entries stream by."""

    def __init__(self, keep_: int):
        self.keep, self.place = keep_, None
        self._open(None)

    def _open(self, place: tuple | None) -> None:
        self.place, self.queries, self.units = place, [], []
        self.scores = self.names = None

    def take(self, place: tuple, query: bool, names: np.ndarray, units: np.ndarray) -> pa.RecordBatch | None:
        done = None
        if place != self.place:
            done = self.close()
            self._open(place)
        if query:
            self.queries.append(names)
            self.units.append(units)
        elif len(self.queries):
            if self.scores is None:
                self.units = np.concatenate(self.units)
                self.queries = np.concatenate(self.queries)
                self.scores = np.full((len(self.units), 0), 0.0)
                self.names = np.zeros((len(self.units), 0, 2), dtype=np.int64)
            for lo in range(0, len(units), 1024):
                part = units[lo : lo + 1024]
                scores = np.concatenate([self.scores, self.units @ part.T], axis=1)
                own = np.broadcast_to(names[lo : lo + 1024], (len(scores), len(part), 2))
                both = np.concatenate([self.names, own], axis=1)
                chosen = _best(-scores, self.keep)
                self.scores = np.take_along_axis(scores, chosen, 1)
                self.names = np.take_along_axis(both, chosen[:, :, None], 1)
        return done

    def close(self) -> pa.RecordBatch | None:
        if self.scores is None or not self.scores.size:
            return None
        n, kept = self.scores.shape
        who, found = np.repeat(self.queries, kept, axis=0), self.names.reshape(-1, 2)
        columns = [who[:, 0], who[:, 1], found[:, 0], found[:, 1], self.scores.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["q1", "q2", "v1", "v2", "score"])
