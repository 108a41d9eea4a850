"""Document fingerprints from closed syncmers.

A k-mer of code points is selected if the smallest of its inner s-mers (by a
hash) is its first or its last one.  That depends on the k-mer alone, so equal
passages select equal anchors at equal relative positions whatever surrounds
them.  ``anchors`` gives them with positions for positional matching; a
fingerprint keeps the smallest ``KEPT`` anchor hashes of the whole text, in
hex, and the likeness of two fingerprints is the Jaccard similarity of the
anchor sets estimated from them (exact for texts with fewer anchors).

A text shorter than k has one anchor, the text itself; an empty or null text
has none, and an empty fingerprint.  Two empty fingerprints have likeness 1.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from labelmill.llm.common import prepare

K = 12
S = 5
KEPT = 64
DIGITS = 8
#: Rows of a span of neighbouring ids in the mean, and most spans.
SPAN_ROWS = 2000
SPANS = 4096
BLOCK_CHARS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _grams(codes: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """Hashes of the n code points from every place, or from the places ``at``."""
    count = len(codes) - n + 1
    out = np.zeros(count if at is None else len(at), dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(0x100000001B3)
        out += codes[j : j + count] if at is None else codes[at + j]
    return _mixed(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def syncmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the anchors of all texts, in order."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = np.empty(0, dtype=np.int64)
    if len(codes) >= K:
        inner = _grams(codes, None, S)
        width = K - S + 1
        least = _sliding_min(inner, width)
        edge = (least == inner[: len(least)]) | (least == inner[width - 1 :])
        at = np.flatnonzero(edge)
        owner = np.searchsorted(ends, at, side="right")
        inside = at + K <= ends[owner]
        at, owner = at[inside], owner[inside]
    else:
        owner = at
    hashes = _grams(codes, at, K) if len(at) else np.empty(0, dtype=np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < K))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8"), digest_size=8).digest(), "little") for i in short], dtype=np.uint64)
        owner, at, hashes = np.append(owner, short), np.append(at, starts[short]), np.append(hashes, whole)
        order = np.argsort(owner, kind="stable")
        owner, at, hashes = owner[order], at[order], hashes[order]
    return owner, at - starts[owner], hashes


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The smallest distinct anchor hashes (32 bits) of each text, ascending."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK_CHARS):
            size += len(texts[hi])
            hi += 1
        owner, _, hashes = syncmers(texts[lo:hi])
        both = np.unique(owner.astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32))
        cuts = np.searchsorted(both >> np.uint64(32), np.arange(hi - lo + 1, dtype=np.uint64))
        low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out += [low[a : min(b, a + KEPT)] for a, b in zip(cuts[:-1], cuts[1:])]
        lo = hi
    return out


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the anchor sets, from the smallest hashes of their union."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:KEPT]
    return float((np.isin(union, a) & np.isin(union, b)).sum() / len(union))


def anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, position, anchor) of every selected k-mer of every whole text, positions in code points."""
    prepare(docs.sparkSession)

    @pandas_udf("array<struct<position:int, anchor:long>>")
    def find(texts: pd.Series) -> pd.Series:
        rows = []
        for text in texts:
            _, at, hashes = syncmers([text or ""])
            rows.append([{"position": int(p), "anchor": int(h)} for p, h in zip(at, hashes.view(np.int64))])
        return pd.Series(rows)

    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(find(F.col(text))).alias("a"))
    return found.select("doc_id", "a.position", "a.anchor")


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of every whole text (a column of that name is replaced)."""
    prepare(docs.sparkSession)

    @pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series([as_text(s) for s in sketches([t or "" for t in texts])], dtype=object)

    return docs.withColumn("fingerprint", mark(F.col(text)))


def _placed(docs: DataFrame) -> DataFrame:
    """Rows with the span of ids that they belong to; a span's first row comes once more at the end of the span before.

    Spans are cut at approximate quantiles of the ids.  The number of spans is
    bounded, and so are the cuts and first ids that come to the driver.
    """
    ids = docs.select("doc_id").filter("doc_id is not null")
    rows = ids.count()
    spans = min(SPANS, max(1, rows // SPAN_ROWS))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / spans for i in range(1, spans)], 0.1 / spans))) if spans > 1 else []
    cuts = [int(c) for c in cuts]
    # two levels, so that a row is compared with two short lists
    step = max(1, int(len(cuts) ** 0.5))
    nested = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    lists = F.from_json(F.lit(json.dumps(nested)), "array<array<bigint>>")
    outer = F.from_json(F.lit(json.dumps([c[0] for c in nested])), "array<bigint>")
    under = lambda array: F.size(F.filter(array, lambda c: c <= F.col("doc_id")))
    if cuts:
        block = under(outer)
        span = F.when(block > 0, (block - 1) * step + under(F.element_at(lists, block))).otherwise(0)
    else:
        span = F.lit(0)
    spanned = docs.withColumn("span", F.when(F.col("doc_id").isNull(), -1).otherwise(span))
    first = {r["span"]: r["first"] for r in spanned.select("span", "doc_id").groupBy("span").agg(F.min("doc_id").alias("first")).collect()}
    order = sorted(first)
    before = {s: order[i - 1] for i, s in enumerate(order)}  # the last span comes before the first
    heads = F.from_json(F.lit(json.dumps({str(s): first[s] for s in order})), "map<string, bigint>")
    earlier = F.from_json(F.lit(json.dumps({str(s): before[s] for s in order})), "map<string, int>")
    name = F.col("span").cast("string")
    leads = F.element_at(heads, name).eqNullSafe(F.col("doc_id"))
    here = F.struct(F.col("span").alias("span"), F.lit(False).alias("ahead"))
    there = F.struct(F.element_at(earlier, name).alias("span"), F.lit(True).alias("ahead"))
    places = F.when(leads, F.array(here, there)).otherwise(F.array(here))
    return spanned.withColumn("place", F.explode(places)).select("doc_id", "text", "place.span", "place.ahead")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint beside that of its edited text and that of the next document.

    Documents are in ascending order of their ids (null ids first, equal ids by
    a hash of their texts), the first comes after the last.  The edited text
    has the last floor(n / 2) code points replaced by as many of the next
    document's first (or all that it has).  Texts are shuffled once, to spans
    of neighbouring ids, and read in order there; a row holds on to one other.
    An empty table gives an empty table; the only row of a table is its own next.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    sorted_rows = _placed(own).repartition("span").withColumn("tie", tie).sortWithinPartitions("span", "ahead", F.asc_nulls_first("doc_id"), "tie")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: (span, ahead, id, text, sketch)
        for rows in _blocks(batches):
            marks = sketches([r[3] for r in rows])
            rows = [(*r, m) for r, m in zip(rows, marks)]
            pairs = [(a, b) for a, b in zip([held, *rows] if held else rows, rows if held else rows[1:]) if a[0] == b[0] and not a[1]]
            held = rows[-1]
            if pairs:
                yield _compared(pairs)

    return sorted_rows.select("span", "ahead", "doc_id", "text").mapInArrow(compare, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of the batches in blocks of bounded text."""
    for batch in batches:
        rows, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and size + len(row[3]) > BLOCK_CHARS:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
        if rows:
            yield rows


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    edited = []
    for a, b in pairs:
        half = len(a[3]) // 2
        edited.append(a[3][: len(a[3]) - half] + b[3][:half])
    marks = sketches(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
            pa.array([as_text(a[4]) for a, _ in pairs]),
            pa.array([as_text(m) for m in marks]),
            pa.array([likeness(a[4], m) for (a, _), m in zip(pairs, marks)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
