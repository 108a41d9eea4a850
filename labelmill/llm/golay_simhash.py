"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments.  Two fingerprints that differ
in at most two bits agree in one segment i, and differ in at most one bit in
the segment after it (round robin) for some i: the patterns of one or two
errors over three segments leave no other case.  So a key joins the whole
segment i with the index of a Golay codeword near segment i + 1.  The binary
(23, 12) Golay code is perfect: every word has one codeword within three
errors.  Of two words one error apart, the nearest codeword of one is at most
four errors from the other, so one side of the join takes the nearest codeword
(one key) and the other all codewords within four errors (one key, or six
where the nearest is three errors away).  Matches are verified bit by bit.

Distinct fingerprints are joined, not documents, so copies meet in a grouped
minimum.  A key that more than ``BUCKET`` fingerprints share would make pairs
with the square of its size.  Its fingerprints are linked through midpoints
instead: two fingerprints differ in at most two bits exactly if some word is
within one bit of both, a fingerprint has 65 such words, and a word at most 65
such fingerprints.  Linking each of them to the smallest keeps every
connection, with a bounded number of rows per fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import free_prefix, keep, prepare, text_column, with_text_column
from labelmill.llm.components import components

SHINGLE = 3
SEED = 42
#: First bit and width of the segments.
SEGMENTS = [(0, 21), (21, 22), (43, 21)]
#: Fixed value: generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101
#: Listed fingerprints of a key beyond which midpoints are used.
BUCKET = 64
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 16


def ascii_words(text: str) -> list[bytes]:
    """Words between ASCII white space; A-Z become lower case."""
    return text.encode("utf-8").lower().split()


def shingle_hashes(
    text: str | None, shingle: int = SHINGLE, words_of: Callable[[str], list[bytes]] = ascii_words
) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a whole text, in blocks; a shorter text is one shingle, a wordless one has none."""
    words = words_of(text or "")
    if not words:
        return
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    size = min(shingle, len(words))
    starts = [0, *[e + 1 for e in ends[: len(ends) - size]]]
    stops = ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(starts), COUNTED):
        yield np.fromiter(
            (digest(joined[s:e], SEED) for s, e in zip(starts[lo : lo + COUNTED], stops[lo : lo + COUNTED])),
            dtype="<u8",
        )


def simhash(blocks: Iterable[np.ndarray]) -> int:
    """Majority bits of hashes that come in blocks."""
    count, ones = 0, np.zeros(64, dtype=np.int64)
    for hashes in blocks:
        count += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > count))


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text by its word shingles."""
    return simhash(shingle_hashes(text))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with fingerprint_bits (long) of every whole text, named with ``prefix``; null and wordless texts have 0."""
    prepare(docs.sparkSession)
    column = text_column(
        "fingerprint_bits long", lambda texts: {"fingerprint_bits": [_signed(fingerprint(t)) for t in texts]}
    )
    return with_text_column(docs, column, text, ["fingerprint_bits"], prefix)


@lru_cache(maxsize=1)
def _nearby() -> np.ndarray:
    """By syndrome: the error pattern to the nearest codeword, then those of weight four (0: none)."""
    patterns = [sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)]
    table, used = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for pattern, syndrome in zip(patterns, syndromes(np.array(patterns, dtype=np.int64))):
        if pattern.bit_count() < 4 or used[syndrome]:
            table[syndrome, used[syndrome]] = pattern
            used[syndrome] += 1
    return table


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four errors of 23-bit words, nearest first; -1 where there is none."""
    errors = _nearby()[syndromes(words)]
    out = (words[:, None] ^ errors) >> 11
    out[:, 1:][errors[:, 1:] == 0] = -1
    return out


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) keys by nearest codewords and (n, 3, 6) keys by all nearby ones, -1 where there is none."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    listed = np.empty((len(prints), 3, 6), dtype=np.int64)
    for i in range(3):
        near = codewords(parts[(i + 1) % 3])
        listed[:, i] = np.where(near < 0, -1, (i << 34 | parts[i] << 12)[:, None] | near)
    return listed[:, :, 0], listed


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, fp, listed): by nearest codewords (listed false) and by all nearby ones (true)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            nearest, listed = keys(own.view(np.uint64))
            flat = listed.reshape(len(own), 18)
            rows, _ = np.nonzero(flat >= 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([nearest.ravel(), flat[flat >= 0]])),
                    pa.array(np.concatenate([np.repeat(own, 3), own[rows]])),
                    pa.array(np.repeat([False, True], [nearest.size, len(rows)])),
                ],
                names=["key", "fp", "listed"],
            )

    return prints.select("fp").mapInArrow(emit, "key long, fp long, listed boolean")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: links whose components are those of all pairs within two bits."""
    keyed = _keyed(prints)
    crowded = keyed.filter("listed").groupBy("key").count().filter(F.col("count") > bucket).select("key")
    rest = keyed.join(crowded, "key", "left_anti")
    one, other = rest.filter("not listed"), rest.filter("listed")
    pairs = one.select("key", F.col("fp").alias("a")).join(other.select("key", F.col("fp").alias("b")), "key")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = pairs.filter((F.col("a") != F.col("b")) & (close <= 2)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    hot = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in range(64)])
    middle = hot.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp")
    met = middle.groupBy("mid").agg(F.collect_set("fp").alias("near"))  # 65 at most
    stars = met.filter(F.size("near") > 1).select(F.array_min("near").alias("b"), F.explode("near").alias("a"))
    return pairs.distinct().union(stars.filter("a <> b").select("a", "b").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint_bits, group, component_id) of every row of ``docs``.

    ``group`` names the near-duplicate group (a fingerprint of it), component_id
    is the smallest document id in it, null if it has none.  Null and wordless
    texts have fingerprint 0 and form one group with all that is near it.
    Repeated rows and repeated ids give a row each.
    """
    prints = keep(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "prints")
    distinct = prints.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min("doc_id").alias("least"))
    distinct = keep(distinct, "distinct-prints")
    linked = components(links(distinct), "a", "b")
    grouped = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = grouped.withColumn("group", F.coalesce("component", "fp"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    classes = grouped.select("fp", "group").join(least, "group").withColumnRenamed("fp", "fingerprint_bits")
    return prints.join(classes, "fingerprint_bits").select("doc_id", "fingerprint_bits", "group", "component_id")


def hex_digits(column: str = "fingerprint_bits"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of every near-duplicate group, with the columns of ``docs``.

    Rows without an id come last in their group; of equal rows one stays.
    """
    found = near_duplicates(docs, doc_id, text)
    chosen = found.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "fingerprint_bits")).alias("first")
    )
    free = free_prefix(docs)
    bits, id_, print_, nth = (free + c for c in ("fingerprint_bits", "id", "print", "nth"))
    chosen = chosen.select(F.col("first.doc_id").alias(id_), F.col("first.fingerprint_bits").alias(print_))
    marked = with_fingerprint(docs, text, free)
    kept = marked.join(chosen, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(bits) == F.col(print_)), "left_semi")
    same = Window.partitionBy(doc_id, bits).orderBy(F.xxhash64(text))
    return kept.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).drop(nth, bits)
