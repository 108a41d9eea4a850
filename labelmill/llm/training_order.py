"""Training-order materialisation: fixed-stride shards of token sequences in a keyed random order.

Every document is cut into sequences of at most ``length`` token ids.  A
sequence's number is a hash of its document's id and text and of its place, in
a domain of 2**40 numbers for each shard, so that ids may be missing, repeated
or spread over all longs; rows that are equal in both are told apart by the
task and their count in it.  A keyed Feistel network with cycle-walking
permutes the domain and gives every sequence its slot.  So slots need no
counting pass over tokens, and but for equal rows do not depend on partitions
or retries.  Equal ranges of slots are shards: each is written by one task in
slot order as records of one stride, so that row r of a shard begins at byte
r * stride.  The manifest, made from file lengths, gives the global position of
every shard's first record (dense, from 0); reading can resume at any position
without touching earlier shards.  Shards are as many as the bytes of texts, or
of one record for each row where that is more, ask for.

A record holds the document id, the sequence's place, its number of ids, the
ids as little-endian unsigned 16-bit integers padded with zeros, and a line
feed (which is what Spark's text writer puts between rows; it writes the bytes
before it as they are).

A null text counts as empty; an empty text has one sequence without ids, so
every row appears.  A null id is stored as the smallest long.  Sequences that
meet in a slot (one pair in 2**41 for each shard's million squared) follow each
other, ordered by their bytes.  Texts of any length are cut whole.  An empty
table gives no files and an empty result.  Only the id and the text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelmill.llm.common import prepare

LENGTH = 256
HEADER = "<qii"
HEAD_BYTES = struct.calcsize(HEADER)
NO_ID = -(1 << 63)
ROUNDS = 6
#: Numbers of the domain for each shard.
SHARD_NUMBERS = 1 << 40
#: Bytes of text that a shard holds in the mean.
SHARD_BYTES = 24 << 20
#: Most tasks that write shards; more shards share tasks.
MOST_TASKS = 100_000
#: Rows of a manifest (24 bytes each) that are broadcast.
BROADCAST_SHARDS = 1_000_000
#: Fixed value: how the rank file's vocabulary splits text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = "shard int, row long, doc_id long, seq_no int, n_tokens int, ids_sha256 string"


def stride(length: int = LENGTH) -> int:
    return HEAD_BYTES + 2 * length + 1


class Permutation:
    """A keyed bijection of 0 .. domain - 1."""

    def __init__(self, key: str, domain: int):
        if not 0 < domain < 1 << 62:
            raise ValueError("the domain must have 1 to 2**62 - 1 numbers")
        self.domain = domain
        self.half = np.uint64(max(1, -(-(domain - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = hashlib.blake2b(key.encode("utf-8"), digest_size=8 * ROUNDS).digest()
        self.keys = np.frombuffer(digest, dtype="<u8")

    def _network(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed ^ mixed >> np.uint64(29)) & self.mask)
        return left << self.half | right

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers that leave the domain walk on along their cycle until they are back."""
        out = self._network(numbers.astype(np.uint64))
        away = np.flatnonzero(out >= self.domain)
        while len(away):
            out[away] = self._network(out[away])
            away = away[out[away] >= self.domain]
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Numbers:
    """Stable 64-bit names of a task's documents; equal documents of a task get different ones from the second on."""

    def __init__(self, task: int):
        self.task, self.seen = task, {}

    def __call__(self, doc_id: int | None, text: str) -> int:
        held = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=b"none" if doc_id is None else struct.pack("<q", doc_id))
        name = int.from_bytes(held.digest(), "little")
        nth = self.seen[name] = self.seen.get(name, -1) + 1
        if not nth:
            return name
        return int.from_bytes(hashlib.blake2b(struct.pack("<Qqq", name, self.task, nth), digest_size=8).digest(), "little")


def write_shards(
    docs: DataFrame, ranks: str, path: str, key: str = "order", length: int = LENGTH, doc_id: str = "doc_id", text: str = "text"
) -> int:
    """Write the shards under ``path``; returns how many ranges the domain was cut into.

    ``ranks`` is the path of a rank file (base64 token, rank); its content is broadcast.
    """
    spark = prepare(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text")
    rows, total = own.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    shards = max(1, max(total, rows * stride(length)) // SHARD_BYTES)
    permutation = Permutation(key, shards * SHARD_NUMBERS)
    with open(ranks, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.value.splitlines() if line)}
        if max(table.values()) >= 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        encode = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=table, special_tokens={}).encode_to_numpy
        number = Numbers(TaskContext.get().partitionId())
        for batch in batches:
            first, places, records = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(t, disallowed_special=()).astype("<u2")
                n, name = max(1, -(-len(ids) // length)), number(i, t)
                for s in range(n):
                    part = ids[s * length : (s + 1) * length].tobytes()
                    first.append(name)
                    places.append(s)
                    records.append(struct.pack(HEADER, NO_ID if i is None else i, s, len(part) // 2) + part.ljust(2 * length, b"\0"))
            names = _mixed(np.array(first, dtype=np.uint64) + np.array(places, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            slots = permutation(names % np.uint64(permutation.domain))
            for lo in range(0, len(records), 8192):
                part = slots[lo : lo + 8192]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part // np.uint64(SHARD_NUMBERS)).astype(np.int32)),
                        pa.array(part.astype(np.int64)),
                        pa.array(records[lo : lo + 8192], pa.binary()),
                    ],
                    names=["shard", "slot", "record"],
                )

    cut_rows = own.mapInArrow(cut, "shard int, slot long, record binary")
    # parallelism follows the data: twice as many partitions as shards, so that few hold more than one
    placed = cut_rows.repartition(min(2 * shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "slot", "record")
    placed.select("shard", F.col("record").cast("string").alias("record")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    return int(shards)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)  # the shard is in the folders' names
    return files if "shard" in files.columns else files.withColumn("shard", F.lit(0))


def manifest(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """(shard, records, first): the global position of each shard's first record, from file lengths alone."""
    sizes = _files(spark, path).select("shard", (F.col("length") / stride(length)).cast("long").alias("records"))
    sizes = sizes.withColumn("block", F.floor(F.col("shard") / 1024))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("block").agg(F.sum("records").alias("held"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for 1024 shards
    blocks = blocks.select("block", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"))
    within = sizes.withColumn("inside", F.coalesce(F.sum("records").over(inside), F.lit(0)))
    return within.join(blocks, "block").select("shard", "records", (F.col("before") + F.col("inside")).alias("first"))


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, start: int = 0, ids: bool = False) -> DataFrame:
    """Records from global position ``start`` on: position, shard, row, doc_id, seq_no, n_tokens, ids_sha256.

    ``ids`` adds token_ids (binary).  Shards that end before ``start`` are not read.
    """
    prepare(spark)
    wide = stride(length)
    firsts = manifest(spark, path, length)
    wanted = firsts.filter(F.col("first") + F.col("records") > start).select("shard", "first")
    if wanted.count() <= BROADCAST_SHARDS:
        wanted = F.broadcast(wanted)  # else the shards' contents would be shuffled to meet one number each

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = content.as_buffer()
                view = memoryview(data)
                begin = max(0, start - first)
                for lo in range(begin, len(view) // wide, 4096):
                    rows = range(lo, min(lo + 4096, len(view) // wide))
                    heads = [struct.unpack_from(HEADER, view, r * wide) for r in rows]
                    parts = [bytes(view[r * wide + HEAD_BYTES : r * wide + HEAD_BYTES + 2 * h[2]]) for r, h in zip(rows, heads)]
                    columns = [
                        pa.array([first + r for r in rows], pa.int64()),
                        pa.array([shard] * len(rows), pa.int32()),
                        pa.array(list(rows), pa.int64()),
                        pa.array([None if h[0] == NO_ID else h[0] for h in heads], pa.int64()),
                        pa.array([h[1] for h in heads], pa.int32()),
                        pa.array([h[2] for h in heads], pa.int32()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
                        *([pa.array(parts, pa.binary())] if ids else []),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "position long, " + RESULT + (", token_ids binary" if ids else "")
    names = [f.strip().split()[0] for f in schema.split(",")]
    found = _files(spark, path).select("shard", "content").join(wanted, "shard")
    return found.select("shard", "first", "content").mapInArrow(split, schema)
