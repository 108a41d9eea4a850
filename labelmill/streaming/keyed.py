"""A stored table with one row per key, upserted by batches that rewrite only the folders they touch.

Rows lie in folders by a hash of their key, ``data/bucket=b/batch_id=n``.  A
batch reads the current folders of the buckets that its keys fall into, folds
them with its own rows and writes those buckets anew under its own number;
every other folder stays as it is.  ``manifest/batch_id=n`` then names the
current folder of every bucket: it is written last and readers follow the
greatest one, so they never see half a batch.  A batch that is repeated after a
failure starts from the manifest before its own number and replaces its own
folders, so it changes nothing.  Folders that the last two manifests do not
name are deleted, the one before the last being kept for running readers.

The driver holds bucket numbers only (``buckets`` of them).  Choose so many
that a bucket is some hundred megabytes; a bucket that grows beyond is written
as several files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelmill.operators.ordered import last_per_key
from labelmill.session import delete

BUCKETS = 256
_BUCKET, _BATCH, _NEW = "bucket", "batch_id", "_from_batch"


class KeyedTable:
    """The table under ``path``: rows of ``schema``, the last one per key under ``order`` (of equal ones the later batch's)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS):
        if {_BUCKET, _BATCH, _NEW} & {c.lower() for c in schema.names}:
            raise ValueError(f"a keyed table has no columns named {_BUCKET}, {_BATCH} or {_NEW}")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.buckets = list(keys), list(order), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def manifests(self, before: int | None = None) -> list[int]:
        """Numbers of the complete batches, ascending."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root)]
        done = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{_BATCH}=") and self._exists(f"{self.path}/manifest/{n}/_SUCCESS"))
        return [n for n in done if before is None or n < before]

    def folders(self, batch_id: int | None) -> dict[int, int]:
        """The batch whose folder is current, for every bucket that has rows, as of a batch."""
        if batch_id is None:
            return {}
        rows = self.spark.read.schema(f"{_BUCKET} int, written int").parquet(f"{self.path}/manifest/{_BATCH}={batch_id}").collect()
        return {r[0]: r[1] for r in rows}

    def _folder(self, bucket: int, batch_id: int) -> str:
        return f"{self.path}/data/{_BUCKET}={bucket}/{_BATCH}={batch_id}"

    def _rows(self, folders: dict[int, int]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(b, n) for b, n in sorted(folders.items())])

    def read(self) -> DataFrame:
        """The current row of every key."""
        return self._rows(self.folders(max(self.manifests(), default=None)))

    def lookup(self, *values) -> DataFrame:
        """The row of one key: its bucket's folder alone is read."""
        typed = [F.lit(v).cast(self.schema[k].dataType) for k, v in zip(self.keys, values)]
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*typed), F.lit(self.buckets)).cast("int")).first()[0]
        current = self.folders(max(self.manifests(), default=None))
        rows = self._rows({bucket: current[bucket]} if bucket in current else {})
        for k, v in zip(self.keys, typed):
            rows = rows.filter(F.col(k).eqNullSafe(v))
        return rows

    def upsert(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Fold a batch into the table; returns the buckets that were written."""
        done = self.manifests(before=batch_id)
        current = self.folders(done[-1] if done else None)
        rows = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        fresh = last_per_key(rows.withColumn(_BUCKET, self._bucket()), self.keys, self.order)
        touched = sorted(r[0] for r in rows.select(self._bucket().alias(_BUCKET)).distinct().collect())
        old = self._rows({b: current[b] for b in touched if b in current}).withColumn(_BUCKET, self._bucket())
        both = old.withColumn(_NEW, F.lit(0)).unionByName(fresh.withColumn(_NEW, F.lit(1)))
        folded = last_per_key(both, self.keys, [*self.order, _NEW]).drop(_NEW).withColumn(_BATCH, F.lit(batch_id))
        if touched:
            placed = folded.hint("rebalance", _BUCKET)
            write = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            write.partitionBy(_BUCKET, _BATCH).parquet(f"{self.path}/data")
        named = {**current, **dict.fromkeys(touched, batch_id)}
        manifest = self.spark.createDataFrame(sorted(named.items()), f"{_BUCKET} int, written int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{_BATCH}={batch_id}")
        if done:
            self._drop_old(done[:-1], current)
        return touched

    def _drop_old(self, older: list[int], current: dict[int, int]) -> None:
        """Delete what the manifest before the last one does not name any more, and the manifests before it."""
        if older:
            before = self.folders(older[-1])
            delete(self.spark, *[self._folder(b, n) for b, n in before.items() if current.get(b) != n])
            delete(self.spark, *[f"{self.path}/manifest/{_BATCH}={n}" for n in older])
