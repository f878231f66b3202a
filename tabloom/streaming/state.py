"""A table of the newest row per key, written by the batches of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that rows are split into by hash of their key, and batches after which changes are folded into the base.
BUCKETS = 16
EVERY = 10


class KeyedTable:
    """Newest row per key: a base, and the changes of at most EVERY + EVERY batches since, both in folders by bucket.

    A batch writes its own changes, so a repeated batch replaces itself, and reads only what earlier batches wrote. After every
    EVERY batches base and changes become a new base; the base before stays until the next one, for a batch that is
    repeated. So what a batch reads grows with the keys of the buckets that it asks for, and not with the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], bucket_by: str | None = None, buckets: int = BUCKETS, every: int = EVERY):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.bucket_by, self.buckets, self.every = bucket_by or keys[0], buckets, every

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")

    def _batches(self, kind: str) -> list[int]:
        """Numbers of the batches whose folder of this kind is complete."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(f"{self.path}/{kind}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        told = [s.getPath() for s in files.listStatus(root)]
        return sorted(int(p.getName().removeprefix("batch=")) for p in told if files.exists(hadoop(p, "_SUCCESS")))

    def _remove(self, kind: str, batch: int) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch={batch}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _folders(self, before: int | None) -> list[tuple[str, int]]:
        bases, changes = self._batches("base"), self._batches("change")
        if before is not None:
            bases, changes = [b for b in bases if b < before], [c for c in changes if c < before]
        base = bases[-1] if bases else -1
        return ([("base", base)] if bases else []) + [("change", c) for c in changes if c > base]

    def read(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Newest row per key, of batches before the given one; with `of` only the buckets that its rows fall into."""
        parts = None
        for kind, batch in self._folders(before):
            rows = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/{kind}/batch={batch}")
            told = rows.withColumn("_batch", F.lit(batch))
            parts = told if parts is None else parts.unionByName(told)
        if parts is None:
            return self.spark.createDataFrame([], self.schema)
        if of is not None:
            # at most one number per bucket
            asked = [r[0] for r in of.select(self._bucket().alias("b")).distinct().collect()]
            parts = parts.filter(F.col("_bucket").isin(asked))
        names = [c for c in parts.columns if c not in ("_bucket", "_batch")]
        newest = parts.groupBy(*self.keys).agg(F.max_by(F.struct(*names), "_batch").alias("_row"))
        return newest.select("_row.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Rows of a batch, one per key; they replace the rows of their keys."""
        self._store(rows, "change", batch)
        if batch % self.every != self.every - 1:
            return
        self._store(self.read(batch + 1), "base", batch)
        bases = self._batches("base")
        if len(bases) > 1:
            kept = bases[-2]
            for old in bases[:-2]:
                self._remove("base", old)
            for old in self._batches("change"):
                if old <= kept:
                    self._remove("change", old)

    def _store(self, rows: DataFrame, kind: str, batch: int) -> None:
        split = rows.withColumn("_bucket", self._bucket()).repartition("_bucket")
        split.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{kind}/batch={batch}")
