"""Rows held between micro-batches: files by bucket of the series, changed only where a batch brings something.

A batch reads the buckets of its own series and appends, per bucket, the new rows of those series; the rows of other series
are not touched. Of a series the rows of its latest batch count. When a bucket has collected ``max_versions`` files, the next
batch that writes it puts all its live rows into one and lists that alone. A manifest per batch names the live files, so a
batch that runs again starts from the manifest before its own, reads the same rows and writes the same ones; files that two
manifests in a row do not name are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, VERSION = "held_bucket", "held_of"


@dataclass
class Manifest:
    """``live``: batches that hold rows of each bucket; ``retired``: (batch, bucket) of files that this batch left out; ``newest``: the latest time seen."""

    live: dict[int, list[int]] = field(default_factory=dict)
    retired: list[tuple[int, int]] = field(default_factory=list)
    newest: str | None = None

    def to_json(self) -> str:
        return json.dumps({"live": {str(b): v for b, v in self.live.items()}, "retired": self.retired, "newest": self.newest})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        read = json.loads(text)
        return cls({int(b): v for b, v in read["live"].items()}, [tuple(x) for x in read["retired"]], read["newest"])


class HeldRows:
    """The rows under ``folder``; ``buckets`` and ``max_versions`` bound the files that one batch lists."""

    def __init__(self, folder: str, schema: T.StructType, series: Sequence[str], buckets: int = 16, max_versions: int = 4):
        if buckets < 1 or max_versions < 1:
            raise ValueError("buckets and max_versions must be at least 1")
        self.folder, self.series, self.buckets, self.max_versions = folder.rstrip("/"), tuple(series), buckets, max_versions
        self._known: tuple[int, Manifest] | None = None
        self.schema = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(VERSION, T.LongType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.series), F.lit(self.buckets)).cast("int")

    def manifest(self, spark: SparkSession, batch_id: int) -> Manifest:
        """What was held after ``batch_id``; nothing before the first."""
        if batch_id < 0:
            return Manifest()
        if self._known and self._known[0] == batch_id:
            return self._known[1]
        return Manifest.from_json(spark.read.text(f"{self.folder}/manifest/batch_id={batch_id}").first()["value"])

    def read(self, spark: SparkSession, manifest: Manifest, buckets: Sequence[int]) -> DataFrame:
        """Live rows of some buckets: per series those of its latest batch. At most ``(length of the window) x max_versions`` rows of a series are looked at."""
        paths = [f"{self.folder}/rows/batch_id={v}/bucket={b}" for b in buckets for v in manifest.live.get(b, ())]
        if not paths:
            return spark.createDataFrame([], self.schema)
        latest = F.max(VERSION).over(Window.partitionBy(*self.series))
        rows = spark.read.schema(self.schema).parquet(*paths).withColumn("_latest", latest)
        return rows.where(F.col(VERSION) == F.col("_latest")).drop("_latest")

    def crowded(self, manifest: Manifest, buckets: Sequence[int]) -> list[int]:
        """The buckets that the next batch rewrites whole."""
        return [b for b in buckets if len(manifest.live.get(b, ())) >= self.max_versions]

    def write(self, rows: DataFrame, before: Manifest, batch_id: int, rewritten: Sequence[int], newest: str | None) -> Manifest:
        """Store the rows of the series that changed (and all of ``rewritten`` buckets) as those of ``batch_id``."""
        spark = rows.sparkSession
        out = f"{self.folder}/rows/batch_id={batch_id}"
        stamped = rows.withColumns({BUCKET: self.bucket(), VERSION: F.lit(batch_id).cast("bigint")}).select(*self.schema.names)
        stamped.withColumn("bucket", F.col(BUCKET)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        fs, path = self._at(spark, out)
        written = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if f.isDirectory() and f.getPath().getName().startswith("bucket="))
        live, retired = dict(before.live), []
        for b in rewritten:
            retired += [(v, b) for v in live.pop(b, [])]
        for b in written:
            live[b] = [*live.get(b, []), batch_id]
        after = Manifest(live, retired, newest)
        path = f"{self.folder}/manifest/batch_id={batch_id}"
        spark.range(1).select(F.lit(after.to_json()).alias("value")).coalesce(1).write.mode("overwrite").text(path)
        self._known = (batch_id, after)
        self._forget(spark, [f"rows/batch_id={v}/bucket={b}" for v, b in before.retired] + [f"manifest/batch_id={batch_id - 2}"])
        return after

    def _at(self, spark: SparkSession, name: str) -> tuple:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _forget(self, spark: SparkSession, names: Sequence[str]) -> None:
        for name in names:
            fs, path = self._at(spark, f"{self.folder}/{name}")
            fs.delete(path, True)
