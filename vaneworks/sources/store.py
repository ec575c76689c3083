"""Image files packed into a store: listed by tasks, each file read once, later runs read what is new.

A folder of many small ``.npy`` files costs a request per file in every job that reads it, and Spark's own file source
keeps the status of every file in the driver. ``pack_images`` lists the folders below a path in tasks, level by level,
leaves out the files that an earlier run has consumed, and writes the decoded images of the others, in the order of their paths,
as parquet files of bounded size. The manifest of a run (path, length and modification time of every file that it consumed) is
written last: a run that broke off has none, its images are not read, and the next run does its work again.

A file that was changed (other length or time) is packed again, and only its newest state is read. A file that was deleted stays
in the store. Files that do not decode are rows with a reason. One run at a time may write to a store.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaneworks.operators.scale import materialise
from vaneworks.sources.images import decode_one, decoded_structs, image_rows

#: file bytes that one task packs, and pixel bytes that leave a task in one Arrow batch
PACK_BYTES = 512_000_000
BATCH_BYTES = 32_000_000
ROW_GROUP_BYTES = 64_000_000
_LISTED = 10_000
_FILE = "path string, length long, modified long"
_FILES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64())])


def _qualified(spark: SparkSession, path: str) -> str:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def list_files(spark: SparkSession, path: str, suffix: str = ".npy") -> DataFrame:
    """``(path, length, modified)`` of the files with ``suffix`` in ``path`` and the folders below it.

    One folder is listed by one task; the driver only learns whether a level has any folders. Names that begin with a dot or an
    underscore are passed over, as Spark does.
    """
    root = _qualified(spark, path)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                infos = store.get_file_info(fs.FileSelector(base + folder.removeprefix(root)))
                rows = [
                    (f"{folder}/{i.base_name}", i.type == fs.FileType.Directory, i.size, (i.mtime_ns or 0) // 1000)
                    for i in infos
                    if not i.base_name.startswith((".", "_"))
                ]
                rows = [r for r in rows if r[1] or r[0].endswith(suffix)]
                for k in range(0, len(rows), _LISTED):
                    columns = zip(*rows[k : k + _LISTED], strict=True)
                    types = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                        ["path", "is_folder", "length", "modified"],
                    )

    level, found = spark.createDataFrame([(root,)], "path string"), []
    while not level.isEmpty():
        listed = materialise(
            level.repartition("path").mapInArrow(listing, "path string, is_folder boolean, length long, modified long"),
            "listing",
        )
        found.append(listed.where(~F.col("is_folder")).select("path", "length", "modified"))
        level = listed.where("is_folder").select("path")
    return reduce(DataFrame.unionAll, found)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """``(path, length, modified, run)``: what the finished runs of a store have consumed."""
    try:
        return spark.read.schema(f"{_FILE}, run int").parquet(f"{store}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_FILE}, run int")


def _read_files(root: str, rank: int, shape: tuple[int, ...] | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        files: list[tuple] = []
        decoded: list[tuple] = []
        held = 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*files, strict=True), _FILES, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, decoded_structs(decoded)], [*_FILES.names, "image"])

        for batch in batches:
            for file in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    with store.open_input_stream(base + file[0].removeprefix(root)) as stream:
                        image = decode_one(stream.read(), rank, shape)
                except FileNotFoundError:
                    image = (None, None, "missing")
                files.append(file)
                decoded.append(image)
                held += 0 if image[1] is None else image[1].nbytes
                if held >= BATCH_BYTES or len(files) >= _LISTED:
                    yield rows()
                    files, decoded, held = [], [], 0
        if files:
            yield rows()

    return read


def pack_images(
    spark: SparkSession,
    path: str,
    store: str,
    rank: int = 3,
    shape: Sequence[int] | None = None,
    pack_bytes: int = PACK_BYTES,
) -> int:
    """Pack the files below ``path`` that no run has consumed in their present state; returns how many those are."""
    seen = manifest(spark, store)
    new = list_files(spark, path).join(seen, ["path", "length", "modified"], "left_anti")
    new = materialise(new.select("path", "length", "modified"), "new-files")
    files, size = new.agg(F.count(F.lit(1)), F.sum("length")).first()
    if not files:
        return 0
    run = (seen.agg(F.max("run")).first()[0] or 0) + 1
    parts = max(1, math.ceil(size / pack_bytes))
    read = _read_files(_qualified(spark, path), rank, tuple(shape) if shape is not None else None)
    image = "image struct<shape: array<int>, pixels: array<float>, error: string>"
    dealt = new.repartitionByRange(parts, "path").sortWithinPartitions("path")
    packed = dealt.mapInArrow(read, f"{_FILE}, {image}")
    packed.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{store}/images/run={run}")
    new.coalesce(parts).write.mode("overwrite").parquet(f"{store}/manifest/run={run}")
    return files


def read_store(
    spark: SparkSession, store: str, key_mode: str = "full", series: Column | None = None
) -> DataFrame:
    """The images of a store with the columns of ``read_images``: the newest state of every file, finished runs only."""
    told = manifest(spark, store)
    runs = [r["run"] for r in told.select("run").distinct().collect()]  # one row per run
    image = "image struct<shape: array<int>, pixels: array<float>, error: string>"
    if not runs:
        return image_rows(spark.createDataFrame([], f"path string, {image}"), key_mode, series)
    packed = spark.read.schema(f"{_FILE}, {image}, run int").parquet(f"{store}/images").where(F.col("run").isin(runs))
    states = told.groupBy(F.col("path").alias("_path")).agg(F.max("run").alias("_last"), F.count(F.lit(1)).alias("_n"))
    changed = states.where(F.col("_n") > 1)
    newest = packed.join(changed, (F.col("path") == F.col("_path")) & (F.col("run") < F.col("_last")), "left_anti")
    return image_rows(newest.select("path", "image"), key_mode, series)
