"""Image files: ``.npy`` arrays whose file name carries the time."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaneworks.functions.pixels import lists, standardise_image
from vaneworks.schema import IMAGE_SCHEMA, SERIES, TIME

_NAME = r"([^/]+)$"
# The two forms of a file-name time, day only and day with time of day.
_FULL_NAME = r"^(\d{8}_\d{6})"
_DAY_TOKEN = r"^([^_.]+)"
_ISO_TOKEN = r"^\d{4}-\d{2}-\d{2}"


def file_time(path: Column, key_mode: str = "full") -> Column:
    """Time from a file name such as ``20240101_130000.npy``.

    ``full`` uses day and time of day when both are there, else the first token. ``first_token`` always uses the
    text before the first underscore, so the hourly files of one day share a key. NULL when nothing parses.
    """
    name = F.regexp_extract(path, _NAME, 1)
    token = F.regexp_extract(name, _DAY_TOKEN, 1)
    day = F.coalesce(
        F.try_to_timestamp(token, F.lit("yyyyMMdd")).cast("timestamp_ntz"),
        F.when(token.rlike(_ISO_TOKEN), token.try_cast("timestamp_ntz")),
    )
    if key_mode == "first_token":
        return day
    if key_mode != "full":
        raise ValueError(f"unknown key_mode {key_mode!r}")
    full = F.regexp_extract(name, _FULL_NAME, 1)
    return F.coalesce(F.try_to_timestamp(full, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz"), day)


def decode_one(content: bytes, rank: int, shape: tuple[int, ...] | None) -> tuple:
    """(shape, float32 values or None, error or None) of one file."""
    try:
        array = np.load(io.BytesIO(content), allow_pickle=False)
    except (ValueError, EOFError, OSError):
        return None, None, "undecodable"
    if array.ndim != rank:
        return array.shape, None, "wrong_rank"
    if shape is not None and array.shape != shape:
        return array.shape, None, "wrong_shape"
    if array.dtype.kind not in "fiub":
        return array.shape, None, "not_numeric"
    return array.shape, array.astype(np.float32, copy=False).ravel(), None


def decoded_structs(decoded: Sequence[tuple]) -> pa.StructArray:
    """The results of ``decode_one`` as an Arrow array of ``struct<shape, pixels, error>``."""
    shapes = pa.array([s and list(s) for s, _, _ in decoded], pa.list_(pa.int32()))
    known = np.array([p is not None for _, p, _ in decoded], dtype=bool)
    sizes = np.array([0 if p is None else len(p) for _, p, _ in decoded])
    values = [p for _, p, _ in decoded if p is not None]
    flat = np.concatenate(values) if values else np.empty(0, np.float32)
    errors = pa.array([e for _, _, e in decoded], pa.string())
    return pa.StructArray.from_arrays([shapes, lists(flat, known, sizes), errors], IMAGE_SCHEMA.names)


def decode_npy(rank: int = 3, shape: Sequence[int] | None = None):
    """Arrow UDF from file bytes to ``struct<shape, pixels, error>``; pixels are float32 in row-major order."""
    wanted = tuple(shape) if shape is not None else None

    @F.arrow_udf(IMAGE_SCHEMA)
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            decoded = [decode_one(c.as_py(), rank, wanted) for c in contents]
            yield decoded_structs(decoded)

    return decode


def standardise_images(images: DataFrame) -> DataFrame:
    """Standardised ``pixels``; a constant image loses its pixels and gets the reason ``constant_image``."""
    known = F.col("reject_reason") if "reject_reason" in images.columns else F.lit(None).cast("string")
    constant = F.col("pixels").isNotNull() & F.col("_standard").isNull()
    return (
        images.withColumn("_standard", standardise_image.asNondeterministic()("pixels"))
        .withColumn("reject_reason", F.coalesce(known, F.when(constant, F.lit("constant_image"))))
        .withColumn("pixels", F.col("_standard"))
        .drop("_standard")
    )


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """The ``.npy`` files directly in ``path``: the suffix is applied while listing, and no byte of a file is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.npy")
        .load(path)
        .select("path", "length", "modificationTime")
    )


def read_images(
    spark: SparkSession,
    path: str,
    rank: int = 3,
    shape: Sequence[int] | None = None,
    key_mode: str = "full",
    series: Column | None = None,
) -> DataFrame:
    """``(series_id, timestamp, path, shape, pixels, reject_reason)``, one row per file of ``path``.

    ``series`` derives the series from the other columns (for example from ``path``); by default all files belong to
    series 0. Files that do not decode, or whose name holds no time, come back with a reason and without pixels.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    # not deterministic for the optimizer: a later filter on the reason must not decode every file a second time
    image = decode_npy(rank, shape).asNondeterministic()(F.col("content"))
    return image_rows(files.select("path", image.alias("image")), key_mode, series)


def image_rows(decoded: DataFrame, key_mode: str = "full", series: Column | None = None) -> DataFrame:
    """``(path, image)`` with decoded images as the rows that ``read_images`` returns."""
    return decoded.withColumn(TIME, file_time(F.col("path"), key_mode)).select(
        (series if series is not None else F.lit(0)).cast("bigint").alias(SERIES),
        TIME,
        "path",
        "image.shape",
        "image.pixels",
        F.coalesce(F.col("image.error"), F.when(F.col(TIME).isNull(), F.lit("bad_timestamp"))).alias("reject_reason"),
    )
