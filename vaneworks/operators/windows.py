"""Time join of observations and images, sliding windows, next-step labels, pooled window features.

A window is ``length`` consecutive rows of one series plus the row after them, whose label is the target. Frames
count rows, not hours: a gap in time does not break a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, DoubleType, LongType

from vaneworks.functions.pixels import cell_means
from vaneworks.operators.scale import CHUNK_ROWS, MAX_SERIES_ROWS, lay_out, running
from vaneworks.schema import FEATURES, LABEL, ORDER, SERIES, TIME

#: pixels that one task may hold as rows of its windows, before they are stacked
CHUNK_BYTES = 512 << 20
_POOL = {"mean": F.avg, "min": F.min, "max": F.max, "last": None}


def latest_images(images: DataFrame, key: Sequence[str] = (SERIES, TIME)) -> DataFrame:
    """One image per key; of several the greatest path wins. Copies of one key are reduced before the shuffle."""
    payload = [c for c in images.columns if c not in (*key, "path")]
    best = F.max_by(F.struct(*payload), "path").alias("_best") if payload else None
    picked = images.groupBy(*key).agg(F.max("path").alias("path"), *([best] if best is not None else []))
    return picked.select(*key, "path", *[F.col(f"_best.{c}").alias(c) for c in payload])


def mark_images(obs: DataFrame, images: DataFrame, key: Sequence[str] = (SERIES, TIME)) -> DataFrame:
    """Observations with ``has_image``: is there an image of exactly this series and time? Pixels are not read."""
    keys = images.select(*key).distinct().withColumn("has_image", F.lit(True))
    return obs.join(keys, list(key), "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))


def series_position(df: DataFrame, series: Sequence[str] = (SERIES,), order: Sequence[str] = ORDER, **options) -> DataFrame:
    """Adds ``pos``, the 0-based position of a row in its series."""
    counted = running(df, series, order, {"_n": ("sum", F.lit(1).cast("bigint"))}, **options)
    return counted.withColumn("pos", F.col("_n") - 1).drop("_n")


def pool_images(images: DataFrame, channels: int, height: int, width: int, grid: int, pixels: str = "pixels") -> DataFrame:
    """Replace the pixels of every image by its cell means, once per image and before any window sees them."""
    means = cell_means(channels, height, width, grid)(F.col(pixels))
    return images.withColumn("cells", means).drop(pixels)


def payload_layout(images: DataFrame, column: str, length: int, row_bytes: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> dict[str, int]:
    """Options of ``lay_out`` that keep the images of a chunk below ``chunk_bytes``, the rows copied across its cut included.

    ``row_bytes`` is the size of the largest image; without it one aggregate over the column finds it. A window has
    ``length`` rows, so a chunk holds twice as many at least.
    """
    if row_bytes is None:
        kind = images.schema[column].dataType
        if isinstance(kind, ArrayType):
            measured = F.size(column) * (8 if isinstance(kind.elementType, (DoubleType, LongType)) else 4)
        else:
            measured = F.octet_length(column)
        row_bytes = images.agg(F.max(measured)).first()[0]
    rows = max(chunk_bytes // max(row_bytes or 1, 1) - length, length)
    return {"max_series_rows": min(MAX_SERIES_ROWS, rows + length), "chunk_rows": min(CHUNK_ROWS, rows)}


def with_payload(rows: DataFrame, side: DataFrame, series: Sequence[str], last: str) -> DataFrame:
    """Observations with the columns of the image row of their series and time, dealt by series alone.

    Both kinds of rows are dealt and sorted together, so the frames over the series that follow need neither a second
    exchange nor a second sort of the observations. ``last`` is the column that orders rows of one time. Image rows
    without a series or time meet nothing, as in a join.
    """
    key = [*series, TIME]
    names = [c for c in side.columns if c not in key]
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    both = rows.withColumn("_obs", F.lit(True)).unionByName(
        side.where(known).withColumn("_obs", F.lit(False)), allowMissingColumns=True
    )
    same = Window.partitionBy(*key).orderBy(last).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = both.repartition(*series).select(
        *rows.columns, "_obs", *[F.first(c, ignorenulls=True).over(same).alias(c) for c in names]
    )
    return met.where("_obs").drop("_obs")


def labelled_windows(
    obs: DataFrame,
    images: DataFrame | None,
    length: int = 24,
    features: Sequence[str] = FEATURES,
    pool: Sequence[str] = ("mean",),
    sequence: bool = False,
    pixels: str | None = None,
    cells: int = 0,
    series: Sequence[str] = (SERIES,),
    order: Sequence[str] = ORDER,
    label: str = LABEL,
    pixel_bytes: int | None = None,
    **layout_options,
) -> DataFrame:
    """Complete labelled windows, one row each, named by their first row.

    obs, images
        Observations and images; ``None`` for images skips the completeness test. ``images`` needs one row per
        series and time when ``pixels`` or ``cells`` is used (``latest_images``).
    pool
        Frame statistics per feature (``mean``, ``min``, ``max``, ``last``), as columns such as ``mean_humidity``.
    sequence
        Adds ``seq``, the features of every step (array of ``length`` arrays).
    pixels
        Name of an image column to stack over the window as ``images``. Each image moves once per shuffle and is
        repeated only inside the task that builds the window. Series are cut by the bytes of their images.
    pixel_bytes
        Size of the largest image, if known; otherwise ``pixels`` are measured first.
    cells
        Number of values in the image column ``cells`` (see ``pool_images``) to average over the window as
        ``mean_cell_<i>``.
    """
    key = (*series, TIME)
    payload = [c for c in (pixels, "cells" if cells else None) if c]
    if pixels:
        layout_options = payload_layout(images, pixels, length, pixel_bytes) | layout_options
    laid = lay_out(
        obs.select(*dict.fromkeys([*series, *order, *features, label])),
        series, order, after=length, **layout_options,
    )
    rows = laid.df
    if images is not None:
        side = images.select(*key, *payload) if payload else images.select(*key).distinct()
        side = side.withColumn("_image", F.lit(1))
        # one exchange needs the uncut series as its key, key columns of one type, and no name used twice
        plain = not laid.chunked and series and tuple(order[:1]) == (TIME,) and len(order) == 2
        alike = all(rows.schema[c].dataType == side.schema[c].dataType for c in key)
        if plain and alike and not set(payload) & set(rows.columns):
            rows = with_payload(rows, side, series, order[1])
        else:
            rows = rows.join(side, list(key), "left")

    w, frame = laid.window(), laid.frame(0, length - 1)
    found = F.count("_image" if images is not None else F.lit(1)).over(frame)
    after = F.lead(F.struct(F.col(label).alias("label"), F.col(TIME).alias("time")), length).over(w)
    columns: list[Column] = []
    for kind in pool:
        for name in features:
            value = F.lead(name, length - 1).over(w) if kind == "last" else _POOL[kind](name).over(frame)
            columns.append(value.alias(f"{kind}_{name}"))
    if sequence:
        columns.append(F.collect_list(F.array(*features)).over(frame).alias("seq"))
    if pixels:
        columns.append(F.collect_list(pixels).over(frame).alias("images"))
    columns += [F.avg(F.get("cells", F.lit(i))).over(frame).alias(f"mean_cell_{i}") for i in range(cells)]

    names = [c for c in (pixels, "cells" if cells else None, *features, label) if c]
    windows = rows.select("*", found.alias("_found"), after.alias("_after"), *columns).where(
        (F.col("_found") == length) & F.col("_after").isNotNull()
    )
    return (
        laid.own_rows(windows)
        .withColumns({"label": F.col("_after.label"), "label_timestamp": F.col("_after.time")})
        .drop("_image", "_found", "_after", *names)
        .withColumnRenamed(TIME, "window_start")
    )


def window_feature_columns(windows: DataFrame) -> list[str]:
    """The pooled columns of ``labelled_windows``, in their order."""
    prefixes = tuple(f"{kind}_" for kind in _POOL)
    return [c for c in windows.columns if c.startswith(prefixes)]
