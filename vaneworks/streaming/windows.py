"""Sliding windows over a stream of observations.

The state of a series is its last rows, as many as a window that ends later can reach. They are kept in bucketed files (see
``held``): a micro-batch reads the buckets of the series it brings, builds the windows with the batch operators over (held
rows + new rows) and appends the last rows of those series. So a series with a third of the traffic is cut into chunks like
in batch, where a per-key state function would put it into one task; silent series cost nothing; and a batch that is run
again after a failure reads and writes the same things.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vaneworks.functions.times import ntz
from vaneworks.operators.scale import join_small, lay_out
from vaneworks.schema import FEATURES, ORDER, SERIES, TIME
from vaneworks.streaming.held import HeldRows

_POOL = {"mean": F.avg, "min": F.min, "max": F.max}


def trailing_windows(
    rows: DataFrame,
    length: int,
    features: Sequence[str] = FEATURES,
    series: Sequence[str] = (SERIES,),
    order: Sequence[str] = ORDER,
    only: str | None = None,
    pool: Sequence[str] = ("mean",),
    images: str | None = None,
    cells: int = 0,
    label: str | None = None,
    **layout_options,
) -> DataFrame:
    """Pooled windows of ``length`` rows that end at each row; ``only`` names a flag of the rows to report.

    With ``label`` a window ends before the row: that row's label is the target, and the window is named by its first
    row, like ``labelled_windows``. ``images`` names a flag that every row of the window must have, ``cells`` the number
    of values in the column ``cells`` to average as ``mean_cell_<i>``.
    """
    gap = 1 if label else 0
    laid = lay_out(rows, series, order, before=length - 1 + gap, **layout_options)
    w, frame = laid.window(), laid.frame(-(length - 1) - gap, -gap)
    counted = F.count(F.when(F.col(images), 1)) if images else F.count(F.lit(1))
    columns = [counted.over(frame).alias("_found")]
    for kind in pool:
        for name in features:
            value = F.lag(name, gap).over(w) if kind == "last" else _POOL[kind](name).over(frame)
            columns.append(value.alias(f"{kind}_{name}"))
    columns += [F.avg(F.get("cells", F.lit(i))).over(frame).alias(f"mean_cell_{i}") for i in range(cells)]
    if label:
        columns.append(F.lag(F.struct(*order), length).over(w).alias("_first"))
    found = laid.df.select("*", *columns).where(F.col("_found") == length)
    if only:
        found = found.where(F.col(only))
    pooled = [f"{kind}_{name}" for kind in pool for name in features] + [f"mean_cell_{i}" for i in range(cells)]
    found = laid.own_rows(found)
    if not label:
        return found.select(*series, *order, *pooled)
    named = [F.col(f"_first.{c}").alias("window_start" if c == TIME else c) for c in order]
    return found.select(*series, *named, *pooled, F.col(label).alias("label"), F.col(TIME).alias("label_timestamp"))


def last_rows(rows: DataFrame, n: int, series: Sequence[str] = (SERIES,), order: Sequence[str] = ORDER) -> DataFrame:
    """The last ``n`` rows of each series. The limit is applied before the shuffle too, so a giant series sends at
    most ``n`` rows per input partition."""
    last_first = Window.partitionBy(*series).orderBy(*[F.desc(c) for c in order])
    ranked = rows.withColumn("_rank", F.row_number().over(last_first))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


class WindowStream:
    """Online windows with a stored state under ``folder`` (shared by all executors).

    ``windows/`` holds the windows and ``late/`` the refused rows, both partitioned by micro-batch; ``state/`` the
    held rows. ``transform`` is applied to the windows before they are written, for example a model's scoring.
    ``idle_seconds`` frees the rows of series that are silent that long, measured against the newest row seen.
    ``pool``, ``images``, ``cells`` and ``label`` are those of ``trailing_windows``.
    """

    def __init__(
        self,
        folder: str,
        schema: T.StructType,
        length: int = 24,
        features: Sequence[str] = FEATURES,
        series: Sequence[str] = (SERIES,),
        order: Sequence[str] = ORDER,
        idle_seconds: int | None = None,
        transform: Callable[[DataFrame], DataFrame] | None = None,
        pool: Sequence[str] = ("mean",),
        images: str | None = None,
        cells: int = 0,
        label: str | None = None,
        buckets: int = 16,
        max_versions: int = 4,
        **layout_options,
    ):
        self.folder, self.length, self.features = folder.rstrip("/"), length, tuple(features)
        self.series, self.order = tuple(series), tuple(order)
        self.idle_seconds, self.transform, self.layout_options = idle_seconds, transform, layout_options
        self.window_options = {"pool": tuple(pool), "images": images, "cells": cells, "label": label}
        extra = [c for c in (images, "cells" if cells else None, label) if c]
        self.columns = list(dict.fromkeys([*self.series, *self.order, *self.features, *extra]))
        held = T.StructType([schema[c] for c in self.columns])
        self.held = HeldRows(f"{self.folder}/state", held, self.series, buckets, max_versions)
        self.reach = length if label else length - 1

    def _alive(self, rows: DataFrame, newest: str | None) -> DataFrame:
        """Without the rows of series that were silent for ``idle_seconds`` when ``newest`` was the latest time."""
        if self.idle_seconds is None or newest is None:
            return rows
        oldest = ntz(dt.datetime.fromisoformat(newest)) - F.expr(f"interval {int(self.idle_seconds)} seconds")
        heard = F.max(TIME).over(Window.partitionBy(*self.series))  # held rows: a few of each series
        return rows.withColumn("_heard", heard).where(F.col("_heard") >= oldest).drop("_heard")

    def held_rows(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """All rows held after ``batch_id``."""
        manifest = self.held.manifest(spark, batch_id)
        return self._alive(self.held.read(spark, manifest, sorted(manifest.live)), manifest.newest).select(*self.columns)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select(*self.columns).persist()
        before = self.held.manifest(spark, batch_id - 1)
        cached = [batch]

        def kept_once(df: DataFrame) -> DataFrame:
            """``df`` computed once for all steps that read it; the same columns without rows if the batch brought none."""
            if not brought:
                return df.limit(0)
            cached.append(df.persist())
            return df

        try:
            brought = [r[0] for r in batch.select(self.held.bucket().alias("b")).distinct().collect()]  # at most one row a bucket
            held = kept_once(self._alive(self.held.read(spark, before, brought), before.newest).select(*self.columns))
            key = F.struct(*self.order)
            newest = held.groupBy(*self.series).agg(F.max(key).alias("_newest"))
            on_time = F.col("_newest").isNull() | (key > F.col("_newest"))
            judged = join_small(batch, newest, self.series, "left").withColumn("_on_time", on_time).drop("_newest")
            judged = kept_once(judged)
            late = judged.where(~F.col("_on_time")).drop("_on_time")
            late.write.mode("overwrite").parquet(f"{self.folder}/late/batch_id={batch_id}")

            touched = judged.select(*self.series).distinct()
            mine, others = (join_small(held, touched, self.series, how) for how in ("left_semi", "left_anti"))
            fresh = judged.where("_on_time").drop("_on_time")
            rows = mine.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)))
            rows = kept_once(rows)
            windows = trailing_windows(
                rows, self.length, self.features, self.series, self.order, only="_new", **self.window_options, **self.layout_options
            )
            if self.transform is not None:
                windows = self.transform(windows)
            windows.write.mode("overwrite").parquet(f"{self.folder}/windows/batch_id={batch_id}")

            kept = last_rows(rows.drop("_new"), self.reach, self.series, self.order)
            rewritten = self.held.crowded(before, brought)
            if rewritten:
                kept = kept.unionByName(others.where(self.held.bucket().isin(rewritten)))
            seen = before.newest
            if self.idle_seconds is not None:
                now = fresh.agg(F.max(TIME).alias("now")).first()["now"]
                seen = max(filter(None, (seen, now and now.isoformat())), default=None)
            self.held.write(kept, before, batch_id, rewritten, seen)
        finally:
            for df in reversed(cached):
                df.unpersist()

    def start(self, observations: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = observations.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", f"{self.folder}/checkpoint"
        )
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def windows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/windows")

    def late_rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late")
