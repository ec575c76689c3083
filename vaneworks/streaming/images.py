"""Images that arrive beside the observations of a stream: before, with or after their row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaneworks.functions.times import wall_micros
from vaneworks.schema import SERIES, TIME


def settle_images(
    observations: DataFrame,
    images: DataFrame,
    delay: str,
    payload: Sequence[str] = (),
    series: Sequence[str] = (SERIES,),
) -> DataFrame:
    """The rows of a stream of observations with ``has_image`` and the ``payload`` of their image, each when its time is settled.

    Rows and images of one series and time meet in one keyed state of Spark. A time is settled once both streams have shown
    a time later by ``delay``; its rows then leave the state, in the same batch as all others of earlier or equal settled
    times, so that windows can be built on them in order. Of several images the one with the greatest ``path`` wins. A row or
    image that comes when its time is settled already is dropped by the watermark: the streaming progress counts it. Rows
    without a time cannot be settled and are not let in (see ``with_reject_reason``). A key holds the rows of one series at
    one time, so a busy series is spread over all tasks.
    """
    columns = observations.columns
    clash = sorted(set(columns) & {"has_image", *payload})
    if clash:
        raise ValueError(f"observations already have {clash}")

    def at(df: DataFrame) -> DataFrame:
        wall = F.timestamp_micros(wall_micros(F.col(TIME)))  # the wall clock as an instant: the same in every time zone
        return df.where(F.col(TIME).isNotNull()).withColumn("_at", wall).withWatermark("_at", delay)

    row, image = F.struct(*columns), F.struct("path", *payload)
    left = at(observations).select(*series, "_at", row.alias("_row"))
    right = at(images).select(*series, "_at", image.alias("_image"))
    both = left.unionByName(right, allowMissingColumns=True)
    met = both.groupBy(*series, "_at").agg(F.collect_list("_row").alias("_rows"), F.max("_image").alias("_image"))
    rows = met.select(F.explode("_rows").alias("_row"), "_image")
    return rows.select(
        *[F.col(f"_row.{c}").alias(c) for c in columns],
        F.col("_image").isNotNull().alias("has_image"),
        *[F.col(f"_image.{c}").alias(c) for c in payload],
    )
