"""The driver's tables seen as observations, images, scores, histories and requests."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaneworks.functions.times import wall_micros
from vaneworks.operators.scale import materialise, scratch_path
from vaneworks.operators.windows import series_position
from vaneworks.schema import FEATURES, JSON_CONTENT

IMAGE_SHAPE = (1, 8, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    is_type = lambda name: F.col("event_type") == name
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        F.col("ts").alias("timestamp"),
        "event_id",
        F.col("value").alias("temperature"),
        k.alias("humidity"),
        (F.lit(1e3) + F.day("ts")).alias("pressure"),
        (F.col("event_id") % 31).cast("double").alias("wind_speed"),
        (F.hour("ts") * 15.0).alias("wind_direction"),
        F.when(is_type("purchase"), F.col("value")).otherwise(0.0).alias("precipitation"),
        (F.minute("ts") / 60.0 * 100.0).alias("cloud_cover"),
        (F.second("ts") / 6.0).alias("visibility"),
        F.when(is_type("error"), 1).otherwise(0).alias("storm_event"),
    )


def imagery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation but each fiftieth has an image, each twentieth a second one under a greater path."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("pixels"))
    n = max(1, vectors.count())  # ids have no gaps: a remainder by their number reaches every vector

    def taken(rows: DataFrame, folder: str, shift: int) -> DataFrame:
        path = F.concat(F.lit(f"{folder}/"), F.col("event_id").cast("string"))
        return (
            rows.withColumn("_vec", (F.col("event_id") + shift) % n)
            .join(vectors, "_vec")
            .select(F.col("user_id").alias("series_id"), F.col("ts").alias("timestamp"), path.alias("path"), "pixels")
        )

    first = taken(events.where(F.col("event_id") % 50 != 0), "a", 0)
    return first.unionByName(taken(events.where(F.col("event_id") % 20 == 0), "b", 1))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("value") - 50) / 40))).alias("p"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a training run, its events in time as epochs."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    return series_position(events, ["run"], ["ts", "event_id"]).select(
        "run", (F.col("pos") + 1).cast("int").alias("epoch"), (F.col("value") / 100).alias("val_loss")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each observation as a JSON request; some are cut off, lack a part or come as another content type."""
    rid = F.col("event_id")
    weather = F.struct(
        *[F.when((rid % 13 == 0) & F.lit(name == "humidity"), None).otherwise(F.col(name)).alias(name) for name in FEATURES]
    )
    image = F.when(rid % 19 != 0, F.array(F.array(F.array(F.col("temperature").cast("float")))))
    body = F.to_json(F.struct(image.alias("satellite_image"), weather.alias("weather_data")))
    return (
        observations(spark, sf_dir)
        .withColumn("_body", body)
        .select(
            rid.alias("request_id"),
            F.when(rid % 23 == 0, "text/csv").otherwise(JSON_CONTENT).alias("content_type"),
            F.when(rid % 17 == 0, F.expr("left(_body, length(_body) - 2)")).otherwise(F.col("_body")).alias("body"),
        )
    )


def write_image_files(spark: SparkSession, sf_dir: str, folder: str | None = None, which: Column | None = None) -> str:
    """Each embedding as an ``.npy`` file in a new shared folder, named by a running hour; returns the folder.

    ``which`` says which of the vectors arrive now, and ``folder`` where, when they come in several deliveries.

    One file in ten has no time of day in its name, and each vector leaves a text file beside its image.
    """
    from pyarrow import fs

    folder = folder or scratch_path(spark, "images")
    shape = IMAGE_SHAPE

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        store.create_dir(base, recursive=True)
        for rows in batches:
            for name, values in zip(rows["name"], rows["embedding"]):
                buffer = io.BytesIO()
                np.save(buffer, np.asarray(values, dtype=np.float64).reshape(shape))
                with store.open_output_stream(f"{base}/{name}.npy") as out:
                    out.write(buffer.getvalue())
                with store.open_output_stream(f"{base}/{name}.txt") as out:
                    out.write(b"note")
            yield rows[["name"]]

    hour = F.timestamp_add("HOUR", F.col("vec_id").cast("int"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    stamp = F.when(F.col("vec_id") % 10 == 0, F.concat(F.date_format(hour, "yyyyMMdd"), F.lit("_v"), F.col("vec_id")))
    name = F.coalesce(stamp, F.concat(F.date_format(hour, "yyyyMMdd_HHmmss"), F.lit("_v"), F.col("vec_id").cast("string")))
    arriving = table(spark, sf_dir, "embeddings").where(which if which is not None else F.lit(True))
    named = arriving.select(name.alias("name"), "embedding")
    named.mapInPandas(write, "name string").count()
    return folder


def time_slices(df: DataFrame, time: str, parts: int, name: str) -> list[DataFrame]:
    """``df`` cut at time quantiles into ``parts`` tables, the earliest first."""
    rows = materialise(df.withColumn("_at", wall_micros(F.col(time))), name)
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("_at", shares, 10_000).alias("q")).first()["q"]
    at, pieces = F.col("_at"), []
    for i in range(parts):  # plain bounds, which the files' statistics can answer; rows without a time are in the first part
        low = at > cuts[i - 1] if i else F.lit(True)
        high = at <= cuts[i] if i < parts - 1 else F.lit(True)
        pieces.append(rows.where((low & high) | at.isNull() if i == 0 else low & high).drop("_at"))
    return pieces
