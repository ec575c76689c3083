"""Stored state: fitted scalers as a table, models with their settings beside them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaneworks.schema import PipelineConfig


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel, config: PipelineConfig, path: str) -> None:
    """Weights under ``path/model``, settings as one JSON line under ``path/config``."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.range(1).select(F.lit(config.to_json()).alias("value")).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, PipelineConfig]:
    config = PipelineConfig.from_json(spark.read.text(f"{path}/config").first()["value"])
    return PipelineModel.load(f"{path}/model"), config
