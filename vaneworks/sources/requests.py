"""Scoring requests and responses as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaneworks.schema import FEATURES, JSON_CONTENT, SEQUENCE_REQUEST_SCHEMA, SNAPSHOT_REQUEST_SCHEMA

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _first_reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in checks])


def _parse(df: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """Adds ``_request``. The generator parses a text once; as a plain column the parser would be copied into every
    later condition on one of its fields."""
    return df.select("*", F.explode(F.array(F.from_json(body, schema, _OPTIONS))).alias("_request"))


def decode_snapshots(df: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Parse requests of one image and one snapshot: adds the features, ``image`` and ``reject_reason``.

    A request is rejected for its content type, for text that is not JSON of the expected types, or for a missing
    image or feature; the rest of the batch is not affected.
    """
    parsed = _parse(df, body, SNAPSHOT_REQUEST_SCHEMA)
    absent = [F.col(f"_request.weather_data.{name}").isNull() for name in FEATURES]
    any_absent = absent[0]
    for missing in absent[1:]:
        any_absent = any_absent | missing
    reason = _first_reason(
        (~F.col(content_type).eqNullSafe(JSON_CONTENT), "unsupported_content_type"),
        (F.col("_request").isNull() | F.col("_request._corrupt_record").isNotNull(), "malformed"),
        (F.col("_request.satellite_image").isNull(), "missing_image"),
        (any_absent, "missing_feature"),
    )
    return parsed.select(
        *df.columns,
        F.col("_request.satellite_image").alias("image"),
        *[F.col(f"_request.weather_data.{name}").alias(name) for name in FEATURES],
        reason.alias("reject_reason"),
    )


def decode_sequences(
    df: DataFrame, body: str = "body", content_type: str = "content_type", length: int | None = None
) -> DataFrame:
    """Parse requests of batched images and sequences: adds ``image``, ``sequence`` and ``reject_reason``.

    Every sequence needs steps of the right width without missing values, and ``length`` of them if it is given.
    """
    parsed = _parse(df, body, SEQUENCE_REQUEST_SCHEMA)
    width = F.lit(len(FEATURES))
    sequences = F.col("_request.sequence")
    steps = lambda test: F.exists(sequences, lambda s: F.exists(s, test))
    empty = (F.size(sequences) == 0) | F.exists(sequences, lambda s: s.isNull() | (F.size(s) == 0))
    ragged = steps(lambda step: step.isNull() | (F.size(step) != width))
    missing = steps(lambda step: F.exists(step, lambda x: x.isNull() | F.isnan(x)))
    other_length = F.exists(sequences, lambda s: F.size(s) != length) if length else F.lit(False)
    reason = _first_reason(
        (~F.col(content_type).eqNullSafe(JSON_CONTENT), "unsupported_content_type"),
        (F.col("_request").isNull() | F.col("_request._corrupt_record").isNotNull(), "malformed"),
        (F.col("_request.image").isNull(), "missing_image"),
        (F.col("_request.sequence").isNull(), "missing_sequence"),
        (empty, "empty_sequence"),
        (ragged, "wrong_width"),
        (missing, "missing_value"),
        (other_length, "wrong_length"),
    )
    return parsed.select(
        *df.columns,
        F.col("_request.image").alias("image"),
        F.col("_request.sequence").alias("sequence"),
        reason.alias("reject_reason"),
    )


def encode_responses(df: DataFrame, score: str = "p", accept: str | None = None) -> DataFrame:
    """Add ``response``: ``{"prediction": [[p]], "probability": p}``.

    With ``accept`` (a column holding the wanted content type) other types get no response but a ``reject_reason``.
    """
    p = F.col(score)
    text = F.to_json(F.struct(F.array(F.array(p)).alias("prediction"), p.alias("probability")))
    if accept is None:
        return df.withColumn("response", text)
    supported = F.col(accept).eqNullSafe(JSON_CONTENT)
    out = df.withColumn("response", F.when(supported, text))
    refused = F.when(~supported, F.lit("unsupported_content_type"))
    known = F.col("reject_reason") if "reject_reason" in df.columns else F.lit(None).cast("string")
    return out.withColumn("reject_reason", F.coalesce(known, refused))
