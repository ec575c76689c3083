"""Column names, schemas and job settings shared by every module."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import types as T

# The feature names and their order are part of the data contract.
FEATURES = (
    "temperature",
    "humidity",
    "pressure",
    "wind_speed",
    "wind_direction",
    "precipitation",
    "cloud_cover",
    "visibility",
)
LABEL = "storm_event"

SERIES = "series_id"
TIME = "timestamp"
ROW_ID = "event_id"
#: total order of the rows of one series; the row id breaks ties on time
ORDER = (TIME, ROW_ID)

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField(SERIES, T.LongType()),
        T.StructField(TIME, T.TimestampNTZType()),
        T.StructField(ROW_ID, T.LongType()),
        *[T.StructField(name, T.DoubleType()) for name in FEATURES],
        T.StructField(LABEL, T.IntegerType()),
    ]
)

IMAGE_SCHEMA = T.StructType(
    [
        T.StructField("shape", T.ArrayType(T.IntegerType())),
        T.StructField("pixels", T.ArrayType(T.FloatType())),
        T.StructField("error", T.StringType()),
    ]
)

#: request with one image and one snapshot of the features
SNAPSHOT_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("satellite_image", T.ArrayType(T.ArrayType(T.ArrayType(T.FloatType())))),
        T.StructField("weather_data", T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES])),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

#: request with batches of images (B,C,H,W) and of whole sequences (B,L,F)
SEQUENCE_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField(
            "image", T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.FloatType()))))
        ),
        T.StructField("sequence", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

JSON_CONTENT = "application/json"


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of the end-to-end job; the defaults are the published ones."""

    sequence_length: int = 24
    batch_size: int = 32
    train_ratio: float = 0.8
    val_ratio: float = 0.1
    threshold: float = 0.5
    calibration_bins: int = 10
    weight_decay: float = 1e-5
    max_iter: int = 100
    epoch_iterations: int = 5
    patience: int = 10
    min_delta: float = 0.001
    search_trials: int = 20
    search_parallelism: int = 4
    search_keep_one_in: int = 1
    image_grid: int = 2
    seed: int = 42
    fit_on: str = "train"

    @classmethod
    def from_dict(cls, values: dict) -> PipelineConfig:
        """Numbers may arrive as text (YAML reads ``1e-5`` as a string), so each is cast to its field's type."""
        known = {f.name: type(f.default) for f in fields(cls)}
        unknown = sorted(set(values) - set(known))
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**{name: known[name](value) for name, value in values.items()})

    @classmethod
    def from_json(cls, text: str) -> PipelineConfig:
        return cls.from_dict(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
