"""Stateless scoring of request streams, with the column functions of the batch path."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vaneworks.functions.pixels import cell_means, stacked_cells, standardise_image
from vaneworks.operators.models import compiled_score, score, score_linear
from vaneworks.operators.scaling import apply_scaler
from vaneworks.schema import FEATURES
from vaneworks.sources.requests import decode_sequences, decode_snapshots, encode_responses
from vaneworks.sources.state import load_model

_KINDS = ("mean", "min", "max", "last")

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)


def read_requests(
    spark: SparkSession,
    fmt: str,
    path: str | None = None,
    schema: T.StructType = REQUEST_SCHEMA,
    streaming: bool = True,
    **options: str,
) -> DataFrame:
    """Requests from a file format (``path``) or from another source named by ``fmt`` with its own options."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if path is None:
        return reader.load()
    return reader.schema(schema).load(path)


def _pooled(sequence: Column, kind: str, place: int) -> Column:
    """Statistic over the steps of a sequence of the feature at ``place``."""
    steps = F.transform(sequence, lambda step: F.get(step, F.lit(place)))
    if kind == "mean":
        return F.try_divide(F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x), F.size(steps))
    return {"min": F.array_min, "max": F.array_max, "last": lambda x: F.try_element_at(x, F.lit(-1))}[kind](steps)


def snapshot_features(df: DataFrame, length: int, features: Sequence[str] = FEATURES) -> DataFrame:
    """A snapshot stands for a whole window of ``length`` equal steps, of which every statistic is the value itself."""
    if length < 1:
        raise ValueError("a window has at least one step")
    return df.withColumns({f"{kind}_{name}": F.col(name).cast("double") for name in features for kind in _KINDS})


def raw_weights(coefficients: dict[str, float], scaler: DataFrame) -> dict[str, float]:
    """Weights for unscaled pooled features that score like ``coefficients`` do on scaled ones."""
    fitted = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.select("feature", "mean", "scale").collect()}
    weights = {"intercept": float(coefficients.get("intercept", 0.0))}
    for name, weight in coefficients.items():
        if name != "intercept":
            mean, scale = fitted[name.split("_", 1)[1]]
            weights[name] = weight / scale
            weights["intercept"] -= weight * mean / scale
    return weights


def sequence_scores(sequences: Column, weights: dict[str, float], features: Sequence[str] = FEATURES) -> Column:
    """Probability of each sequence in an array of sequences, without leaving the row."""
    places = {name: i for i, name in enumerate(features)}
    unknown = sorted(n for n in weights if n != "intercept" and n.split("_", 1)[-1] not in places)
    if unknown:
        raise ValueError(f"no feature of a sequence for {unknown}; see score_sequences_with_model for images")

    def one(sequence: Column) -> Column:
        margin = F.lit(float(weights.get("intercept", 0.0)))
        for name, weight in weights.items():
            if name != "intercept":
                kind, feature = name.split("_", 1)
                margin = margin + F.lit(float(weight)) * _pooled(sequence, kind, places[feature])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    return F.transform(sequences, one)


def score_sequences(
    requests: DataFrame, weights: dict[str, float], threshold: float = 0.5, length: int | None = None
) -> DataFrame:
    """Score requests that bring whole sequences: one response per request, with one prediction per sequence.

    ``p`` and ``decision`` belong to the first sequence of the request. Rejected requests are not computed on.
    """
    decoded = decode_sequences(requests, length=length)
    accepted = F.col("reject_reason").isNull()
    scored = decoded.withColumn("predictions", sequence_scores(F.when(accepted, F.col("sequence")), weights))
    return _answer_sequences(scored, threshold)


def score_sequences_with_model(
    requests: DataFrame,
    scaler: DataFrame,
    model: PipelineModel,
    length: int | None = None,
    threshold: float = 0.5,
    image_shape: tuple[int, int, int] | None = None,
    grid: int = 1,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """As ``score_sequences`` with a fitted model of any family, with or without image cells.

    The model is written out as an expression over each sequence's pooled and scaled features and the cells of the image
    that comes with it, so a request is scored in its row. With a model that looks at images a request needs one image per
    sequence (``wrong_image_count``), each of ``image_shape`` and not constant (``wrong_image_size``).
    """
    decoded = decode_sequences(requests, length=length)
    names = model.stages[0].getInputCols()
    # one row per feature
    fitted = {r["feature"]: (float(r["mean"]), float(r["scale"])) for r in scaler.select("feature", "mean", "scale").collect()}
    places = {name: i for i, name in enumerate(features)}
    reason, cells = F.col("reject_reason"), F.lit(None)
    if any(name.startswith("mean_cell_") for name in names):
        if image_shape is None:
            raise ValueError("the model looks at images: give image_shape")
        counted = F.coalesce(reason, F.when(F.size("image") != F.size("sequence"), "wrong_image_count"))
        stacks = F.transform("image", lambda image: F.transform(F.flatten(F.flatten(image)), lambda x: x.cast("float")))
        decoded = decoded.withColumn("reject_reason", counted)
        decoded = decoded.withColumn("_cells", stacked_cells(*image_shape, grid)(F.when(reason.isNull(), stacks)))
        cells = F.col("_cells")
        unfit = F.exists(cells, lambda c: c.isNull())
        decoded = decoded.withColumn("reject_reason", F.coalesce(reason, F.when(unfit, "wrong_image_size")))

    def value(name: str, sequence: Column, i: Column) -> Column:
        if name.startswith("mean_cell_"):
            return F.get(F.get(cells, i), F.lit(int(name.removeprefix("mean_cell_"))))
        kind, feature = name.split("_", 1)
        mean, scale = fitted[feature]
        return (_pooled(sequence, kind, places[feature]) - F.lit(mean)) / F.lit(scale)

    accepted = reason.isNull()
    # the inputs of the model first, once per sequence: its expression reads them many times
    inputs = F.transform(F.when(accepted, F.col("sequence")), lambda s, i: F.array(*[value(name, s, i) for name in names]))
    numbers = {name: k for k, name in enumerate(names)}
    predictions = F.transform("_inputs", lambda v: compiled_score(model, lambda name: F.get(v, F.lit(numbers[name]))))
    scored = decoded.withColumn("_inputs", inputs).withColumn("predictions", predictions)
    return _answer_sequences(scored, threshold)


def _answer_sequences(scored: DataFrame, threshold: float) -> DataFrame:
    accepted = F.col("reject_reason").isNull()
    p = F.when(accepted, F.get("predictions", F.lit(0)))
    answer = F.struct(
        F.transform("predictions", lambda x: F.array(x)).alias("prediction"),
        F.get("predictions", F.lit(0)).alias("probability"),
    )
    return scored.select(
        "request_id",
        "reject_reason",
        p.alias("p"),
        (p >= threshold).alias("decision"),
        F.when(accepted, F.to_json(answer)).alias("response"),
    )


def score_snapshots(
    requests: DataFrame,
    scaler: DataFrame,
    coefficients: dict[str, float],
    length: int = 24,
    threshold: float = 0.5,
) -> DataFrame:
    """Decode, check, scale, pool, score and answer: one row per request, batch or stream.

    Rejected requests keep their reason and have neither score nor response.
    """
    decoded = decode_snapshots(requests)
    pooled = snapshot_features(apply_scaler(decoded, scaler), length)
    scored = score_linear(pooled, coefficients)
    accepted = F.col("reject_reason").isNull()
    scored = scored.withColumn("p", F.when(accepted, F.col("p"))).withColumn("decision", F.col("p") >= threshold)
    answered = encode_responses(scored)
    return answered.select(
        "request_id", "reject_reason", "p", "decision", F.when(accepted, F.col("response")).alias("response")
    )


def image_features(df: DataFrame, image: str, shape: tuple[int, int, int], grid: int) -> DataFrame:
    """``mean_cell_<i>`` of the request's image, standardised and pooled as images are for training; NULL for another size."""
    pixels = F.transform(F.flatten(F.flatten(image)), lambda x: x.cast("float"))
    pooled = df.withColumn("_cells", cell_means(*shape, grid)(standardise_image(pixels)))
    cells = {f"mean_cell_{i}": F.get("_cells", F.lit(i)) for i in range(shape[0] * grid * grid)}
    return pooled.withColumns(cells).drop("_cells")


def score_with_model(
    requests: DataFrame,
    scaler: DataFrame,
    model: PipelineModel,
    length: int = 24,
    threshold: float = 0.5,
    image_shape: tuple[int, int, int] | None = None,
    grid: int = 1,
) -> DataFrame:
    """As ``score_snapshots`` with a fitted model, of any family and with or without image cells (see ``load_model``).

    A request whose image does not have ``image_shape`` is rejected as ``wrong_image_size`` if the model looks at images.
    """
    decoded = decode_snapshots(requests)
    rows = snapshot_features(apply_scaler(decoded, scaler), length)
    reason = F.col("reject_reason")
    if any(name.startswith("mean_cell_") for name in model.stages[0].getInputCols()):
        if image_shape is None:
            raise ValueError("the model looks at images: give image_shape")
        rows = image_features(rows, "image", image_shape, grid)
        reason = F.coalesce(reason, F.when(F.col("mean_cell_0").isNull(), "wrong_image_size"))
    accepted = F.col("reject_reason").isNull()
    scored = score(rows.withColumn("reject_reason", reason), model)
    scored = scored.withColumn("p", F.when(accepted, F.col("p"))).withColumn("decision", F.col("p") >= threshold)
    return encode_responses(scored).select(
        "request_id", "reject_reason", "p", "decision", F.when(accepted, F.col("response")).alias("response")
    )


def stored_scorer(
    spark: SparkSession, path: str, scaler: DataFrame | None = None, threshold: float | None = None
) -> Callable[[DataFrame], DataFrame]:
    """A function that scores windows with the model stored at ``path`` (see ``state``), written out once; for ``WindowStream``.

    ``scaler`` holds the parameters of the features that the model was fitted on scaled; the windows' pooled columns are
    raw. The threshold is that of the stored settings unless given.
    """
    model, config = load_model(spark, path)
    fitted = {}
    if scaler is not None:
        fitted = {r["feature"]: (float(r["mean"]), float(r["scale"])) for r in scaler.select("feature", "mean", "scale").collect()}

    def value(name: str) -> Column:
        mean, scale = fitted.get(name.split("_", 1)[1], (0.0, 1.0))
        return (F.col(name) - F.lit(mean)) / F.lit(scale)

    p = compiled_score(model, value)
    limit = config.threshold if threshold is None else threshold
    return lambda windows: windows.withColumn("p", p).withColumn("decision", F.col("p") >= limit)


def run_scoring(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    scaler: DataFrame,
    model: PipelineModel | dict[str, float],
    sequences: bool = False,
    **options,
) -> StreamingQuery:
    """Score everything available now and append the answers to parquet; rerunning continues after the last batch.

    ``model`` is a stored model or the exported weights of one. With ``sequences`` the requests bring whole sequences, which
    a model scores.
    """
    if sequences:
        if isinstance(model, dict):
            raise ValueError("requests with sequences are streamed through a model; see score_sequences for weights")
        score_rows = score_sequences_with_model
    else:
        score_rows = score_snapshots if isinstance(model, dict) else score_with_model
    return (
        score_rows(requests, scaler, model, **options)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
