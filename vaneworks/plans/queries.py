"""One query per operator over the driver's tables, with column names that match ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from vaneworks.functions import pixels, vectors
from vaneworks.functions.times import wall_micros
from vaneworks.operators import history as hist
from vaneworks.operators import metrics, models, scaling, splits, windows
from vaneworks.operators.scale import materialise, release_table, scratch_path
from vaneworks.plans import fixtures, training_job
from vaneworks.schema import FEATURES, PipelineConfig
from vaneworks.sources import images as image_files
from vaneworks.sources import observations as observation_files
from vaneworks.sources import requests as request_json
from vaneworks.sources import state, store
from vaneworks.streaming import scoring
from vaneworks.streaming.images import settle_images
from vaneworks.streaming.windows import WindowStream, trailing_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LENGTH = 24
POOL = ("mean", "min", "max", "last")
#: requests with a sequence and an image that one file of their source holds
REQUESTS_PER_FILE = 50_000
#: weights used where a query scores without fitting first (also written out in the oracles)
WEIGHTS = {"intercept": -0.25, "mean_temperature": 0.75, "max_humidity": -0.5, "last_pressure": 0.125}
TRAILING_WEIGHTS = {"intercept": -1.0, "mean_temperature": 0.0625, "mean_humidity": -0.03125}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _r(column: Column | str, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6).alias(name or column)


def _micros(column: Column | str) -> Column:
    return wall_micros(F.col(column) if isinstance(column, str) else column)


def _complete(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return windows.labelled_windows(
        fixtures.observations(spark, sf_dir), fixtures.imagery(spark, sf_dir), LENGTH, **options
    )


# --- sources and sinks -----------------------------------------------------------------------------------------


@query("a1_read_csv")
def _(spark, sf):
    path = scratch_path(spark, "observations-csv")
    obs = fixtures.observations(spark, sf)
    writer = obs.select(*sorted(obs.columns), F.lit("x").alias("note")).write.option("header", True)
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    read = observation_files.read_observations(spark, path)
    good, _ = observation_files.split_rejected(observation_files.with_reject_reason(read))
    return good.select(
        "series_id", _micros("timestamp").alias("time_us"), "event_id", *[_r(f) for f in FEATURES], "storm_event"
    )


@query("a2_timestamp_coercion")
def _(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("at "), text)).otherwise(text)
    rows = fixtures.table(spark, sf, "events").select("event_id", text.alias("strict"), broken.alias("lenient"))
    rows = observation_files.coerce_timestamp(rows, "strict")
    rows = observation_files.coerce_timestamp(rows, "lenient", strict=False)
    return rows.select(
        "event_id",
        _micros("strict").alias("strict_us"),
        F.coalesce(_micros("lenient"), F.lit(-1)).alias("lenient_us"),
    )


@query("a3_read_images")
def _(spark, sf):
    folder = fixtures.write_image_files(spark, sf)
    images = image_files.read_images(spark, folder, rank=3, shape=fixtures.IMAGE_SHAPE)
    vec = F.regexp_extract("path", r"_v(\d+)\.npy$", 1).cast("bigint")
    return images.where(F.col("reject_reason").isNull()).select(
        vec.alias("vec_id"), _micros("timestamp").alias("time_us"), F.posexplode("pixels").alias("pos", "pixel")
    ).withColumn("pixel", F.round(F.col("pixel").cast("double"), 6))


@query("a3_packed_images")
def _(spark, sf):
    """Two deliveries, the second one in a folder below the first; a run after each."""
    folder, packed = scratch_path(spark, "images"), scratch_path(spark, "image-store")
    late = F.col("vec_id") % 3 == 0
    for place, which in ((folder, ~late), (f"{folder}/late", late)):
        fixtures.write_image_files(spark, sf, place, which)
        store.pack_images(spark, folder, packed, rank=3, shape=fixtures.IMAGE_SHAPE)
    images = store.read_store(spark, packed).where(F.col("reject_reason").isNull())
    vec = F.regexp_extract("path", r"_v(\d+)\.npy$", 1).cast("bigint")
    return images.join(store.manifest(spark, packed).select("path", "run"), "path").select(
        vec.alias("vec_id"), "run", _micros("timestamp").alias("time_us"), F.posexplode("pixels").alias("pos", "pixel")
    ).withColumn("pixel", F.round(F.col("pixel").cast("double"), 6))


@query("a4_file_time")
def _(spark, sf):
    day, clock = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss")
    stem = F.when(F.col("event_id") % 10 == 0, day).otherwise(F.concat_ws("_", day, clock))
    path = F.concat(F.lit("file:/data/images/"), stem, F.lit(".npy"))
    return fixtures.table(spark, sf, "events").select(
        "event_id",
        _micros(image_files.file_time(path)).alias("full_us"),
        _micros(image_files.file_time(path, "first_token")).alias("token_us"),
    )


@query("a5_decode_requests")
def _(spark, sf):
    decoded = request_json.decode_snapshots(fixtures.requests(spark, sf))
    good = F.col("reject_reason").isNull()
    shown = [F.round(F.when(good, F.col(f)).otherwise(-1.0), 6).alias(f) for f in FEATURES]
    pixel = F.col("image")[0][0][0].cast("double")
    return decoded.select(
        "request_id",
        F.coalesce("reject_reason", F.lit("ok")).alias("reason"),
        *shown,
        F.round(F.when(good, pixel).otherwise(-1.0), 3).alias("pixel"),
    )


@query("a5_decode_sequences")
def _(spark, sf):
    obs = fixtures.observations(spark, sf)
    vector = vectors.feature_vector()
    steps = F.array(vectors.repeat_snapshot(vector, 3))
    image = F.array(F.array(F.array(F.array(F.col("temperature").cast("float")))))
    body = F.to_json(F.struct(image.alias("image"), steps.alias("sequence")))
    rows = obs.withColumn("body", body).withColumn("content_type", F.lit("application/json"))
    decoded = request_json.decode_sequences(rows.select("event_id", "content_type", "body"))
    flat = F.flatten(F.flatten("sequence"))
    return decoded.where(F.col("reject_reason").isNull()).select(
        "event_id",
        F.size(F.flatten("sequence")).alias("steps"),
        F.round(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query("a6_encode_responses")
def _(spark, sf):
    text = request_json.encode_responses(fixtures.predictions(spark, sf))
    back = F.from_json("response", "prediction array<array<double>>, probability double")
    return text.withColumn("back", back).select(
        "event_id", _r(F.col("back.prediction")[0][0], "prediction"), _r("back.probability", "probability")
    )


@query("a7_scaler_state")
def _(spark, sf):
    path = scratch_path(spark, "scaler")
    state.save_table(scaling.fit_scaler(fixtures.observations(spark, sf)), path)
    return state.load_table(spark, path).select("feature", _r("mean"), _r("scale"), "n")


@query("a8_model_state")
def _(spark, sf):
    rows, names = _training_rows(spark, sf)
    path = scratch_path(spark, "model")
    fitted = models.fit_logistic(rows, names, max_iter=10)
    state.save_model(fitted, PipelineConfig(), path)
    loaded, config = state.load_model(spark, path)
    before = models.score(rows, fitted).select("series_id", "event_id", F.col("p").alias("p_before"))
    both = models.score(before.join(rows, ["series_id", "event_id"]), loaded, config.threshold)
    same = F.col("p_before").isNotNull() & F.col("p_before").eqNullSafe(F.col("p"))
    decided = F.col("decision") == (F.col("p") >= config.threshold)
    return both.select("series_id", "event_id", same.cast("int").alias("same"), decided.cast("int").alias("decided"))


@query("a9_quarantine")
def _(spark, sf):
    return observation_files.count_reasons(request_json.decode_snapshots(fixtures.requests(spark, sf)))


# --- projections and arrays ------------------------------------------------------------------------------------


@query("b1_feature_vector")
def _(spark, sf):
    return fixtures.observations(spark, sf).select(
        "event_id", F.posexplode(vectors.feature_vector()).alias("pos", "value")
    ).withColumn("value", F.round("value", 6))


@query("b2_present_columns")
def _(spark, sf):
    partial = fixtures.observations(spark, sf).drop("humidity", "visibility")
    scaled = scaling.apply_scaler(partial, scaling.fit_scaler(partial))
    return scaled.select("event_id", *[_r(f) for f in vectors.present(scaled)])


def _unfold(df: DataFrame, values: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(values).alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


@query("b3_image_standardise")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "embeddings")
    return _unfold(rows.select("vec_id", pixels.standardise_image("embedding").alias("v")), "v")


@query("b4_pixel_scale")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "embeddings")
    return _unfold(rows.select("vec_id", vectors.scale_pixels(F.col("embedding")).alias("v")), "v")


@query("b5_sequence_standardise")
def _(spark, sf):
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    rows = fixtures.table(spark, sf, "embeddings").select("vec_id", steps.alias("seq"))
    rows = rows.select("vec_id", F.flatten(vectors.standardise_sequence(F.col("seq"))).alias("v"))
    return _unfold(rows, "v")


@query("b6_snapshot_sequence")
def _(spark, sf):
    seq = vectors.repeat_snapshot(vectors.feature_vector(), LENGTH)
    return fixtures.observations(spark, sf).select("event_id", seq.alias("seq")).select(
        "event_id",
        F.size("seq").alias("steps"),
        F.size(F.element_at("seq", -1)).alias("width"),
        _r(F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x), "total"),
    )


@query("b7_threshold")
def _(spark, sf):
    p = F.col("p")
    return fixtures.predictions(spark, sf).select(
        "event_id",
        vectors.above(p, 0.5).cast("int").alias("scored"),
        vectors.above(p, 0.5, inclusive=False).cast("int").alias("evaluated"),
        _r(vectors.above(p, None), "unchanged"),
    )


@query("b8_label_cast")
def _(spark, sf):
    return fixtures.observations(spark, sf).select("event_id", vectors.label_value().alias("label"))


@query("b9_suffix_filter")
def _(spark, sf):
    listed = image_files.list_images(spark, fixtures.write_image_files(spark, sf))
    return listed.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


# --- joins -----------------------------------------------------------------------------------------------------


@query("c1_time_join")
def _(spark, sf):
    marked = windows.mark_images(fixtures.observations(spark, sf), fixtures.imagery(spark, sf))
    return marked.select("series_id", "event_id", F.col("has_image").cast("int").alias("has_image"))


@query("c2_latest_image")
def _(spark, sf):
    best = windows.latest_images(fixtures.imagery(spark, sf))
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return best.select("series_id", _micros("timestamp").alias("time_us"), "path", F.round(total, 5).alias("pixel_sum"))


@query("c3_apply_scaler")
def _(spark, sf):
    obs = fixtures.observations(spark, sf)
    return scaling.apply_scaler(obs, scaling.fit_scaler(obs)).select("event_id", *[_r(f) for f in FEATURES])


@query("c3_apply_series_scaler")
def _(spark, sf):
    obs = fixtures.observations(spark, sf)
    fitted = scaling.fit_scaler(obs, by=["series_id"])
    return scaling.apply_series_scaler(obs, fitted).select("series_id", "event_id", *[_r(f) for f in FEATURES])


@query("c4_window_images")
def _(spark, sf):
    best = windows.latest_images(fixtures.imagery(spark, sf))
    stacked = windows.labelled_windows(fixtures.observations(spark, sf), best, LENGTH, pool=(), pixels="pixels")
    total = F.aggregate("image", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stacked.select("series_id", "event_id", F.posexplode("images").alias("pos", "image")).select(
        "series_id", "event_id", "pos", F.round(total, 5).alias("pixel_sum")
    )


# --- aggregates ------------------------------------------------------------------------------------------------


@query("d1_fit_scaler")
def _(spark, sf):
    return scaling.fit_scaler(fixtures.observations(spark, sf)).select("feature", _r("mean"), _r("scale"), "n")


@query("d1_fit_series_scaler")
def _(spark, sf):
    fitted = scaling.fit_scaler(fixtures.observations(spark, sf), by=["series_id"])
    return fitted.select("series_id", "feature", _r("mean"), _r("scale"), "n")


@query("d2_accuracy")
def _(spark, sf):
    return fixtures.predictions(spark, sf).agg(_r(metrics.accuracy(), "accuracy"))


@query("d3_log_loss")
def _(spark, sf):
    return fixtures.predictions(spark, sf).agg(_r(metrics.log_loss(), "loss"))


@query("d4_roc_auc")
def _(spark, sf):
    return metrics.roc_auc(fixtures.predictions(spark, sf)).select(_r("auc"))


@query("d4_roc_auc_by_series")
def _(spark, sf):
    return metrics.roc_auc(fixtures.predictions(spark, sf), by=["user_id"]).select("user_id", _r("auc"))


def _batched(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.batch_metrics(splits.shuffled_batches(fixtures.predictions(spark, sf)))


@query("d5_batch_metrics")
def _(spark, sf):
    return _batched(spark, sf).select("batch_id", "n", _r("loss"), _r("accuracy"), _r("auc"))


@query("d5_mean_over_batches")
def _(spark, sf):
    mean = metrics.mean_over_batches(_batched(spark, sf))
    return mean.select("batches", *[_r(c) for c in ("loss", "accuracy", "auc", "row_loss", "row_accuracy")])


@query("d6_confusion")
def _(spark, sf):
    found = metrics.pointwise(fixtures.predictions(spark, sf))
    return found.select("tp", "fp", "fn", "tn", _r("precision"), _r("recall"), _r("f1"))


@query("d6_pointwise_by_series")
def _(spark, sf):
    found = metrics.pointwise(fixtures.predictions(spark, sf), by=["user_id"])
    return found.select(
        "user_id", "n", "tp", "fp", "fn", "tn",
        *[_r(c) for c in ("accuracy", "loss", "brier", "precision", "recall", "f1")],
    )


@query("d7_brier")
def _(spark, sf):
    return fixtures.predictions(spark, sf).agg(_r(metrics.brier(), "brier"))


@query("d8_calibration")
def _(spark, sf):
    table = metrics.calibration_table(fixtures.predictions(spark, sf))
    return table.select("bin", "n", _r("mean_p"), _r("observed_rate"))


@query("d8_calibration_error")
def _(spark, sf):
    table = metrics.calibration_table(fixtures.predictions(spark, sf))
    return metrics.expected_calibration_error(table).select(_r("ece"))


@query("d9_average_precision")
def _(spark, sf):
    return metrics.average_precision(fixtures.predictions(spark, sf)).select(_r("average_precision"))


@query("d9_precision_recall_curve")
def _(spark, sf):
    # scores from exp() may differ in the last digit between engines, so the curve is cut on the value they come from
    scored = fixtures.table(spark, sf, "events").select(
        (F.col("value") / 1000).alias("p"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y")
    )
    curve = metrics.precision_recall_curve(scored)
    return curve.select(_r("threshold"), "tp", "fp", _r("precision"), _r("recall"))


@query("d10_class_balance")
def _(spark, sf):
    rows = splits.random_split(fixtures.observations(spark, sf))
    return splits.split_counts(rows, label="storm_event")


# --- windows ---------------------------------------------------------------------------------------------------


@query("e1_series_position")
def _(spark, sf):
    return windows.series_position(fixtures.observations(spark, sf)).select("series_id", "event_id", "pos")


@query("e2_sliding_windows")
def _(spark, sf):
    found = windows.labelled_windows(fixtures.observations(spark, sf), None, LENGTH, pool=(), sequence=True)
    steps = found.select("series_id", "event_id", F.posexplode("seq").alias("step", "v"))
    return steps.select("series_id", "event_id", "step", *[_r(F.col("v")[i], f) for i, f in enumerate(FEATURES)])


@query("e3_complete_windows")
def _(spark, sf):
    return _complete(spark, sf, features=("temperature",)).select(
        "series_id", "event_id", _r("mean_temperature"), "label"
    )


@query("e4_next_label")
def _(spark, sf):
    found = windows.labelled_windows(fixtures.observations(spark, sf), None, LENGTH, pool=())
    return found.select("series_id", "event_id", _micros("label_timestamp").alias("label_us"), "label")


@query("e5_image_cells")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "embeddings")
    return _unfold(rows.select("vec_id", pixels.cell_means(*fixtures.IMAGE_SHAPE, grid=3)("embedding").alias("v")), "v")


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    # pooled while scanning: the shuffles that follow move four numbers per image instead of its pixels
    pooled = windows.latest_images(windows.pool_images(fixtures.imagery(spark, sf), *fixtures.IMAGE_SHAPE, grid=2))
    return windows.labelled_windows(fixtures.observations(spark, sf), pooled, LENGTH, pool=POOL, cells=4)


@query("e5_pool_and_fuse")
def _(spark, sf):
    fused = _fused(spark, sf)
    return fused.select("series_id", "event_id", "label", *[_r(c) for c in windows.window_feature_columns(fused)])


@query("e6_one_giant_series")
def _(spark, sf):
    obs = fixtures.observations(spark, sf)
    found = windows.labelled_windows(
        obs, None, LENGTH, features=("temperature", "humidity"), series=(), chunk_rows=2_000
    )
    return found.select("event_id", _r("mean_temperature"), _r("mean_humidity"), "label")


# --- splits and batches ----------------------------------------------------------------------------------------


@query("f1_random_split")
def _(spark, sf):
    return splits.random_split(fixtures.observations(spark, sf)).select("event_id", "split")


@query("f2_head_split")
def _(spark, sf):
    return splits.head_split(fixtures.observations(spark, sf)).select("event_id", "split")


@query("f2_series_head_split")
def _(spark, sf):
    rows = splits.series_head_split(fixtures.observations(spark, sf), gap=2)
    return rows.select("series_id", "event_id", "split")


@query("f2_window_gap_split")
def _(spark, sf):
    found = materialise(_complete(spark, sf, pool=()), "windows")  # the cut is searched in a few passes
    rows = splits.head_split(found, order=("window_start", "event_id"), end="label_timestamp")
    return rows.select("series_id", "event_id", "split")


@query("f3_shuffled_batches")
def _(spark, sf):
    return splits.shuffled_batches(fixtures.observations(spark, sf)).select("event_id", "batch_id")


@query("f3_ordered_batches")
def _(spark, sf):
    return splits.ordered_batches(fixtures.observations(spark, sf)).select("event_id", "batch_id")


@query("f4_samples_at")
def _(spark, sf):
    rows = fixtures.observations(spark, sf)
    return splits.samples_at(rows, [0, 7, 31, 500, 999, 10**9]).select("sample_idx", "event_id", _r("temperature"))


# --- models ----------------------------------------------------------------------------------------------------


#: a window is in the planted class above this mean temperature
PLANTED_ABOVE = 50.0


def _training_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Fused windows, written once because fitting, scoring and evaluating all read them."""
    fused = materialise(_fused(spark, sf), "fused-windows")
    return fused, windows.window_feature_columns(fused)


@query("g1_fit_logistic")
def _(spark, sf):
    rows, names = _training_rows(spark, sf)
    penalty = 1e-3
    fitted = models.fit_logistic(rows, names, weight_decay=penalty, max_iter=100)
    weights = models.linear_coefficients(fitted)
    linear = models.score_linear(rows, weights).select("series_id", "event_id", F.col("p").alias("p_linear"))
    both = models.score(rows, fitted).join(linear, ["series_id", "event_id"])
    flat = max(abs(g) for g in models.loss_gradient(rows, weights, weight_decay=penalty).values()) < 1e-3
    same = F.abs(F.col("p") - F.col("p_linear")) < 1e-9
    return both.select("series_id", "event_id", same.cast("int").alias("same"), F.lit(int(flat)).alias("flat"))


@query("g2_boosted_trees")
def _(spark, sf):
    rows, names = _training_rows(spark, sf)
    rows = rows.withColumn("label", (F.col("mean_temperature") > PLANTED_ABOVE).cast("int"))
    parts = splits.random_split(rows, ids=("series_id", "event_id"))
    fitted = models.fit_boosted_trees(parts.where(F.col("split") == "train"), names, max_iter=5)
    scored = models.score(parts, fitted)
    auc = metrics.roc_auc(scored, y="label", by=["split"]).select("split", (F.col("auc") > 0.9).cast("int").alias("learned"))
    return scored.groupBy("split", "label").agg(F.count("*").alias("n")).join(auc, "split")


@query("g3_batch_score")
def _(spark, sf):
    rows, names = _training_rows(spark, sf)
    fitted = models.fit_logistic(rows, names, max_iter=20)
    linear = models.score_linear(rows, models.linear_coefficients(fitted)).select("series_id", "event_id", F.col("p").alias("p_linear"))
    scored = models.score(rows, fitted, threshold=0.5).join(linear, ["series_id", "event_id"])
    same = F.abs(F.col("p") - F.col("p_linear")) < 1e-9
    decided = F.col("decision") == (F.col("p_linear") >= 0.5)
    return scored.select("series_id", "event_id", same.cast("int").alias("same"), decided.cast("int").alias("decided"))


@query("g3_linear_score")
def _(spark, sf):
    obs = fixtures.observations(spark, sf)
    scaled = scaling.apply_scaler(obs, scaling.fit_scaler(obs))
    found = windows.labelled_windows(
        scaled, fixtures.imagery(spark, sf), LENGTH, features=("temperature", "humidity", "pressure"), pool=POOL
    )
    scored = models.score_linear(found, WEIGHTS, threshold=0.5)
    return scored.select("series_id", "event_id", _r("p"), F.col("decision").cast("int").alias("decision"))


@query("g4_search")
def _(spark, sf):
    rows, names = _training_rows(spark, sf)
    rows = splits.head_split(rows, order=("window_start", "event_id"), end="label_timestamp")
    _, trials = models.search(rows, names, trials=8, max_iter=10)
    _, again = models.search(rows.repartition(5), names, trials=8, max_iter=10)
    lowest = F.min(F.struct("val_loss", "trial")).over(Window.partitionBy("family"))  # one row per trial
    chosen = F.col("is_best") == (lowest["trial"] == F.col("trial"))
    both = trials.withColumn("chosen", chosen).join(again.select("trial", F.col("val_loss").alias("_again")), "trial")
    repeated = F.abs(F.col("val_loss") - F.col("_again")) < 1e-6
    return both.select("trial", F.col("chosen").cast("int").alias("chosen"), repeated.cast("int").alias("repeated"))


@query("g4_halving_search")
def _(spark, sf):
    """20 trials, four at a time, of which half go on to twice the iterations, against the same trials one after the other."""
    rows, names = _training_rows(spark, sf)
    rows = splits.head_split(rows, order=("window_start", "event_id"), end="label_timestamp")
    _, trials = models.search(rows, names, trials=20, max_iter=8, parallelism=4, keep_one_in=2)
    _, serial = models.search(rows.repartition(5), names, trials=20, max_iter=8, parallelism=1)
    both = trials.join(serial.select("trial", F.col("val_loss").alias("_alone")), "trial")
    finished = F.col("iterations") == 8
    lowest = F.min(F.when(finished, F.struct("_alone", "trial"))).over(Window.partitionBy("family"))  # one row per trial
    return both.withColumn("_low", lowest["trial"]).select(
        "trial",
        (~finished | (F.abs(F.col("val_loss") - F.col("_alone")) < 1e-6)).cast("int").alias("same"),
        (F.col("is_best") == (F.col("_low") == F.col("trial"))).cast("int").alias("chosen"),
        F.sum(finished.cast("int")).over(Window.partitionBy("family")).cast("int").alias("finished"),
    )


@query("g5_stopped_fits")
def _(spark, sf):
    """Real fits of both families that the stopping rule ends: their histories, the rule over them, and the kept state."""
    rows, names = _training_rows(spark, sf)
    rows = materialise(splits.head_split(_planted(rows), order=("window_start", "event_id"), end="label_timestamp"), "planted-windows")
    out = []
    for family, setting, delta in (("logistic", {}, 0.01), ("trees", {"learning_rate": 0.05}, 0.002)):
        model, history = models.fit_epochs(rows, names, family=family, setting=setting, max_iter=30, epoch_iterations=2, patience=2, min_delta=delta)
        history = materialise(history, "fit-history")
        kept = hist.best_checkpoint(history, patience=2, min_delta=delta)
        held_out = models.score(rows.where(F.col("split") == "val"), model)
        loss = held_out.agg(metrics.log_loss("p", "label").alias("loss")).first()["loss"]
        first = history.where("epoch = 1").select("run", F.col("val_loss").alias("_first"))
        last = history.groupBy("run").agg(F.max("epoch").alias("_last"), F.min("train_loss").alias("_low"))
        stop = hist.early_stopping(history, patience=2, min_delta=delta).select("run", "stop_epoch")
        ended = (F.col("stop_epoch") == F.col("_last")) | (F.col("stop_epoch") == -1)
        found = kept.join(first, "run").join(last, "run").join(stop, "run")
        out.append(found.select(
            F.col("run").alias("family"),
            (F.abs(F.col("best_loss") - F.lit(loss)) < 1e-6).cast("int").alias("kept_state"),
            (F.col("best_loss") < F.col("_first")).cast("int").alias("learned"),
            ended.cast("int").alias("ended"),
        ))
    return out[0].unionByName(out[1])


@query("g5_early_stopping")
def _(spark, sf):
    return hist.early_stopping(fixtures.history(spark, sf)).select("run", "best_epoch", "stop_epoch")


@query("g6_best_checkpoint")
def _(spark, sf):
    best = hist.best_checkpoint(fixtures.history(spark, sf))
    return best.select(
        "run", "best_epoch", F.col("min_epoch").cast("bigint").alias("min_epoch"), _r("best_loss"), _r("min_loss")
    )


@query("g7_epoch_report")
def _(spark, sf):
    report = hist.epoch_report(fixtures.history(spark, sf))
    return report.select(
        "run", "epoch", _r("val_loss"), _r(F.coalesce("delta", F.lit(0.0)), "delta"), _r("best_so_far")
    )


@query("g8_train_and_evaluate")
def _(spark, sf):
    found = training_job.run(
        spark,
        fixtures.observations(spark, sf),
        fixtures.imagery(spark, sf),
        scratch_path(spark, "training-job"),
        PipelineConfig(max_iter=20),
        fixtures.IMAGE_SHAPE,
    )
    sound = F.col("auc").between(0, 1) & (F.col("loss") >= 0) & F.col("ece").between(0, 1)
    return found.select("split", "n", sound.cast("int").alias("sound"))


# --- streams ---------------------------------------------------------------------------------------------------


@query("h1_stream_scoring")
def _(spark, sf):
    obs = fixtures.observations(spark, sf)
    source, out, checkpoint = (scratch_path(spark, n) for n in ("requests", "responses", "responses-checkpoint"))
    fixtures.requests(spark, sf).repartition(4, "request_id").write.parquet(source)
    stream = scoring.read_requests(spark, "parquet", source, maxFilesPerTrigger="2")
    scoring.run_scoring(stream, out, checkpoint, scaling.fit_scaler(obs), WEIGHTS).awaitTermination()
    answered = spark.read.parquet(out)
    back = F.from_json("response", "prediction array<array<double>>, probability double")
    return answered.select(
        "request_id",
        F.coalesce("reject_reason", F.lit("ok")).alias("reason"),
        _r(F.coalesce("p", F.lit(-1.0)), "p"),
        _r(F.coalesce(back["probability"], F.lit(-1.0)), "probability"),
        F.coalesce(F.col("decision").cast("int"), F.lit(-1)).alias("decision"),
    )


@query("h1_sequence_scoring")
def _(spark, sf):
    v = vectors.feature_vector()
    growing = F.array(*[F.transform(v, _times(k)) for k in (1, 2, 3)])
    image = F.array(F.array(F.array(F.array(F.col("temperature").cast("float")))))
    rid = F.col("event_id")
    none = F.lit(None).cast("array<array<double>>")
    short = F.transform(growing, lambda step: F.slice(step, 1, 7))
    holes = F.transform(growing, lambda step: F.transform(step, lambda x, i: F.when(i != 2, x)))
    second = F.when(rid % 11 == 0, short).when(rid % 13 == 0, holes).when(rid % 17 == 0, F.slice(growing, 1, 0)).when(
        rid % 19 == 0, F.slice(growing, 1, 2)).when(rid % 23 == 0, none).otherwise(growing)
    both = F.when(rid % 29 == 0, F.array().cast("array<array<array<double>>>")).when(rid % 31 != 0, F.array(vectors.repeat_snapshot(v, 3), second))
    body = F.to_json(F.struct(image.alias("image"), both.alias("sequence")), {"ignoreNullFields": "true"})
    rows = fixtures.observations(spark, sf).select(
        F.col("event_id").alias("request_id"), F.lit("application/json").alias("content_type"), body.alias("body")
    )
    scaler = scaling.fit_scaler(fixtures.observations(spark, sf))
    answered = scoring.score_sequences(rows, scoring.raw_weights(WEIGHTS, scaler), length=3)
    back = F.from_json("response", "prediction array<array<double>>, probability double")
    return answered.withColumn("back", back).select(
        "request_id",
        F.coalesce("reject_reason", F.lit("ok")).alias("reason"),
        _r("p"),
        F.col("decision").cast("int").alias("decision"),
        _r(F.col("back.prediction")[0][0], "first"),
        _r(F.col("back.prediction")[1][0], "second"),
    )


def _planted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", (F.col("mean_temperature") > PLANTED_ABOVE).cast("int"))


def _requests_per_file(rows: int) -> int:
    """Requests that a file of ``rows`` in all holds at most: each is one task, so their number grows with the requests, from 4 on."""
    return max(1, min(REQUESTS_PER_FILE, -(-rows // 4)))


@query("h1_model_sequences")
def _(spark, sf):
    """Requests of one sequence and one image each, scored in their row by stored models of both families."""
    steps, shape = 6, fixtures.IMAGE_SHAPE
    obs = fixtures.observations(spark, sf)
    best = windows.latest_images(fixtures.imagery(spark, sf))
    found = windows.labelled_windows(obs, best, steps, pool=POOL, sequence=True)
    scaler = materialise(scaling.fit_scaler(obs), "scaler")
    first = best.select("series_id", F.col("timestamp").alias("window_start"), "pixels")
    rows = _planted(found.join(first, ["series_id", "window_start"]))
    cells = pixels.cell_means(*shape, grid=2)(pixels.standardise_image("pixels"))
    rows = rows.withColumn("_cells", cells).withColumns({f"mean_cell_{i}": F.get("_cells", F.lit(i)) for i in range(4)}).drop("_cells")
    names = windows.window_feature_columns(rows)
    # what the requests bring and what the models read lie in one table until each has its own
    rows = materialise(rows.select("series_id", "event_id", "label", *names, "seq", "pixels"), "sequence-windows", "zstd")
    scaled = scaling.apply_scaler(rows.drop("seq", "pixels"), training_job.pooled_parameters(scaler), [n for n in names if "cell" not in n])
    scaled = materialise(scaled, "scaled-windows", "zstd")

    image = F.transform(F.sequence(F.lit(0), F.lit(shape[1] - 1)), lambda r: F.slice("pixels", r * shape[2] + 1, shape[2]))
    body = F.to_json(F.struct(F.array(F.array(image)).alias("image"), F.array("seq").alias("sequence")))
    key = F.concat_ws(":", "series_id", "event_id")
    requests = rows.select(key.alias("request_id"), F.lit("application/json").alias("content_type"), body.alias("body"))
    source = scratch_path(spark, "sequence-requests")
    # written where the rows are: an exchange of the bodies takes as much disk as their files
    requests.write.options(compression="zstd", maxRecordsPerFile=str(_requests_per_file(rows.count()))).parquet(source)
    files = len(spark.read.schema(requests.schema).parquet(source).inputFiles())
    release_table(rows)
    out = []
    for family, fit in (("logistic", models.fit_logistic), ("trees", models.fit_boosted_trees)):
        state.save_model(fit(scaled, names, max_iter=10), PipelineConfig(), path := scratch_path(spark, "sequence-model"))
        model, config = state.load_model(spark, path)
        answers, checkpoint = (scratch_path(spark, n) for n in ("sequence-answers", "sequence-checkpoint"))
        # two micro-batches, however many files there are
        stream = scoring.read_requests(spark, "parquet", source, requests.schema, maxFilesPerTrigger=str(max(1, -(-files // 2))))
        scoring.run_scoring(stream, answers, checkpoint, scaler, model, sequences=True, length=steps, image_shape=shape, grid=2).awaitTermination()
        direct = models.score(scaled, model, config.threshold).select(key.alias("request_id"), "series_id", "event_id", F.col("p").alias("_p"), F.col("decision").alias("_d"))
        both = spark.read.parquet(answers).join(direct, "request_id")
        same = F.coalesce(F.abs(F.col("p") - F.col("_p")) < 1e-9, F.lit(False))
        out.append(both.select("series_id", "event_id", F.lit(family).alias("family"), same.cast("int").alias("same"), (F.col("decision") == F.col("_d")).cast("int").alias("decided")))
    return out[0].unionByName(out[1])


def _times(factor: int):
    return lambda x: x * factor


def _stream_windows(spark: SparkSession, sf: str, name: str, **options) -> WindowStream:
    """Four deliveries of rows, each followed by a run of the stream that resumes from its checkpoint."""
    obs = fixtures.observations(spark, sf)
    source = scratch_path(spark, f"{name}-source")
    online = WindowStream(scratch_path(spark, name), obs.schema, LENGTH, ("temperature", "humidity"), **options)
    for delivery in fixtures.time_slices(obs, "timestamp", 4, f"{name}-rows"):
        delivery.write.mode("append").parquet(source)
        online.start(spark.readStream.schema(obs.schema).parquet(source)).awaitTermination()
    return online


@query("h2_stream_windows")
def _(spark, sf):
    found = _stream_windows(spark, sf, "online-windows").windows(spark)
    return found.select("series_id", "event_id", _r("mean_temperature"), _r("mean_humidity"))


@query("h3_stream_window_scores")
def _(spark, sf):
    online = _stream_windows(
        spark, sf, "online-scores", transform=lambda w: models.score_linear(w, TRAILING_WEIGHTS, threshold=0.5)
    )
    return online.windows(spark).select(
        "series_id", "event_id", _r("p"), F.col("decision").cast("int").alias("decision")
    )


@query("h3_stream_model_scores")
def _(spark, sf):
    """Online windows scored by a stored tree ensemble, loaded by its path, against the batch scorer."""
    obs = fixtures.observations(spark, sf)
    features = ("temperature", "humidity")
    batch = materialise(_planted(trailing_windows(obs, LENGTH, features, pool=POOL)), "trailing-windows")
    names = windows.window_feature_columns(batch)
    fitted = models.fit_boosted_trees(batch, names, max_iter=5)
    state.save_model(fitted, PipelineConfig(), path := scratch_path(spark, "window-model"))
    online = _stream_windows(spark, sf, "online-model-scores", pool=POOL, transform=scoring.stored_scorer(spark, path))
    direct = models.score(batch, fitted, 0.5).select("series_id", "event_id", F.col("p").alias("_p"), F.col("decision").alias("_d"))
    both = online.windows(spark).join(direct, ["series_id", "event_id"])
    same = F.coalesce(F.abs(F.col("p") - F.col("_p")) < 1e-9, F.lit(False))
    return both.select("series_id", "event_id", _r("mean_temperature"), same.cast("int").alias("same"), (F.col("decision") == F.col("_d")).cast("int").alias("decided"))


@query("h3_stream_image_windows")
def _(spark, sf):
    """Complete labelled windows online: of the images a third arrive one delivery before their rows, a third with them, a third one after."""
    parts = 4
    obs = fixtures.observations(spark, sf)
    pics = fixtures.imagery(spark, sf).select("series_id", "timestamp", "path")
    rows = fixtures.time_slices(obs, "timestamp", parts, "settled-rows")
    upto = [part.agg(F.max("timestamp").alias("t")).first()["t"] for part in rows]
    slot = F.lit(0)
    for end in upto[:-1]:
        slot = slot + (F.col("timestamp") > F.lit(end)).cast("int")
    shift = F.pmod(F.xxhash64("path"), F.lit(3)).cast("int") - 1
    pics = materialise(pics.withColumn("_slot", F.greatest(F.lit(0), slot + shift)), "settled-images")
    span = max(b - a for a, b in zip([obs.agg(F.min("timestamp").alias("t")).first()["t"], *upto], upto))
    delay = f"{int(span.total_seconds()) * 2 + 60} seconds"

    sources = [scratch_path(spark, n) for n in ("settled-rows-source", "settled-images-source")]
    schema = obs.withColumn("has_image", F.lit(True)).schema
    online = WindowStream(
        scratch_path(spark, "online-image-windows"), schema, LENGTH, ("temperature",), images="has_image", label="storm_event"
    )
    settled = obs.select(*[c for c in online.columns if c in obs.columns])  # what the windows do not read stays out of the state
    # a last delivery of one row and one image of no series, late enough to settle all times before it
    end = F.lit(max(upto)).cast("timestamp_ntz") + F.expr(f"interval {delay}") * 3
    closing = spark.range(1).select(end.alias("timestamp"))
    for i in range(parts + 1):
        if i < parts:
            rows[i].write.mode("append").parquet(sources[0])
        else:
            closing.select(*[("timestamp" if f.name == "timestamp" else F.lit(None).cast(f.dataType).alias(f.name)) for f in obs.schema]).write.mode("append").parquet(sources[0])
        brought = pics.where(F.col("_slot") == i).drop("_slot")
        if i == parts:
            brought = brought.unionByName(closing.withColumns({"series_id": F.lit(None).cast("bigint"), "path": F.lit("-")}))
        brought.write.mode("append").parquet(sources[1])
        streams = [spark.readStream.schema(df.schema).parquet(path) for df, path in zip((settled, brought), sources)]
        online.start(settle_images(*streams, delay)).awaitTermination()
    return online.windows(spark).select("series_id", "event_id", _r("mean_temperature"), "label")
