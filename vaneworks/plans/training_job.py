"""The end-to-end job: read, check, build windows, split, scale, fit, score, evaluate, write.

``python -m vaneworks.plans.training_job --observations obs.csv --images images/ --out out/`` runs it on files.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaneworks.functions.times import ntz
from vaneworks.operators import metrics, models, scaling, splits, windows
from vaneworks.operators.history import best_checkpoint
from vaneworks.operators.scale import release_scratch
from vaneworks.schema import ROW_ID, SERIES, TIME, PipelineConfig
from vaneworks.session import get_session
from vaneworks.sources import images as image_files
from vaneworks.sources import observations as observation_files
from vaneworks.sources import state, store

POOL = ("mean", "min", "max", "last")


def pooled_parameters(params: DataFrame) -> DataFrame:
    """Scaler parameters for the pooled columns: scaling is affine, so it may follow the pooling."""
    kinds = F.explode(F.array(*[F.lit(k) for k in POOL]))
    return params.withColumn("_kind", kinds).select(
        F.concat_ws("_", "_kind", "feature").alias("feature"), "mean", "scale", "n"
    )


def prepare(
    obs: DataFrame, images: DataFrame | None, config: PipelineConfig, image_shape: tuple[int, int, int] | None, out: str
) -> DataFrame:
    """Complete windows with pooled raw features, written to ``out/windows`` because four later steps read them."""
    cells = 0
    if images is not None and image_shape is not None:
        # pooled while the images are read: pixels never enter a shuffle
        images = windows.latest_images(windows.pool_images(images, *image_shape, grid=config.image_grid))
        cells = image_shape[0] * config.image_grid**2
    found = windows.labelled_windows(obs, images, config.sequence_length, pool=POOL, cells=cells)
    state.save_table(found, f"{out}/windows")
    return state.load_table(obs.sparkSession, f"{out}/windows")


def split_windows(found: DataFrame, config: PipelineConfig, by: str) -> DataFrame:
    if by == "time":
        return splits.head_split(found, ("window_start", ROW_ID), config.train_ratio, end="label_timestamp")
    if by == "random":
        return splits.random_split(found, (SERIES, ROW_ID), config.train_ratio, config.val_ratio, config.seed)
    raise ValueError(f"unknown split {by!r}")


def fit_window_scaler(obs: DataFrame, parted: DataFrame, config: PipelineConfig) -> DataFrame:
    """Scaler over all observations or over those a training window may look at."""
    if config.fit_on == "train":
        end = parted.where(F.col("split") == "train").agg(F.max("label_timestamp").alias("end")).first()["end"]
        if end is not None:
            obs = obs.where(F.col(TIME) <= ntz(end))
    elif config.fit_on != "all":
        raise ValueError(f"unknown fit_on {config.fit_on!r}")
    return scaling.fit_scaler(obs)


def evaluate(scored: DataFrame, config: PipelineConfig) -> DataFrame:
    """All metrics per split in one table; the batch means use ordered batches, as for validation."""
    by = ["split"]
    point = metrics.pointwise(scored, y="label", by=by, threshold=config.threshold)
    rank = metrics.rank_metrics(metrics.score_table(scored, y="label", by=by), by)
    bins = metrics.calibration_table(scored, y="label", bins=config.calibration_bins, by=by)
    return point.join(rank, by).join(metrics.expected_calibration_error(bins, by), by)


def run(
    spark: SparkSession,
    obs: DataFrame,
    images: DataFrame | None,
    out: str,
    config: PipelineConfig = PipelineConfig(),
    image_shape: tuple[int, int, int] | None = None,
    split: str = "time",
    trials: int = 0,
    family: str = "logistic",
) -> DataFrame:
    """Run the job and return the metrics per split. Everything it produces is a table or a model under ``out``.

    With ``trials`` the model's settings are searched on the job's own train and validation parts and the table of trials is
    kept. The model, with the best trial's settings or the configured ones, is fitted on the train part epoch by epoch until
    the stopping rule ends it; ``history`` has both losses of each epoch, ``best_epoch`` the rule's outcome, and the state
    of that epoch is the stored model.
    """
    obs, rejected = observation_files.split_rejected(observation_files.with_reject_reason(obs))
    state.save_table(rejected, f"{out}/rejected")
    if images is not None:
        images = image_files.standardise_images(images)
        images = images.where(F.col("reject_reason").isNull()).select(SERIES, TIME, "path", "pixels")

    parted = split_windows(prepare(obs, images, config, image_shape, out), config, split)
    state.save_table(fit_window_scaler(obs, parted, config), f"{out}/scaler")
    params = state.load_table(spark, f"{out}/scaler")
    names = windows.window_feature_columns(parted)
    scaled = scaling.apply_scaler(parted, pooled_parameters(params), names)

    setting = {"weight_decay": config.weight_decay} if family == "logistic" else {}
    if trials:
        _, tried = models.search(
            scaled, names, family=family, trials=trials, max_iter=config.max_iter, seed=config.seed,
            parallelism=config.search_parallelism, keep_one_in=config.search_keep_one_in,
        )
        state.save_table(tried, f"{out}/trials")
        winner = tried.where("is_best").first()
        setting = {name: winner[name] for name in models.USED[family]}
    model, history = models.fit_epochs(
        scaled, names, family=family, setting=setting, max_iter=config.max_iter, epoch_iterations=config.epoch_iterations,
        patience=config.patience, min_delta=config.min_delta, seed=config.seed,
    )
    state.save_model(model, config, f"{out}/model")
    state.save_table(history, f"{out}/history")
    kept = best_checkpoint(state.load_table(spark, f"{out}/history"), patience=config.patience, min_delta=config.min_delta)
    state.save_table(kept, f"{out}/best_epoch")

    scored = models.score(scaled, model, config.threshold)
    state.save_table(scored.select(SERIES, ROW_ID, "window_start", "split", "label", "p", "decision"), f"{out}/scores")
    scored = state.load_table(spark, f"{out}/scores")
    state.save_table(evaluate(scored, config), f"{out}/metrics")
    held_out = scored.where(F.col("split") == "val")
    batches = splits.ordered_batches(held_out, ("window_start", ROW_ID), config.batch_size)
    per_batch = metrics.batch_metrics(batches, y="label", threshold=config.threshold)
    state.save_table(metrics.mean_over_batches(per_batch), f"{out}/batch_means")
    state.save_table(splits.split_counts(scored), f"{out}/class_balance")
    return state.load_table(spark, f"{out}/metrics")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--observations", required=True)
    parser.add_argument("--format", default="csv", choices=("csv", "parquet"))
    parser.add_argument("--images", help="directory of .npy files; without it windows are not tested for images")
    parser.add_argument("--image-store", help="folder where the images are packed; a later run reads new files only")
    parser.add_argument("--image-shape", type=int, nargs=3, metavar=("C", "H", "W"))
    parser.add_argument("--series-pattern", help="regular expression whose first group of the image path is the series")
    parser.add_argument("--key-mode", default="full", choices=("full", "first_token"))
    parser.add_argument("--split", default="time", choices=("time", "random"))
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--search", type=int, nargs="?", const=-1, default=0, metavar="TRIALS", help="search the settings, in so many trials or as many as configured")
    parser.add_argument("--family", default="logistic", choices=tuple(models.USED))
    parser.add_argument("--out", required=True)
    args = parser.parse_args()

    spark = get_session("training-job")
    config = PipelineConfig.from_json(Path(args.config).read_text()) if args.config else PipelineConfig()
    obs = observation_files.read_observations(spark, args.observations, args.format)
    images = None
    if args.images:
        series = F.regexp_extract("path", args.series_pattern, 1) if args.series_pattern else None
        if args.image_store:
            store.pack_images(spark, args.images, args.image_store, 3, args.image_shape)
            images = store.read_store(spark, args.image_store, args.key_mode, series)
        else:
            images = image_files.read_images(spark, args.images, 3, args.image_shape, args.key_mode, series)
    shape = tuple(args.image_shape) if args.image_shape else None
    trials = config.search_trials if args.search < 0 else args.search
    run(spark, obs, images, args.out, config, shape, args.split, trials, args.family).show(truncate=False)
    release_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
