"""Stopping rule, best epoch and reports over the metric history of many training runs at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaneworks.operators.scale import join_small, lay_out, running_in


def _comparable(loss: str) -> Column:
    """The loss with missing ones above all others."""
    value = F.col(loss).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(float("inf"))).otherwise(value)


def early_stopping(
    history: DataFrame,
    run: Sequence[str] = ("run",),
    epoch: str = "epoch",
    loss: str = "val_loss",
    patience: int = 10,
    min_delta: float = 0.001,
    **layout_options,
) -> DataFrame:
    """Per run: ``best_epoch``, ``best_loss`` and ``stop_epoch`` (-1 when the run was not stopped).

    An epoch improves when its loss is below the best so far by more than ``min_delta``; ``patience`` epochs in a row
    without improvement stop the run. Whether an epoch improves depends on the improvements before it, so the rule
    needs a fold - but only over record losses: a loss that is not below every earlier one cannot improve. The
    records are found with running minima; they alone are sorted by run and folded as they stream by, so a run of any length
    needs the memory of one record. A NULL or NaN loss is no improvement.
    """
    if min_delta < 0 or patience < 1:
        raise ValueError("min_delta must not be negative and patience must be at least 1")
    keyed = history.select(*run, F.col(epoch).cast("bigint").alias("_epoch"), _comparable(loss).alias("_loss"))
    # the epoch at which the run stops if this one turns out to be its last improvement
    laid = lay_out(keyed, run, ["_epoch"], after=patience, **layout_options)
    laid = replace(laid, df=laid.df.withColumn("_stop", F.lead("_epoch", patience).over(laid.window())))
    laid = running_in(
        laid, {"_pos": ("sum", F.lit(1).cast("bigint")), "_low": ("min", F.struct("_loss", "_epoch"))}
    )
    ranked = laid.own_rows(laid.df)
    # the running minimum of (loss, epoch) sits at the row itself exactly when its loss is a new record
    record = (F.col("_low._epoch") == F.col("_epoch")) & (F.col("_loss") < float("inf"))
    per_run = ranked.groupBy(*run).agg(F.min(F.when(F.col("_pos") == patience, F.col("_epoch"))).alias("_stop_without_best"))
    improved = _last_improvements(ranked.where(record), run, patience, float(min_delta))
    met = join_small(per_run, improved, run, "left")
    never = F.col("_best_epoch").isNull()
    return met.select(
        *run,
        F.coalesce("_best_epoch", F.lit(-1).cast("bigint")).alias("best_epoch"),
        F.col("_best").alias("best_loss"),
        F.coalesce(F.when(never, F.col("_stop_without_best")).otherwise(F.col("_stop_at")), F.lit(-1).cast("bigint")).alias("stop_epoch"),
    )


def _last_improvements(records: DataFrame, run: Sequence[str], patience: int, min_delta: float) -> DataFrame:
    """Per run the last improvement before the stop: _best, _best_epoch and _stop_at, the epoch ``patience`` later."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best, found, at, stop, stopped = None, math.inf, None, 0, None, False

        def row(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([current], kind), pa.array([best], pa.float64()), pa.array([found], pa.int64()), pa.array([stop], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["_run", "_best", "_best_epoch", "_stop_at"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("_run").type
            for key, pos, epoch, loss, later in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != current:
                    if found is not None:
                        yield row(kind)
                    current, best, found, at, stop, stopped = key, math.inf, None, 0, None, False
                if stopped or pos - at > patience:
                    stopped = True
                elif loss < best - min_delta:
                    best, found, at, stop = loss, epoch, pos, later
        if found is not None:
            yield row(kind)

    rows = records.select(F.struct(*run).alias("_run"), "_pos", "_epoch", "_loss", "_stop")
    dealt = rows.repartition("_run").sortWithinPartitions("_run", "_pos")
    folded = dealt.mapInArrow(fold, f"_run {rows.schema['_run'].dataType.simpleString()}, _best double, _best_epoch long, _stop_at long")
    return folded.select(*[F.col(f"_run.{c}").alias(c) for c in run], "_best", "_best_epoch", "_stop_at")


def stopping_point(losses: Sequence[float], patience: int, min_delta: float) -> tuple[int, int]:
    """The rule for one run that is under way: (index of the best epoch, index of the stop), -1 for none."""
    best, found, stop = math.inf, -1, -1
    for i, loss in enumerate(losses):
        if loss < best - min_delta:
            best, found = loss, i
        elif i - found >= patience:
            stop = i
            break
    return found, stop


def best_checkpoint(
    history: DataFrame, run: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "val_loss", **options
) -> DataFrame:
    """Per run the epoch whose state is kept (``best_epoch``, last improvement before the stop) beside the epoch of
    the overall lowest loss (``min_epoch``); they differ after a late dip or a gain below ``min_delta``."""
    kept = early_stopping(history, run, epoch, loss, **options)
    lowest = history.groupBy(*run).agg(F.min(F.struct(_comparable(loss).alias("_cmp"), epoch, loss)).alias("_low"))
    return join_small(kept, lowest, run).select(
        *run, "best_epoch", "best_loss", F.col(f"_low.{epoch}").alias("min_epoch"), F.col(f"_low.{loss}").alias("min_loss")
    )


def epoch_report(
    history: DataFrame, run: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "val_loss", **layout_options
) -> DataFrame:
    """Per epoch: the loss, its change since the previous epoch and the lowest loss so far."""
    # a row of the chunk before changes no running minimum of this one
    laid = lay_out(history, run, [epoch], before=1, **layout_options)
    laid = running_in(laid, {"best_so_far": ("min", F.col(loss))})
    delta = F.col(loss) - F.lag(loss, 1).over(laid.window())
    return laid.own_rows(laid.df.withColumn("delta", delta))
