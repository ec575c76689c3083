"""Evaluation of scores ``p`` in [0, 1] against labels ``y`` in {0, 1}.

The column functions combine in one aggregate, so all pointwise metrics of a table or of every group cost one pass.
The rank metrics first reduce the rows to one per distinct score, map-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaneworks.functions.vectors import above
from vaneworks.operators.scale import Layout, join_small, lay_out, running_in

#: distinct scores in a piece of the order
PIECE_ROWS = 500_000
SLICES = 8
_LOG_FLOOR = -100.0  # fixed value: lower bound of a log term


def log_loss(p: str = "p", y: str = "y") -> Column:
    """Mean binary cross-entropy with its log terms bounded below."""
    floor = F.lit(_LOG_FLOOR)
    hit = F.greatest(F.ln(F.col(p)), floor)  # ln(0) is NULL in Spark and greatest skips NULL
    miss = F.greatest(F.ln(F.lit(1.0) - F.col(p)), floor)
    return F.avg(F.when(F.col(p).isNotNull(), -(F.col(y) * hit + (F.lit(1.0) - F.col(y)) * miss)))


def accuracy(p: str = "p", y: str = "y", threshold: float = 0.5) -> Column:
    right = above(F.col(p), threshold, inclusive=False) == (F.col(y) == 1)
    return F.avg(right.cast("double"))


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def confusion(p: str = "p", y: str = "y", threshold: float = 0.5) -> list[Column]:
    said, is_one = above(F.col(p), threshold, inclusive=False), F.col(y) == 1
    return [
        F.count_if(said & is_one).alias("tp"),
        F.count_if(said & ~is_one).alias("fp"),
        F.count_if(~said & is_one).alias("fn"),
        F.count_if(~said & ~is_one).alias("tn"),
    ]


def with_ratios(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from confusion counts; 0 where there is nothing to divide by."""

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


def _scored(df: DataFrame, p: str, y: str) -> DataFrame:
    """Rows with a score and a label; NaN is no score."""
    return df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())


def pointwise(
    df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """n, accuracy, loss, Brier score, confusion counts and their ratios in one pass; unscored rows do not count."""
    return with_ratios(
        _scored(df, p, y).groupBy(*by).agg(
            F.count("*").alias("n"),
            accuracy(p, y, threshold).alias("accuracy"),
            log_loss(p, y).alias("loss"),
            brier(p, y).alias("brier"),
            *confusion(p, y, threshold),
        )
    )


def _slices(table: DataFrame, lo: float | None, hi: float | None) -> Layout:
    """A table that one task could order, in slices of equal width of the scores."""
    width = (hi or 0.0) - (lo or 0.0)
    at = F.floor((F.col("p") - lo) / width * SLICES) if 0.0 < width < math.inf else F.lit(0).cast("bigint")
    return Layout(table.withColumns({"_chunk": at, "_halo": F.lit(False)}), ("_chunk",), ("p",), chunked=True)


def score_table(
    df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    """One row per distinct score (and group) with the positives and negatives at it and below it.

    Columns ``*by, p, pos, neg, pos_below, neg_below, all_pos, all_neg``. A group with more than ``PIECE_ROWS`` distinct
    scores is cut by the positions of its scores; running counts are local to a piece and take in the totals of the
    lower ones, so no task holds the whole order. ``pieces`` sets the number of pieces instead.
    """
    rows = _scored(df, p, y).select(*by, F.col(p).alias("p"), F.col(y).alias("y"))
    table = rows.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    limit = PIECE_ROWS
    sums = F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")
    totals = {"_pos": ("sum", F.col("pos")), "_neg": ("sum", F.col("neg"))}
    if not by or pieces is not None:
        whole = table.agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), *sums).first()
        limit = limit if pieces is None else max(1, -(-whole["n"] // pieces))
    if not by and whole["n"] <= limit:
        laid = _slices(table, whole["lo"], whole["hi"])
    else:
        laid = lay_out(table, by, ["p"], max_series_rows=limit, chunk_rows=limit)
    counted = running_in(laid, totals)
    counted = laid.own_rows(counted.df)
    if by:
        counted = join_small(counted, table.groupBy(*by).agg(*sums), by)
    else:
        counted = counted.withColumns({c: F.lit(whole[c]).cast("bigint") for c in ("all_pos", "all_neg")})
    return counted.select(
        *by,
        "p",
        "pos",
        "neg",
        (F.col("_pos") - F.col("pos")).alias("pos_below"),
        (F.col("_neg") - F.col("neg")).alias("neg_below"),
        "all_pos",
        "all_neg",
    )


def rank_metrics(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``auc`` and ``average_precision`` from a ``score_table``, in one aggregate.

    auc: share of (positive, negative) pairs ordered right, a tie counts one half; 0 when only one class is present.
    average_precision: sum over distinct scores, from the highest, of recall gained times precision there.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    all_pos, all_neg = F.col("all_pos").cast("double"), F.col("all_neg").cast("double")
    won = F.sum(pos * (F.col("neg_below") + neg / 2))
    pairs = F.max(all_pos * all_neg)
    tp = all_pos - F.col("pos_below")
    fp = all_neg - F.col("neg_below")
    gained = F.sum(pos * F.try_divide(tp, tp + fp))
    return table.groupBy(*by).agg(
        F.coalesce(F.try_divide(won, pairs), F.lit(0.0)).alias("auc"),
        F.coalesce(F.try_divide(gained, F.max(all_pos)), F.lit(0.0)).alias("average_precision"),
    )


def roc_auc(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (), pieces: int | None = None) -> DataFrame:
    return rank_metrics(score_table(df, p, y, by, pieces), by).select(*by, "auc")


def average_precision(
    df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    return rank_metrics(score_table(df, p, y, by, pieces), by).select(*by, "average_precision")


def precision_recall_curve(
    df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    """Per distinct score used as threshold (``>=``): tp, fp, precision, recall."""
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    return score_table(df, p, y, by, pieces).select(
        *by,
        F.col("p").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        (tp / (tp + fp)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("all_pos")), F.lit(0.0)).alias("recall"),
    )


def batch_metrics(df: DataFrame, batch: str = "batch_id", p: str = "p", y: str = "y", threshold: float = 0.5) -> DataFrame:
    """Loss, accuracy and AUC of every batch. A batch is small by construction, so its ranks need no cutting."""
    rows = _scored(df, p, y).select(batch, F.col(p).alias("p"), F.col(y).alias("y"))
    w = Window.partitionBy(batch).orderBy("p")
    below = F.count_if(F.col("y") != 1).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.count_if(F.col("y") != 1).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = rows.withColumn("_won", F.when(F.col("y") == 1, below - at / 2))
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)
    return ranked.groupBy(batch).agg(
        F.count("*").alias("n"),
        log_loss().alias("loss"),
        accuracy(threshold=threshold).alias("accuracy"),
        F.coalesce(F.try_divide(F.sum("_won"), (pos * neg).cast("double")), F.lit(0.0)).alias("auc"),
    )


def mean_over_batches(batches: DataFrame) -> DataFrame:
    """Unweighted means over batches (a short batch counts in full) beside the row-weighted loss and accuracy."""
    rows = F.sum("n")
    return batches.agg(
        F.count("*").alias("batches"),
        F.avg("loss").alias("loss"),
        F.avg("accuracy").alias("accuracy"),
        F.avg("auc").alias("auc"),
        F.try_divide(F.sum(F.col("loss") * F.col("n")), rows).alias("row_loss"),
        F.try_divide(F.sum(F.col("accuracy") * F.col("n")), rows).alias("row_accuracy"),
    )


def calibration_table(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins of the score: rows, mean score and observed rate; a score of 1 is in the last bin."""
    place = F.least(F.floor(F.col(p) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    return (
        _scored(df, p, y)
        .groupBy(*by, place.alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.avg(p).alias("mean_p"),
            F.avg(F.col(y).cast("double")).alias("observed_rate"),
        )
    )


def expected_calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean distance of score and observed rate over the bins, weighted by their rows."""
    distance = F.abs(F.col("mean_p") - F.col("observed_rate"))
    return table.groupBy(*by).agg(F.try_divide(F.sum(distance * F.col("n")), F.sum("n")).alias("ece"))
