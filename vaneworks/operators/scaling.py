"""Standard scaling of features: fitted on one table, applied to any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaneworks.functions.vectors import present
from vaneworks.operators.scale import join_small
from vaneworks.schema import FEATURES, SERIES


def _known(name: str) -> Column:
    """NaN counts as missing; Spark's own aggregates would turn the whole result into NaN."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def fit_scaler(df: DataFrame, features: Sequence[str] = FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, feature, mean, scale, n)``: mean and population deviation over the known values, scale 1 if constant.

    One pass for all features, combined map-side, so a series with a third of the rows costs no more than others.
    """
    names = present(df, features)
    stats = [
        F.struct(
            F.lit(name).alias("feature"),
            F.avg(_known(name)).alias("mean"),
            F.stddev_pop(_known(name)).alias("deviation"),
            F.count(_known(name)).alias("n"),
        ).alias(name)
        for name in names
    ]
    wide = df.groupBy(*by).agg(*stats)
    return wide.select(*by, F.inline(F.array(*names))).select(
        *by,
        "feature",
        "mean",
        F.when(F.col("deviation") == 0, F.lit(1.0)).otherwise(F.col("deviation")).alias("scale"),
        "n",
    )


def apply_scaler(df: DataFrame, params: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``(x - mean) / scale`` for the fitted features ``df`` has; the same function serves training and scoring.

    The parameters are one row per feature; they become constants of the projection, so nothing is joined.
    """
    fitted = {r["feature"]: (r["mean"], r["scale"]) for r in params.select("feature", "mean", "scale").collect()}
    scaled = {
        name: (F.col(name) - F.lit(fitted[name][0])) / F.lit(fitted[name][1])
        for name in present(df, features)
        if name in fitted and fitted[name][0] is not None
    }
    return df.withColumns(scaled) if scaled else df


def apply_series_scaler(
    df: DataFrame, params: DataFrame, by: Sequence[str] = (SERIES,), features: Sequence[str] = FEATURES
) -> DataFrame:
    """As ``apply_scaler`` with parameters per series. A series without parameters gets NULL features."""
    names = present(df, features)
    wide = (
        params.groupBy(*by)
        .pivot("feature", list(names))
        .agg(F.first(F.struct("mean", "scale")))
        .select(*by, *[F.col(name).alias(f"_fit_{name}") for name in names])
    )
    joined = join_small(df, wide, by, "left")
    scaled = {name: (F.col(name) - F.col(f"_fit_{name}.mean")) / F.col(f"_fit_{name}.scale") for name in names}
    return joined.withColumns(scaled).drop(*[f"_fit_{name}" for name in names])
