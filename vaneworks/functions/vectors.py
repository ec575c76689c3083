"""Column functions on feature vectors and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaneworks.schema import FEATURES, LABEL


def present(df: DataFrame, features: Sequence[str] = FEATURES) -> list[str]:
    """The features ``df`` has, in contract order; absent ones are skipped, as the plan is built."""
    return [name for name in features if name in df.columns]


def feature_vector(features: Sequence[str] = FEATURES) -> Column:
    return F.array(*[F.col(name).cast("double") for name in features])


def repeat_snapshot(vector: Column, length: int) -> Column:
    """A sequence of ``length`` equal steps from one snapshot."""
    return F.array_repeat(vector, length)


def label_value(label: str = LABEL) -> Column:
    return F.col(label).cast("double")


def above(score: Column, threshold: float | None, inclusive: bool = True) -> Column:
    """Scoring decides with ``>=`` (inclusive), evaluation with ``>``; without a threshold the score is returned."""
    if threshold is None:
        return score
    return score >= F.lit(float(threshold)) if inclusive else score > F.lit(float(threshold))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not once per element of the array the body loops over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term(x))


def standardise(values: Column) -> Column:
    """``(x - mean) / deviation`` over a whole array, with the population deviation; NULL for a constant array.

    Mean first, squares second: the one-pass form loses the small deviations of large values. Sequences are short,
    so they stay in the JVM; images go through ``pixels.standardise_image``.
    """
    n = F.size(values)
    mean = F.when(n > 0, _sum(values, lambda x: x.cast("double")) / n)
    centred = _bind(mean, lambda m: F.transform(values, lambda x: x.cast("double") - m))

    def scale(c: Column) -> Column:
        squares = _sum(c, lambda x: x * x)
        deviation = F.when(squares > 0, F.sqrt(squares / F.size(c)))
        return _bind(deviation, lambda d: F.when(d.isNotNull(), F.transform(c, lambda x: x / d)))

    return _bind(centred, scale)


def standardise_sequence(sequence: Column) -> Column:
    """One mean and population deviation over all steps and features of a sequence, which keeps its shape."""
    flat = standardise(F.flatten(sequence))
    width = F.size(F.get(sequence, F.lit(0)))

    def reshape(values: Column) -> Column:
        return F.transform(sequence, lambda _, i: F.slice(values, i * width + 1, width))

    return _bind(flat, lambda values: F.when(values.isNotNull(), reshape(values)))


def scale_pixels(pixels: Column) -> Column:
    """Byte-valued pixels to [0, 1], as float."""
    return F.transform(pixels, lambda v: (v / 255).cast("float"))
