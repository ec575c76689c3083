"""Splits, batches and positional access, all reproducible and exact in size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaneworks.functions.times import wall_micros
from vaneworks.operators.scale import hash_cuts, hash_rank, join_small, key_at_rank, row_index, running, seeded_hash
from vaneworks.schema import ORDER, ROW_ID, SERIES


def part_size(n: int, ratio: float) -> int:
    """Rows of a part, truncated."""
    return int(n * ratio)


def random_split(
    df: DataFrame,
    ids: Sequence[str] = (ROW_ID,),
    train: float = 0.8,
    val: float = 0.1,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Adds ``split``: exactly ``floor(n*train)`` and ``floor(n*val)`` rows, the rest is test.

    Only two hashes are searched for (aggregates over the ids); the split itself is a projection, so the rows - with
    all their features - are neither shuffled nor sorted. The search reads ``df`` a few times: pass a written table
    rather than a long plan.
    """

    def sizes(n: int) -> list[int]:
        return [part_size(n, train), part_size(n, train) + part_size(n, val)]

    last_train, last_val = hash_cuts(df, ids, seed, sizes)
    h = seeded_hash(ids, seed)
    part = F.lit("test")
    if last_val is not None:
        part = F.when(h <= last_val, "val").otherwise(part)
    if last_train is not None:
        part = F.when(h <= last_train, "train").otherwise(part)
    return df.withColumn(out, part)


def _as_long(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return wall_micros(F.col(name))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    return F.col(name).cast("bigint")


def _before(columns: Sequence[Column], key: Sequence[int]) -> Column:
    """(a, b, ...) < key, column by column."""
    condition = F.lit(False)
    for column, value in reversed(list(zip(columns, key))):
        condition = (column < F.lit(value)) | ((column == F.lit(value)) & condition)
    return condition


def head_split(
    df: DataFrame,
    order: Sequence[str] = ORDER,
    train: float = 0.8,
    end: str | None = None,
    out: str = "split",
) -> DataFrame:
    """Adds ``split``: the first ``floor(n*train)`` rows in time are train, the rest val.

    ``order`` holds time and integer columns and ends in a unique one. The cut is one key, searched in a few passes
    over these columns (``df`` should be a written table); the rows are neither shuffled nor sorted. With ``end`` (the time of the last row a
    window looks at) the train windows that reach into the validation part are marked ``gap``; windows overlap, so
    without it the two parts share rows.
    """
    keys = [_as_long(df, c) for c in order]
    cut = key_at_rank(df, keys, lambda n: part_size(n, train))
    if cut is None:  # all rows are train (or there are none)
        return df.withColumn(out, F.lit("train"))
    head = _before(keys, cut)
    part = F.when(head, "train").otherwise("val")
    if end is not None:
        part = F.when(head & (_as_long(df, end) >= F.lit(cut[0])), "gap").otherwise(part)
    return df.withColumn(out, part)


def series_head_split(
    df: DataFrame,
    series: Sequence[str] = (SERIES,),
    order: Sequence[str] = ORDER,
    train: float = 0.8,
    gap: int = 0,
    out: str = "split",
    **layout_options,
) -> DataFrame:
    """As ``head_split``, inside every series; ``gap`` rows before the cut are marked ``gap`` instead of train."""
    counted = running(df, series, order, {"_pos": ("sum", F.lit(1).cast("bigint"))}, **layout_options)
    sizes = df.groupBy(*series).agg(F.count("*").alias("_size"))
    head = F.floor(F.col("_size") * F.lit(float(train)))
    part = F.when(F.col("_pos") <= head - gap, "train").when(F.col("_pos") <= head, "gap").otherwise("val")
    return join_small(counted, sizes, series).withColumn(out, part).drop("_pos", "_size")


def shuffled_batches(
    df: DataFrame, ids: Sequence[str] = (ROW_ID,), batch_size: int = 32, seed: int = 42, out: str = "batch_id"
) -> DataFrame:
    """0-based batch of each row in a seeded order; the last batch may be short."""
    ranked = hash_rank(df, ids, seed, out="_rank")
    return ranked.withColumn(out, F.expr(f"(_rank - 1) div {int(batch_size)}")).drop("_rank")


def ordered_batches(
    df: DataFrame, order: Sequence[str] = ORDER, batch_size: int = 32, out: str = "batch_id"
) -> DataFrame:
    """0-based batch of each row in the given order; the last batch may be short."""
    indexed = row_index(df, order, out="_idx")
    return indexed.withColumn(out, F.expr(f"_idx div {int(batch_size)}")).drop("_idx")


def samples_at(
    df: DataFrame, positions: Sequence[int], order: Sequence[str] = ORDER, out: str = "sample_idx"
) -> DataFrame:
    """The rows at 0-based positions of the given order, with their position; positions outside give no row.

    ``order`` holds time and integer columns and ends in a unique one. The key at each position is found by counting
    (see ``key_at_rank``); nothing is sorted, and the rows are picked by a filter on the asked keys. Meant for a handful of
    positions: ``df`` is read a few times for each.
    """
    keys = [_as_long(df, c) for c in order]
    place = None
    for position in sorted({int(p) for p in positions}):
        found = key_at_rank(df, keys, lambda n, at=position: at) if position >= 0 else None
        if found is not None:
            here = F.lit(True)
            for column, value in zip(keys, found):
                here = here & (column == F.lit(value))
            place = F.when(here, F.lit(position).cast("bigint")) if place is None else place.when(here, F.lit(position).cast("bigint"))
    if place is None:
        return df.withColumn(out, F.lit(None).cast("bigint")).where(F.lit(False))
    return df.withColumn(out, place).where(F.col(out).isNotNull())


def split_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows per split and label."""
    return df.groupBy(split, label).agg(F.count("*").alias("n"))
