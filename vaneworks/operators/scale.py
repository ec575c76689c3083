"""Ordering work without a one-task window.

Global ranks, running totals and sliding frames all need an order, and the direct form - a window without a
partition, or one partitioned by a key that holds a third of the rows - puts that order into one task. The helpers
here cut the order into pieces of bounded size, work inside the pieces, and add what the earlier pieces contribute.

* ``row_index``     global position by any columns (range shuffle, written once)
* ``hash_rank``     global position in a seeded random order (one hash shuffle, no sort of the whole)
* ``hash_cuts``     the keys at given positions of that order (aggregates only, rows are not shuffled)
* ``key_at_rank``   the key at a position of an order by integer columns (aggregates only)
* ``lay_out``       pieces of one series plus the neighbouring rows a frame reaches (halo)
* ``running``       running totals per series that also hold for one giant series
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: a series with more rows than this is cut into chunks
MAX_SERIES_ROWS = 2_000_000
CHUNK_ROWS = 100_000
#: with more oversized series than this, every series is cut (their list is no longer small)
MAX_LISTED_SERIES = 10_000
#: rows (not table rows but aggregated ones) that may be fetched to look up a cut
FETCH_ROWS = 50_000

_SCRATCH: list[str] = []
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits
_HEX_PER_STEP = 4
_HASH_LENGTH = 32
_HASH_PREFIX = 12  # 48 bits of a hash number its bucket
_TOP_BITS = 16
_BINS_PER_STEP = 4096


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder of ``spark.checkpoint.dir``; a temporary folder only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vaneworks-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process made; call it when the results that read them are stored."""
    removed = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to scratch and read it back: later plans start from files that outlive an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_table(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    for scratch in [p for p in _SCRATCH if p.rsplit("/", 1)[1] in folders]:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _SCRATCH.remove(scratch)


def join_small(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join values that exist once per key to many rows; a NULL key meets a NULL key.

    Adaptive execution broadcasts ``per_key`` when its measured bytes allow it; beyond, both sides are shuffled and the
    partition of a key that holds many of the rows is split. Nothing is computed twice to find out.
    """
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"`{key}`").eqNullSafe(F.col(f"`_key_{key}`"))
    renamed = per_key.withColumnsRenamed({key: f"_key_{key}" for key in keys})
    return df.join(renamed, condition, how).drop(*[f"_key_{key}" for key in keys])


# --- global order ----------------------------------------------------------------------------------------------


def row_index(df: DataFrame, order: Sequence[str], out: str = "row_idx") -> DataFrame:
    """0-based position of each row in the order by ``order``, which must end in a unique column.

    The rows are range-shuffled, sorted inside their partition and written with their local number; the partition
    sizes (one number per partition) then give the offset of each partition. Writing matters: range bounds are
    sampled, so the count and the final read must see the same partitions.
    """
    spark = df.sparkSession
    ranked = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_local", F.monotonically_increasing_id()),
        "row-index",
    )
    pid = F.shiftright("_local", _LOCAL_BITS)
    sizes = sorted((r["pid"], r["n"]) for r in ranked.groupBy(pid.alias("pid")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_pid bigint, _start bigint")
    local = F.col("_local").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        ranked.withColumn("_pid", pid.cast("bigint"))
        .join(F.broadcast(offsets), "_pid")  # one row per partition
        .withColumn(out, F.col("_start") + local)
        .drop("_pid", "_start", "_local")
    )


def seeded_hash(ids: Sequence[str], seed: int) -> Column:
    """Hex text whose order is a reproducible shuffle of the rows; ``ids`` identify a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def _prefix_counts(hashed: DataFrame, inside: Sequence[str], length: int) -> list[tuple[str, int]]:
    """Rows per hash prefix of ``length`` below the prefixes ``inside``; at most 65,536 per prefix."""
    if inside and inside[0]:
        hashed = hashed.where(F.substring("_hash", 1, len(inside[0])).isin(*inside))
    counts = hashed.groupBy(F.substring("_hash", 1, length).alias("prefix")).agg(F.count("*").alias("n"))
    return sorted((r["prefix"], r["n"]) for r in counts.collect())


def hash_rank(df: DataFrame, ids: Sequence[str], seed: int, out: str = "rank", bucket_rows: int = 200_000) -> DataFrame:
    """1-based rank of each row in the seeded order.

    Hash prefixes are buckets of near equal size whatever the data looks like, so the rank is the rank inside the
    bucket plus the rows of all lower buckets. Both are functions of the row values: a lost task recomputes the same.
    """
    hashed = df.withColumn("_hash", seeded_hash(ids, seed))
    total = hashed.count()
    bits = max(0, (total // bucket_rows).bit_length())
    long_prefix = F.conv(F.substring("_hash", 1, _HASH_PREFIX), 16, 10).cast("bigint")
    hashed = hashed.withColumn("_bucket", F.shiftright(long_prefix, 4 * _HASH_PREFIX - min(bits, 4 * _HASH_PREFIX)))
    offsets = _bucket_offsets(hashed.groupBy("_bucket").agg(F.count("*").alias("_n")), max(0, bits - _TOP_BITS))
    if bits <= _TOP_BITS:
        offsets = F.broadcast(offsets)  # at most 65,536 rows
    inside = Window.partitionBy("_bucket").orderBy("_hash", *ids)
    return (
        hashed.withColumn("_local", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_hash", "_bucket", "_local", "_start")
    )


def _bucket_offsets(counts: DataFrame, low_bits: int) -> DataFrame:
    """Rows in all lower buckets, per bucket. At most 65,536 sums are fetched; below each of them a window adds up the rest."""
    top = F.shiftright("_bucket", low_bits)
    starts, before = [], 0
    for part, n in sorted((r["t"], r["n"]) for r in counts.groupBy(top.alias("t")).agg(F.sum("_n").alias("n")).collect()):
        starts.append((part, before))
        before += n
    upper = counts.sparkSession.createDataFrame(starts or [(0, 0)], "_top bigint, _upper bigint")
    lower = Window.partitionBy("_top").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_top", top)
        .withColumn("_lower", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        .join(F.broadcast(upper), "_top")  # at most 65,536 rows
        .select("_bucket", (F.col("_upper") + F.col("_lower")).alias("_start"))
    )


def hash_cuts(
    df: DataFrame, ids: Sequence[str], seed: int, ranks: Callable[[int], Sequence[int]]
) -> list[str | None]:
    """Hash of the ``rank``-th row (1-based) of the seeded order for each rank; None for ranks below 1.

    ``ranks`` gets the number of rows. Counts per prefix find the prefix that holds a rank, then only rows below that
    prefix are looked at again. Rows with equal ids have equal hashes: they fall on one side of a cut together, so a part
    may be larger than asked for by the copies of its last row. Their number is not checked at any size.
    """
    hashed = df.select(seeded_hash(ids, seed).alias("_hash"))
    length = _HEX_PER_STEP
    counts = _prefix_counts(hashed, (), length)
    wanted = list(ranks(sum(n for _, n in counts)))
    open_cuts = {rank: ("", rank) for rank in wanted if rank >= 1}
    found: dict[int, str] = {}
    while open_cuts:
        held = dict(counts)
        for rank, (prefix, left) in open_cuts.items():
            for candidate, n in counts:
                if candidate.startswith(prefix):
                    if left <= n:
                        open_cuts[rank] = (candidate, left)
                        break
                    left -= n
            else:
                raise ValueError(f"rank {rank} is beyond the last row")
        inside = sorted({p for p, _ in open_cuts.values()})
        if length >= _HASH_LENGTH or sum(held[p] for p in inside) <= FETCH_ROWS:
            if length >= _HASH_LENGTH:
                rows = {p: held[p] for p in inside}  # a prefix is a whole hash now
            else:
                rows = Counter(r[0] for r in hashed.where(F.substring("_hash", 1, length).isin(*inside)).collect())
            for rank, (prefix, left) in open_cuts.items():
                for h, n in sorted((h, n) for h, n in rows.items() if h.startswith(prefix)):
                    if left <= n:
                        found[rank] = h
                        break
                    left -= n
            break
        length += _HEX_PER_STEP
        counts = _prefix_counts(hashed, inside, length)
    return [found.get(rank) for rank in wanted]


def key_at_rank(
    df: DataFrame, columns: Sequence[Column], rank_of: Callable[[int], int]
) -> tuple[int, ...] | None:
    """Values of the integer ``columns`` in the row at 0-based position ``rank_of(rows)`` of the order by them.

    Each pass counts rows in equal-width bins and keeps the bin that holds the position; None when the position is
    outside the table. No row is shuffled: a pass returns at most ``FETCH_ROWS`` counts.
    """
    rank = None
    keys = df.select(*[c.cast("bigint").alias(f"_k{i}") for i, c in enumerate(columns)])
    result: list[int] = []
    for i in range(len(columns)):
        col = F.col(f"_k{i}")
        span = keys.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")).first()
        lo, hi, n = span["lo"], span["hi"], span["n"]
        if rank is None:
            rank = rank_of(n)
        if rank < 0 or rank >= n:
            return None
        while lo < hi:
            exact = n <= FETCH_ROWS
            width = 1 if exact else -(-(hi - lo + 1) // _BINS_PER_STEP)
            bins = (
                keys.where(col.between(lo, hi))
                .groupBy(F.expr(f"(_k{i} - {lo}L) div {width}L").alias("bin"))
                .agg(F.count("*").alias("n"))
            )
            for b, n in sorted((r["bin"], r["n"]) for r in bins.collect()):
                if rank < n:
                    lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                    break
                rank -= n
        result.append(lo)
        keys = keys.where(col == lo)
    return tuple(result)


# --- order inside a series -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Rows ready for windows partitioned by ``keys``; rows with ``_halo`` only feed the frames of others."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def frame(self, first: int, last: int):
        return self.window().rowsBetween(first, last)

    def own_rows(self, df: DataFrame) -> DataFrame:
        """Drop the halo copies and the helper columns after the frames are computed."""
        return df.where(~F.col("_halo")).drop("_halo", "_chunk") if self.chunked else df


def _oversized(df: DataFrame, series: Sequence[str], max_rows: int) -> list | None:
    """Series with more than ``max_rows`` rows; None when they are too many to list."""
    big = df.groupBy(*series).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows).drop("_n")
    rows = big.limit(MAX_LISTED_SERIES + 1).collect()
    return rows if len(rows) <= MAX_LISTED_SERIES else None


def lay_out(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
    strategy: str = "auto",
    max_series_rows: int = MAX_SERIES_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> Layout:
    """Make row frames that reach ``before`` rows back and ``after`` rows ahead safe for a giant series.

    ``partition`` keeps one partition per series. ``chunk`` cuts the global order into chunks of ``chunk_rows`` and
    copies the rows a frame can reach across a cut. ``auto`` counts the rows per series (one narrow aggregate) and
    cuts only the series above ``max_series_rows``; without any, it is the plain window.
    """
    series, order = tuple(series), tuple(order)
    if strategy not in ("auto", "partition", "chunk"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "auto" and not series:
        strategy = "chunk"
    if strategy == "auto":
        big = _oversized(df, series, max_series_rows)
        if big == []:
            strategy = "partition"
        elif big is None:
            strategy = "chunk"
    if strategy == "partition":
        return Layout(df, series, order, chunked=False)

    chunk_rows = max(chunk_rows, before, after, 1)  # a frame reaches into the next chunk, not beyond
    rest = None
    if strategy == "auto":
        schema = T.StructType([df.schema[c] for c in series])
        listed = df.sparkSession.createDataFrame(big, schema)  # at most MAX_LISTED_SERIES rows
        rest = join_small(df, F.broadcast(listed), series, "left_anti")
        df = join_small(df, F.broadcast(listed), series, "left_semi")

    indexed = row_index(df, [*series, *order], out="_idx")
    own = F.expr(f"_idx div {chunk_rows}") + 1
    within = F.col("_idx") % F.lit(chunk_rows)
    placed = [F.struct(own.alias("chunk"), F.lit(False).alias("halo"))]
    if after:
        placed.append(F.when(within < after, F.struct((own - 1).alias("chunk"), F.lit(True).alias("halo"))))
    if before:
        placed.append(
            F.when(within >= chunk_rows - before, F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo")))
        )
    names = [c for c in indexed.columns if c != "_idx"]
    chunked = (
        indexed.withColumn("_at", F.explode(F.filter(F.array(*placed), lambda x: x.isNotNull())))
        .select(*names, F.col("_at.chunk").alias("_chunk"), F.col("_at.halo").alias("_halo"))
    )
    if rest is not None:  # uncut series are chunk 0, which no cut series uses as its own
        chunked = chunked.unionByName(
            rest.select(*names, F.lit(0).cast("bigint").alias("_chunk"), F.lit(False).alias("_halo"))
        )
    return Layout(chunked, (*series, "_chunk"), order, chunked=True)


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    totals: dict[str, tuple[str, Column]],
    **layout_options,
) -> DataFrame:
    """Running ``sum``/``min``/``max`` from the first row of a series to the current one.

    ``totals`` maps an output column to (kind, value).
    """
    laid = running_in(lay_out(df, series, order, **layout_options), totals)
    return laid.own_rows(laid.df)


def running_in(laid: Layout, totals: dict[str, tuple[str, Column]]) -> Layout:
    """``running`` over rows that are laid out already, without a halo of earlier rows.

    In a cut series each chunk first runs for itself, then takes in the combined value of the chunks before it. Halo
    rows follow the rows of their chunk, so they do not disturb its totals; their own are not used.
    """
    w = laid.frame(Window.unboundedPreceding, Window.currentRow)
    local = laid.df.select("*", *[_COMBINE[kind][0](value).over(w).alias(name) for name, (kind, value) in totals.items()])
    if not laid.chunked:
        return replace(laid, df=local)
    chunks = (
        laid.df.where(~F.col("_halo"))
        .groupBy(*laid.keys)
        .agg(*[_COMBINE[kind][0](value).alias(f"_all_{name}") for name, (kind, value) in totals.items()])
    )
    series = [c for c in laid.keys if c != "_chunk"]
    earlier = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    prior = chunks.select(
        *laid.keys,
        *[_COMBINE[kind][0](f"_all_{name}").over(earlier).alias(f"_prior_{name}") for name, (kind, _) in totals.items()],
    )
    combined = join_small(local, prior, laid.keys, "left").withColumns(
        {name: _COMBINE[kind][1](F.col(f"_prior_{name}"), F.col(name)) for name, (kind, _) in totals.items()}
    )
    return replace(laid, df=combined.drop(*[f"_prior_{name}" for name in totals]))
