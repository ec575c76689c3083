"""Near duplicates among vectors: binary codes by iterative quantisation, multi-index Hamming tables, original vectors to decide.

A rotation of the principal axes is learnt that brings unit vectors near the corners of a cube (iterative quantisation); the
signs of the rotated axes are the bits. With fewer axes than bits further rotations are learnt from other starts. The code is
cut into ``tables`` words, and each word is a table of its own: two codes that differ in fewer bits than there are tables
agree in a word. Vectors of one bucket (group, table, word) are held against each other by their cosine in double precision,
in blocks; a pair that shares several words counts in the first of them only.

The fit sees ``fit_rows`` vectors at most (those with the smallest hash of their content, so the same ones each time); every
vector is coded and looked up. Vectors of a length of which the sample holds too few are coded by seeded random planes.

Equal vectors of one group are one class: they are told by 64 bits of the group and 128 of their content, held against others once, and weigh by
their number. A bucket of more than ``BLOCK`` classes is cut into blocks, each pair of blocks is a task; no pair of rows is
written, only counts, and for each class the smallest class of the block that it reaches. A dense group of m different
vectors costs m * m cosines, since each member's number of links is asked for.

Rows: a null group, a null or zero vector, and one with a null or non-finite component link with nothing. Vectors of
different lengths never link. A null id takes part; a component whose ids are all null has a null component_id. Of repeated
ids each row is a vector. An empty table gives an empty result. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaneworks.llm.common import drop_stored, stored
from vaneworks.llm.components import components

THRESHOLD = 0.98
#: Vectors that the rotation is learnt from, at most; and their numbers altogether.
FIT_ROWS = 10_000
FIT_VALUES = 2_000_000
TABLES = 8
WORD_BITS = 16
#: Classes of a bucket that are held against each other at once.
BLOCK = 1_000
ROUNDS = 30
SEED = 17

Codes = dict[int, tuple[np.ndarray, np.ndarray]]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their scale."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def random_planes(dim: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(dim), np.random.default_rng(seed * 1_000_003 + dim).normal(size=(dim, bits))


def learn_planes(units: np.ndarray, bits: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Centre and planes (dim, bits): principal axes, rotated until the projections lie near the corners of a cube."""
    dim = units.shape[1]
    centre = units.mean(axis=0)
    axes = min(dim, bits)
    principal = np.linalg.eigh(np.cov(units.T).reshape(dim, dim))[1][:, ::-1][:, :axes]
    projected = (units - centre) @ principal
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(-(-bits // axes)):
        rotation = np.linalg.qr(rng.normal(size=(axes, axes)))[0]
        for _ in range(ROUNDS):
            corners = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(corners.T @ projected)
            rotation = (left @ right).T
        planes.append(principal @ rotation)
    return centre, np.concatenate(planes, axis=1)[:, :bits]


def code_words(units: np.ndarray, planes: tuple[np.ndarray, np.ndarray], tables: int, word_bits: int) -> np.ndarray:
    """(rows, tables) words of the codes."""
    bits = (units - planes[0]) @ planes[1] >= 0
    return bits.reshape(len(units), tables, word_bits) @ (1 << np.arange(word_bits, dtype=np.int64))


def _kind(docs: DataFrame, vector: str) -> np.dtype:
    element = docs.schema[vector].dataType.elementType
    return np.dtype("<f4") if isinstance(element, T.FloatType) else np.dtype("<f8")


def _usable(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, double vectors) of each length: finite, not zero."""
    lists = batch.column(column)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.asarray(lists.offsets)[:-1] if len(lists) else np.zeros(0, np.int64)
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        vectors = values[starts[rows][:, None] + np.arange(length)]
        good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        yield rows[good], vectors[good] + 0.0  # -0.0 becomes 0.0


def fit(docs: DataFrame, vector: str = "embedding", fit_rows: int = FIT_ROWS, bits: int = TABLES * WORD_BITS, seed: int = SEED) -> Codes:
    """Centre and planes per length of vector, learnt from a bounded sample: the rows with the smallest hashes of their vectors."""
    seen = docs.select(F.col(vector).alias("v")).where(F.col("v").isNotNull())
    widest = seen.agg(F.max(F.size("v"))).first()[0] or 1
    sample = seen.orderBy(F.xxhash64("v")).limit(max(1, min(fit_rows, FIT_VALUES // widest))).toArrow()
    by_length: dict[int, list[np.ndarray]] = {}
    for batch in sample.to_batches():
        for _, vectors in _usable(batch, 0):
            if len(vectors):
                by_length.setdefault(vectors.shape[1], []).append(unit(vectors))
    found = {dim: np.unique(np.concatenate(parts), axis=0) for dim, parts in by_length.items()}
    return {dim: learn_planes(units, bits, seed) for dim, units in found.items() if len(units) > dim}


def _coded(docs: DataFrame, codes: Codes, vec_id: str, vector: str, group: str, tables: int, word_bits: int, seed: int) -> DataFrame:
    """_id, _group, and for vectors that can link _cls, _vec and _words."""
    kind = _kind(docs, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = dict(codes)
        for batch in batches:
            cls, vec, words = ([None] * batch.num_rows for _ in range(3))
            named = batch.column(2).to_pylist()
            for rows, vectors in _usable(batch, 1):
                if not len(rows):
                    continue
                dim = vectors.shape[1]
                if dim not in planes:
                    planes[dim] = random_planes(dim, tables * word_bits, seed)
                found = code_words(unit(vectors), planes[dim], tables, word_bits)
                for k, row in enumerate(rows.tolist()):
                    if named[row] is not None:
                        vec[row] = vectors[k].astype(kind).tobytes()
                        cls[row] = hashlib.blake2b(named[row].encode(), digest_size=8).digest() + hashlib.blake2b(vec[row], digest_size=16).digest()
                        words[row] = found[k].tolist()
            columns = [batch.column(0), batch.column(2), pa.array(cls, pa.binary()), pa.array(vec, pa.binary()), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_group", "_cls", "_vec", "_words"])

    ids = docs.schema[vec_id].dataType.simpleString()
    rows = docs.select(F.col(vec_id).alias("_id"), F.col(vector).alias("_v"), F.col(group).cast("string").alias("_group"))
    return rows.mapInArrow(run, f"_id {ids}, _group string, _cls binary, _vec binary, _words array<long>")


def _forest(linked: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of the rows the smallest member (by ``order``) of its component in a symmetric link matrix."""
    label = order.copy()
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(order)).min(axis=1, initial=len(order)))
        if (low == label).all():
            return label
        label = low


def _bucket(cls: list[bytes], units: np.ndarray, words: np.ndarray, weight: np.ndarray, table: int, cut: int, threshold: float):
    """Links inside a block (``cut`` 0) or between rows before and from ``cut`` on: (class, number of linked vectors, smallest class reached)."""
    a, b = (slice(0, cut), slice(cut, None)) if cut else (slice(None), slice(None))
    near = units[a] @ units[b].T >= threshold
    if not cut:
        np.fill_diagonal(near, False)
    fresh = near.copy()
    i, j = np.nonzero(near)
    if table and len(i):
        known = (words[a][i, :table] == words[b][j, :table]).any(axis=1)
        fresh[i[known], j[known]] = False
    if not len(i):
        return
    n = np.zeros(len(cls), dtype=np.int64)
    n[a] += fresh @ weight[b]
    if cut:
        n[b] += weight[a] @ fresh
    whole = near
    if cut:
        whole = np.zeros((len(cls), len(cls)), dtype=bool)
        whole[:cut, cut:], whole[cut:, :cut] = near, near.T
    by_name = sorted(range(len(cls)), key=cls.__getitem__)
    rank = np.empty(len(cls), dtype=np.int64)
    rank[by_name] = np.arange(len(cls))
    root = _forest(whole, rank)
    for k in np.flatnonzero((n > 0) | (root != rank)).tolist():
        yield cls[k], int(n[k]), cls[by_name[root[k]]]


def _held(tasks: DataFrame, kind: np.dtype, threshold: float) -> DataFrame:
    """(_cls, _n, _root) of all tasks: rows come sorted by task, so one task's rows are in memory at a time."""
    names = ["_key", "_i", "_j", "_t", "_mine", "_cls", "_weight", "_words", "_vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, bytes]] = []

        def settle(rows: list[tuple]) -> None:
            if len(rows) < 2:
                return
            i, j = rows[0][1], rows[0][2]
            rows.sort(key=lambda r: r[4] != i)
            cut = sum(r[4] == i for r in rows) if i != j else 0
            if i != j and cut in (0, len(rows)):
                return
            alike: dict[tuple, list[tuple]] = {}
            for r in rows:
                alike.setdefault((r[3], len(r[8]), r[5][:8]), []).append(r)
            for (table, *_), same in alike.items():  # more than one only where two keys have one hash
                own_cut = sum(r[4] == i for r in same) if cut else 0
                if len(same) < 2 or (cut and own_cut in (0, len(same))):
                    continue
                units = unit(np.frombuffer(b"".join(r[8] for r in same), dtype=kind).reshape(len(same), -1).astype(np.float64))
                words = np.array([r[7] for r in same])
                out.extend(_bucket([r[5] for r in same], units, words, np.array([r[6] for r in same]), table, own_cut, threshold))

        def sent() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["_cls", "_n", "_root"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:3] != held[0][:3]:
                    settle(held)
                    held = []
                    if len(out) > 10_000:
                        yield sent()
                held.append(row)
        settle(held)
        if out:
            yield sent()

    dealt = tasks.select(*names).repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")
    return dealt.mapInArrow(run, "_cls binary, _n long, _root binary")


def near_duplicates(docs: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = THRESHOLD,
                    codes: Codes | None = None, tables: int = TABLES, word_bits: int = WORD_BITS, block: int = BLOCK, fit_rows: int = FIT_ROWS,
                    seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: its id, n_links, component_id (smallest id that links reach) and kept (the id is the component's)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    if codes is None:
        codes = fit(docs, vector, fit_rows, tables * word_bits, seed)
    coded = stored(_coded(docs, codes, vec_id, vector, group, tables, word_bits, seed), "codes")
    able = coded.where(F.col("_cls").isNotNull())
    classes = stored(
        able.groupBy("_cls").agg(
            F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_weight"),
            F.first(F.struct("_group", F.length("_vec").alias("n"), "_words", "_vec")).alias("_of"),  # equal in all rows of a class
        ).select("_cls", "_first", "_weight", "_of.*"),
        "vectors",
    )

    word = F.posexplode("_words").alias("_t", "_word")
    entries = classes.select("_cls", "_group", "n", word).select("_cls", "_t", F.xxhash64("_group", "n", "_t", "_word").alias("_key"))
    sizes = entries.groupBy("_key").agg(F.count(F.lit(1)).alias("_members")).where(F.col("_members") > 1)
    sizes = sizes.select(F.col("_key").alias("_k"), F.ceil(F.col("_members") / block).cast("int").alias("_blocks"))
    met = entries.join(sizes, F.col("_key") == F.col("_k"))
    places = stored(met.groupBy("_cls").agg(F.collect_list(F.struct("_t", "_key", "_blocks")).alias("_at")).withColumnRenamed("_cls", "_c"), "places")

    rows = classes.join(places, F.col("_cls") == F.col("_c")).select("_cls", "_weight", "_words", "_vec", F.explode("_at").alias("_p"))
    rows = rows.select("*", F.col("_p._t").alias("_t"), F.col("_p._key").alias("_key"), F.col("_p._blocks").alias("_blocks"))
    mine = F.pmod(F.xxhash64("_cls"), F.col("_blocks")).cast("int")
    rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    tasks = rows.withColumns({"_i": F.least("_mine", "_other"), "_j": F.greatest("_mine", "_other")})
    held = stored(_held(tasks, _kind(docs, vector), threshold), "held")

    counts = held.groupBy("_cls").agg(F.sum("_n").alias("_n")).withColumnRenamed("_cls", "_c")
    labels = components(held.select(F.col("_cls").alias("a"), F.col("_root").alias("b")))
    named = classes.join(labels, F.col("_cls") == F.col("node"), "left").select("_cls", "_first", "_weight", F.coalesce("root", "_cls").alias("_root"))
    named = named.join(counts, F.col("_cls") == F.col("_c"), "left").drop("_c")
    # stored, so that the join with it can split a component that holds many of the classes
    smallest = stored(named.groupBy("_root").agg(F.min("_first").alias("_component")).withColumnRenamed("_root", "_r"), "smallest")
    linked = F.col("_weight") - 1 + F.coalesce("_n", F.lit(0))
    known = named.join(smallest, F.col("_root") == F.col("_r")).select(F.col("_cls").alias("_c"), linked.alias("_links"), "_component")
    known = stored(known, "known")
    for df in (classes, places, held, labels, smallest):
        drop_stored(df)
    out = coded.join(known, F.col("_cls") == F.col("_c"), "left")
    component = F.when(F.col("_cls").isNull(), F.col("_id")).otherwise(F.col("_component"))
    return out.select(
        F.col("_id").alias(vec_id), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept")
    )
