"""Substring dedup with prefix-partitioned suffix trees.

Words covered by a window of ``WINDOW`` words whose word sequence also starts earlier (smaller doc_id, or earlier in the
same document) are removed; windows are judged on the input. The suffixes of all documents, as long as a window, are
dealt into memory-sized groups by prefixes of variable length. In each group the sorted suffixes and the words that
neighbours share are the subtree: below an inner node as deep as a window lie the occurrences of a repeated window, and
all but the first are removed.

Two equal windows have the same rarest run of ``RUN`` words (the one with the smallest hash) at the same place. So a
window is read from that run on, around its end, to the word before the run: the run is the prefix by which suffixes are dealt
out, and neighbouring windows of one run travel as one stretch of words. A run with too many windows for a group gives way
to the whole window as the prefix. Only windows whose run stands elsewhere too are dealt out; no other can have an equal.
Copies of a whole text are known by 64 bits of it: all but the first lose every window. Of equal windows among the texts
that are worked on together all but the first are removed at once, so that a passage in very many documents sends few.

Rows: null texts have no words. Rows with equal doc_id and text are one document; of rows with equal doc_id and other
texts the order is that of a hash of the text. A null doc_id comes first. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vaneworks.llm.common import SPACES, stored, text_batches, text_key, whole
from vaneworks.llm.tokens import Chunk, chunks, mix, runs

WINDOW = 20
RUN = 8
#: Windows in a group.
GROUP_WINDOWS = 50_000


def _anchored(chunk: Chunk, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words at which a window starts; for each the word at which its rarest run starts; hashes of all runs and of all words."""
    hashed = chunk.hashes(lower=False)
    found = runs(hashed, run)
    last = len(hashed) - window + 1
    starts = np.flatnonzero(chunk.doc[:last] == chunk.doc[window - 1 :]) if last > 0 else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, found, hashed
    views = np.lib.stride_tricks.sliding_window_view(found, window - run + 1)
    return starts, starts + views[starts].argmin(axis=1), found, hashed


def anchor_rows(docs: DataFrame, window: int, run: int) -> DataFrame:
    """(_anchor, _text, _known) of every text: a run that stands for a window, and whether it is known to stand elsewhere too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                keys = batch.column(0).slice(chunk.rows.start, len(chunk.rows)).to_numpy()
                starts, anchors, found, _ = _anchored(chunk, window, run)
                at = np.unique(anchors)
                _, once = np.unique(keys, return_index=True)  # a copy's runs tell nothing new
                fresh = np.zeros(len(keys), dtype=bool)
                fresh[once] = True
                at = at[fresh[chunk.doc[at]]]
                doc, value = chunk.doc[at], found[at]
                order = np.lexsort((doc, value))
                doc, value = doc[order], value[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = value[1:] != value[:-1]
                group = np.cumsum(new) - 1
                several = np.bincount(group)[group] > 1 if len(group) else new
                own = np.ones(len(doc), dtype=bool)
                own[1:] = new[1:] | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[own].view(np.int64)), pa.array(keys[doc[own]]), pa.array(several[own]), pa.array(~new[own])], ["_anchor", "_text", "_known", "_later"])

    return docs.select("_key", "_words").mapInArrow(work, "_anchor long, _text long, _known boolean, _later boolean")


def repeated_anchors(docs: DataFrame, window: int, run: int) -> DataFrame:
    """(_text, _anchors): the runs of each text that stand elsewhere too. Rows known to be repeated are spread, one for each batch is compared."""
    rows = anchor_rows(docs, window, run)
    rows = rows.withColumn("_salt", F.when(F.col("_later"), F.pmod(F.col("_text"), F.lit(997)) + 1).otherwise(F.lit(0)))
    over = "over (partition by _anchor, _salt)"
    met = rows.select("_anchor", "_text", "_known", F.expr(f"min(_text) {over} <> max(_text) {over}").alias("_elsewhere"))
    return met.where(F.col("_known") | F.col("_elsewhere")).groupBy("_text").agg(F.collect_set("_anchor").alias("_anchors"))


def suffix_rows(texts: DataFrame, window: int, run: int) -> DataFrame:
    """What the groups and the last step need of the texts, in two kinds of rows.

    Windows known to be later: _id, _key, _starts. Windows that share a rarest run: _id, _key, _run (its hash), _words (of all
    of them), _start (of the first in the document), _n (windows), _at (the word of _words at which the run starts).
    """
    kind = texts.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                starts, rare, found, hashed = _anchored(chunk, window, run)
                ids, keys, part = (batch.column(k).slice(chunk.rows.start, len(chunk.rows)) for k in (0, 1, 3))
                owner = np.repeat(np.arange(len(part)), pa.compute.list_value_length(part).to_numpy())
                wanted = mix(part.flatten().to_numpy().view(np.uint64) ^ mix(owner.astype(np.uint64)))
                good = np.isin(mix(found[rare] ^ mix(chunk.doc[rare].astype(np.uint64))), wanted)
                starts, rare = starts[good], rare[good]
                first = _first_of_kind(starts, chunk, hashed, window, ids.to_pylist(), keys.to_pylist())
                yield _batch(ids, keys, _by_doc(chunk, starts[~first]))
                yield _batch(ids, keys, _by_run(chunk, starts[first], rare[first], found, window))

    columns = "_starts array<int>, _run long, _words string, _start int, _n int, _at int"
    return texts.select("_id", "_key", "_words", "_anchors").mapInArrow(work, f"_id {kind}, _key long, {columns}")


def _first_of_kind(starts: np.ndarray, chunk: Chunk, hashed: np.ndarray, window: int, ids: list, keys: list) -> np.ndarray:
    """Whether no equal window starts earlier in the texts of the chunk."""
    rank = np.empty(len(ids), dtype=np.int64)
    rank[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], keys[i]))] = np.arange(len(ids))
    value = runs(hashed, window)[starts] if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((starts, rank[chunk.doc[starts]], value))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = value[order][1:] != value[order][:-1]
    first = np.empty(len(starts), dtype=bool)
    first[order] = new
    return first


_COLUMNS = (("_starts", pa.list_(pa.int32())), ("_run", pa.int64()), ("_words", pa.string()), ("_start", pa.int32()), ("_n", pa.int32()), ("_at", pa.int32()))


def _batch(ids: pa.Array, keys: pa.Array, rows: tuple[np.ndarray, dict]) -> pa.RecordBatch:
    docs, given = rows
    docs = pa.array(docs, pa.int64())
    arrays = [given[name].cast(kind) if name in given else pa.nulls(len(docs), kind) for name, kind in _COLUMNS]
    return pa.RecordBatch.from_arrays([ids.take(docs), keys.take(docs), *arrays], ["_id", "_key", *[name for name, _ in _COLUMNS]])


def _by_doc(chunk: Chunk, starts: np.ndarray) -> tuple[np.ndarray, dict]:
    docs, cut = np.unique(chunk.doc[starts], return_index=True)
    places = pa.array((starts - chunk.first[chunk.doc[starts]]).astype(np.int32))
    return docs, {"_starts": pa.ListArray.from_arrays(pa.array(np.append(cut, len(starts)).astype(np.int32)), places)}


def _by_run(chunk: Chunk, starts: np.ndarray, rare: np.ndarray, found: np.ndarray, window: int) -> tuple[np.ndarray, dict]:
    # windows of one run lie side by side; one that is known to be later splits them
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (rare[1:] != rare[:-1]) | (starts[1:] != starts[:-1] + 1)
    cut = np.flatnonzero(new)
    low, n, at = starts[cut], np.diff(np.append(cut, len(starts))), rare[cut]
    spans = zip(chunk.start[low].tolist(), chunk.end[low + n - 1 + window - 1].tolist(), strict=True)
    return chunk.doc[low], {
        "_run": pa.array(found[at].view(np.int64)), "_words": pa.array([chunk.data[s:e].tobytes() for s, e in spans], pa.binary()),
        "_start": pa.array(low - chunk.first[chunk.doc[low]]), "_n": pa.array(n), "_at": pa.array(at - low),
    }


def suffix_order(words: np.ndarray, starts: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of windows, and for each how many words it shares with the one before.

    A window is read from its rarest run on to its end, then the place of the run, then what stands before the run: so all
    suffixes of a group start with the words of the run, and equal suffixes are equal windows. ``words``: a number for each word.
    """
    code = np.unique(words, return_inverse=True)[1].reshape(-1).astype(np.int32)
    column = np.arange(window + 1)
    right = (window - at)[:, None]
    place = np.where(column < right, (starts + at)[:, None] + column, starts[:, None] + column - right - 1)
    rows = code[np.clip(place, 0, max(0, len(code) - 1))]
    np.put_along_axis(rows, right, -1 - at[:, None].astype(np.int32), axis=1)
    keys = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).reshape(-1)
    order = np.argsort(keys, kind="stable")
    rows = rows[order]
    shared = np.zeros(len(rows), dtype=np.int64)
    shared[1:] = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    return order, shared


def deep_nodes(shared: np.ndarray, depth: int) -> np.ndarray:
    """The number of the topmost inner node at least ``depth`` deep that is above each sorted suffix; a suffix below none has a number of its own."""
    return np.cumsum(shared < depth)


def later_in_group(table: pa.Table, window: int, out: pa.Schema) -> pa.Table:
    """Builds the subtree of a group and returns its windows that do not come first: _id, _key, _starts (one in each)."""
    runs_n, start = table.column("_n").to_numpy(), table.column("_start").to_numpy()
    row = np.repeat(np.arange(len(table)), runs_n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(runs_n) - runs_n, runs_n)
    base, words = np.zeros(len(table), dtype=np.int64), []
    total = done = 0
    for chunk in chunks(table.column("_words")):
        base[done : done + len(chunk.rows)] = total + chunk.first[:-1]
        words.append(chunk.hashes(lower=False))
        total, done = total + len(chunk.start), done + len(chunk.rows)
    order, shared = suffix_order(np.concatenate(words), base[row] + step, table.column("_at").to_numpy()[row] - step, window)
    node = np.empty(len(row), dtype=np.int64)
    node[order] = deep_nodes(shared, window + 1)
    ids, keys = table.column("_id").combine_chunks(), table.column("_key").to_numpy()
    named = ids.dictionary_encode()
    values = named.dictionary
    rank = np.empty(len(values) + 1, dtype=np.int64)
    rank[pa.compute.sort_indices(values).to_numpy()] = np.arange(1, len(values) + 1)
    rank[-1] = 0  # null ids come first
    by_id = rank[named.indices.fill_null(len(values)).to_numpy()][row] if len(table) else np.zeros(0, np.int64)
    sort = np.lexsort((start[row] + step, keys[row], by_id, node))
    later = np.zeros(len(row), dtype=bool)
    later[1:] = node[sort][1:] == node[sort][:-1]
    gone = np.sort(sort[later])
    at = row[gone]
    cut = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    places = pa.array((start[at] + step[gone]).astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)).astype(np.int32)), places)
    rows = pa.array(at[cut])
    return pa.Table.from_arrays([ids.take(rows), pa.array(keys).take(rows), lists], schema=out)


def later_windows(suffixes: DataFrame, window: int, group_windows: int) -> DataFrame:
    """(_id, _key, _starts) of all windows but the first of each kind.

    The run is the prefix by which suffixes are dealt out, several to a group of about ``group_windows``; a run with more
    windows than that gives way to the longest prefix, the whole window, of which the first is found by an aggregate.
    """
    some = suffixes.where(F.col("_run").isNotNull())
    loads = some.groupBy("_run").agg(F.sum("_n").alias("_load"))
    heavy = stored(loads.where(F.col("_load") > group_windows).select(F.col("_run").alias("_heavy")), "heavy")
    groups = max(1, -(-(some.agg(F.sum("_n")).first()[0] or 0) // group_windows))
    kind = suffixes.schema["_id"].dataType
    out = pa.schema([("_id", to_arrow_type(kind)), ("_key", pa.int64()), ("_starts", pa.list_(pa.int32()))])

    def work(table: pa.Table) -> pa.Table:
        return later_in_group(table, window, out)

    split = not heavy.isEmpty()
    light = some.join(heavy, F.col("_run") == F.col("_heavy"), "left_anti") if split else some
    dealt = light.select("_id", "_key", "_words", "_start", "_n", "_at", F.pmod(F.xxhash64("_run"), F.lit(groups)).alias("_group"))
    found = dealt.groupBy("_group").applyInArrow(work, f"_id {kind.simpleString()}, _key long, _starts array<int>")
    found = found.unionAll(suffixes.where(F.col("_starts").isNotNull()).select("_id", "_key", "_starts"))
    if not split:
        return found
    listed = some.join(heavy, F.col("_run") == F.col("_heavy"), "left_semi").withColumn("_w", F.split("_words", " "))
    wide = listed.select("_id", "_key", "_start", "_w", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i", "_j"))
    wide = wide.select("_id", "_key", (F.col("_start") + F.col("_i")).alias("_start"), F.array_join(F.slice("_w", F.col("_i") + 1, window), " ").alias("_window"))
    place = F.struct(F.col("_id").alias("i"), F.col("_key").alias("k"), F.col("_start").alias("s"))
    firsts = wide.groupBy("_window").agg(F.min(place).alias("_first")).withColumnRenamed("_window", "_win")
    many = wide.join(firsts, F.col("_window") == F.col("_win")).where(~place.eqNullSafe(F.col("_first")))
    return found.unionAll(many.select("_id", "_key", F.array("_start").alias("_starts")))


def cut(texts: DataFrame, window: int) -> DataFrame:
    """(_id, _key, _removed, _kept): ``texts`` without the words that windows at ``_starts`` cover."""
    kind = texts.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                part = batch.column(3).slice(chunk.rows.start, len(chunk.rows))
                flat, owner = part.flatten().to_numpy(), np.repeat(np.arange(len(part)), pa.compute.list_value_length(part).to_numpy())
                delta = np.zeros(len(chunk.start) + 1, dtype=np.int64)
                np.add.at(delta, flat + chunk.first[owner], 1)
                np.add.at(delta, flat + chunk.first[owner] + window, -1)
                stay = np.cumsum(delta)[:-1] == 0
                removed, kept = [], []
                for a, b in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True):
                    at = a + np.flatnonzero(stay[a:b])
                    removed.append(b - a - len(at))
                    kept.append(b" ".join(chunk.data[s:e].tobytes() for s, e in zip(chunk.start[at], chunk.end[at], strict=True)))
                ids, keys = (batch.column(k).slice(chunk.rows.start, len(chunk.rows)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["_id", "_key", "_removed", "_kept"])

    return texts.select("_id", "_key", "_words", "_starts").mapInArrow(work, f"_id {kind}, _key long, _removed long, _kept string")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and the kept words joined by one space, ``kept``."""
    text_batches(docs.sparkSession)
    bare = F.trim(F.regexp_replace(whole(F.col(text)), SPACES, " "))
    rows = docs.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), bare.alias("_words"))
    firsts = stored(rows.groupBy("_key").agg(F.min(F.struct("_id")).alias("_first"), F.count(F.lit(1)).alias("_c")), "firsts")
    anchors = repeated_anchors(rows, window, run)
    owners = anchors.join(firsts.withColumnRenamed("_key", "_k"), F.col("_text") == F.col("_k")).select(F.col("_first._id").alias("_fid"), F.col("_text").alias("_fkey"), "_anchors")
    affected = rows.join(owners, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey"))).select("_id", "_key", "_words", "_anchors")
    affected = stored(affected.dropDuplicates(["_id", "_key"]), "affected")
    suffixes = stored(suffix_rows(affected, window, run), "suffixes")
    gone = later_windows(suffixes, window, group_windows).groupBy("_id", "_key").agg(F.flatten(F.collect_list("_starts")).alias("_starts"))
    gone = gone.withColumnsRenamed({"_id": "_gid", "_key": "_gkey"})
    touched = cut(affected.drop("_anchors").join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_key") == F.col("_gkey"))), window)
    # copies are known by narrow columns; the texts themselves meet what is changed of them once
    n_words = F.when(F.col("_words") == "", F.lit(0)).otherwise(F.length("_words") - F.length(F.translate("_words", " ", "")) + 1).cast("long")
    copied = firsts.where(F.col("_c") > 1).select(F.col("_key").alias("_ckey"), F.col("_first._id").alias("_cid"))
    narrow = rows.select("_id", "_key", n_words.alias("_removed")).where(F.col("_removed") >= window).distinct()
    lost = narrow.join(copied, F.col("_key") == F.col("_ckey")).where(~F.col("_id").eqNullSafe(F.col("_cid")))
    changed = touched.unionByName(lost.select("_id", "_key", "_removed", F.lit("").alias("_kept")))
    changed = changed.withColumnsRenamed({"_id": "_tid", "_key": "_tkey"})
    met = rows.join(changed, F.col("_id").eqNullSafe(F.col("_tid")) & (F.col("_key") == F.col("_tkey")), "left")
    return met.select(
        F.col("_id").alias(doc_id), n_words.alias("n_words"), F.coalesce("_removed", F.lit(0)).alias("n_removed"),
        F.when(F.col("_tkey").isNotNull(), F.col("_kept")).otherwise(F.col("_words")).alias("kept"),
    )
