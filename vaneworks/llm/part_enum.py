"""Jaccard self-join of shingle sets by PartEnum signatures, and the components of its links.

Sets of words are cut into size bands. For two sets of neighbouring bands that reach the threshold, the number of
elements in just one of them is at most k, a number that follows from the bands. The domain is dealt into n > k parts;
at least n - k parts hold the same elements of both sets, so the two share the signature of one of them: the hash of a
set's elements in a part, for a subset of the parts of size one. Parts without elements give no signature: a set with
fewer empty parts than n - k has a shared part that is not empty; one with more is dealt again by other seeds until it
has fewer, and so is any partner that it could have missed. No link is lost.

Sets that share a signature are first held against each other by a sketch, the parities of the numbers of elements in
some 0.6 to 1.3 bits for each element: it tells a lower bound of the elements in just one of two sets, so no link is lost, and the
sets of a part that many share by chance go apart. Each set meets the least of its signature; where one of them fails, all
pairs of that signature are tried. What is left is held against each other exactly: the sets are gathered in groups of bounded size, by
component of the candidate graph, and, where those are large, by bands and blocks of it. In a group a prefix index in
order of rareness finds the pairs to count; pairs already joined are passed over.

Rows: null texts and texts without words have no set and link with nothing. Rows with equal sets, copies and repeated rows
among them, are one class, known by 64 bits of its set, and are held against others once. A null doc_id takes part; a component of nulls only
has a null component_id. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.common import drop_stored, stored, text_batches
from vaneworks.llm.components import components
from vaneworks.llm.tokens import Chunk, chunks, group_sets, mix

SHINGLE = 4
THRESHOLD = 85
#: A group of sets held against each other has at most about so many elements (twice that for two blocks).
GROUP_ELEMENTS = 400_000
#: Signatures of more sets are searched set by set, and pairs already joined passed over; those of fewer pair by pair.
PAIRWISE = 32
#: Sketches are held against each other in groups of whole signatures of about so many bytes and rows.
SKETCH_BYTES, SKETCH_ROWS = 16_000_000, 100_000
_M32 = np.uint64(0xFFFFFFFF)


def band_bounds(threshold: int, top: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band: sets that reach the threshold lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * 100 // threshold + 1)
    return np.array(out, dtype=np.int64)


def instance_shape(bounds: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For the pairs of each band with itself and the next: how many elements may differ, and the number of parts."""
    largest = bounds[1:-1] - 1 + bounds[2:] - 1
    k = largest * (100 - threshold) // (100 + threshold)
    return k, k + 1 + k // 12


def doc_sets(chunk: Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of the chunk, and where each text's begin; fewer words than a shingle are one element."""
    hashed = chunk.hashes(lower=True)
    grams, at = chunk.ngrams(hashed, shingle)
    docs, values = [chunk.doc[at]], [grams]
    counts = np.diff(chunk.first)
    for n in range(1, shingle):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            short = np.full(len(rows), n, dtype=np.uint64)
            for k in range(n):
                short = mix(short ^ hashed[chunk.first[rows] + k])
            docs.append(rows)
            values.append(short)
    return group_sets(np.concatenate(docs), np.concatenate(values), len(chunk.rows))


def _sums(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values by key, wrapping: in halves, each exact in a double for up to 2**21 values of a key."""
    low = np.bincount(key, (value & _M32).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(key, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def class_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits of each set, whatever the order of its elements."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    return mix(_sums(doc, mix(values ^ np.uint64(0x5851F42D4C957F2D)), n) + np.diff(first).astype(np.uint64)).view(np.int64)


def sketches(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of each set's elements by the low bits of their hashes, as 64-bit words, and where each set's begin.

    The number of bits is a power of two that follows from the size; one half of the words xor the other is the sketch of half the bits.
    """
    sizes = np.diff(first)
    words = np.where(sizes > 0, 1 << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) * 0.625)) - 6).astype(np.int64), 0)
    at = np.concatenate([[0], np.cumsum(words)])
    bit = mix(values ^ np.uint64(0x8EBC6AF09C88C6E3)) & np.repeat(words * 64 - 1, sizes).astype(np.uint64)
    odd = np.bincount(np.repeat(at[:-1] * 64, sizes) + bit.astype(np.int64), minlength=int(at[-1]) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8"), at


def sketches_allow(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, words: np.ndarray, first: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets ``a[i]`` and ``b[i]`` can reach the threshold: True for all that do, and for few others."""
    length = np.diff(first)
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    out = 100 * small >= threshold * large
    width = np.minimum(length[a], length[b])

    def folded(sets: np.ndarray, to: int) -> np.ndarray:
        found = np.empty((len(sets), to), dtype=np.uint64)
        for n in np.unique(length[sets]).tolist():
            rows = np.flatnonzero(length[sets] == n)
            x = words[first[sets[rows], None] + np.arange(n)]
            while x.shape[1] > to:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            found[rows] = x
        return found

    for n in np.unique(width[out]).tolist():
        of = np.flatnonzero(out & (width == n))
        step = max(1, 500_000 // n)
        for i in range(0, len(of), step):
            pairs = of[i : i + step]
            differ = np.bitwise_count(folded(a[pairs], n) ^ folded(b[pairs], n)).sum(axis=1, dtype=np.int64)
            out[pairs] = differ * (100 + threshold) <= (small[pairs] + large[pairs]) * (100 - threshold)
    return out


def signatures(values: np.ndarray, first: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of all sets: (set number, 64 bits)."""
    bounds = band_bounds(threshold)
    differ, parts = instance_shape(bounds, threshold)
    sizes = np.diff(first)
    band = np.searchsorted(bounds, sizes, side="right") - 1
    content = mix(values ^ np.uint64(0xA0761D6478BD642F))
    out_doc, out_sig = [], []
    for back in (0, 1):
        todo = np.flatnonzero((sizes > 0) & (band - back >= 0))
        seed = 0
        while len(todo):
            inst = band[todo] - back
            n = parts[inst]
            base = np.concatenate([[0], np.cumsum(n)])
            picked = np.repeat(np.arange(len(todo)), sizes[todo])
            at = np.repeat(first[todo] - np.concatenate([[0], np.cumsum(sizes[todo])[:-1]]), sizes[todo]) + np.arange(len(picked))
            dealt = mix(values[at] + np.uint64((seed * 2 + 1) * 0xE7037ED1A0B428DB % (1 << 64))) >> np.uint64(32)
            part = ((dealt * n[picked].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            key = base[picked] + part
            total = int(base[-1])
            filled = np.bincount(key, minlength=total) > 0
            owner = np.repeat(np.arange(len(todo)), n)
            number = np.arange(total) - base[owner]
            tag = (inst[owner] * 64 + seed).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            sig = mix(_sums(key, content[at], total) + mix(tag))
            out_doc.append(todo[owner[filled]])
            out_sig.append(sig[filled])
            empty = np.bincount(owner[~filled], minlength=len(todo))
            todo, seed = todo[empty >= n - differ[inst]], seed + 1
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_doc), np.concatenate(out_sig).view(np.int64)


def class_rows(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """Per row: _id, _cls (null without a set), _n, _bits (the set's sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                values, first = doc_sets(chunk, shingle)
                sizes = np.diff(first)
                ids = batch.column(0).slice(chunk.rows.start, len(chunk.rows))
                words, at = sketches(values, first)
                bits = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(class_ids(values, first), mask=sizes == 0), pa.array(sizes.astype(np.int64)), bits], ["_id", "_cls", "_n", "_bits"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"_id {kind}, _cls long, _n long, _bits binary")


def signature_rows(docs: DataFrame, text: str, shingle: int, threshold: int) -> DataFrame:
    """(_sig, _cls) of every set; a class once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                values, first = doc_sets(chunk, shingle)
                ids = class_ids(values, first)
                fresh = np.zeros(len(ids), dtype=bool)
                for i, (c, size) in enumerate(zip(ids.tolist(), np.diff(first).tolist(), strict=True)):
                    if size and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                sizes = np.where(fresh, np.diff(first), 0)
                keep = np.repeat(fresh, np.diff(first))
                doc, sig = signatures(values[keep], np.concatenate([[0], np.cumsum(sizes)]), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ids[doc])], ["_sig", "_cls"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "_sig long, _cls long")


def _linked(ids: np.ndarray, values: np.ndarray, first: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join the sets of a group: a spanning forest of all pairs at the threshold."""
    n = len(ids)
    sizes = np.diff(first)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), sizes)
    by_rareness = np.lexsort((code, count[code], doc))
    code = code[by_rareness]
    root = np.arange(n)
    lists: dict[int, list[int]] = {}
    marked = np.zeros(len(count), dtype=bool)
    out: list[tuple[int, int]] = []
    for x in np.lexsort((ids, sizes)).tolist():
        own = code[first[x] : first[x + 1]]
        size = len(own)
        prefix = own[: size - -(-threshold * size // 100) + 1]
        prefix = prefix[count[prefix] > 1].tolist()
        near = [lists[t] for t in prefix if t in lists]
        if near:
            found = np.unique(np.concatenate([np.array(y) for y in near]))
            found = found[(root[found] != root[x]) & (100 * sizes[found] >= threshold * size)]
            if len(found):
                marked[own] = True
                span = sizes[found]
                at = np.repeat(first[found] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
                common = np.add.reduceat(marked[code[at]].astype(np.int64), np.concatenate([[0], np.cumsum(span)[:-1]]))
                marked[own] = False
                for y in found[100 * common >= threshold * (size + span - common)].tolist():
                    if root[y] != root[x]:
                        out.append((int(ids[x]), int(ids[y])))
                        root[root == root[y]] = root[x]
        for t in prefix:
            lists.setdefault(t, []).append(x)
    return out


def _words(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of a column of sketches, and where each one's begin."""
    if isinstance(bits, pa.ChunkedArray):
        bits = bits.combine_chunks()
    bits = bits.cast(pa.large_binary())
    at = np.frombuffer(bits.buffers()[1], dtype=np.int64)[bits.offset : bits.offset + len(bits) + 1]
    return np.frombuffer(bits.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].copy().view("<u8"), (at - at[0]) // 8


def _held(sig: np.ndarray, cls: np.ndarray, sizes: np.ndarray, words: np.ndarray, first: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs of classes of one signature whose sketches allow the threshold: enough to join the same ones as all of them do."""
    order = np.lexsort((cls, sizes, sig))
    order = order[np.concatenate([[True], (np.diff(sig[order]) != 0) | (np.diff(cls[order]) != 0)])]  # rows that repeat go
    sig, begin = sig[order], np.flatnonzero(np.concatenate([[True], np.diff(sig[order]) != 0]))
    end = np.append(begin[1:], len(sig))
    few = np.repeat(end - begin <= PAIRWISE, end - begin)
    out = [np.zeros((0, 2), np.int64)]
    for d in range(1, min(PAIRWISE, int((end - begin).max()))):
        i = np.flatnonzero((sig[:-d] == sig[d:]) & few[:-d])
        a, b = order[i], order[i + d]
        near = sketches_allow(a, b, sizes, words, first, threshold)
        out.append(np.stack([cls[a[near]], cls[b[near]]], axis=1))
    for i in np.flatnonzero(end - begin > PAIRWISE).tolist():
        own = order[begin[i] : end[i]]
        root = np.arange(len(own))
        upto = np.searchsorted(sizes[own], sizes[own] * 100 // threshold, side="right")
        for x in range(len(own) - 1):
            others = x + 1 + np.flatnonzero(root[x + 1 : upto[x]] != root[x])
            others = others[sketches_allow(np.full(len(others), own[x]), own[others], sizes, words, first, threshold)]
            roots, at = np.unique(root[others], return_index=True)
            if len(at):
                out.append(np.stack([np.full(len(at), cls[own[x]]), cls[own[others[at]]]], axis=1))
                root[np.isin(root, roots)] = root[x]
    return np.unique(np.concatenate(out), axis=0)


def candidate_edges(docs: DataFrame, classes: DataFrame, text: str, shingle: int, threshold: int) -> DataFrame:
    """(a, b), stored: classes that share a signature and whose sketches allow the threshold, enough to join all such pairs."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                (wa, fa), (wb, fb) = _words(batch.column(3)), _words(batch.column(5))
                sizes = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()])
                near = sketches_allow(np.arange(n), n + np.arange(n), sizes, np.concatenate([wa, wb]), np.concatenate([fa, fa[-1] + fb[1:]]), threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["a", "b", "near"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> pa.RecordBatch:
            words, first = _words(rows["_bits"])
            pairs = _held(*(rows[c].to_numpy() for c in ("_sig", "_cls", "_n")), words, first, threshold)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        kept, n, size, enough = [], 0, 0, (SKETCH_ROWS, SKETCH_BYTES)
        for batch in batches:
            if batch.num_rows:
                kept, n, size = [*kept, batch], n + batch.num_rows, size + batch.nbytes
            if n >= enough[0] or size >= enough[1]:
                rows = pa.Table.from_batches(kept)
                last = int(np.searchsorted(rows["_sig"].to_numpy(), rows["_sig"][n - 1].as_py()))  # the last signature may go on
                if last:
                    yield found(rows.slice(0, last))
                kept = rows.slice(last).combine_chunks().to_batches()
                n, size = sum(x.num_rows for x in kept), sum(x.nbytes for x in kept)
                enough = (n + SKETCH_ROWS, size + SKETCH_BYTES)
        if n:
            yield found(pa.Table.from_batches(kept))

    sigs = signature_rows(docs, text, shingle, threshold)
    sigs = sigs.select("_sig", "_cls", F.expr("min(_cls) over (partition by _sig)").alias("_least"), F.expr("max(_cls) over (partition by _sig)").alias("_most"))
    sigs = sigs.where("_least != _most").withColumn("_more", F.expr("max(_cls not in (_least, _most)) over (partition by _sig)"))
    shared = stored(sigs.where("_more or _cls != _least").select("_sig", "_cls", "_least", "_more"), "shared")
    edges = shared.where("_cls != _least").select(F.col("_cls").alias("a"), F.col("_least").alias("b")).distinct()
    for end in "ab":
        edges = edges.join(classes.select(F.col("_cls").alias(end), F.col("_n").alias(f"_n{end}"), F.col("_bits").alias(f"_x{end}")), end)
    with_least = stored(edges.select("a", "b", "_na", "_xa", "_nb", "_xb").mapInArrow(tried, "a long, b long, near boolean"), "tried")
    # where a class can't be near the least one of a signature, the others of that signature are held against each other
    several = shared.where("_more")
    apart = with_least.where("not near")
    mixed = several.join(apart, (F.col("_cls") == F.col("a")) & (F.col("_least") == F.col("b")), "left_semi").select("_sig").distinct()
    members = several.select("_sig", "_cls").join(mixed, "_sig", "left_semi").join(classes.select("_cls", "_n", "_bits"), "_cls")
    rest = members.repartition("_sig").sortWithinPartitions("_sig").select("_sig", "_cls", "_n", "_bits").mapInArrow(held, "a long, b long")
    found = stored(with_least.where("near").select("a", "b").union(rest).distinct(), "candidates")
    drop_stored(shared)
    drop_stored(with_least)
    return found


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD,
                          group_elements: int = GROUP_ELEMENTS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    text_batches(docs.sparkSession)
    rows = stored(class_rows(docs, doc_id, text, shingle), "classes")
    classes = stored(rows.where(F.col("_cls").isNotNull()).groupBy("_cls").agg(F.min("_id").alias("_first"), F.max("_n").alias("_n"), F.max("_bits").alias("_bits")), "members")
    candidates = candidate_edges(docs, classes, text, shingle, threshold)
    gathered = components(candidates)
    links = stored(_links(docs, classes, gathered, doc_id, text, shingle, threshold, group_elements), "links")
    drop_stored(candidates)
    drop_stored(gathered)
    labels = components(links)
    named = classes.join(labels, classes["_cls"] == labels["node"], "left").select("_cls", "_first", F.coalesce("root", "_cls").alias("_root"))
    smallest = named.groupBy("_root").agg(F.min("_first").alias("_component")).withColumnRenamed("_root", "_r")
    known = stored(named.join(smallest, F.col("_root") == F.col("_r")).select(F.col("_cls").alias("_c"), "_component"), "known")
    for done in (classes, links, labels):
        drop_stored(done)
    met = rows.join(known, rows["_cls"] == known["_c"], "left")
    return met.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_shingles"), F.when(F.col("_cls").isNull(), F.col("_id")).otherwise(F.col("_component")).alias("component_id"))


def _links(docs: DataFrame, classes: DataFrame, gathered: DataFrame, doc_id: str, text: str, shingle: int, threshold: int, group_elements: int) -> DataFrame:
    """The links (a, b) among the candidates, each group held against itself."""
    bounds = F.array(*[F.lit(int(b)) for b in band_bounds(threshold)])
    member = classes.join(gathered, classes["_cls"] == gathered["node"]).select("_cls", "_first", "_n", F.col("root").alias("_group"))
    member = member.withColumn("_band", F.size(F.filter(bounds, lambda b: b <= F.col("_n"))))
    loads = member.groupBy("_group", "_band").agg(F.sum("_n").alias("_load"))
    blocks = loads.select("_group", F.struct(F.col("_band").alias("band"), F.ceil(F.col("_load") / group_elements).cast("int").alias("blocks")).alias("_b"), "_load")
    blocks = blocks.groupBy("_group").agg(F.map_from_entries(F.collect_list("_b")).alias("_blocks"), F.sum("_load").alias("_load"))
    blocks = blocks.withColumnRenamed("_group", "_g")
    met = member.join(blocks, F.col("_group") == F.col("_g"))

    def of(band):
        return F.coalesce(F.try_element_at("_blocks", band), F.lit(0))

    # a block of a band meets every block of its band and of the next; small groups are one block
    mine = F.pmod(F.xxhash64("_cls"), of(F.col("_band"))).cast("int")
    here, up, down = of(F.col("_band")), of(F.col("_band") + 1), of(F.col("_band") - 1)

    def span(n):
        return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))

    def key(kind, band, i, j):
        return F.struct(F.lit(kind).alias("kind"), band.alias("band"), i.alias("i"), j.alias("j"))

    same = F.transform(span(here), lambda j: key(1, F.col("_band"), F.least(j, mine), F.greatest(j, mine)))
    above = F.transform(span(up), lambda j: key(2, F.col("_band"), mine, j))
    below = F.transform(span(down), lambda j: key(2, F.col("_band") - 1, j, mine))
    one = F.array(key(0, F.lit(0), F.lit(0), F.lit(0)))
    keys = F.when(F.col("_load") <= group_elements, one).otherwise(F.concat(same, above, below))
    tasks = met.select("_cls", F.col("_first").alias("_id"), "_group", F.explode(keys).alias("_task"))
    texts = docs.select(F.col(doc_id).alias("_id2"), F.col(text).cast("string").alias("_text"))
    # of rows with one doc_id only those whose set is the class are wanted; the group drops the others
    joined = tasks.groupBy("_id", "_cls").agg(F.collect_list(F.struct("_group", "_task")).alias("_to")).join(texts, F.col("_id").eqNullSafe(F.col("_id2")))
    sent = joined.select("_cls", "_text", F.explode("_to").alias("_t")).select("_cls", "_text", F.xxhash64("_t").alias("_key"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sets = [], []
        wanted = pdf["_cls"].to_numpy()
        at = 0
        for chunk in chunks(pa.array(pdf["_text"], pa.large_string())):
            values, first = doc_sets(chunk, shingle)
            right = class_ids(values, first) == wanted[at : at + len(chunk.rows)]
            for i in np.flatnonzero(right).tolist():
                ids.append(int(wanted[at + i]))
                sets.append(values[first[i] : first[i + 1]])
            at += len(chunk.rows)
        if len(ids) < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        ids, once = np.unique(np.array(ids, dtype=np.int64), return_index=True)
        sets = [sets[i] for i in once.tolist()]
        found = _linked(ids, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return sent.groupBy("_key").applyInPandas(run, "a long, b long")
