"""Benchmark decontamination by spaced seeds.

A mask marks which of its consecutive tokens count; the others may differ. Every placement of every mask over the
items and over the documents is hashed, equal hashes are hits, and a hit is verified: the item is laid over the document
at the hit's offset, and a document is contaminated where ``WINDOW`` consecutive tokens (the whole item if it is shorter)
agree in at least ``MIN_MATCHES`` per hundred places. Tokens are runs of letters and digits, lower-cased.

Items with fewer tokens than ``SPAN`` are too short to tell a changed copy from chance: a document is searched for the whole
item, all tokens equal and in a row, and such finds are reported apart (``short_item_ids``), without marking the document.

Rows: null texts and empty ones have no tokens, and items without a token match nothing. A very long text is hashed place by
place, and read once more for all offsets of an item that it shares a seed with. Without documents the result is empty, without
items no document is marked. A null doc_id comes back like any other. Rows with equal doc_id and text are the same document. Further columns
are left alone. Equal items, or items found twice, are all reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.common import let, text_key, upto, whole

#: Fixed masks: however the differing tokens lie in a window that passes verification, one of them finds it. The last three
#: (six tokens each) are needed for that: with the first three alone 69 of the 455 ways to change three of 15 tokens have no hit.
MASKS = ("11010110101", "10110011011", "11101001101", "1110111", "11100100011", "11011010001")
#: Shortest item that may differ from its copy, in tokens.
SPAN = 11
WINDOW = 15
MIN_MATCHES = 80
#: Broadcast the seeds of the items up to so many (24 bytes each); beyond, they meet the documents' seeds by a shuffle.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(whole(text)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[^\p{L}\p{N}]+"))


def _hashes(toks: Column) -> Column:
    return F.transform(toks, lambda w: F.xxhash64(w))


def _seed_rows(hashed: DataFrame, tokens_column: str, keys: tuple[str, ...], masks: tuple[str, ...], pos: str, first: int = 0) -> DataFrame:
    """One row per placement of a mask: the keys, the place and ``_seed``, which takes in the mask's number (from ``first`` on).

    The token hashes are zipped with themselves shifted, so a row holds a whole span and its masks are hashed in generated code.
    """
    span = max(len(m) for m in masks)
    h = F.col(tokens_column)
    shifted = F.arrays_zip(*[F.slice(h, k + 1, F.greatest(F.size(h), F.lit(1))).alias(f"t{k}") for k in range(span)])
    rows = hashed.select(*keys, F.posexplode(shifted).alias(pos, "_t"))
    seeds = []
    for m, mask in enumerate(masks, first):
        counted = [F.col(f"_t.t{k}") for k, c in enumerate(mask) if c == "1"]
        seeds.append(F.when(F.col(f"_t.t{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(m), *counted)))
    return rows.select(*keys, pos, F.explode(F.array(*seeds)).alias("_seed")).where(F.col("_seed").isNotNull())


def item_seeds(items: DataFrame, item_id: str, text: str, masks: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Item tokens, and one row per seed hash: _seed, _item, _ikey, _ipos."""
    hashed = items.select(F.col(item_id).alias("_item"), text_key(F.col(text)).alias("_ikey"), _hashes(tokens(F.col(text))).alias("_ih")).distinct()
    return hashed, _seed_rows(hashed.where(F.size("_ih") >= SPAN), "_ih", ("_item", "_ikey"), masks, "_ipos")


def hits(docs: DataFrame, seeds: DataFrame, doc_id: str, text: str, masks: tuple[str, ...], small: bool) -> DataFrame:
    """Offsets at which an item shares a seed with a document: _id, _key, _item, _ikey, _off."""
    hashed = docs.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), _hashes(tokens(F.col(text))).alias("_h"))
    rows = _seed_rows(hashed, "_h", ("_id", "_key"), masks, "_dpos")
    met = rows.join(F.broadcast(seeds) if small else seeds, "_seed")
    return met.select("_id", "_key", "_item", "_ikey", (F.col("_dpos") - F.col("_ipos")).alias("_off")).distinct()


def overlap(doc: Column, item: Column, off: Column, window: int = WINDOW) -> Column:
    """The best window of the item laid over the document at ``off``: struct(matches, size, start in the document)."""
    def best(flags: Column) -> Column:
        size = F.least(F.lit(window), F.size(item))
        sums = F.transform(upto(F.size(flags) - size + 1), lambda i: F.struct(F.aggregate(F.slice(flags, i + 1, size), F.lit(0), lambda a, b: a + b).alias("matches"), (-(i + F.greatest(off, F.lit(0)))).alias("back")))
        top = F.array_max(sums)
        return F.struct(top["matches"].alias("matches"), size.alias("size"), (-top["back"]).alias("start"))

    # places of the item that lie inside the document; item place p stands at document place p + off
    first, last = F.greatest(-off, F.lit(0)), F.least(F.size(item), F.size(doc) - off)
    flags = F.transform(upto(last - first), lambda k: (F.get(doc, k + first + off) == F.get(item, k + first)).cast("int"))
    return let(flags, best)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  masks: tuple[str, ...] = MASKS, window: int = WINDOW, min_matches: int = MIN_MATCHES, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per verified overlap of a document and an item: _id, _key, item_id, start (token of the document), matches, size."""
    hashed, seeds = item_seeds(items, item_id, item_text, masks)
    small = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    found = hits(docs, seeds, doc_id, text, masks, small).groupBy("_id", "_key", "_item", "_ikey").agg(F.collect_set("_off").alias("_offs"))
    held = hashed.withColumnsRenamed({"_item": "_item2", "_ikey": "_ikey2"})
    found = found.join(F.broadcast(held) if small else held, F.col("_item").eqNullSafe(F.col("_item2")) & (F.col("_ikey") == F.col("_ikey2")))
    found = found.select("_id", "_key", "_item", "_ikey", "_offs", "_ih")
    texts = docs.select(F.col(doc_id).alias("_id2"), text_key(F.col(text)).alias("_key2"), F.col(text).alias("_text"))
    met = found.join(texts, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")))

    def top(doc: Column) -> Column:
        laid = F.transform("_offs", lambda off: overlap(doc, F.col("_ih"), off, window))
        return F.array_max(F.transform(laid, lambda o: F.struct(o["matches"].alias("m"), (-o["start"]).alias("s"), o["size"].alias("z"))))

    laid = met.select("_id", "_key", "_item", "_ikey", let(_hashes(tokens(F.col("_text"))), top).alias("_o"))
    best = laid.where(100 * F.col("_o.m") >= min_matches * F.col("_o.z")).groupBy("_id", "_key", "_item", "_ikey").agg(F.max("_o").alias("_b"))
    return best.select("_id", "_key", F.col("_item").alias("item_id"), (-F.col("_b.s")).alias("start"), F.col("_b.m").alias("matches"), F.col("_b.z").alias("size"))


def short_finds(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Items of fewer than ``SPAN`` tokens that a document holds as they are: _id, _key, item_id, start (its first token there).

    The mask of such an item counts all its tokens, so its one seed is the item; only the lengths that occur are placed.
    """
    hashed = items.select(F.col(item_id).alias("_item"), text_key(F.col(item_text)).alias("_ikey"), _hashes(tokens(F.col(item_text))).alias("_ih")).distinct()
    short = hashed.where(F.size("_ih").between(1, SPAN - 1))
    sizes = sorted(r[0] for r in short.select(F.size("_ih")).distinct().collect())  # at most SPAN - 1 numbers
    masks = tuple("1" * n for n in sizes) or ("1",)
    seeds = _seed_rows(short.where("false"), "_ih", ("_item", "_ikey"), masks, "_ipos")
    for m, n in enumerate(sizes):
        seeds = seeds.unionByName(_seed_rows(short.where(F.size("_ih") == n), "_ih", ("_item", "_ikey"), ("1" * n,), "_ipos", m))
    small = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    places = docs.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), _hashes(tokens(F.col(text))).alias("_h"))
    met = _seed_rows(places, "_h", ("_id", "_key"), masks, "_dpos").join(F.broadcast(seeds) if small else seeds, "_seed")
    return met.groupBy("_id", "_key", "_item", "_ikey").agg(F.min("_dpos").alias("start")).select("_id", "_key", F.col("_item").alias("item_id"), "start")


def flagged(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``contaminated``, ``item_ids`` (the items found in it, sorted) and ``short_item_ids`` (see ``short_finds``)."""
    own = ("contaminated", "item_ids", "short_item_ids")
    limits = {k: v for k, v in options.items() if k in ("item_id", "item_text", "broadcast_seeds")}
    found = contamination(docs, items, doc_id, text, **options).select("_id", "_key", "item_id", F.lit(False).alias("_short"))
    found = found.unionByName(short_finds(docs, items, doc_id, text, **limits).select("_id", "_key", "item_id", F.lit(True).alias("_short")))
    ids = [F.sort_array(F.collect_set(F.when(c, F.col("item_id")))).alias(n) for n, c in (("_items", ~F.col("_short")), ("_shorts", F.col("_short")))]
    found = found.groupBy(F.col("_id").alias("_fid"), F.col("_key").alias("_fkey")).agg(*ids, F.bool_or(~F.col("_short")).alias("_leak"))
    kept = [c for c in docs.columns if c not in own]
    met = docs.withColumn("_key", text_key(F.col(text))).join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey")), "left")
    none = F.array().cast(found.schema["_items"].dataType)
    return met.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("_leak", F.lit(False)).alias("contaminated"),
                      F.coalesce("_items", none).alias("item_ids"), F.coalesce("_shorts", none).alias("short_item_ids"))
