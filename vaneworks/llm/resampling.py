"""Importance resampling towards a target: hashed n-gram counts of corpus and target weigh each document, and a seeded
Gumbel draw takes a share of the documents.

A text is lower-cased (A-Z), its separators become single spaces, and one overlapped regular expression per length, held to
word borders by lookarounds, gives the span of every run of that many words; its bytes' CRC is its bucket. Buckets are counted
over all texts of both tables. A document weighs the mean gain of its features, and the highest of weight + noise are drawn.

The texts are read once: buckets and counts of each document are written to the shared folder beside the sums of each task, of
which the driver gets one number a bucket. The order of the draw is a global index over range partitions.

Rows: a null text has no words, like an empty one; both have weight 0 and are not drawn. A text is held by one task, whole and
however long. Of equal scores the smaller doc_id comes first, a null one last; repeated rows are drawn one by one. Empty tables count nothing. Further
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.common import drop_stored, stored, text_batches
from vaneworks.operators.scale import row_index

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Separators are the bytes below 0x80 that are neither digits nor lower-case letters; A-Z are lower-cased before.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_GAPS = regex.compile(rb" +")


def span_pattern(n: int) -> regex.Pattern:
    """Runs of n words of a text whose separators are single spaces, each from the start of a word to the end of one."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def collapsed(text: bytes) -> bytes:
    return _GAPS.sub(b" ", text.translate(_CLEAN)).strip(b" ")


def feature_counts(text: bytes, patterns: list[regex.Pattern], buckets: int = BUCKETS) -> tuple[int, dict[int, int]]:
    """(number of words, occurrences by bucket) of a text."""
    clean = collapsed(text)
    found: Counter[int] = Counter()
    for pattern in patterns:
        for span, n in Counter(m.group() for m in pattern.finditer(clean, overlapped=True)).items():
            found[zlib.crc32(span) % buckets] += n
    return clean.count(b" ") + 1 if clean else 0, found


def counted(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id", min_n: int = 1, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Stored features: a row per document (_id, _words, _n, _bucket and _count as int arrays), and one per task with _sums over its documents."""
    if not 1 <= min_n <= max_n:
        raise ValueError("lengths of features run from min_n, at least 1, to max_n")
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [span_pattern(n) for n in range(min_n, max_n + 1)]
        sums = np.zeros(buckets, dtype=np.int64)
        kinds, names = (id_type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())), ["_id", "_words", "_n", "_bucket", "_count", "_sums"]
        for batch in batches:
            words, totals, places, counts = [], [], [], []
            for value in batch.column(1):
                n_words, found = feature_counts((value.as_py() or "").encode(), patterns, buckets)
                bucket, count = np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.int64, len(found))
                sums[bucket] += count
                words.append(n_words)
                totals.append(int(count.sum()))
                places.append(bucket)
                counts.append(count)
            columns = [batch.column(0), *[pa.array(c, k) for c, k in zip((words, totals, places, counts, [None] * len(words)), kinds[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((None, None, None, None, None, sums), kinds, strict=True)], names)

    ids = F.col(doc_id) if doc_id else F.lit(None).cast("long")
    rows = docs.select(ids.alias("_id"), F.col(text).cast("string").alias("_text"))
    name = rows.schema["_id"].dataType.simpleString()
    id_type = pa.string() if name == "string" else {"int": pa.int32(), "bigint": pa.int64()}[name]
    return stored(rows.mapInArrow(run, f"_id {name}, _words long, _n long, _bucket array<int>, _count array<long>, _sums array<long>"), "features")


def bucket_sums(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences by bucket over all documents: one number a bucket reaches the driver."""
    sums = np.zeros(buckets, dtype=np.int64)
    rows = features.where(F.col("_sums").isNotNull()).select(F.posexplode("_sums").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n"))
    for b, n in rows.collect():
        sums[b] = n
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log ratio of target to corpus by bucket, each count raised by one."""
    buckets = len(corpus)
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def weighed(features: DataFrame, gain: list[int]) -> DataFrame:
    """(_id, _words, _n, _weight) of each document: the floored mean gain of its features, 0 without any."""
    by_bucket = np.array(gain, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, count, n = batch.column(3), batch.column(4), batch.column(2).to_numpy()
            first = np.asarray(bucket.offsets)
            parts = by_bucket[bucket.values.to_numpy()] * count.values.to_numpy()
            total = np.concatenate([[0], np.cumsum(parts)])
            weight = (total[first[1:]] - total[first[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)], ["_id", "_words", "_n", "_weight"])

    ids = features.schema["_id"].dataType.simpleString()
    rows = features.where(F.col("_sums").isNull()).select("_id", "_words", "_n", "_bucket", "_count")
    return rows.mapInArrow(run, f"_id {ids}, _words long, _n long, _weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel draw that follows from seed and doc_id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", min_n: int = 1, max_n: int = 1,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, and rank (1 is drawn first; null when not drawn).

    ``percent`` of the documents with ``min_words`` words are drawn, rounded down.
    """
    features = counted(docs, text, doc_id, min_n, max_n, buckets)
    wanted = counted(target, target_text, None, min_n, max_n, buckets)
    gain = gains(bucket_sums(features, buckets), bucket_sums(wanted, buckets))
    rows = weighed(features, gain).select(
        F.col("_id").alias(doc_id), F.col("_n").alias("n_features"), F.col("_weight").alias("weight"),
        (F.col("_weight") + noise(F.col("_id"), seed)).alias("score"), (F.col("_words") >= min_words).alias("_able"),
    )
    scored = stored(rows, "scored")
    drop_stored(features)
    drop_stored(wanted)
    able = scored.where("_able")
    drawn = percent * able.count() // 100
    # rows that are equal in score and id are told apart by their place in the stored table, so that they need not be one task's
    able = able.withColumns({"_down": -F.col("score"), "_last": F.col(doc_id).isNull(), "_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    ranked = row_index(able, ["_down", "_last", doc_id, "_file", "_row"], "_at")
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("long")
    columns = [doc_id, "n_features", "weight", "score"]
    rest = scored.where(~F.col("_able")).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).unionByName(rest)
