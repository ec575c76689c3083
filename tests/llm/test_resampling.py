"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from vaneworks.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string"


def grams(text, lengths):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return ws, Counter(" ".join(ws[i : i + n]) for n in lengths for i in range(len(ws) - n + 1))


def brute(docs, target, lengths=(1,), buckets=10_000, min_words=20, percent=10, seed=2024):
    def hashed(text):
        out = Counter()
        for g, n in grams(text, lengths)[1].items():
            out[zlib.crc32(g.encode()) % buckets] += n
        return out

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(hashed(text))
    for text in target:
        t.update(hashed(text))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found = hashed(text)
        n = found.total()
        weight = sum(gain[b] * c for b, c in found.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, n, weight, weight + noise, None, len(grams(text, lengths)[0]) >= min_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(docs, target, **options):
    df = resampling.resample(docs, target, **options)
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "naïve", "中文", "\U0001f600", "d0g"]
    gaps = [" ", "  ", "\n", "-", ", ", "\x00", "__"]
    return [(i, "".join(rng.choice(vocab).title() + rng.choice(gaps) for _ in range(rng.choice([0, 5, 19, 20, 21, 80])))) for i in range(n)], [
        " ".join(rng.choice(vocab[:40]) for _ in range(30)) for _ in range(20)
    ]


@pytest.mark.parametrize("lengths", [(1,), (1, 2), (2, 3)])
def test_against_the_plain_version(spark, lengths):
    docs, target = corpus()
    docs += [(1000, None), (1001, ""), (1002, " ,. "), (1003, "long words " * 40_000), (7, docs[7][1])]
    df = spark.createDataFrame(docs, DOCS).withColumnRenamed("doc_id", "id").selectExpr("id as doc_id", "text", "1 as score", "'x' as _words").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target] + [(None,)], "text string")
    options = {"min_n": lengths[0], "max_n": lengths[-1]}
    assert found(df, bench, **options) == brute(docs, target, lengths)


def test_drawn_documents_lean_to_the_target(spark):
    docs, target = corpus(seed=5, n=600)
    rows = found(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(t,) for t in target], "text string"), percent=20)
    able = [r for r in rows if r[1] >= 20]
    drawn = [r for r in able if r[4] is not None]
    assert len(drawn) == len(able) * 20 // 100
    assert sum(r[2] for r in drawn) / len(drawn) > sum(r[2] for r in able) / len(able)


def test_repeated_rows_and_null_ids(spark):
    text = "alpha beta " * 15
    docs = [(1, text)] * 400 + [(None, text)] * 30 + [(2, text)] * 20
    df = spark.createDataFrame(docs, DOCS).repartition(6)
    bench = spark.createDataFrame([("beta",)], "text string")
    assert found(df, bench) == brute(docs, ["beta"])


def test_empty_tables_and_lengths(spark):
    none = spark.createDataFrame([], DOCS)
    assert found(none, none) == []
    docs, target = corpus(n=30)
    assert found(spark.createDataFrame(docs, DOCS), none) == brute(docs, [])
    with pytest.raises(ValueError):
        resampling.resample(none, none, min_n=2, max_n=1)


def test_spans_are_runs_of_whole_words():
    clean = resampling.collapsed("The  quick,brown\tFOX É!".encode())
    assert clean == "the quick brown fox É".encode()
    assert [m.group().decode() for m in resampling.span_pattern(3).finditer(clean, overlapped=True)] == ["the quick brown", "quick brown fox", "brown fox É"]
