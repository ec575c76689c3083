"""Spelling variants against all pairs of words."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from vaneworks.llm import permuterm

WORDS = "word string, n long"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), counts.get(form.get(w), -1)) for w, n in counts.items())


def found(df, **options):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in permuterm.variant_groups(df, **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabet_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 6))): rng.choice([2, 2, 3, 20, 25, 300, 5000]) for _ in range(250)}
    assert found(spark.createDataFrame(list(counts.items()), WORDS).repartition(3)) == brute(counts)


def test_runs_of_one_letter_count_once(spark):
    counts = {"aaaa": 5, "aaaaa": 7, "aaab": 2, "baaa": 2, "aaba": 2}
    assert found(spark.createDataFrame(list(counts.items()), WORDS)) == brute(counts)


def test_chain_of_forms(spark):
    counts = {"x" * 7 + "a" * k: 10**k for k in range(12)}
    got = found(spark.createDataFrame(list(counts.items()), WORDS))
    assert got == brute(counts)
    assert {r[2] for r in got} == {"x" * 7 + "a" * 11}


def test_ties_take_the_smallest_word(spark):
    counts = {"wordada": 2, "wordadb": 50, "wordadÿ": 50, "wordadz": 50, "lonely": 9}
    assert found(spark.createDataFrame(list(counts.items()), WORDS)) == brute(counts)


def test_counts_of_texts(spark):
    long = "Lengthen " * 30_000
    rows = [(1, "Alphabet alphabet ALPHABET ÉlÉphant el×phant short"), (2, None), (3, ""), (None, "alphabet"), (4, long), (4, long), (5, "a_lphabet 123")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    counts = {r.word: r.n for r in permuterm.word_counts(docs).collect()}
    assert counts == {"alphabet": 4, "lengthen": 60_000}
    planted = {}
    for doc_id, text in rows:
        for run in (text or "").split():
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            if len(run) < 7 or "_" in run:
                continue
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            planted[run] = planted.get(run, 0) + 1
    planted["lphabet"] = planted.get("lphabet", 0) + 1  # from a_lphabet
    got = {r.word: r.n for r in permuterm.word_counts(docs, one_in=3).collect()}
    h = zlib.crc32(b"5:lphabet")
    if h % 3 == 0:
        planted["lphabet"] -= 1
    assert got == {w: n for w, n in planted.items() if n >= 2 and len(w) >= 7}


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], WORDS)) == []
    assert permuterm.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        permuterm.variant_groups(spark.createDataFrame([], WORDS), ratio=1)
