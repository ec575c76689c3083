"""PartEnum join, components and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vaneworks.llm import part_enum, substring_dedup
from vaneworks.llm.components import components
from vaneworks.llm.tokens import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, n=4):
    ws = WORD.findall(lower(text or ""))
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def near_texts(seed, groups=25, copies=7):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    texts = ["", None, " \n", "a", "A", "a b", "a b c", "a\tb\vc", "É a", "é a"]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 8, 12, 25, 60, 150, 400]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    return texts


def links(sets):
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and 100 * common >= 85 * (len(a) + len(b) - common):
                out.append((i, j))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_link_shares_a_signature(seed):
    texts = near_texts(seed)
    owners = {}
    for chunk in chunks(pa.array(texts), 3000):
        values, first = part_enum.doc_sets(chunk, 4)
        assert np.diff(first).tolist() == [len(shingles(texts[i])) for i in chunk.rows]
        doc, sig = part_enum.signatures(values, first, 85)
        for d, s in zip(doc.tolist(), sig.tolist(), strict=True):
            owners.setdefault(d + chunk.rows.start, set()).add(s)
    found = links([shingles(t) for t in texts])
    assert len(found) > 50 and all(owners[i] & owners[j] for i, j in found)


def brute_components(ids, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))
    for i, j in links(sets):
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    least = {}
    for r, i in zip(root, ids, strict=True):
        least[r] = min(least.get(r, i), i)
    return [(i, len(s), least[r]) for i, s, r in zip(ids, sets, root, strict=True)]


@pytest.mark.parametrize("elements", [400_000, 300])
def test_components_equal_brute_force(spark, elements):
    texts = near_texts(7)
    rng = random.Random(9)
    ids = rng.sample(range(10_000), len(texts))
    frame = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, component_id int")
    got = part_enum.similarity_components(frame, group_elements=elements).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(ids, texts))


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (5, long), (4, long + " x"), (7, None), (7, "a B c d e")]
    got = part_enum.similarity_components(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (5, 29_997, 4), (4, 29_998, 4), (7, 0, 7), (7, 2, 1)], key=repr)
    assert part_enum.similarity_components(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, 301), (301, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {300: 300, 301: 300}
    assert got == want


def brute_substrings(rows, window):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ws = WORD.findall(text or "")
        gone = set()
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out.append((doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def passage_rows(seed):
    rng = random.Random(seed)
    own = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    shared = [own(n) for n in (20, 21, 60, 90, 19)]
    rows = []
    for i in range(150):
        parts = [own(rng.choice([0, 3, 30, 90])) for _ in range(3)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((i, " ".join(parts)))
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(600, None), (601, ""), (602, "z " * 200), (603, "z " * 300), (604, "a b " * 50), (None, shared[2]), (605, own(4000) + " " + shared[3])]
    return rows


@pytest.mark.parametrize("group_windows", [50_000, 300, 3])
def test_substrings_equal_brute_force(spark, group_windows):
    rows = passage_rows(3)
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_words int").repartition(5)
    got = substring_dedup.substring_dedup(frame, group_windows=group_windows).collect()
    assert sorted(map(tuple, got), key=repr) == brute_substrings(rows, 20)


def test_substrings_of_repeated_rows_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text), (1, text), (2, text), (2, "short")]
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (2, 25)]
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_deep_nodes():
    # windows of three words at 0, 3, 6, 9; the run starts at their second word
    words = np.array([5, 6, 7, 5, 6, 7, 9, 6, 7, 5, 6, 8], dtype=np.uint64)
    order, shared = substring_dedup.suffix_order(words, np.array([0, 3, 6, 9]), np.array([1, 1, 1, 1]), 3)
    node = dict(zip(order.tolist(), substring_dedup.deep_nodes(shared, 4).tolist(), strict=True))
    assert node[0] == node[1] and len({node[0], node[2], node[3]}) == 3
    assert sorted(shared.tolist()) == [0, 1, 3, 4]


def test_word_hashes_tell_words_apart():
    texts = [" ".join(hashlib.sha1(str(i).encode()).hexdigest()[: 1 + i % 12] for i in range(5000)), "é É e", None, "a"]
    found = {}
    for chunk in chunks(pa.array(texts), 1000):
        for a, b, h in zip(chunk.start, chunk.end, chunk.hashes(lower=False).tolist(), strict=True):
            assert found.setdefault(h, chunk.data[a:b].tobytes()) == chunk.data[a:b].tobytes()
    assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_made_to_collide_do_not(spark, size):
    """Two words that any polynomial modulo 2**64 takes for one."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    (chunk,) = chunks(pa.array([f"{word} {other} {word}"]))
    a, b, c = chunk.hashes(lower=True).tolist()
    assert a != b and a == c
    docs = spark.createDataFrame([(1, word), (2, other)], "doc_id int, text string")
    assert sorted(r.component_id for r in part_enum.similarity_components(docs).collect()) == [1, 2]
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}")], "doc_id int, text string")
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs).collect()] == [0, 0]


def test_word_hashes_follow_the_word_alone():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    by_word = {}
    for gap in (" ", "\n  "):
        for size in (50, 10_000):
            for chunk in chunks(pa.array([gap.join(words), words[0]]), size):
                spans = [chunk.data[s:e].tobytes() for s, e in zip(chunk.start, chunk.end, strict=True)]
                for span, h in zip(spans, chunk.hashes(lower=False).tolist(), strict=True):
                    assert by_word.setdefault(span, h) == h
    assert len(set(by_word.values())) == len(by_word) == len(set(words))
