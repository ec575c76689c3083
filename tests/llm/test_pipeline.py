"""The pipeline against a plain version of its stages, over the smallest tables and odd rows."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from conftest import SF
from test_native import brute_lines, brute_repeated
from tokenizers import Tokenizer

from vaneworks.llm import quality_rules
from vaneworks.llm.queries import tokenizer_path

SPACES = r"[\x20\x09-\x0D]+"


def norm(line):
    return re.sub("[0-9]", "0", re.sub(SPACES, " ", line.lower()).strip(" "))


def plain_quality(rows):
    """rows: (doc_id, text, source); ids differ. The texts that stay, without boilerplate."""
    texts, first, every = defaultdict(set), {}, defaultdict(set)
    lines = lambda t: [(i, norm(s), s) for i, s in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", s)]
    for doc_id, text, host in sorted(rows, key=lambda r: r[0]):
        for _, line, _ in lines(text):
            texts[host, line].add(text)
            first.setdefault((host, line), doc_id)
            every[host].add(text)
    out = []
    for doc_id, text, host in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(ws) < quality_rules.MIN_WORDS or 100 * brute_repeated(ws) > 30 * len(ws):
            continue
        gone = {
            i: len(s.split()) for i, line, s in lines(text)
            if len(texts[host, line]) > quality_rules.MIN_LIMIT and 1000 * len(texts[host, line]) > quality_rules.LIMIT_PER_MILLE * len(every[host]) and first[host, line] != doc_id
        }
        if 100 * sum(gone.values()) <= quality_rules.MAX_REMOVED_PERCENT * len(ws):
            out.append((doc_id, "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone)))
    return out


def plain_lines(rows):
    left = brute_lines(rows)
    return [(d, left[d]) for d, t in rows if left[d] == t or re.search(r"[^\x20\x09-\x0D]", left[d])]


def plain_groups(rows, n=5, percent=80):
    """Of linked texts the one with the smallest doc_id; texts without a word stay."""
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [r for i, r in enumerate(rows) if least[find(i)] == r[0]]


def leaks(text, items, shortest=11, window=15, percent=80):
    """Do ``window`` consecutive tokens of an item (all, if it has fewer) agree with tokens of the text in ``percent`` of their places?"""
    toks = lambda t: re.findall(r"[^\W_]+", t.lower())
    doc = np.array([hash(w) for w in toks(text)])
    for item in items:
        own = np.array([hash(w) for w in toks(item or "")])
        size = min(window, len(own))
        if len(own) < shortest or len(doc) < size:
            continue
        for off in range(size - len(own), len(doc) - size + 1):
            a, b = max(0, -off), min(len(own), len(doc) - off)
            if b - a >= size and 100 * np.convolve(doc[a + off : b + off] == own[a:b], np.ones(size), "valid").max() >= percent * size:
                return True
    return False


def plain_pieces(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        out += [(doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out)


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    filler = lambda i: " ".join(f"own{i}x{k}" for k in range(25))
    line = "A boiler plate line of seven words"
    odd = [(10_000, None, None, None, None), (10_001, "", "en", "h", 0), (10_002, real[3][1], None, None, None), (10_003, filler(0) + " " + items[2], "en", "h", 1)]
    odd += [(11_000 + i, f"{filler(i + 1)}\n{line}", "en", "one", 1) for i in range(60)]
    # 0.8 of five-word shingles is reached by the second alone, 0.85 of four-word ones by neither
    near = lambda at: " ".join(f"near{k}" if k not in at else f"edit{k}" for k in range(60))
    odd += [(13_000, near(()), "en", "h", 1), (13_001, near((30, 31)), "en", "h", 1), (13_002, near((10, 30, 50)), "en", "h", 1)]
    rows = real + odd
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = plain_quality([(d, t, s) for d, t, _, s, _ in rows])
    assert (11_000, f"{filler(1)}\n{line}") in kept and (11_001, filler(2)) in kept
    kept = plain_lines(kept)
    lined = kept
    kept = plain_groups(lined)
    assert dict(kept)[13_000] == near(()) and 13_001 not in dict(kept) and 13_002 in dict(kept)
    assert kept != plain_groups(lined, n=4, percent=85) and kept != plain_groups(lined, percent=70)
    kept = [(d, t) for d, t in kept if not leaks(t, items)]
    assert 10_003 not in dict(kept) and len(kept) > 100

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(kept)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024


def test_stages_of_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (7, "x " * 40, None, None, None), (7, "x " * 40, None, None, None)], docs.schema)
    for table in (docs.limit(0), extra):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.count() <= 3
            if name != "best_fit_packing":
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
