"""Toxicity, packing, WARC archives and secret scans."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF
from tokenizers import Tokenizer

from vaneworks.llm import automata, packing, secret_scan, toxicity, warc
from vaneworks.llm.common import new_path
from vaneworks.llm.queries import QUERIES, tokenizer_path
from vaneworks.llm.tokens import chunks


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_automaton_on_trie_equals_edit_distance():
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 10))): 1.0 for _ in range(60)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(3, 11)))
        k = toxicity.allowed_edits(len(word))
        if word in terms:
            continue
        near = [e for t in terms if 1 <= (e := edits(word, t)) <= min(k, toxicity.allowed_edits(len(t)))]
        assert lexicon._near(word, k) == (1 / min(near) if near else 0)


def test_weights_of_terms_and_stems_equal_edit_distance():
    rng = random.Random(8)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 10))) + rng.choice(["", "", "*"]): float(rng.randint(1, 9)) for _ in range(25)}
    lexicon = toxicity.Lexicon(terms)
    fuzzy = 0
    for _ in range(4000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(3, 12)))
        exact = [w for t, w in terms.items() if word == t or (t[-1] == "*" and len(word) >= len(t) and word.startswith(t[:-1]))]
        near = [0.0]
        for t, w in terms.items():
            bare = t.rstrip("*")
            k = min(toxicity.allowed_edits(len(word)), toxicity.allowed_edits(len(bare)))
            e = min(edits(word[:i], bare) for i in range(len(word))) if t[-1] == "*" else edits(word, bare)
            if max(1, e) <= k:
                near.append(w / max(1, e))
        assert lexicon.weight(word) == (max(exact) if exact else toxicity.MISSPELLED * max(near)), word
        fuzzy += not exact and max(near) > 0
    assert fuzzy > 150


def test_misspelled_ends_and_stems_are_found():
    lexicon = toxicity.Lexicon({"pathetic": 2.0, "vermin*": 4.0})
    assert lexicon.weight("aathetie") == toxicity.MISSPELLED * 1.0
    assert {lexicon.weight(w) for w in ("vermnins", "virmins", "vrminous")} == {toxicity.MISSPELLED * 4.0}


def test_hits_and_context():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "lowe*": 1.0})
    plain, addressed, quoted = (toxicity.features(t, lexicon) for t in ("what an idiot here", "you are an idiot", 'they said "idiot" there'))
    assert plain[0] > 0 and addressed[1] > plain[0] and 0 < quoted[2] < plain[0]
    assert toxicity.features("such an idiott", lexicon)[3] == pytest.approx(2.0 * toxicity.MISSPELLED)
    assert toxicity.features("loweren", lexicon)[3] == 1.0 and toxicity.features("lowe", lexicon)[3] == 0
    assert toxicity.features("", lexicon) == toxicity.features("nice day", lexicon)


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        ws = [rng.choice(["red", "tree", "house", "walk", "over", "river"]) for _ in range(40)]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            ws[rng.randrange(40)] = rng.choice(["vileterm", "nastyword", f"grumx{rng.choice(['en', 'et', 'is'])}"])
        rows.append((i, " ".join(ws), 1))
        labels.append((i, int(bad)))
    rows += [(1000, None, 1), (None, "vileterm", 1), (1001, "", 1), (1001, "", 1), (1002, "vileterrm " * 3000, 1)]
    labels += [(5000, 1), (None, 1), (3, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id int, text string, score int"), spark.createDataFrame(labels, "doc_id int, toxic int")
    model = toxicity.fit(docs.where("doc_id < 400"), marks)
    assert {"vileterm", "nastyword"} <= set(model.terms) and any(t.startswith("grum") and t.endswith("*") for t in model.terms)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert sum(by[i] == (i % 4 == 0) for i in range(400, 600)) >= 195
    assert by[None] == 1 and by[1000] == by[1001] == 0 and by[1002] == 1
    assert toxicity.score(docs.limit(0), model).collect() == []
    bare = toxicity.fit(docs.limit(0), marks)
    assert {r.predicted for r in toxicity.score(docs, bare).collect()} <= {0, 1}


def test_toxicity_query_scores_all(spark):
    got = QUERIES["op2_toxicity"](spark, SF).collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_ids_equal_those_of_tokenizers():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "a<|endoftext|>b", "  \n\n x y \t", "é" * 50, "don't DON'T 123 ７ ½", " " * 3000, "x" * 3000, "\x00\x01", "👩‍👩‍👧 ok"]
    assert packing.encoder(tokenizer_path())(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_packs_are_valid_and_dense(n):
    sizes = np.minimum(64, np.random.default_rng(n).geometric(1 / 20, n))
    sequence, offset = packing.pack(sizes, 64)
    for s in range(sequence.max() + 1):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == [0, *np.cumsum(sizes[own])[:-1].tolist()] and sizes[own].sum() <= 64
    assert sequence.max() + 1 <= -(-int(sizes.sum()) // 64) * 1.02 + 1


def test_two_pieces_replace_the_shortest():
    # 50 + 12 leave 2 over; 12 gives way to 8 and 6
    sequence, _ = packing.pack(np.array([50, 12, 8, 6]), 64)
    assert sequence[0] == sequence[2] == sequence[3] != sequence[1]


def test_packing_of_documents(spark):
    rows = [(1, "hello world " * 900, 3), (2, None, 3), (3, "", 3), (3, "", 3), (None, "a b", 3), (4, "word " * 1022 + "word", 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, length int")
    got = packing.best_two_fit(packing.token_pieces(docs, tokenizer_path())).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    assert packing.best_two_fit(packing.token_pieces(docs.limit(0), tokenizer_path())).collect() == []


def page_rows():
    rows = [(i, f"http://x/{i}", f"<p>page {i % 7}</p>" if i % 3 else f"<b>é {i}</b>" * 50) for i in range(200)]
    return [*rows, (900, None, None), (901, "u", ""), (902, "u\r\nX: y", None), (None, "u", "<p>page 1</p>"), (950, "u", "z" * 200_000), (950, "u", "z" * 200_000)]


def test_archive_equals_the_pages(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload_bytes string")
    got = sorted(map(tuple, warc.archive(pages, roll_bytes=3000, shard_bytes=9000).collect()), key=repr)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        other = None if first[html or ""] == i else first[html or ""]
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if other is None else "revisit", other))
    assert got == sorted(want, key=repr)
    assert warc.archive(pages.limit(0)).collect() == []


def test_archive_is_deterministic_and_standard(spark):
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    runs = []
    for parts in (1, 6):
        out = new_path(spark, "warc")
        manifest = warc.write_warc(pages.repartition(parts), out, roll_bytes=3000, shard_bytes=9000)
        files = {r.file: (r.records, r.bytes, r.sha256) for r in manifest.collect()}
        runs.append(files)
        for name, (records, size, digest) in files.items():
            with open(f"{out.removeprefix('file://')}/{name}", "rb") as f:
                data = f.read()
            assert len(data) == size and hashlib.sha256(data).hexdigest() == digest
            assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == records
    assert runs[0] == runs[1] and len(runs[0]) > 5


def test_archive_of_string_ids(spark):
    ids = ["b", "", "a b/é\r\nX-Page: 7", None, "%41", "A"]
    pages = spark.createDataFrame([(i, "u", "same" if n % 2 else f"own {n}") for n, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    want = {i: ("response", None) if n % 2 == 0 or i == "" else ("revisit", "") for n, i in enumerate(ids)}
    assert got == want


def test_shards_are_even_beside_an_outlying_id(spark):
    """Three hundred pages, an id far away, a third of all pages without an id: every shard but the heaviest key stays near the limit."""
    rows = [(i, f"u{i}", f"{i:04d}" * 250) for i in range(300)] + [(2**62, "u", "far")] + [(None, f"n{i}", f"{i:05d}" * 200) for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    known = warc.digests(pages, "page_id", "html")
    starts = warc.shard_starts(known, 30_000)
    total = sum(len(r[2]) + warc.HEADER_BYTES for r in rows)
    assert len(starts) == -(-total // 30_000) and starts[0][0] is None
    sizes = {}
    for r in known.withColumn("s", warc.shard_of(starts)("_page", "_sha1")).collect():
        sizes[r.s] = sizes.get(r.s, 0) + r._size + warc.HEADER_BYTES
    assert sorted(sizes) == list(range(len(starts))) and max(sizes.values()) <= 30_000 + 1500
    assert len(warc.archive(pages, shard_bytes=30_000).collect()) == len(rows)


def scanned(texts):
    scanner = secret_scan.scanner_for(secret_scan.RULES)
    out = []
    for chunk in chunks(pa.array(texts), 4000):
        points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
        found = [[] for _ in chunk.rows]
        for k, a, b in scanner.spans(chunk.data, chunk.bounds):
            t = int(np.searchsorted(chunk.bounds, a, side="right")) - 1
            found[t].append((int(points[a] - points[chunk.bounds[t]]), k, int(points[b] - points[chunk.bounds[t]])))
        out += [sorted(f) for f in found]
    return out


def expected(text):
    out = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(f"({rule.head})({rule.tail}+)", text):
            if len(m.group(2) if rule.counts == "tail" else m.group()) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_equal_the_rules():
    rng = random.Random(8)
    parts = ["token", "PassWord", "passwd", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "\n", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "x",
             "==", ".", "ghp_", "A" * 36, "xoxb-", "-", "token=abcdefghijkl", "👍", ",", "_", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 10, 40]))) for _ in range(4000)] + ["a" * 100_000, "token" + " " * 500 + "= abcdefghijklm"]
    assert scanned(texts) == [expected(t) for t in texts]


@pytest.mark.parametrize("rule", ["ab*c", "(?i:key|Kex)[0-9]{2,3}", "[^a]b?", "x(y|z)+"])
def test_automaton_accepts_what_the_rule_matches(rule):
    machine = automata.compile_rules([rule], anywhere=False)
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("abcxyzkKeyX012") for _ in range(rng.randint(0, 6)))
        state = 0
        for b in text.encode():
            state = machine.moves[state, b]
        assert bool(machine.accepts[state]) == bool(re.fullmatch(rule, text))


def test_scan_of_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "password = 'abcdefghijkl'", 0), (3, "é AKIA" + "B" * 14, 0), (3, "é AKIA" + "B" * 14, 0)]
    got = secret_scan.scan_digest(secret_scan.scan(spark.createDataFrame(rows, "doc_id int, text string, found int"))).collect()
    assert sorted([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in got], key=repr) == sorted(
        [(1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (None, 1, 0, 0, "assign:0:24"), (3, 0, 1, 0, "access:2:20"), (3, 0, 1, 0, "access:2:20")], key=repr)
    assert {r.base_sha256 for r in got if r.doc_id is None} == {hashlib.sha256(b"assign:0:24").hexdigest()}


def test_scan_query_equals_the_rules(spark):
    import duckdb

    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())
    for r in QUERIES["op8_secret_scan"](spark, SF).collect():
        assert r.spans == ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in expected(texts[r.doc_id]))


def test_a_hundred_rules_are_all_found(spark):
    rules = tuple(secret_scan.Rule(f"k{i}", f"r{i}x", "[0-9]", 8) for i in range(100))
    texts = [(i, f"see r{i}x123456 and r{(i * 7 + 3) % 100}x9876543, r{i}x1") for i in range(100)]
    got = secret_scan.scan(spark.createDataFrame(texts, "doc_id int, text string"), rules=rules).collect()
    for r in got:
        want = []
        for rule in rules:
            want += [(m.start(), rule.kind, m.end()) for m in re.finditer(f"{rule.head}{rule.tail}+", texts[r.doc_id][1]) if m.end() - m.start() >= 8]
        assert sorted((s.start, s.kind, s.end) for s in r.found) == sorted(want) and len(want) >= 1


def test_every_shipped_rule_against_re(spark):
    rng = random.Random(1)
    alphabet = "ABCXYZabcdefxyz0123456789_-./= "
    heads = {"assign": ["password=", 'API_KEY" : "'], "hex": [""], "json_token": ["eyJab_9.eyJ"], "private_key": ["-----BEGIN "]}
    texts = []
    for rule in secret_scan.RULES:
        sample = heads.get(rule.kind) or [re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"\(([^|)]*)[^)]*\)", r"\1", rule.head))]
        pool = [c for c in alphabet + "defDEF" if re.fullmatch(rule.tail, c)]
        for n in (rule.least - 12, rule.least, rule.least + 30):
            texts.append(" é " + rng.choice(sample) + "".join(rng.choice(pool) for _ in range(max(1, n))) + rng.choice(["", " ", '"', "é"]) + rng.choice(sample))
    got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    found = set()
    for r in got:
        want = []
        for rule in secret_scan.RULES:
            for m in re.finditer(f"(?:{rule.head})((?:{rule.tail})+)", texts[r.doc_id]):
                if len(m.group(m.lastindex)) >= rule.least if rule.counts == "tail" else m.end() - m.start() >= rule.least:
                    want.append((m.start(), rule.kind, m.end()))
        assert sorted((s.start, s.kind, s.end) for s in r.found) == sorted(want), texts[r.doc_id]
        found |= {k for _, k, _ in want}
    assert found == {rule.kind for rule in secret_scan.RULES}
