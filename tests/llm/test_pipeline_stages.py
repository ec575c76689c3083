"""Stages of the pipeline by themselves, against plain versions with their own limits."""

import corpus_pipeline
from conftest import SF

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def similarity(a, b, n):
    a, b = ({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} for ws in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_copies_of_five_words_at_four_fifths(spark):
    base = [f"w{i}" for i in range(60)]
    edited = lambda *at: " ".join("changed" + str(i) if i in at else w for i, w in enumerate(base))
    rows = [(1, edited()), (2, edited(30, 31)), (3, edited(10, 30, 50)), (4, edited(2, 57))]
    # two linked at 5 words and 0.8 but not at 4 words and 0.85; one below both
    assert similarity(rows[0][1], rows[1][1], 5) >= 0.8 > 0.7 > similarity(rows[0][1], rows[2][1], 5)
    assert similarity(rows[0][1], rows[1][1], 4) < 0.85 and similarity(rows[0][1], rows[3][1], 4) < 0.85
    stay = []
    for i, text in rows:
        if all(similarity(text, other, 5) < 0.8 for j, other in rows if j < i):
            stay.append(i)
    got = sorted(r.doc_id for r in corpus_pipeline.jaccard_stage(spark, frame(spark, rows), SF).collect())
    assert got == stay == [1, 3]


def test_a_shared_passage_takes_no_unique_lines(spark):
    line = lambda tag, k: " ".join(f"{tag}{k}x{j}" for j in range(8))
    passage = [line("shared", k) for k in range(12)]
    own = [line("own", k) for k in range(4)]
    copy = [s.replace("shared3x4", "typo") for s in passage]
    rows = [
        (1, "\n".join([line("first", 0), *passage])),
        (2, "\n".join([*own, *passage])),  # less than half is left, and that is nowhere else
        (3, "\n".join([line("first", 0), *copy])),  # a near copy of 1: one line is its own
        (4, "\n".join(passage)),  # nothing is left
        (None, "\n".join([line("none", 0), line("none", 1)])),
    ]
    assert similarity(rows[1][1], rows[0][1], 5) < 0.8 < similarity(rows[2][1], rows[0][1], 5)
    out = corpus_pipeline.line_stage(spark, frame(spark, rows), SF)
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "\n".join(own), 3: copy[3], None: rows[4][1]}
    assert not [n for n in ("Python", "Arrow", "Pandas") if n in out._jdf.queryExecution().executedPlan().toString()]


def test_a_document_is_a_doc_id_with_a_text(spark):
    a, b, c = (" ".join(f"{tag}{i}" for i in range(40)) for tag in "abc")
    rows = [(1, a), (2, b), (2, b), (2, a + " z"), (None, c), (None, c), (None, "")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, frame(spark, rows), SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (None, c), (None, "")], key=repr)
