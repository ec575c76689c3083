"""Packing of texts that the faster tokenizer refuses."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from vaneworks.llm import packing
from vaneworks.llm.queries import tokenizer_path


def test_a_run_of_more_than_a_million_spaces(spark):
    texts = ["before", "a" + " " * 1_200_000 + "b", "after"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted(packing.token_pieces(docs, tokenizer_path()).collect())
    assert [sum(r.length for r in got if r.doc_id == i) for i in range(3)] == list(map(len, want))
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
