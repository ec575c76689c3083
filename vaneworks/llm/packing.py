"""Best-two-fit packing of tokenized documents into sequences of bounded length.

A document is its token ids and one id that ends it. Documents longer than a sequence are cut into pieces of a sequence's
length, the first piece taking what is over. Pieces are dealt evenly over groups; in each, sequences are filled one after
the other with the longest piece that fits, and when none fits the shortest piece in the sequence is replaced by the two
unpacked pieces that fill the widened gap best, if they fill it better.

Rows: null texts are empty, a document of the end id alone. Repeated rows are pieces of their own. A null doc_id is packed
like any other. An empty table gives no sequence. Further columns are not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.common import stored, text_batches, whole

LENGTH = 1024
END_ID = 2
#: Pieces that are packed together: the more, the fewer sequences stay partly empty.
GROUP_PIECES = 100_000
#: Longer runs of text are tokenized in one call only up to so many texts at a time.
BATCH = 256


@functools.cache
def encoder(path: str):
    """A function from texts to id arrays, for a byte-level BPE in the ``tokenizers`` format.

    Where the same vocabulary lies beside it as ranks (``.tiktoken``) the faster library reads those; the ids are equal. A
    text that this one refuses, such as one with a run of a million spaces, is encoded by ``tokenizers``.
    """
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    @functools.cache
    def tokenizer() -> Tokenizer:
        return Tokenizer.from_file(path)

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if path.endswith("byte_bpe_50k.json") and os.path.exists(ranks_path):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": 50256}
        fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def ids(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:  # its regular expressions have a bounded stack
                return tokenizer().encode(text, add_special_tokens=False).ids

        return lambda texts: [ids(t) for t in texts]
    return lambda texts: [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, in ``docs``' order."""
    kind = docs.schema[doc_id].dataType.simpleString()
    text_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(texts), BATCH):
                rows, piece, start, size, crc = [], [], [], [], []
                for i, found in enumerate(encode(texts.slice(a, BATCH).to_pylist())):
                    found.append(end_id)
                    raw = np.array(found, dtype="<u4").tobytes()
                    cut = [0, *range((len(found) - 1) % length + 1, len(found) + 1, length)]
                    for n, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        rows.append(a + i)
                        piece.append(n)
                        start.append(x)
                        size.append(y - x)
                        crc.append(zlib.crc32(raw[4 * x : 4 * y]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(doc_id, whole(F.col(text))).mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, by best-two-fit."""
    order = np.argsort(-sizes, kind="stable")
    starts = np.searchsorted(-sizes[order], -np.arange(length + 2), side="left")  # pieces of one size lie together
    left = np.bincount(sizes, minlength=length + 1)
    sequence, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    steps = np.arange(length + 1)
    floor = np.maximum.accumulate(np.where(left > 0, steps, 0))  # the largest size up to each number that is left
    number = 0
    unpacked = len(sizes)
    while unpacked:
        own: list[int] = []
        gap = length

        def take(size: int) -> None:
            left[size] -= 1
            own.append(size)
            if not left[size]:
                _lower(floor, left, size)

        while size := int(floor[gap]):
            take(size)
            gap -= size
        while gap and own:
            shortest = min(own)
            wide = gap + shortest
            first = steps[1 : wide // 2 + 1]
            first = first[left[1 : wide // 2 + 1] > 0]
            if not len(first):
                break
            second = floor[wide - first]
            good = (second >= first) & ((second > first) | (left[first] > 1))
            # two of a size need two; with one left the next smaller size takes its place and pairs with it elsewhere
            total = np.where(good, first + second, 0)
            best = int(total.argmax()) if len(total) else 0
            if total[best] <= shortest:
                break
            own.remove(shortest)
            take(int(first[best]))
            take(int(second[best]))
            if not left[shortest]:
                left[shortest] = 1
                _raise(floor, shortest)
            else:
                left[shortest] += 1
            gap = length - sum(own)
        at = 0
        for size in own:
            place = order[starts[size]]
            starts[size] += 1
            sequence[place], offset[place] = number, at
            at += size
        unpacked -= len(own)
        number += 1
    return sequence, offset


def _lower(floor: np.ndarray, left: np.ndarray, size: int) -> None:
    """The last piece of a size is gone: numbers that pointed at it point at the next smaller size."""
    end = size + int(np.argmax(floor[size:] != size)) if floor[-1] != size else len(floor)
    floor[size:end] = floor[size - 1]


def _raise(floor: np.ndarray, size: int) -> None:
    """A size is there again."""
    floor[size:] = np.maximum(floor[size:], size)


def best_two_fit(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. The groups are dealt by turns, so they hold like mixtures of sizes."""
    pieces = stored(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        held, rows, number = [], 0, 0

        def packed():
            table = pa.Table.from_batches(held).combine_chunks()
            sequence, offset = pack(table.column("length").to_numpy(), length)
            table = table.append_column("sequence_id", pa.array(sequence + (group << 40) + number)).append_column("offset", pa.array(offset))
            return table.to_batches(max_chunksize=50_000), number + int(sequence.max()) + 1

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= 2 * group_pieces:  # a partition that came out larger than asked for
                out, number = packed()
                yield from out
                held, rows = [], 0
        if rows:
            out, number = packed()
            yield from out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(groups).mapInArrow(work, f"{kinds}, sequence_id long, offset long")
