"""Deterministic sharded WARC writer and its reader.

Records are sorted by (page_id, payload digest) and cut into shards, ranges of that order with about equal payload bytes: the
cuts are exact quantiles, found by a running sum over the narrow rows of keys, so they depend on the records alone and an outlying
id moves none of them. Each shard is one task and is written as files of gzip members, one per record, that end when their
compressed size reaches a limit. Headers are made anew from the record alone (ids are name-based, the date is a parameter), so a task that runs again writes the same
bytes. A file is written under a temporary name and renamed when it is complete; the files that count are those of the
manifest, a table with name, size and digest written last. Of records with equal payloads the smallest page_id is
the response; the others are revisits without a payload that refer to it.

Rows: a null payload is empty; a null url or page_id is left out of the header. A null page_id comes first and never is what
others refer to, unless all of its kind are null: then they are responses. Rows with equal page_id and payload are responses
all, if the first of their kind, and lie in one shard, however many they are: it is written as a stream, one record in memory.
Ids are whole numbers or strings (any characters); others come back as strings. A very long payload is one record, the unit that
must fit into memory. Further columns, whatever their names, are not written. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaneworks.llm.common import drop_stored, new_path, stored, text_batches, whole

ROLL_BYTES = 32_000_000
SHARD_BYTES = 64_000_000
#: Shards grow beyond their wanted size before there are more of them: their first keys are sent to every task.
MAX_SHARDS = 65_536
#: What a record's headers count for when shards are cut.
HEADER_BYTES = 500
#: Records with fewer payload bytes are never revisits.
MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("6f0c8e2e-3b5a-5d0e-9a77-2f6d1c0b4a11")
_READ = 1 << 20
_ROWS = "page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int, date: str = DATE) -> bytes:
    """One record with its headers, uncompressed. ``refers_to``: the page whose payload this one repeats."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    lines.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {quote(str(refers_to))}"]
    if page_id is not None:
        lines.append(f"X-Page: {quote(str(page_id))}")
    lines += [f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without a time stamp or a name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def digests(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """The narrow rows (_page, _sha1, _size) that repeats and shards are found by."""
    payload = whole(F.col(html))
    return pages.select(F.col(page_id).alias("_page"), F.sha1(payload.cast("binary")).alias("_sha1"), F.octet_length(payload).cast("long").alias("_size"))


def records(pages: DataFrame, known: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """The pages with their digests (_kind 1), and before those that repeat a payload a row that says which (_kind 0, _refers).

    Only digests meet to find the repeats; the payloads themselves are moved once, to their shards.
    """
    known = known.where(F.col("_size") >= min_bytes)
    named = known.groupBy("_sha1").agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_c"))
    firsts = named.where((F.col("_c") > 1) & F.col("_first").isNotNull()).select(F.col("_sha1").alias("_s2"), "_first")
    again = known.join(firsts, F.col("_sha1") == F.col("_s2")).where(~F.col("_page").eqNullSafe(F.col("_first")))
    none = F.lit(None).cast("string")
    told = again.select("_page", "_sha1", "_size", none.alias("_url"), none.alias("_html"), F.col("_first").alias("_refers"), F.lit(0).alias("_kind")).distinct()
    own = F.lit(None).cast(pages.schema[page_id].dataType)
    bare = pages.select(F.col(page_id).alias("_page"), F.col(url).cast("string").alias("_url"), whole(F.col(html)).alias("_html"))
    made = bare.withColumn("_sha1", F.sha1(F.col("_html").cast("binary"))).withColumn("_size", F.octet_length("_html").cast("long"))
    return made.select("_page", "_sha1", "_size", "_url", "_html", own.alias("_refers"), F.lit(1).alias("_kind")).unionAll(told)


def _key(page, digest: str) -> tuple:
    return (page is not None, 0 if page is None else page, digest)


def shard_starts(known: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (page, digest) of each shard, in order: at most ``MAX_SHARDS`` keys, ``shard_bytes`` of records or one key apart.

    The keys are sorted over all partitions and written once, so that the partitions that are counted are those that are cut;
    the bytes before a partition come from one sum per partition.
    """
    keys = known.groupBy("_page", "_sha1").agg(F.sum(F.col("_size") + HEADER_BYTES).alias("_bytes"))
    laid = stored(keys.repartitionByRange("_page", "_sha1").withColumn("_part", F.spark_partition_id()), "warc-keys")
    offsets, total = [], 0
    for part, size in sorted(map(tuple, laid.groupBy("_part").agg(F.sum("_bytes")).collect())):
        offsets.append((part, total))
        total += size
    wanted = max(shard_bytes, -(-total // MAX_SHARDS))
    before = F.broadcast(known.sparkSession.createDataFrame(offsets, "_part int, _offset long"))
    earlier = Window.partitionBy("_part").orderBy("_page", "_sha1").rowsBetween(Window.unboundedPreceding, -1)
    place = F.floor((F.col("_offset") + F.coalesce(F.sum("_bytes").over(earlier), F.lit(0))) / wanted)
    cut = laid.join(before, "_part").withColumn("_shard", place)
    starts = cut.groupBy("_shard").agg(F.min(F.struct("_page", "_sha1")).alias("k")).collect()
    drop_stored(laid)
    return [tuple(r["k"]) for r in sorted(starts, key=lambda r: r["_shard"])]


def shard_of(starts: list[tuple]):
    """Arrow UDF from (page, digest) to the number of its shard; only these two narrow columns reach Python."""
    keys = [_key(*s) for s in starts]

    @F.arrow_udf("int")
    def place(pages: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([max(bisect_right(keys, _key(*k)) - 1, 0) for k in zip(pages.to_pylist(), found.to_pylist(), strict=True)], pa.int32())

    return place


def write_warc(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES,
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write the archive below ``out``; returns the manifest: file, shard, records, bytes, sha256."""
    spark = pages.sparkSession
    text_batches(spark)
    known = stored(digests(pages, page_id, html), "warc-digests")
    starts = shard_starts(known, shard_bytes)
    rows = records(pages, known, page_id, url, html, min_bytes).withColumn("_shard", shard_of(starts)("_page", "_sha1"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(out)
        store.create_dir(base, recursive=True)
        shard, stream = None, None
        done: list[tuple] = []

        def start() -> None:
            nonlocal stream, name, temporary, count, size, digest
            name = f"part-{shard:06d}-{number:05d}.warc.gz"
            temporary = f"{base}/.{name}.{uuid.uuid4().hex}.tmp"
            stream, count, size, digest = store.open_output_stream(temporary), 0, 0, hashlib.sha256()

        def finish() -> None:
            nonlocal stream, number
            if stream is not None:
                stream.close()
                store.move(temporary, f"{base}/{name}")
                done.append((name, shard, count, size, digest.hexdigest()))
                stream, number = None, number + 1

        repeats: tuple = (None, None, None)
        name = temporary = ""
        number = count = size = 0
        digest = hashlib.sha256()
        for batch in batches:
            for r in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                page, address, text, length, sha1, refers, kind, own = r
                if kind == 0:
                    repeats = (page, sha1, refers)
                    continue
                if repeats[:2] == (page, sha1):
                    refers = repeats[2]
                if own != shard:
                    finish()
                    shard, number = own, 0
                if stream is None:
                    start()
                member = gzip_member(record(page, address, (text or "").encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), refers, length, date))
                stream.write(member)
                digest.update(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "records", "bytes", "sha256"])

    columns = ("_page", "_url", "_html", "_size", "_sha1", "_refers", "_kind", "_shard")
    laid = rows.select(*columns).repartitionById(max(len(starts), 1), "_shard").sortWithinPartitions("_shard", "_page", "_sha1", "_kind", "_url")
    manifest = laid.mapInArrow(work, "file string, shard int, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{out}/_manifest")
    drop_stored(known)
    return spark.read.parquet(f"{out}/_manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of a file, one in memory at a time."""
    data = stream.read(_READ)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data and not (data := stream.read(_READ)):
                raise ValueError("the file ends inside a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]
        data = data or stream.read(_READ)


def read_warc(spark: SparkSession, out: str, id_type: str = "bigint") -> DataFrame:
    """The records of the files of the manifest; digests are those of the payloads found, for revisits the one referred to."""
    files = spark.read.parquet(f"{out}/_manifest").select("file")
    numeric = id_type in ("bigint", "int", "smallint", "tinyint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(out)

        def to_id(told: str | None):
            return None if told is None else int(told) if numeric else unquote(told)

        kinds = pa.int64() if numeric else pa.string()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[tuple] = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in _records(stream):
                        revisit = headers["WARC-Type"] == "revisit"
                        told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        digest = told if revisit else base32_sha1(block)
                        if digest != told or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: a digest differs")
                        size = int(headers["X-Payload-Length"]) if revisit else len(block)
                        held.append((to_id(headers.get("X-Page")), size, digest, headers["WARC-Type"], to_id(headers.get("X-Refers-To-Page"))))
                        if len(held) >= 20_000:
                            yield _batch(held, kinds)
                            held = []
                yield _batch(held, kinds)

    schema = _ROWS.format(id="bigint" if numeric else "string")
    return files.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(work, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.string(), kind)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive(pages: DataFrame, out: str | None = None, **options) -> DataFrame:
    """Write the pages and read them back."""
    out = out or new_path(pages.sparkSession, "warc")
    write_warc(pages, out, **options)
    return read_warc(pages.sparkSession, out, pages.schema[options.get("page_id", "page_id")].dataType.simpleString())
