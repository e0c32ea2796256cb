"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

``normalise`` takes archives whose records lie in one gzip stream (or in any members): it inflates the
stream once, in blocks, rewrites every record as a gzip member of its own and writes a sidecar index
with each record's offset and length, so that a record can be read without the rest.

Files go through ``pyarrow.fs`` by the URI of the shared folder. A task writes under a name of its own
attempt, and only names that a finished task returned count, so lost executors leave no half archive.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import scratch_path, ship, table, written

BLOCK = 1 << 16
_DATE = "2024-01-01T00:00:00Z"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _urn(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record, not compressed: a response, or a revisit of page ``refers`` without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {''.join(url.split())}")
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if refers is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers)}",
            f"X-Refers-To-Page-Id: {refers}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(stream) -> Iterator[bytes]:
    """Blocks of a gzip file of one or more members, each inflated once; a member that isn't whole is an error."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(BLOCK):
        while data:
            begun = True
            yield z.decompress(data)  # deflate grows a block a thousandfold at most
            data = z.unused_data
            if z.eof:
                z, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of each record of an inflated stream; memory holds one record."""
    held = bytearray()
    done = False
    blocks = iter(blocks)

    def more() -> bool:
        nonlocal done
        for b in blocks:
            if b:
                held.extend(b)
                return True
        done = True
        return False

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a header")
                return
        header = parse_header(bytes(held[:end]))
        size = end + 4 + int(header["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield header, bytes(held[:size])
        del held[:size]


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write (page_id, url, payload, digest, refers_to) to archives of one gzip stream each; (path, records)."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        uri = f"{folder}/mono-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        out, z, n = None, zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, refers = (c[row].as_py() for c in batch.columns)
                if out is None:
                    system, path = _open(uri)
                    out = system.open_output_stream(path, compression=None)
                out.write(z.compress(record(page, url, payload, digest, refers)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["path", "records"])

    return written(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, records long"), "mono")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive in column ``path``: (path, index, records) of the new ones.

    An archive that breaks off raises; an empty one gives an archive and an index of no records.
    """
    ship(archives.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                name = f"{folder}/{uri.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{attempt}"
                system, source = _open(uri)
                _, target = _open(f"{name}.warc.gz")
                _, beside = _open(f"{name}.idx")
                offset, lines = 0, []
                with system.open_input_file(source) as stream, system.open_output_stream(target, compression=None) as out:
                    for header, whole in records(inflate(stream)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        lines.append(json.dumps([header["warc-record-id"], header["warc-type"], offset, len(member)]))
                        offset += len(member)
                with system.open_output_stream(beside, compression=None) as out:
                    out.write("".join(x + "\n" for x in lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([f"{name}.idx"]), pa.array([len(lines)], pa.int64())], names=["path", "index", "records"])

    return written(_spread(archives.select("path")).mapInArrow(rewrite, "path string, index string, records long"), "normal")


def _spread(paths: DataFrame) -> DataFrame:
    """Few rows of much work each, dealt evenly over tasks."""
    n = max(1, min(paths.count(), 20_000))
    return paths.repartition(n)


def read_member(stream, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record header, HTTP header, payload) of the member at an offset."""
    whole = zlib.decompress(stream.read_at(length, offset), 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    header = parse_header(head)
    http, _, payload = rest[: int(header["content-length"])].partition(b"\r\n\r\n")
    return header, parse_header(http), payload


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, member by member along the index."""
    ship(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(uri)
                _, beside = _open(index)
                with system.open_input_stream(beside) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                with system.open_input_file(path) as stream:
                    for i in range(0, max(1, len(entries)), 2000):
                        yield _answer(stream, entries[i : i + 2000])

    return _spread(archives.select("path", "index")).mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def _answer(stream, entries: list) -> pa.RecordBatch:
    rows = []
    for name, kind, offset, length in entries:
        header, http, payload = read_member(stream, offset, length)
        size, digest = int(http["content-length"]), header["warc-payload-digest"].removeprefix("sha1:")
        if header["warc-record-id"] != name or header["warc-type"] != kind:
            raise ValueError("the index doesn't fit the archive")
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {name} doesn't fit its digest")
        page, refers = header.get("x-page-id"), header.get("x-refers-to-page-id")
        rows.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, small: int = 100_000) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of ``least`` bytes, all but the largest id refer to it.

    Null html is an empty payload. Rows with a null id refer to the largest id among their equals, if
    any has one. Rows that share the largest id are all responses.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = written(large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first"), "responses")
    if first.limit(small + 1).count() <= small:  # 100,000 rows of 48 bytes
        first = F.broadcast(first)
    joined = rows.join(first, F.col("digest") == F.col("same"), "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).select("page_id", "url", "payload", "digest", "refers_to")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives, normalised and read back. Null html is an empty payload; see ``revisits``."""
    folder = scratch_path(spark, "warc")
    _mkdir(spark, folder)
    pages = revisits(table(spark, sf_dir, "pages"))
    return read_archives(normalise(write_monolithic(pages, folder), folder))


def _mkdir(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
