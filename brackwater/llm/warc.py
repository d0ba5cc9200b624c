r"""WARC archives: written by tasks, read back sequentially.

Every page becomes one record and every record one gzip member. The reader goes through an
archive from start to end: it inflates member after member with an incremental zlib
decompressor, frames the block by Content-Length, and verifies block and payload digests. Of
records with equal payloads of some size or more the one with the largest page_id is the
response; the others are revisits that refer to it and hold headers only.

Archives are files in a folder that all executors share. A task writes its rows in the order of
their page_id, in files of a bounded size, under a name that is final only when the file is
whole, so a task that runs again replaces its own files with the same bytes. Reading takes bounded
memory for any length of archive and payload; writing holds one page and one file's packed bytes.

Defined results: a null html is an empty payload; a null url is written as an empty target; equal
rows are written each, and all rows that share the winning page_id and payload are responses;
rows with a null page_id are written and read with a null, win over nothing and revisit the
winner where there is one; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import scratch_path, table

LEAST = 1000
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
#: More bytes of headers than a record may have. A target is as long as its page's url.
HEAD_BYTES = 64 << 20
ROWS = 2048
DATE = "2024-01-01T00:00:00Z"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class DigestError(ValueError):
    """A record's bytes don't give the digest that its header names."""


def tagged(sha) -> str:
    return "sha1:" + base64.b32encode(sha.digest()).decode()


def digest(data: bytes) -> str:
    return tagged(hashlib.sha1(data))


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP headers, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        *([f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"WARC-Payload-Digest: {digest(payload)}",
        f"WARC-Block-Digest: {digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class Member:
    """One gzip member, inflated as far as it is asked for: never more than some ``chunk`` bytes ahead."""

    def __init__(self, source: Source, chunk: int):
        self.source, self.chunk, self.inflate, self.ready = source, chunk, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        """Inflates the next bytes; false at the member's end."""
        while not self.inflate.eof:
            packed = self.inflate.unconsumed_tail or self.source.take()
            if not packed:
                raise EOFError("the archive ends inside a record")
            out = self.inflate.decompress(packed, self.chunk)
            if out:
                self.ready += out
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes before ``mark``, which is skipped; a ValueError where it doesn't come within ``most`` bytes."""
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if len(self.ready) > most or not self._more():
                raise ValueError(f"no end of headers: {bytes(self.ready[:40])!r}")
        head = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return head

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, piece by piece; fewer where the member ends before."""
        while size and (self.ready or self._more()):
            piece = bytes(self.ready[:size])
            del self.ready[:size]
            size -= len(piece)
            yield piece

    def rest(self) -> bytes:
        """What is left of the member, a few bytes at most; what follows it goes back to the source."""
        while len(self.ready) <= 4 and self._more():
            pass
        if self.inflate.eof:
            self.source.give_back(self.inflate.unused_data)
        return bytes(self.ready)


class Source:
    """A stream read in chunks, of which the last can be given back in part."""

    def __init__(self, stream, chunk: int):
        self.stream, self.chunk, self.left = stream, chunk, b""

    def take(self) -> bytes:
        got, self.left = self.left or self.stream.read(self.chunk), b""
        return got

    def give_back(self, data: bytes) -> None:
        self.left = data


def members(stream, chunk: int = CHUNK) -> Iterator[Member]:
    """The gzip members of a stream, one after the other; each is to be read to its end before the next."""
    source = Source(stream, chunk)
    while first := source.take():
        source.give_back(first)
        yield Member(source, chunk)


def headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data.decode("utf-8", "replace").split("\r\n"))}


def read_archive(stream, keep: bool = True) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record.

    A record's block goes by in pieces that both digests take up; only with ``keep`` are they held, else the
    payload is None and a record of any length takes bounded memory.
    """
    for member in members(stream):
        head = member.until(b"\r\n\r\n", HEAD_BYTES)
        version, _, lines = head.partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        h = headers(lines)
        size = int(h["content-length"])
        whole, own, http, parts, came = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        inside = False  # past the block's own headers
        for piece in member.pieces(size):
            came += len(piece)
            whole.update(piece)
            if not inside:
                http += piece
                http, mark, piece = http.partition(b"\r\n\r\n")
                inside = bool(mark)
                if not inside:
                    if len(http) > HEAD_BYTES:
                        raise ValueError(f"{h['warc-record-id']}: no end of headers")
                    continue
            own.update(piece)
            if keep:
                parts.append(piece)
        if came != size or member.rest() != b"\r\n\r\n":
            raise ValueError(f"{h['warc-record-id']}: the block is not framed by its Content-Length")
        kind = h["warc-type"]
        if tagged(whole) != h["warc-block-digest"] or kind == "response" and tagged(own) != h["warc-payload-digest"]:
            raise DigestError(h["warc-record-id"])
        numbers = [h.get(k, "<urn:page:>")[10:-1] for k in ("warc-record-id", "warc-refers-to")]
        page_id, refers_to = (int(x) if x else None for x in numbers)
        full = int(headers(http.partition(b"\r\n")[2])["content-length"])
        yield page_id, full, base64.b32decode(h["warc-payload-digest"][5:]).hex(), kind, refers_to, b"".join(parts) if keep else None


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): what each page's record says."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    # short payloads have a key of their own, so that they aren't all dealt to one task
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.xxhash64("payload", "url")))
    rows = rows.withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload")).otherwise(alone))
    winners = rows.filter(F.length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1 and winner is not null").select("sha", "winner")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.join(winners, "sha", "left").select("page_id", "url", "payload", F.when(revisit, F.col("winner")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages as ``*.warc.gz`` files below ``folder``; gives (file, n_records, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        buffer, n, at, done = io.BytesIO(), 0, 0, []

        def close() -> None:
            nonlocal n, at
            name = f"part-{part:06d}-{at:04d}.warc.gz"
            with store.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                out.write(buffer.getbuffer())
            store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            done.append((name, n, buffer.tell()))
            buffer.seek(0)
            buffer.truncate()
            n, at = 0, at + 1

        for batch in batches:
            for i in range(batch.num_rows):
                buffer.write(record(*(batch.column(c)[i].as_py() for c in range(5))))
                n += 1
                if buffer.tell() >= file_bytes:
                    close()
        if n:
            close()
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["file", "n_records", "n_bytes"])

    dealt = planned(pages, least).sortWithinPartitions("page_id", "url", "payload")
    return dealt.mapInArrow(run, "file string, n_records long, n_bytes long")


def read_archives(spark, folder: str) -> DataFrame:
    """The records of all archives in ``folder``, as ``READ`` columns. Archives are read in parallel, each from its
    start to its end through an open stream; no archive and no payload is held whole.

    Spark's file source lists the archives and deals them to the tasks by their lengths; contents aren't in its plan.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None) as stream:
                    rows: list[tuple] = []
                    for found in read_archive(stream, keep=False):
                        rows.append(found[:5])
                        if len(rows) == ROWS:
                            yield frame(rows)
                            rows = []
                    if rows:
                        yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path").mapInArrow(run, READ)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives into a new shared folder and reads them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    written = write_archives(pages, folder).agg(F.count("*")).first()[0]
    return read_archives(spark, folder) if written else spark.createDataFrame([], READ)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS winner FROM p WHERE octet_length(b) >= 1000 GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM p LEFT JOIN w USING (d)
"""
