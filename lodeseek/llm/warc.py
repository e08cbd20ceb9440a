"""WARC archives: a writer, and a sequential reader, one gzip member a record.

Writing: each task writes its rows as records to files of bounded size in a shared folder, under names that no other
attempt uses, and reports them; the report is a table written by Spark's committer, so only files of successful
attempts count; files that other attempts left behind are then deleted, a folder a task. Of records with equal payloads of at
least MIN_REVISIT bytes the one with the smallest id is a response, others are revisits without a payload. Equal
payloads are found by digests, counted before the shuffle; the digests that occur several times are broadcast if they are
few, else frequent ones are broadcast and pages with others meet them in a shuffle, so no task gathers a frequent page.

Reading: a file is read in chunks; each member is decompressed incrementally, its header lines parsed, its block
framed by Content-Length, and block and payload digests verified; a wrong digest, a short block or a missing end
raises an error. Memory holds one record.

Null html is an empty payload, a null url is written as `about:blank`, a null id has no page id header (and is never
the smallest). Rows of the smallest id that are repeated are all responses. Long payloads are written and read whole. Empty
tables give no file and no rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh_path, hot_keys, looked_up, ready, small, written
from . import kernels

MIN_REVISIT, FILE_BYTES, CHUNK = 100, 32 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def urn(page_id) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'page:{page_id}'.encode()).digest()[:16])}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {json.dumps(page_id)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page-Id: {json.dumps(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as one gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Reader:
    """Records of an archive, one after another: (headers, HTTP headers, payload)."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest, self.unzip, self.data, self.over = stream, b"", None, bytearray(), True

    def _open(self) -> bool:
        """Begins the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.stream.read(CHUNK)
        if not self.rest:
            return False
        self.unzip, self.data, self.over = zlib.decompressobj(31), bytearray(), False
        return True

    def _more(self) -> None:
        """Decompresses one more chunk of the member."""
        if self.over:
            raise ValueError("a record ends early")
        chunk = self.rest or self.stream.read(CHUNK)
        got = self.unzip.decompress(chunk, 4 * CHUNK)  # without input, what is still held back
        if not chunk and not got and not self.unzip.eof:
            raise ValueError("the archive ends within a member")
        self.data += got
        self.rest = self.unzip.unconsumed_tail
        if self.unzip.eof:
            self.rest, self.over = self.unzip.unused_data, True

    def _until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.data.find(mark, at)) < 0:
            at = max(0, len(self.data) - len(mark) + 1)
            self._more()
        out = bytes(self.data[:found])
        del self.data[: found + len(mark)]
        return out

    def _take(self, n: int) -> bytes:
        while len(self.data) < n:
            self._more()
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    @staticmethod
    def _headers(head: bytes, first: bytes) -> dict[str, str]:
        top, *lines = head.split(b"\r\n")
        if not top.startswith(first):
            raise ValueError(f"not {first!r}: {top[:40]!r}")
        return {k.strip().lower().decode(): v.strip().decode() for k, v in (x.split(b":", 1) for x in lines)}

    def __iter__(self) -> Iterator[tuple[dict, dict, bytes]]:
        while self._open():
            headers = self._headers(self._until(b"\r\n\r\n"), b"WARC/1.")
            block = self._take(int(headers["content-length"]))
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("a record has no end")
            while not self.over:
                self._more()
            if self.data:
                raise ValueError("a member holds more than a record")
            if headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                raise ValueError(f"wrong block digest in {headers['warc-record-id']}")
            head, _, payload = block.partition(b"\r\n\r\n")
            http = self._headers(head, b"HTTP/")
            if headers["warc-type"] == "response" and (len(payload) != int(http["content-length"]) or headers["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest()):
                raise ValueError(f"wrong payload in {headers['warc-record-id']}")
            yield headers, http, payload


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages below folder (a URI that driver and executors share); gives the report (file, records, bytes)."""
    ready(pages.sparkSession)
    html = F.encode(F.coalesce(col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    of = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    of = small(written(of, "payloads"))
    rows = looked_up(rows, of.drop("n"), "digest", hot_keys("digest", counted=of), "left")
    rows = rows.select("id", "url", "payload", "digest", F.when((F.col("id") > F.col("first")) | (F.col("id").isNull() & F.col("first").isNotNull()), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.begin("warc")
        task, out, done, size, n = TaskContext.get(), None, [], 0, 0
        system, base = fs.FileSystem.from_uri(f"{folder}/part-{task.partitionId():06d}")
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(base, recursive=True)
                    name = f"{task.taskAttemptId()}-{len(done):04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, size, n = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = member(record(page_id, url, payload, digest, refers_to))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{task.partitionId():06d}/{x[0]}" for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["file", "records", "bytes"])

    report = written(rows.mapInArrow(run, "file string, records long, bytes long"), "archives")
    tidied(report)
    return report


def tidied(report: DataFrame) -> int:
    """Deletes files beside those of the report, which failed attempts have left; gives how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, files in zip(*(c.to_pylist() for c in batch.columns)):
                system, base = fs.FileSystem.from_uri(folder)
                kept = {x.rsplit("/", 1)[1] for x in files}
                gone = [x.path for x in system.get_file_info(fs.FileSelector(base)) if x.base_name not in kept]
                for path in gone:
                    system.delete_file(path)
                yield pa.RecordBatch.from_arrays([pa.array([len(gone)], pa.int64())], ["n"])

    of_folder = report.groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).agg(F.collect_list("file").alias("files"))  # a task's files
    return of_folder.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_archives(report: DataFrame, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the report's files."""
    spark = ready(report.sparkSession)
    ids = pa.int64() if id_type in ("long", "bigint") else pa.string()
    load = lambda x: None if x is None else json.loads(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (ids, pa.string(), pa.int64(), pa.string(), pa.string(), ids, pa.binary())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for headers, http, payload in Reader(stream):
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((load(headers.get("x-page-id")), headers["warc-target-uri"], int(http["content-length"]), digest, headers["warc-type"], load(headers.get("x-refers-to-page-id")), payload if payloads and headers["warc-type"] == "response" else None))
                        held += len(payload)
                        if len(rows) >= 1_000 or held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = report.select("file")
    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism * 64))
    return files.repartition(n, "file").mapInArrow(run, f"page_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of each page, read back from archives."""
    report = write_archives(pages, fresh_path(pages.sparkSession, "warc"), id_col, url_col, html_col)
    out = read_archives(report, pages.schema[id_col].dataType.simpleString(), payloads=False)
    return out.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB's form of round_trip() over `pages`.
SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
"""
