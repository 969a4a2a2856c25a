"""WARC archives: writing, normalising whole-file gzip streams, reading by a sidecar index.

``write`` makes one archive per task, as a single gzip stream over all its records (the form that simple
crawlers leave).  ``normalise`` inflates such a stream once, from start to end, and rewrites every record as a
gzip member of its own, with an index of (offset, length, record id, type) lines beside it.  ``read``
opens each member by that index and checks the payload digest.

Payloads that occur more than once and have at least ``REVISIT_BYTES`` bytes are stored once: the page with the
largest page_id is the response, the others are revisit records that refer to it.

Scale and recovery: an archive is a task's file in the shared folder, written under an attempt's name and
renamed when complete, so a task that is run again replaces it whole.  Records are streamed; memory holds a
read block and one record.  Archives are listed in a table, never on the driver.  Only digests are
shuffled to find equal payloads; pages meet the repeated digests in a join that may be split.

Folders are qualified by Hadoop, so one without a scheme lies on the cluster's own file system; workers reach it through
``pyarrow.fs`` (file, hdfs, s3, gs, abfs and the Hadoop names of these).

Edge cases: null html is the empty payload; null urls have no target header.  Pages without a page_id are
never referred to while another has the payload.  A record's id is its page_id with its payload's digest, so
rows of one page_id with several payloads are told apart; repeated rows give a record each, of the same id.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_dir, stash, table

REVISIT_BYTES = 1000
LEVEL = 4
BLOCK = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


#: Names that Hadoop has for file systems, and theirs in ``pyarrow.fs``.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasb": "abfss", "wasbs": "abfss"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and authority that Hadoop takes it to have."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def location(uri: str) -> str:
    """A Hadoop URI as ``pyarrow.fs`` wants it."""
    scheme, parted, rest = uri.partition(":")
    scheme = SCHEMES.get(scheme, scheme)
    if scheme == "file":  # Hadoop writes file:/path
        return "file:///" + rest.lstrip("/")
    return scheme + parted + rest


class _File:
    """A file that appears under its name only when it is complete."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(location(uri))
        context = TaskContext.get()
        self.part = f"{self.path}.{context.taskAttemptId() if context else 0}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def _open(uri: str) -> BinaryIO:
    files, path = fs.FileSystem.from_uri(location(uri))
    return files.open_input_file(path)


def _safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def _record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One record: an HTTP response with the payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC-Type: " + ("response" if refers is None else "revisit"), f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _safe(url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers is not None:
        head += [f"WARC-Refers-To: {_record_id(refers, digest)}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html, digest, size, refers = (c[row].as_py() for c in batch.columns)
                if out is None:
                    uri = f"{folder}/raw-{TaskContext.get().partitionId():06d}.warc.gz"
                    out, gz = _File(uri), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(gz.compress(_record(page, url, html or b"", digest, size, refers)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "records": [n], "bytes": [out.size]})

    return write


class _Stream:
    """The inflated bytes of a gzip file of one or many members, read block by block, once."""

    def __init__(self, uri: str) -> None:
        self.file, self.inflate, self.have, self.raw = _open(uri), zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Take in another block; False at the end."""
        if self.inflate.eof:
            rest = self.inflate.unused_data or self.raw
            self.inflate, self.raw = zlib.decompressobj(31), rest
        data = self.inflate.unconsumed_tail or self.raw or self.file.read(BLOCK)
        self.raw = b""
        if not data:
            return False
        self.have += self.inflate.decompress(data, BLOCK)
        return True

    def header(self) -> bytes:
        """Up to and with the next empty line; b"" at the end of the file."""
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.have.strip():
                    raise ValueError("the stream ends inside a record")
                return b""
        head, self.have = self.have[: end + 4], self.have[end + 4 :]
        return head

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have and not self.more():
                raise ValueError("the stream ends inside a record")
            part, self.have = self.have[:n], self.have[n:]
            n -= len(part)
            if part:
                yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_file(source: str, target: str) -> tuple[int, int]:
    """Rewrite one archive record by record, with ``target``.idx beside it; records and bytes written."""
    stream, out, index, n = _Stream(source), _File(target), _File(target + ".idx"), 0
    while head := stream.header():
        fields, start = _fields(head), out.size
        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out.write(gz.compress(head))
        for part in stream.body(int(fields["content-length"]) + 4):
            out.write(gz.compress(part))
        out.write(gz.flush())
        index.write(f"{start}\t{out.size - start}\t{fields['warc-record-id']}\t{fields['warc-type']}\n".encode())
        n += 1
    out.close()
    index.close()
    return n, out.size


def _normaliser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source in batch.column(0).to_pylist():
            target = source.replace("/raw-", "/warc-")
            n, size = normalise_file(source, target)
            yield pa.RecordBatch.from_pydict({"path": [target], "records": [n], "bytes": [size]})


def read_record(member: bytes) -> dict:
    """The parts of one record: id, type, url, payload, its digest and size, and what it refers to."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(b"WARC/http\r\n" + http.partition(b"\r\n")[2])["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    number = lambda urn: int(x) if (x := urn.removeprefix("<urn:page:").partition(":")[0]) else None
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload": payload if fields["warc-type"] == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
    }


_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _reader(with_payload: bool):
    schema = _READ if with_payload else _READ.remove(2)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with _open(path) as archive, _open(path + ".idx") as index:
                    for line in index.read().decode().splitlines():
                        start, length = map(int, line.split("\t")[:2])
                        archive.seek(start)
                        rows.append(read_record(archive.read(length)))
                        held += len(rows[-1]["payload"] or b"") if with_payload else 0
                        if len(rows) >= 10_000 or held > 16 * BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, size, refers): what each page's record will be."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    groups = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    groups = stash(groups.filter("n > 1 AND largest IS NOT NULL").select(F.col("digest").alias("again"), "largest"), "payloads")
    rows = rows.join(groups, (F.col("digest") == F.col("again")) & (F.col("size") >= REVISIT_BYTES), "left")
    refers = F.when(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return rows.select(F.col("page_id").cast("long"), "url", "html", "digest", "size", refers.cast("long").alias("refers"))


_LIST = "path string, records long, bytes long"


def _one_each(archives: DataFrame) -> DataFrame:
    """The list of archives with a task for each (for up to 100 000; then several share one)."""
    return archives.repartition(max(1, min(archives.count(), 100_000)), "path")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write whole-file gzip archives of ``pages`` (page_id, url, html) to ``folder``; their list."""
    return stash(plan_records(pages).mapInArrow(_writer(qualified(pages.sparkSession, folder)), _LIST), "archives")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite archives with a member per record and an index; the list of the new ones."""
    return stash(_one_each(archives.select("path")).mapInArrow(_normaliser, _LIST), "normalised")


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of normalised archives; a revisit has the payload of the response that it refers to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema = schema if with_payload else schema.replace("payload binary, ", "")
    records = _one_each(archives.select("path")).mapInArrow(_reader(with_payload), schema)
    if not with_payload:
        return records
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), F.col("payload").alias("_b"))
    wanted = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("_w"), F.col("payload_digest").alias("_wd")).distinct()
    held = held.join(wanted, (F.col("_p") == F.col("_w")) & (F.col("_d") == F.col("_wd")), "left_semi").dropDuplicates(["_p", "_d"])
    both = records.join(held, (F.col("refers_to") == F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left")
    return both.withColumn("payload", F.coalesce("payload", "_b")).drop("_p", "_d", "_b")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = normalise(write(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc")))
    return read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.m IS NULL OR g.m = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.m <> p.page_id THEN g.m END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND p.n >= 1000
"""

QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": _SQL}
