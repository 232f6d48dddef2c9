"""WARC archives: a whole-file gzip stream becomes one gzip member a record, with a sidecar index of offsets.

write() stores pages as archives whose gzip stream spans the whole file, the way careless writers do. normalise()
inflates each such stream once, in pieces, and writes every record as its own member, and beside the archive a JSON line
a record with its offset and length. read() opens members by that index alone.

Of the records whose payloads of LEAST bytes or more are equal, that with the largest page_id is the response and the
others revisit it. Archives lie in the shared folder, named by task attempt, so a lost executor's task writes new ones
and only files of finished tasks are known.

Defined cases: a null html is empty, a null url is an empty target; smaller payloads are never revisits; repeated rows
with the largest page_id are all responses; rows with null page_id are responses unless another row has the payload;
white space in a url is percent-encoded in the header; an empty table gives no archives and no rows; other columns
don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import new_folder, table
from vecspark.llm.common import read as read_table

LEAST = 1000
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 18
DATE = "1970-01-01T00:00:00Z"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _open(uri: str):
    """The filesystem of a folder that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header but not the payload."""
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header(stream) -> tuple[bytes, dict[str, str]] | None:
    """The raw header of the next record, after any blank lines, and its fields in lower case; None at the end of the stream."""
    lines = []
    while (line := stream.readline()).strip() or line and not lines:
        if line.strip():
            lines.append(line)
    if not lines:
        return None
    if not line:
        raise ValueError("the archive ends within a header")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines[1:])
    return b"".join(lines) + b"\r\n", {k.strip().lower(): v.strip() for k, _, v in pairs}


def decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, record_type, refers_to).

    Pages with small payloads are in no join. Payloads that very many pages share are looked up where those pages are.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    large = rows.where(F.octet_length("html") >= least).withColumn("_digest", F.concat(F.sha1(F.col("html").cast("binary")), F.octet_length("html").cast("string")))
    again = table(pages.sparkSession, large.groupBy("_digest").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("n")).where("n > 1 AND _keeper IS NOT NULL"), "digests")
    other = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    total = again.agg(F.sum("n")).first()[0] or 0
    hot, cold = F.broadcast(again.where(F.col("n") * 1000 > total)), again.where(F.col("n") * 1000 <= total).withColumnRenamed("_keeper", "_other")
    joined = large.join(hot.select("_digest", "_keeper"), "_digest", "left").join(cold.select("_digest", "_other"), "_digest", "left").withColumn("_keeper", F.coalesce("_keeper", "_other"))
    decided = joined.select("page_id", "url", "html", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("_keeper")).alias("refers_to"))
    rest = rows.where(F.octet_length("html") < least)
    return decided.union(rest.select("page_id", "url", "html", F.lit("response"), F.lit(None).cast("bigint")))


def write(decided: DataFrame, folder: str) -> DataFrame:
    """(file, records): archives of one gzip stream each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, done = None, []

        def close() -> None:
            nonlocal out
            if out:
                out["sink"].write(out["gz"].flush())
                out["sink"].close()
                done.append((out["name"], out["records"]))
                out = None

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, kind, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                if out is None:
                    name = f"whole-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out = {"name": name, "sink": fs.open_output_stream(f"{base}/{name}", compression=None), "gz": zlib.compressobj(6, zlib.DEFLATED, 31), "records": 0, "size": 0}
                data = record(page_id, url, html.encode(), kind, refers_to)
                out["sink"].write(out["gz"].compress(data))
                out["records"] += 1
                out["size"] += len(data)
                if out["size"] >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "records"])

    return decided.mapInArrow(run, "file string, records bigint")


def normalise_stream(source, sink, index) -> int:
    """Inflates source once and writes each record as a member of sink and a line of index; the number of records."""
    stream, at, n = gzip.GzipFile(fileobj=source), 0, 0
    while (found := header(stream)) is not None:
        raw, fields = found
        left, gz = int(fields["content-length"]), zlib.compressobj(6, zlib.DEFLATED, 31)
        size = sink.write(gz.compress(raw)) or 0
        while left:
            part = stream.read(min(left, PIECE))
            if not part:
                raise ValueError("the archive ends within a record")
            left -= len(part)
            size += sink.write(gz.compress(part)) or 0
        size += sink.write(gz.compress(b"\r\n\r\n")) or 0
        size += sink.write(gz.flush()) or 0
        line = {"offset": at, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
        index.write(json.dumps(line).encode() + b"\n")
        at, n = at + size, n + 1
    return n


class _Counted:
    """A sink whose write says how many bytes it took."""

    def __init__(self, sink):
        self.sink = sink

    def write(self, data: bytes) -> int:
        self.sink.write(data)
        return len(data)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """(file, index, records): archives of a member a record, and their sidecar indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"{name.removeprefix('whole-').removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}"
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source, fs.open_output_stream(f"{base}/{new}.warc.gz", compression=None) as sink, fs.open_output_stream(f"{base}/{new}.offsets.jsonl", compression=None) as index:
                    n = normalise_stream(source, _Counted(sink), index)
                yield pa.RecordBatch.from_arrays([pa.array([f"{new}.warc.gz"]), pa.array([f"{new}.offsets.jsonl"]), pa.array([n], pa.int64())], ["file", "index", "records"])

    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return files.repartition(tasks, "file").mapInArrow(run, "file string, index string, records bigint")


def parsed(member: bytes) -> tuple:
    """COLUMNS of a record, from its member alone; the digest of a response is taken from its payload and must agree."""
    stream = io.BytesIO(zlib.decompress(member, 31))
    _, fields = header(stream)
    block = stream.read(int(fields["content-length"]))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size, kind = int(fields["x-payload-length"]), fields["warc-type"]
    if kind == "response":
        payload = block.split(b"\r\n\r\n", 1)[1]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    page_id, refers_to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return page_id and int(page_id), size, digest, kind, refers_to and int(refers_to)


def read(files: DataFrame, folder: str) -> DataFrame:
    """COLUMNS of each record, read member by member at the offsets of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(f"{base}/{name}") as archive, fs.open_input_stream(f"{base}/{index}", compression=None) as lines:
                    for line in io.BufferedReader(lines):
                        at = json.loads(line)
                        archive.seek(at["offset"])
                        rows.append(parsed(archive.read(at["length"])))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], COLUMNS)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], COLUMNS)

    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archived(pages: DataFrame) -> tuple[DataFrame, str]:
    """The normalised archives (file, index, records) and their folder; the whole-stream ones are deleted."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    whole = table(spark, write(decisions(pages), folder), "whole")
    files = table(spark, normalise(whole, folder), "archives")
    files.count()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/whole-*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(path) or ():
        fs.delete(found.getPath(), False)
    return files, folder


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as its record in the normalised archives says."""
    files, folder = archived(read_table(spark, sf_dir, "pages"))
    return read(files, folder)


OP3_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM k
"""
