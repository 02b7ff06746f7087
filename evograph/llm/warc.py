"""WARC archives: writing, the monolithic-gzip normaliser, and indexed reading.

An archive that is one gzip stream over the whole file can't be entered in the middle.  The normaliser
inflates such a stream once, front to back, rewrites every record as a gzip member of its own,
and writes a sidecar index of (offset, length) by record, through which single records are read.
Each task handles one archive; files appear under their final name only when complete, so a repeated task replaces its own work.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 1 << 20
#: Shorter payloads are never written as revisits.
REVISIT_BYTES = 1_000
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"


def _open(path: str, mode: str):
    """A file in a store that Arrow can reach (local, HDFS, S3 ...), by its URI."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if mode == "r" else store.open_output_stream(inner, compression=None)


def _publish(temporary: str, path: str) -> None:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.move(fs.FileSystem.from_uri(temporary)[1], inner)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed.  A revisit holds no payload, but its length and digest."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    uri = "".join(c for c in (url or "") if c > " ")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    if refers_to is not None:
        fields.insert(4, ("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of a stream of inflated bytes, holding one record at a time."""
    buffer, at, ended = bytearray(), 0, False
    feed = iter(chunks)

    def more() -> bool:
        nonlocal ended
        got = next(feed, None)
        if got is None:
            ended = True
            return False
        buffer.extend(got)
        return True

    while True:
        while (cut := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(buffer[at:]).strip():
                    raise ValueError("the archive ends within a record's header")
                return
        head = parse_head(bytes(buffer[at:cut]))
        end = cut + 4 + int(head["content-length"]) + 4
        while len(buffer) < end:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(buffer[at:end])
        at = end
        if at > BLOCK:
            del buffer[:at]
            at = 0


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """Inflated bytes of a gzip file, of one member or several."""
    z, whole = zlib.decompressobj(31), True
    while raw := source.read(BLOCK):
        while raw:
            got = z.decompress(raw, BLOCK)
            if got:
                yield got
            raw, whole = z.unconsumed_tail, z.eof
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
    while not whole and (got := z.decompress(b"", BLOCK)):
        yield got
        whole = z.eof
    if not whole:
        raise ValueError("the gzip stream is cut off")


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def normalise(source: str, target: str, index: str) -> int:
    """Rewrite the archive at ``source`` with a member a record, and its index (JSON lines); the number of records."""
    n, offset, mine = 0, 0, uuid.uuid4().hex
    with _open(source, "r") as src, _open(f"{target}.{mine}", "w") as out, _open(f"{index}.{mine}", "w") as idx:
        for head, raw in records(inflate(src)):
            packed = member(raw)
            out.write(packed)
            idx.write(json.dumps({"id": head["warc-record-id"], "offset": offset, "length": len(packed)}).encode() + b"\n")
            offset += len(packed)
            n += 1
    _publish(f"{target}.{mine}", target)
    _publish(f"{index}.{mine}", index)
    return n


def read_indexed(archive: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, body) of each indexed record, each inflated by itself from its offset."""
    with _open(index, "r") as idx:
        entries = [json.loads(x) for x in idx.read().splitlines()]
    with _open(archive, "r") as src:
        for e in entries:
            src.seek(e["offset"])
            raw = zlib.decompress(src.read(e["length"]), 31)
            cut = raw.index(b"\r\n\r\n")
            head = parse_head(raw[:cut])
            if head["warc-record-id"] != e["id"]:
                raise ValueError(f"the index is wrong at {e['offset']}")
            yield head, raw[cut + 4 : -4]


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to).  Of equal payloads of at least ``least`` bytes, that with the largest page_id is kept;
    the payload of the others stays on its row to be measured, and they refer to it.  Rows that share the largest id are all kept."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= least
    first = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # Digests of more than one page only.  Written, so that plain exchanges meet in the join and a hot digest's partition can be split.
    first = common.materialize(first, "first_pages")
    found = rows.join(first, "digest", "left")
    other = F.when((F.col("page_id") < F.col("_first")) | F.col("page_id").isNull(), F.col("_first"))
    return found.select("page_id", "url", "payload", "digest", F.when(long, other).alias("refers_to"))


def write_monolithic(found: DataFrame, folder: str) -> DataFrame:
    """Write the rows of :func:`with_revisits` as one whole-file gzip stream a task; (archive, records) of each that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, mine, n = f"{folder}/mono-{TaskContext.get().partitionId():06d}.warc.gz", uuid.uuid4().hex, 0
        z, out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), None
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64).to_pydict()
                for row in zip(part["page_id"], part["url"], part["payload"], part["digest"], part["refers_to"], strict=True):
                    out = out or _open(f"{name}.{mine}", "w")
                    out.write(z.compress(record(*row)))
                    n += 1
        if out:
            out.write(z.flush())
            out.close()
            _publish(f"{name}.{mine}", name)
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    return found.mapInArrow(run, "archive string, records long")


def normalise_all(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive; (archive, index, records) of the results, whose counts must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                stem = x["archive"].rsplit("/", 1)[1].removeprefix("mono-").removesuffix(".warc.gz")
                archive, index = f"{folder}/part-{stem}.warc.gz", f"{folder}/part-{stem}.idx.jsonl"
                n = normalise(x["archive"], archive, index)
                if n != x["records"]:
                    raise ValueError(f"{x['archive']}: {n} records of {x['records']}")
                yield pa.RecordBatch.from_pydict({"archive": [archive], "index": [index], "records": pa.array([n], pa.int64())})

    return archives.mapInArrow(run, "archive string, index string, records long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary"


def read_all(archives: DataFrame, with_body: bool = False) -> DataFrame:
    """Every record of the normalised archives.  The body of a response is held against its digest and length."""
    schema = READ if with_body else READ.removesuffix(", body binary")
    out = common._arrow_schema(schema)

    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows: list[tuple] = []
                for head, body in read_indexed(x["archive"], x["index"]):
                    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    if head["warc-type"] == "response":
                        size, found = len(body), hashlib.sha1(body).hexdigest()
                        if found != digest:
                            raise ValueError(f"{head['warc-record-id']}: payload of {found}, not {digest}")
                    rows.append((number(head["warc-record-id"]), head["warc-target-uri"], size, digest, head["warc-type"], number(head.get("warc-refers-to")), body)[: len(out)])
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return archives.mapInArrow(run, schema)


def _spread(paths: DataFrame) -> DataFrame:
    """One archive a task; there are as many rows as the tasks that wrote them."""
    return paths.repartition(max(1, paths.count()), "archive")


def archive_pages(pages: DataFrame, folder: str | None = None, with_body: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, normalise them, and read them back through their indexes.

    Null html is an empty payload, short payloads are always responses, and repeated rows each get a record.
    Rows with a null page_id are revisits wherever an equal long payload has an id.  Control
    characters and blanks in a url are dropped.  An empty table leaves no archive and gives no rows.  Other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or common.new_path(spark, "warc")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    written = common.materialize(write_monolithic(with_revisits(pages), folder), "warc_written")
    ready = common.materialize(normalise_all(_spread(written), folder), "warc_normalised")
    return read_all(_spread(ready), with_body)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every page through an archive and back."""
    found = archive_pages(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as last from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {REVISIT_BYTES} and page_id < last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {REVISIT_BYTES} and page_id < last then last end as refers_to
from m
"""
