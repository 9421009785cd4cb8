"""WARC archives: a writer with revisit records, and a reader that splits files anywhere.

Every record is a gzip member of its own. A read task owns a byte range: it looks for the gzip
magic inside it, takes a place for a member only if the header decodes to a WARC version line,
and then reads on record by record while records start inside its range. So files of any size
are read by many tasks, and each record by exactly one.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, broadcast_small

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes of a read range, bytes read at once.
RANGE, STEP = 8 << 20, 1 << 18


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))


def plan_records(pages: DataFrame, work: Workspace, min_bytes: int = 1000) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type, refers_to, refers_url to (page_id, url, html).

    Of records with equal payloads of at least min_bytes, the one of the largest page_id is the
    response (ties: largest url, then any one of the equal rows), the others revisit it. Only
    keys are grouped, with map-side combining; a group of copies never meets in one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    order = F.struct(F.col("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    copies = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max(order).alias("best"))
    copies = copies.filter("n > 1").select(F.col("payload_digest").alias("d"), F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("best_url"))
    copies = work.keep(copies, "copies", small=True)
    few = broadcast_small(copies)
    rows = rows.join(few, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= min_bytes), "left")
    is_best = F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.coalesce("url", F.lit("")) == F.col("best_url"))
    rows = rows.withColumn("record_type", F.when(F.col("d").isNull() | is_best, "response").otherwise("revisit"))
    revisit = F.col("record_type") == "revisit"
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("refers_to"))).withColumn("refers_url", F.when(revisit, F.col("best_url")))
    # Fully equal rows at the top of a group: all but one of them revisit.
    top = rows.filter(F.col("d").isNotNull() & (F.col("record_type") == "response"))
    twice = work.keep(top.groupBy("d").count().filter("count > 1").select(F.col("d").alias("t")), "twice", small=True)
    if not twice.isEmpty():
        equal = top.join(twice, top["d"] == twice["t"], "left_semi")
        one = equal.dropDuplicates(["d"])
        more = equal.groupBy("d").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest")], F.count("*").alias("n"))
        more = more.withColumn("_again", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).withColumn("record_type", F.lit("revisit")).withColumn("refers_to", F.col("page_id")).withColumn("refers_url", F.col("url"))
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_url"]
        again = F.col("d").isNotNull() & (F.col("record_type") == "response")
        rest = rows.join(twice, again & (F.col("d") == F.col("t")), "left_anti")
        return rest.select(names).unionByName(one.select(names)).unionByName(more.select(names))
    return rows.drop("d", "best_url")


def record_id(page_id, url) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url or ''}')}>"


def _field(text) -> str:
    return "".join(c if c.isprintable() else "?" for c in text or "")


def record(page_id, url, payload: bytes, payload_bytes: int, digest: str, kind: str, refers_to, refers_url=None) -> bytes:
    """One WARC record as a gzip member. A revisit carries no payload but its digest and size."""
    body = payload if kind == "response" else b""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", datetime.fromtimestamp(0, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", _field(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(payload_bytes)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(body))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        head += [("WARC-Refers-To", record_id(refers_to, refers_url)), ("WARC-Refers-To-Target-URI", _field(refers_url)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(VERSION + lines + b"\r\n" + body + b"\r\n\r\n") + pack.flush()


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per partition below folder (shared); returns (path, bytes, records).

    Each attempt of a task writes a file of its own name and only the winner's row enters the
    manifest, so a lost executor or a speculative copy leaves at most an unlisted file. Run the
    returned frame once (write it down): running it again writes anew.
    """

    def run(batches):
        out, path, size, count = None, None, 0, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        system, base = _filesystem(folder)
                        system.create_dir(base, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        path, out = f"{folder}/{name}", system.open_output_stream(f"{base}/{name}", compression=None)
                    data = record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["record_type"], row["refers_to"], row["refers_url"])
                    out.write(data)
                    size, count = size + len(data), count + 1
        finally:
            if out is not None:
                out.close()
        if path:
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_url"]
    return records.select(columns).mapInArrow(run, "path string, bytes long, records long")


class _Members:
    """Sequential reader of gzip members from a place in a file."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at

    def record(self) -> tuple[dict, bytes, int] | None:
        """(headers, body, end) of the record whose member starts at self.at; None if there is none."""
        self.file.seek(self.at)
        unpack, out, read = zlib.decompressobj(31), io.BytesIO(), 0
        checked = False
        while not unpack.eof:
            raw = self.file.read(STEP if checked else 4096)
            if not raw:
                return None
            read += len(raw)
            try:
                out.write(unpack.decompress(raw))
            except zlib.error:
                return None
            if not checked and out.tell() >= len(VERSION):
                if not out.getvalue().startswith(VERSION[:6]):
                    return None
                checked = True
        data = out.getvalue()
        cut = data.find(b"\r\n\r\n")
        if not data.startswith(VERSION[:6]) or cut < 0:
            return None
        head = {}
        for line in data[:cut].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        if not head.get("content-length", "").isdigit() or "warc-type" not in head:
            return None
        length = int(head["content-length"])
        body = data[cut + 4 : cut + 4 + length]
        if len(body) != length:
            return None
        return head, body, self.at + read - len(unpack.unused_data)


def records_in_range(file, size: int, start: int, end: int):
    """(offset, headers, body) of every record whose member starts in [start, end)."""
    at = start
    while at < end:
        file.seek(at)
        window = file.read(min(STEP, end + len(MAGIC) - 1 - at))
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            if len(window) < len(MAGIC):
                return
            continue
        at += found
        if at >= end:
            return
        got = _Members(file, at).record()
        if got is None:
            at += 1
            continue
        # From here on members follow each other without a search.
        while got is not None and at < end:
            head, body, after = got
            yield at, head, body
            at = after
            got = _Members(file, at).record() if at < end else None


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE, with_body: bool = False) -> DataFrame:
    """Records of archives (path, bytes): page_id, url, payload_bytes, payload_digest, record_type, refers_to, body.

    The digest and size of a response are taken from the body that was read and must equal the
    header's, or the read fails; a revisit has those of its header. body is null unless asked
    for. An empty file has no records. Memory is one record and one buffer.
    """
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary"

    def number(text):
        return int(text) if text else None

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                system, base = _filesystem(path)
                with system.open_input_file(base) as file:
                    rows, held = [], 0
                    for _, head, body in records_in_range(file, size, start, min(size, start + range_bytes)):
                        digest, length = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        if head["warc-type"] == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, length):
                            raise ValueError(f"payload differs from its digest in {path}")
                        rows.append((number(head.get("x-page-id")), head.get("warc-target-uri"), length, digest, head["warc-type"], number(head.get("x-refers-to-page")), body if with_body else None))
                        held += len(body) if with_body else 100
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    def _rows(rows):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    tasks = max(2 * spark.sparkContext.defaultParallelism, 1)
    return ranges.repartition(tasks, "path", "start").mapInArrow(run, schema)


def read_all(work: Workspace, manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Records of the archives of a manifest (path, bytes, records), without bodies.

    They are written down and counted: the read fails unless it found as many as are listed.
    """
    rows = work.keep(read_warc(work.spark, manifest, range_bytes).drop("body"), "read")
    listed, found = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], rows.count()
    if found != listed:
        raise ValueError(f"{found} records were read of {listed} in the manifest")
    return rows


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 1000, range_bytes: int = 2 << 20) -> DataFrame:
    """Writes all pages as WARC below the shared folder and reads the archives back.

    Null html is an empty payload; null urls and page_ids are written as empty fields and read
    as null ids. Repeated rows are records of their own. An empty table gives no archive and no
    rows. Extra columns are ignored.
    """
    work = Workspace(spark, "warc")
    manifest = work.keep(write_warc(plan_records(pages, work, min_bytes), f"{work.path}/archives"), "manifest")
    return read_all(work, manifest, range_bytes).drop("url")
