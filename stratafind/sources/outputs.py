"""Exact output bytes: CSV, JSON, text, binary pages and frames."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.filetime import format_local, format_utc
from ..functions.text import needs_quotes, to_utf16

# Header names, page and frame formats.
HEADERS = {"size": "Size", "date": "Date Modified"}
TAG_JSON, TAG_PAGE, PAGE_ROWS = 0, 1, 4096
REQUEST_LIMIT, RESPONSE_LIMIT = 1 << 20, 16 << 20


def csv_line(columns: list[str], double_quote: bool = True, mtime: Column | None = None) -> Column:
    """One CSV row (without line end) of hits: columns in order, the file name last."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("path"), F.lit('"'), F.lit('""')), F.lit('"'))
    name = quoted if double_quote else F.when(needs_quotes(F.col("path")), quoted).otherwise(F.col("path"))
    cell = {
        "size": F.when(~F.col("is_dir") & F.col("size").isNotNull(), F.col("size").cast("string")).otherwise(F.lit("")),
        "date": F.coalesce(mtime if mtime is not None else format_utc(F.col("mtime_ft")), F.lit("")),
    }
    return F.concat(*[F.concat(cell[c], F.lit(",")) for c in columns], name)


def csv_rows(hits: DataFrame, columns: list[str] = (), double_quote: bool = True, zone: str | None = "UTC") -> DataFrame:
    """The lines of hits, in their order; dates on the clock of zone (None: the session's)."""
    return hits.select(csv_line(list(columns), double_quote, format_local(F.col("mtime_ft"), zone)).alias("line"))


def write_csv(hits: DataFrame, out, columns: list[str] = (), bom: bool = True, header: bool = True, double_quote: bool = True, zone: str | None = "UTC") -> None:
    """Streams ordered hits to an open file or to a path, a partition at a time."""
    if isinstance(out, str):
        with open(out, "wb") as file:
            return write_csv(hits, file, columns, bom, header, double_quote, zone)
    if bom:
        out.write(b"\xef\xbb\xbf")
    if header:
        out.write("".join(HEADERS[c] + "," for c in columns).encode() + b"Filename\r\n")
    for row in csv_rows(hits, columns, double_quote, zone).toLocalIterator(prefetchPartitions=True):
        out.write(row.line.encode("utf-8") + b"\r\n")


def hit_dict(row) -> dict:
    """A hit as JSON fields; absent values are left out."""
    out = {"path": row["path"]}
    if row["path_raw"] is not None:
        out["path_u16"] = to_utf16(bytes(row["path_raw"]))
    for c in ("size", "mtime_ft"):
        if row[c] is not None:
            out[c] = row[c]
    out["is_dir"] = row["is_dir"]
    return out


def to_json(hits: DataFrame, total: int, generation: int, incomplete: bool, pending: bool) -> str:
    items = [hit_dict(r.asDict()) for r in hits.toLocalIterator()]
    return json.dumps({"total": total, "generation": generation, "items": items, "more": False, "volumes_incomplete": incomplete, "metadata_pending": pending}, indent=2, ensure_ascii=False)


def plain_paths(hits: DataFrame, out) -> None:
    """One path per line; a reader that goes away is no error."""
    try:
        for row in hits.select("path").toLocalIterator():
            out.write(row.path + "\n")
        out.flush()
    except BrokenPipeError:
        pass


def pages(items, total: int, generation: int, incomplete: bool, pending: bool):
    """Binary pages of at most PAGE_ROWS (path bytes, is_dir, size, mtime); an empty set still is one page."""
    held, items = [], iter(items)
    following = next(items, None)
    while True:
        while following is not None and len(held) < PAGE_ROWS:
            held.append(following)
            following = next(items, None)
        flags = (following is not None) | incomplete << 1 | pending << 2
        body = [struct.pack("<BQQBI", TAG_PAGE, total, generation, flags, len(held))]
        for path, is_dir, size, mtime in held:
            body.append(struct.pack("<I", len(path)) + path + bytes([is_dir | (size is not None) << 1 | (mtime is not None) << 2]))
            body.append(b"" if size is None else struct.pack("<Q", size))
            body.append(b"" if mtime is None else struct.pack("<q", mtime))
        yield b"".join(body)
        held = []
        if following is None:
            return


def hit_pages(hits: DataFrame, total: int, generation: int = 0, incomplete: bool = False, pending: bool = False):
    rows = ((r.path.encode() if r.path_raw is None else bytes(r.path_raw), r.is_dir, r["size"], r.mtime_ft) for r in hits.toLocalIterator())
    return pages(rows, total, generation, incomplete, pending)


def read_page(data: bytes) -> dict:
    """A decoded page; ValueError where it is cut short or has bytes to spare."""
    try:
        tag, total, generation, flags, count = struct.unpack_from("<BQQBI", data)
        if tag != TAG_PAGE:
            raise ValueError("no page")
        at, items = 22, []
        for _ in range(count):
            (length,) = struct.unpack_from("<I", data, at)
            raw, at = data[at + 4 : at + 4 + length], at + 4 + length
            mark, at = data[at], at + 1
            size = mtime = None
            if mark & 2:
                (size,), at = struct.unpack_from("<Q", data, at), at + 8
            if mark & 4:
                (mtime,), at = struct.unpack_from("<q", data, at), at + 8
            text = raw.decode("utf-8", "replace")
            exact = None
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                exact = to_utf16(raw)
                text = "".join("�" if 0xD800 <= u < 0xE000 else chr(u) for u in exact)
            items.append({"path": text, "path_u16": exact, "is_dir": bool(mark & 1), "size": size, "mtime_ft": mtime})
    except (struct.error, IndexError):
        raise ValueError("page is cut short") from None
    if at != len(data):
        raise ValueError("page has bytes to spare")
    return {"total": total, "generation": generation, "more": bool(flags & 1), "volumes_incomplete": bool(flags & 2), "metadata_pending": bool(flags & 4), "items": items}


def frame(payload: bytes, limit: int = RESPONSE_LIMIT) -> bytes:
    if len(payload) > limit:
        raise ValueError("frame is too large")
    return struct.pack("<I", len(payload)) + payload


class FrameReader:
    """Frames out of chunks of any size; an oversized frame spoils the stream for good."""

    def __init__(self, limit: int = RESPONSE_LIMIT):
        self.limit, self.data, self.spoiled = limit, bytearray(), False

    def feed(self, chunk: bytes):
        self.data += chunk
        while True:
            if self.spoiled:
                raise ValueError("frame is too large")
            if len(self.data) < 4:
                return
            (size,) = struct.unpack_from("<I", self.data)
            if size > self.limit:
                self.spoiled = True
                continue
            if len(self.data) < 4 + size:
                return
            payload = bytes(self.data[4 : 4 + size])
            del self.data[: 4 + size]
            yield payload
