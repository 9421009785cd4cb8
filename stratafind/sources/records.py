"""Binary change-journal and file-layout buffers, as documented by the operating system."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import from_utf16
from ..schema import DIRECTORY, JOURNAL, LAYOUT, MAX_I64, RECORD_MASK, SNAPSHOT

# Record layouts.
V2, V3 = struct.Struct("<IHHQQqqIIIIHH"), struct.Struct("<IHHQQQQqqIIIIHH")
LAYOUT_HEAD, LAYOUT_FILE, LAYOUT_NAME = struct.Struct("<IIII"), struct.Struct("<IIIIQIIII"), struct.Struct("<IIQII")
LAYOUT_STREAM, NAME_BYTES = struct.Struct("<IIIIqqIIII"), 510
DATA_TYPE, NAME_PRIMARY, NAME_DOS = 0x80, 1, 2


class DecodeError(ValueError):
    """A buffer that can't be trusted; nothing of it is used."""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _units(data: bytes, at: int, size: int) -> list[int]:
    return [u for (u,) in struct.iter_unpack("<H", data[at : at + size])]


def journal_buffer(data: bytes) -> tuple[int, list[dict], dict[int, int]]:
    """(next position, records, skipped records by version) of one buffer."""
    if len(data) < 8:
        raise DecodeError("no header")
    (following,), at, out, skipped = struct.unpack_from("<q", data), 8, [], {}
    while at < len(data):
        if len(data) - at < 8:
            raise DecodeError("header is cut short")
        length, major, _ = struct.unpack_from("<IHH", data, at)
        if not length:
            raise DecodeError("length 0")
        if at + length > len(data):
            raise DecodeError("record leaves the buffer")
        if major in (2, 3):
            form = V2 if major == 2 else V3
            if length < form.size:
                raise DecodeError("header is cut short")
            got = form.unpack_from(data, at)
            if major == 2:
                frn, parent, usn, stamp, reason, _, _, attributes, size, start = got[3:]
            else:
                frn, _, parent, _, usn, stamp, reason, _, _, attributes, size, start = got[3:]
            if size % 2 or start < form.size or start + size > length:
                raise DecodeError("malformed name")
            name, raw = from_utf16(_units(data, at + start, size))
            out.append({"usn": usn, "frn": _signed(frn), "parent_frn": _signed(parent), "reason": reason, "attributes": attributes, "name": name, "name_raw": raw, "name_lossy": raw is not None, "timestamp_ft": stamp, "major_version": major})
        else:
            skipped[major] = skipped.get(major, 0) + 1
        at += -(-length // 8) * 8
    return following, out, skipped


def layout_buffer(data: bytes) -> list[dict]:
    """Files of a layout buffer: size, time and all names."""

    def take(form: struct.Struct, at: int):
        if at < 0 or at + form.size > len(data):
            raise DecodeError("entry leaves the buffer")
        return form.unpack_from(data, at)

    count, first, _, _ = take(LAYOUT_HEAD, 0)
    at, files = first, []
    while count and at:
        _, onward, _, attributes, frn, names_at, streams_at, info_at, info_size = take(LAYOUT_FILE, at)
        is_dir, names, place = bool(attributes & DIRECTORY), [], names_at
        step = at + names_at
        while place:
            next_name, flags, parent, size, _ = take(LAYOUT_NAME, step)
            if size % 2:
                raise DecodeError("odd name length")
            if size > NAME_BYTES:
                raise DecodeError("name is too long")
            if step + LAYOUT_NAME.size + size > len(data):
                raise DecodeError("name leaves the buffer")
            name, raw = from_utf16(_units(data, step + LAYOUT_NAME.size, size))
            names.append({"parent_frn": _signed(parent), "name": name, "name_raw": raw, "name_lossy": raw is not None, "dos_only": bool(flags & NAME_DOS) and not flags & NAME_PRIMARY})
            place = next_name
            step += next_name
        mtime = None
        if info_at and (info_size == 0 or info_size >= 24):
            (mtime,) = struct.unpack_from("<q", data, at + info_at + 16) if at + info_at + 24 <= len(data) else (None,)
        size, place, step = None, streams_at, at + streams_at
        while place and not is_dir:
            _, next_stream, _, _, _, end, _, kind, _, id_size = take(LAYOUT_STREAM, step)
            if id_size % 2:
                raise DecodeError("odd stream name length")
            name = from_utf16(_units(data, step + LAYOUT_STREAM.size, id_size))[0]
            if size is None and name in ("", "::$DATA") and kind in (0, DATA_TYPE):
                size = min(max(end, 0), MAX_I64)
            place = next_stream
            step += next_stream
        files.append({"frn": _signed(frn), "attributes": attributes, "size": size, "mtime_ft": mtime, "names": names})
        if not onward:
            break
        at += onward
    return files


def _buffers(spark: SparkSession, path: str) -> DataFrame:
    """(volume, path, content) of <path>/<volume>/* files, one buffer each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("volume"), "path", "content")


def _decoded(spark: SparkSession, files: DataFrame, decode, schema: str) -> DataFrame:
    """Rows of all buffers that can be decoded; of a damaged one nothing is used (see scan_report)."""
    import pandas as pd

    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches):
        for batch in batches:
            for volume, content in zip(batch["volume"], batch["content"]):
                try:
                    rows = [{"volume": volume, **r} for r in decode(bytes(content))]
                except DecodeError:
                    continue
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.select("volume", "content").mapInPandas(run, schema)


def _journal_rows(data: bytes) -> list[dict]:
    return journal_buffer(data)[1]


def _snapshot_rows(data: bytes) -> list[dict]:
    """Records of an enumeration buffer; what orders all of them is the buffer's next record number and the place in it."""
    following, rows, _ = journal_buffer(data)
    keep = ("frn", "parent_frn", "attributes", "name", "name_raw")
    return [{"position": following & RECORD_MASK, "place": i, **{c: r[c] for c in keep}} for i, r in enumerate(rows)]


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JOURNAL rows of <path>/<volume>/* buffers; unknown record versions are left out."""
    return _decoded(spark, _buffers(spark, path), _journal_rows, JOURNAL)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """SNAPSHOT rows of <path>/<volume>/* enumeration buffers, whose header is where the next one starts."""
    return _decoded(spark, _buffers(spark, path), _snapshot_rows, SNAPSHOT)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, _buffers(spark, path), layout_buffer, LAYOUT)


def scan_report(spark: SparkSession, path: str, kind: str = "journal") -> DataFrame:
    """Per volume: buffers, records, skipped records by version, and rejected buffers by reason."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for volume, content in zip(batch["volume"], batch["content"]):
                found, records, skipped, error = [(volume, "buffers", "", 1)], 0, {}, None
                try:
                    if kind == "layout":
                        records = len(layout_buffer(bytes(content)))
                    else:
                        _, rows, skipped = journal_buffer(bytes(content))
                        records = len(rows)
                except DecodeError as e:
                    error = str(e)
                found += [(volume, "records", "", records)] + [(volume, "skipped", str(v), n) for v, n in skipped.items()] + [(volume, "rejected", error, 1)] * (error is not None)
                yield pd.DataFrame(found, columns=["volume", "what", "detail", "n"])

    rows = _buffers(spark, path).select("volume", "content").mapInPandas(run, "volume string, what string, detail string, n long")
    return rows.groupBy("volume", "what", "detail").agg(F.sum("n").alias("n"))


def entries_from_paths(paths: DataFrame) -> DataFrame:
    """(path) dump to (frn, parent_frn, name, is_dir, path): every prefix is an entry, one that
    another lies below is a directory. References are hashes of the paths, the same on any rerun."""
    parts = F.filter(F.split(F.translate("path", "/", "\\"), r"\\"), lambda x: x != "")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", F.lit(1), i)))
    rows = paths.select(parts.alias("p")).filter(F.size("p") > 0).select(prefixes.alias("p")).distinct()
    ref = lambda c: F.xxhash64(F.array_join(c, "\\"))
    parent = F.slice("p", F.lit(1), F.size("p") - 1)
    from ..operators.paths import ROOT_FRN

    rows = rows.select(ref(F.col("p")).alias("frn"), F.when(F.size("p") > 1, ref(parent)).otherwise(F.lit(ROOT_FRN)).alias("parent_frn"), F.element_at("p", -1).alias("name"), F.array_join("p", "\\").alias("path"))
    above = rows.select(F.col("parent_frn").alias("d")).distinct().withColumn("is_dir", F.lit(True))
    return rows.join(above, F.col("frn") == F.col("d"), "left").select("frn", "parent_frn", "name", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "path")
