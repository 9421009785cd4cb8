"""Name folding, lossless UTF-16 names, paths."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType


def fold_text(name: str) -> str:
    """Case folding of names: decompose, lower each character on its own, recompose.

    Context-free (no final-sigma rule), canonical-equivalence-safe and idempotent; accents stay.
    """
    if name.isascii():
        return name.lower()
    low = "".join(c.lower()[0] if c.lower() else c for c in unicodedata.normalize("NFD", name))
    return unicodedata.normalize("NFC", low)


@F.pandas_udf(StringType())
def _fold_any(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else fold_text(x))


@F.pandas_udf(BinaryType())
def _fold_raw(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else fold_raw(bytes(x)))


def fold_raw(raw: bytes) -> bytes:
    """fold_text of a name's exact bytes: unpaired surrogates stay, what is no text at all too."""
    try:
        return fold_text(raw.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str, str]:
    """From the folding rule, over all characters: those that fold to another one, what they fold to, and a
    class of those whose folding depends on their neighbours (marks and what joins with them) or has more
    than one character."""
    shown, folded, others = [], [], []
    for code in range(0x80, 0x20000):  # of what comes later, nothing is common in names
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:  # surrogates; syllables fold to themselves
            continue
        c = chr(code)
        out = fold_text(c)
        if len(out) != 1 or unicodedata.combining(out) or unicodedata.category(c) in ("Mn", "Mc") or 0x1100 <= code < 0x1200:
            others.append(code)
        elif out != c:
            shown.append(c), folded.append(out)
    spans: list[list[int]] = [[0x20000, 0x10FFFF]]
    for code in others:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(shown), "".join(folded), "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def joins_letters(name: Column) -> Column:
    """Names whose characters can't be folded one by one; none is ASCII."""
    return F.coalesce((F.octet_length(name) != F.char_length(name)) & name.rlike(_letters()[2]), F.lit(False))


def fold_letters(name: Column) -> Column:
    """fold_text of names without such characters, in generated code."""
    shown, folded, _ = _letters()
    return F.when(F.octet_length(name) == F.char_length(name), F.lower(name)).otherwise(F.translate(_ascii_lower(name), shown, folded))


def _ascii_lower(name: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(name, upper, upper.lower())


def fold(name: Column) -> Column:
    """fold_text as a column, by Python: for single values. Tables go through with_folded()."""
    return _fold_any(name)


def with_folded(rows: DataFrame, name: str, out: str, raw: str | None = None, raw_out: str | None = None) -> DataFrame:
    """rows with the folded name; only names with joining marks, or with raw bytes, go through Python.

    They are a branch of their own, so that the plan of all other rows has no Python step.
    """
    odd = joins_letters(F.col(name)) | (F.col(raw).isNotNull() if raw else F.lit(False))
    plain = rows.filter(~odd).withColumn(out, fold_letters(F.col(name)))
    rare = rows.filter(odd).withColumn(out, _fold_any(F.col(name)))
    if raw:
        plain = plain.withColumn(raw_out, F.lit(None).cast("binary"))
        rare = rare.withColumn(raw_out, _fold_raw(F.col(raw)))
    return plain.unionByName(rare)


def fold_ascii(name: Column) -> Column:
    """Folding of names that are known to be ASCII."""
    return F.lower(name)


def folded_file_name(path: Column) -> Column:
    """The folded last component of a path whose characters fold one by one."""
    return fold_letters(F.substring_index(path, "\\", -1))


def extension(name_fold: Column) -> Column:
    """Text after the last dot; null without one, '' for a trailing dot."""
    return F.when(F.instr(name_fold, ".") > 0, F.substring_index(name_fold, ".", -1))


def from_utf16(units: list[int]) -> tuple[str, bytes | None]:
    """(lossy text, raw bytes if it holds unpaired surrogates)."""
    raw = b"".join(u.to_bytes(2, "little") for u in units)
    try:
        return raw.decode("utf-16-le"), None
    except UnicodeDecodeError:
        text = raw.decode("utf-16-le", "surrogatepass")
        return "".join("�" if 0xD800 <= ord(c) < 0xE000 else c for c in text), text.encode("utf-8", "surrogatepass")


def to_utf16(raw: bytes) -> list[int]:
    """UTF-16 units of raw name bytes; bytes that decode to nothing become U+FFFD one by one."""
    try:
        text = raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode("utf-8", "surrogatepass"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        text = "".join(out)
    data = text.encode("utf-16-le", "surrogatepass")
    return [int.from_bytes(data[i : i + 2], "little") for i in range(0, len(data), 2)]


def like_pattern(glob: str) -> str:
    """A whole-name glob as a LIKE pattern with escape character backslash."""
    out = []
    for c in glob:
        if c == "*":
            if not out or out[-1] != "%":
                out.append("%")
        elif c == "?":
            out.append("_")
        else:
            out.append("\\" + c if c in "%_\\" else c)
    return "".join(out)


def glob_matches(name: Column, glob: str) -> Column:
    return name.like(like_pattern(glob))


def frn_parts(frn: Column) -> tuple[Column, Column]:
    """(record number, sequence) of a 64-bit reference kept as its bit pattern."""
    return frn.bitwiseAND(F.lit((1 << 48) - 1)), F.shiftrightunsigned(frn, 48).cast("int")


def split_path(path: str) -> tuple[str, str]:
    """(parent, name) at the last separator of either kind."""
    at = max(path.rfind("\\"), path.rfind("/"))
    return (path[:at], path[at + 1 :]) if at >= 0 else ("", path)


def starts_ignoring_case(text: str, prefix: str) -> bool:
    """ASCII-case-insensitive prefix test."""
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    return low(text).startswith(low(prefix))


def needs_quotes(value: Column) -> Column:
    return value.rlike('[,"\r\n]')
