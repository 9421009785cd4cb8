"""The search language: text to a predicate tree, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.text import fold_text
from ..schema import MAX_I64

KB = 1024
# Named sizes, inclusive; unit suffixes.
NAMED_SIZES = {
    "empty": (0, 0),
    "tiny": (0, 10 * KB),
    "small": (10 * KB, 100 * KB),
    "medium": (100 * KB, KB**2),
    "large": (KB**2, 16 * KB**2),
    "huge": (16 * KB**2, 128 * KB**2),
    "gigantic": (128 * KB**2, None),
}
UNITS = {"kb": KB, "mb": KB**2, "gb": KB**3, "tb": KB**4, "b": 1}
MAX_U64 = (1 << 64) - 1


class QueryError(ValueError):
    """A query that can't be run (exit code 4 of the command line)."""


class UnsupportedOperator(QueryError):
    def __init__(self, char: str):
        super().__init__(f"unsupported operator {char!r}")
        self.char = char


class Malformed(QueryError):
    pass


@dataclass
class ParsedQuery:
    """What must hold: all terms, globs and path terms, and the last of each filter."""

    terms: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    size: tuple[int, int] | None = None
    is_dir: bool | None = None
    match_case: bool = False


def tokens(text: str) -> list[tuple[str, bool]]:
    """(token, literal): split at unquoted white space; a token with a quoted part is literal."""
    out, now, literal, open_quote, begun = [], [], False, False, False
    for c in text:
        if c == '"':
            open_quote, literal, begun = not open_quote, True, True
        elif c.isspace() and not open_quote:
            if begun:
                out.append(("".join(now), literal))
            now, literal, begun = [], False, False
        else:
            if c in "|!" and not open_quote:
                raise UnsupportedOperator(c)
            now.append(c)
            begun = True
    if begun:
        out.append(("".join(now), literal))
    return out


def byte_count(text: str) -> int:
    """"10mb" and the like; integers of 64 bits."""
    low = text.strip().lower()
    unit = next((u for u in UNITS if low.endswith(u)), "")
    digits = low[: len(low) - len(unit)].strip().removeprefix("+")
    if not digits or not digits.isascii() or not digits.isdigit():
        raise Malformed(f"size: {text!r}")
    value = int(digits) * UNITS.get(unit, 1)
    if value > MAX_U64:
        raise Malformed(f"size: {text!r} is too large")
    return value


def size_range(text: str) -> tuple[int, int]:
    """Inclusive bounds of a size filter."""
    text = text.strip()
    low = text.lower()
    if low in NAMED_SIZES:
        least, most = NAMED_SIZES[low]
        return least, MAX_U64 if most is None else most
    if ".." in text:
        a, b = text.split("..", 1)
        return byte_count(a) if a.strip() else 0, byte_count(b) if b.strip() else MAX_U64
    for mark in (">=", "<=", ">", "<", "="):
        if text.startswith(mark):
            value = byte_count(text[len(mark) :])
            return {
                ">=": (value, MAX_U64),
                "<=": (0, value),
                ">": (min(value + 1, MAX_U64), MAX_U64),
                "<": (0, max(value - 1, 0)),
                "=": (value, value),
            }[mark]
    value = byte_count(text)
    return value, value


def parse_query(text: str, match_case: bool = False) -> ParsedQuery:
    """match_case is the default that a case: in the text overrides."""
    words, query = tokens(text), ParsedQuery(match_case=match_case)
    rest = []
    for word, literal in words:
        name, colon, value = word.partition(":")
        if not literal and colon and name.lower() == "case" and value in ("", "0", "1"):
            query.match_case = value != "0"
        else:
            rest.append((word, literal))
    keep = (lambda s: s) if query.match_case else fold_text

    def bare(word: str) -> None:
        if not word:
            return
        if "*" in word or "?" in word:
            query.globs.append(keep(word))
        elif "\\" in word or "/" in word:
            query.paths.append(keep(word))
        else:
            query.terms.append(keep(word))

    for word, literal in rest:
        name, colon, value = word.partition(":")
        name = name.lower()
        if literal or not colon:
            if literal:
                query.terms.append(keep(word))
            else:
                bare(word)
        elif name == "ext":
            # a list without any member leaves an earlier one as it is
            given = [x for x in value.split(";") if x]
            query.extensions = [fold_text(x.lstrip(".")) for x in given] or query.extensions
        elif name == "size":
            query.size = size_range(value)
        elif name == "path":
            if value:
                query.paths.append(keep(value))
        elif name in ("file", "folder", "dir"):
            query.is_dir = name != "file"
            bare(value)
        else:
            query.terms.append(keep(word))
    return query


def clamp(value: int) -> int:
    return min(value, MAX_I64)
