"""Command-line flags to a plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..schema import Sort

# Exit codes.
OK, BAD_QUERY, FILE_ERROR, BAD_ARGUMENT = 0, 4, 5, 6

_SORTS = {"name": "name", "path": "path", "size": "size", "dm": "date", "date-modified": "date"}


class ArgumentError(ValueError):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


@dataclass
class Plan:
    query: str = ""
    limit: int | None = None
    scope: str | None = None
    columns: list[str] = field(default_factory=list)
    sort: Sort = field(default_factory=Sort)
    export: str | None = None
    bom: bool = True
    header: bool = True
    double_quote: bool = True
    match_case: bool = False
    json: bool = False
    status: bool = False

    def column(self, name: str) -> None:
        """Adds a column; a repeated one moves to the end."""
        if name in self.columns:
            self.columns.remove(name)
        self.columns.append(name)


def _switch(word: str) -> str | None:
    """The canonical switch of a word: dashes inside are optional but may not be added."""
    body = word[1:]
    flags = ("n", "max-results", "path", "size", "dm", "date-modified", "sort", "export-csv", "utf8-bom", "no-utf8-bom", "no-header", "no-double-quote", "case", "match-case")
    sorts = [f"sort-{k}{d}" for k in _SORTS for d in ("", "-ascending", "-descending")]
    for flag in (*flags, *sorts):
        if re.fullmatch("-?".join(map(re.escape, flag.split("-"))), body):
            return flag
    return None


def _sort(text: str) -> Sort:
    for name, key in _SORTS.items():
        for tail, down in (("", None), ("-ascending", False), ("-descending", True)):
            if re.fullmatch("-?".join(map(re.escape, (name + tail).split("-"))), text):
                return Sort(key, down)
    raise ArgumentError(BAD_QUERY, f"unknown sort {text!r}")


def parse_arguments(argv: list[str]) -> Plan:
    plan, words, rest = Plan(), [], iter(argv)

    def value(flag: str) -> str:
        got = next(rest, None)
        if got is None:
            raise ArgumentError(BAD_QUERY, f"{flag} needs a value")
        return got

    for word in rest:
        if word in ("--json", "--status", "--insecure-no-server-check"):
            plan.json |= word == "--json"
            plan.status |= word == "--status"
            continue
        if word.startswith("--") and word.strip("-"):
            raise ArgumentError(BAD_ARGUMENT, f"unknown flag {word}")
        flag = _switch(word) if word[:1] in ("-", "/") and len(word) > 1 else None
        if flag is None:
            if word.startswith("-") and word.strip("-"):
                raise ArgumentError(BAD_ARGUMENT, f"unknown flag {word}")
            words.append(word)
        elif flag in ("n", "max-results"):
            number = value(word)
            if not re.fullmatch(r"\+?\d+", number, re.A) or int(number) >= 1 << 32:
                raise ArgumentError(BAD_QUERY, f"bad count {number!r}")
            plan.limit = int(number)
        elif flag == "path":
            plan.scope = value(word)
        elif flag == "size":
            plan.column("size")
        elif flag in ("dm", "date-modified"):
            plan.column("date")
        elif flag == "sort":
            plan.sort = _sort(value(word))
        elif flag.startswith("sort-"):
            plan.sort = _sort(flag.removeprefix("sort-"))
        elif flag == "export-csv":
            plan.export = value(word)
        elif flag in ("utf8-bom", "no-utf8-bom"):
            plan.bom = flag == "utf8-bom"
        elif flag == "no-header":
            plan.header = False
        elif flag == "no-double-quote":
            plan.double_quote = False
        else:
            plan.match_case = True
    plan.query = " ".join(words)
    return plan
