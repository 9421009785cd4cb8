"""Boolean trigram queries derived from regular expressions (driver side, no data)."""

from __future__ import annotations

import re._constants as C
import re._parser as P

#: Most exact strings that are tracked through a concatenation, and class members spelled out.
MOST_STRINGS, MOST_CLASS = 48, 4

#: A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).
Query = object


def both(a, b):
    return _join("and", a, b)


def either(a, b):
    return _join("or", a, b)


def _join(kind, a, b):
    if a is True or b is True:
        return True if kind == "or" else (b if a is True else a)
    if a == b:
        return a
    parts: set = set()
    for x in (a, b):
        parts |= x[1] if isinstance(x, tuple) and x[0] == kind else {x}
    return (kind, frozenset(parts))


def _grams(text: str):
    query = True
    for i in range(len(text) - 2):
        query = both(query, text[i : i + 3])
    return query


def _of_strings(strings: set[str]):
    """What a text must hold if it holds one of strings."""
    out = None
    for s in sorted(strings):
        grams = _grams(s)
        out = grams if out is None else either(out, grams)
    return True if out is None else out


class _Info:
    """What a sub-expression demands: its exact strings (or None), else ends and a query."""

    def __init__(self, exact=None, prefix=None, suffix=None, query=True):
        self.exact, self.query = exact, query
        self.prefix = {""} if prefix is None else prefix
        self.suffix = {""} if suffix is None else suffix


def _short(strings: set[str], last: bool) -> set[str]:
    cut = {s[-2:] if last else s[:2] for s in strings}
    return cut if len(cut) <= MOST_STRINGS else {""}


def _ends(x: _Info) -> tuple[set, set, object]:
    if x.exact is not None:
        return _short(x.exact, False), _short(x.exact, True), _of_strings(x.exact)
    return x.prefix, x.suffix, x.query


def _concat(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Info({x + y for x in a.exact for y in b.exact})
    a_pre, a_suf, a_query = _ends(a)
    b_pre, b_suf, b_query = _ends(b)
    if a.exact is not None and a.exact and len(a.exact) * len(b_pre) <= MOST_STRINGS:
        seam = _of_strings({x + y for x in a.exact for y in b_pre})
        a_query = True
    elif b.exact is not None and b.exact and len(a_suf) * len(b.exact) <= MOST_STRINGS:
        seam = _of_strings({x + y for x in a_suf for y in b.exact})
        b_query = True
    else:
        seam = _of_strings({x + y for x in a_suf for y in b_pre})
    return _Info(None, a_pre, b_suf, both(both(a_query, b_query), seam))


def _union(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _Info(a.exact | b.exact)
    a_pre, a_suf, a_query = _ends(a)
    b_pre, b_suf, b_query = _ends(b)
    return _Info(None, a_pre | b_pre, a_suf | b_suf, either(a_query, b_query))


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind == C.LITERAL:
            out.add(chr(value))
        elif kind == C.RANGE and value[1] - value[0] < MOST_CLASS:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _sequence(nodes) -> _Info:
    out = _Info({""})
    for kind, value in nodes:
        if kind == C.LITERAL:
            x = _Info({chr(value).lower()})
        elif kind == C.IN:
            members = _members(value)
            x = _Info({m.lower() for m in members}) if members else _Info()
        elif kind == C.SUBPATTERN:
            x = _sequence(value[-1])
        elif kind == C.BRANCH:
            x = None
            for branch in value[1]:
                one = _sequence(branch)
                x = one if x is None else _union(x, one)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = value
            one = _sequence(body)
            if (least, most) == (0, 1):
                x = _union(one, _Info({""}))
            elif least == 0:
                x = _Info()
            elif least == most == 1:
                x = one
            else:
                pre, suf, query = _ends(one)
                x = _Info(None, pre, suf, query)
        elif kind == C.AT:
            x = _Info({""})
        else:
            x = _Info()
        out = _concat(out, x)
    return out


def trigram_query(pattern: str):
    """The Boolean query over lower-cased trigrams that every text with a match satisfies.

    True means that the pattern has no mandatory trigram, so that its rule must scan fully.
    """
    info = _sequence(P.parse(pattern))
    return _ends(info)[2]


def grams_of(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*map(grams_of, query[1]))
