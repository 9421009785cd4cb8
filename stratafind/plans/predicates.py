"""Predicate trees as Columns. Cheap conditions stand first; all can reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.text import glob_matches
from .query_text import ParsedQuery, clamp


def entry_predicate(query: ParsedQuery) -> Column:
    """Everything that is decided on the entry alone (no path)."""
    name = F.col("name") if query.match_case else F.col("name_fold")
    raw = F.col("name_raw") if query.match_case else F.col("name_fold_raw")
    parts = [~F.col("is_placeholder")]
    if query.is_dir is not None:
        parts.append(F.col("is_dir") == query.is_dir)
    if query.size is not None:
        least, most = query.size
        parts.append(F.lit(False) if least > (1 << 63) - 1 else F.col("size").between(least, clamp(most)))
    for term in query.terms:
        if term:
            plain = F.contains(name, F.lit(term))
            # U+FFFD of a lossy name must not match a needle that holds it
            parts.append(plain if "�" not in term else F.when(F.col("non_unicode"), F.contains(raw, F.lit(term.encode()))).otherwise(plain))
    parts += [glob_matches(name, g) for g in query.globs]
    if query.extensions:
        parts.append(F.col("ext_fold").isin(query.extensions))
    return reduce(lambda a, b: a & b, parts)


def path_predicate(query: ParsedQuery) -> Column | None:
    """Conditions on the path within the volume, or None."""
    path = F.col("path_in_volume") if query.match_case else F.col("path_fold")
    parts = [F.contains(path, F.lit(p)) for p in query.paths]
    return reduce(lambda a, b: a & b, parts) if parts else None
