"""Runs the plan of a command line: search or status to a CSV file, JSON or text; returns the exit code."""

from __future__ import annotations

import ntpath
import sys
from collections.abc import Callable

from ..operators.search import Engine, Result
from ..sources import outputs
from .arguments import BAD_QUERY, FILE_ERROR, OK, ArgumentError, Plan, parse_arguments
from .query_text import QueryError

INCOMPLETE = "warning: some volumes are still indexing or unavailable; results may be incomplete"


def absolute_scope(scope: str | None, base: str = "C:\\") -> str | None:
    """A scope folder made absolute against base, without a look at any disk."""
    if scope is None:
        return None
    text = scope.replace("/", "\\")
    drive, rest = ntpath.splitdrive(text)
    return ntpath.normpath(text if drive and rest.startswith("\\") else ntpath.join(base, text))


def search(plan: Plan, engine: Engine, base: str = "C:\\") -> Result:
    return engine.query(plan.query, scope=absolute_scope(plan.scope, base), sort=plan.sort, limit=plan.limit, match_case=plan.match_case)


def csv_lines(plan: Plan, engine: Engine, zone: str | None = None):
    """The rows of a plan's CSV as a DataFrame (line), in order, without the header."""
    return outputs.csv_rows(search(plan, engine).hits, plan.columns, plan.double_quote, zone)


def show_status(engine: Engine, out, drift=None) -> bool:
    """One line a volume, and one for what its counters show; whether all volumes are whole."""
    rows = engine.status(drift).orderBy("mount").collect()
    print(f"status: {len(rows)} volume(s)", file=out)
    for r in rows:
        v = r.asDict()
        pending = "  (metadata pending)" if v["metadata_pending"] else ""
        print(f"  {v['mount']:<8} {v['entries']:>12} entries  phase={v['phase_text']}{pending}", file=out)
        if v.get("dropped"):
            print(f"           {v['dropped']} hard-link change(s) not reconciled: some names may be stale", file=out)
        if v.get("stale_slots") or v.get("delete_of_unknown") or v.get("placeholders_created"):
            print(f"           drift: {v['stale_slots']} stale slot(s), {v['delete_of_unknown']} unknown delete(s), {v['placeholders_created']} placeholder(s)", file=out)
    return all(r["ready"] for r in rows)


#: Hits that a scan report shows of its query.
SHOWN_HITS = 20


def show_scan(engine: Engine, out, text: str | None = None) -> int:
    """The report of one scan: entries by volume and in all, and the first hits of a query; returns the entries."""
    rows = engine.status().orderBy("mount").collect()
    for r in rows:
        print(f"  {r['mount']:<8} {r['entries']:>12} entries", file=out)
    total = sum(r["entries"] for r in rows)
    print(f"  {'all':<8} {total:>12} entries", file=out)
    if text is not None:
        found = engine.query(text, limit=SHOWN_HITS)
        print(f"{found.total} match(es) of {text!r}", file=out)
        outputs.plain_paths(found.hits, out)
    return total


def run(argv: list[str], connect: Callable[[], Engine], out=None, err=None, zone: str | None = None, drift=None) -> int:
    """connect makes the engine; dates are on the clock of zone (None: the session's).

    An export file is created before anything else, so that a failure leaves an empty one.
    """
    out, err = out or sys.stdout, err or sys.stderr
    try:
        plan = parse_arguments(argv)
    except ArgumentError as e:
        print(e, file=err)
        return e.code
    try:
        file = open(plan.export, "wb") if plan.export is not None else None
    except OSError as e:
        print(f"cannot create {plan.export}: {e}", file=err)
        return FILE_ERROR
    try:
        engine = connect()
        if plan.status:
            if not show_status(engine, out, drift):
                print("some volumes are not fully live", file=err)
            return OK
        try:
            found = search(plan, engine)
        except QueryError as e:
            print(e, file=err)
            return BAD_QUERY
        if found.volumes_incomplete:
            print(INCOMPLETE, file=err)
        try:
            if file is not None:
                outputs.write_csv(found.hits, file, plan.columns, plan.bom, plan.header, plan.double_quote, zone)
            elif plan.json:
                print(outputs.to_json(found.hits, found.total, found.generation, found.volumes_incomplete, found.metadata_pending), file=out)
            else:
                outputs.plain_paths(found.hits, out)
        except BrokenPipeError:
            return OK
        except OSError as e:
            print(f"writing results failed: {e}", file=err)
            return FILE_ERROR
        return OK
    finally:
        if file is not None:
            file.close()
