"""Control messages: requests and replies as dictionaries, the same over any transport."""

from __future__ import annotations

import json

from .operators.search import Engine
from .plans.query_text import QueryError
from .schema import COMPLETE, Sort
from .sources.outputs import REQUEST_LIMIT, hit_dict

# Protocol version, names of requests, replies and failures.
PROTOCOL = 1
HELLO, QUERY, STATUS, RESULTS, ERROR = "Hello", "Query", "Status", "Results", "Error"
BAD_QUERY, INTERNAL, TOO_LARGE, UNSUPPORTED = "BadQuery", "Internal", "TooLarge", "Unsupported"
_SORT_KEYS = ("name", "path", "size", "date")


def failure(code: str, message: str) -> dict:
    return {"t": ERROR, "code": code, "message": message}


class Service:
    """Answers one request after the other from an engine."""

    def __init__(self, engine: Engine, name: str = "stratafind"):
        self.engine, self.name = engine, name

    def handle_bytes(self, data: bytes) -> dict:
        if len(data) > REQUEST_LIMIT:
            return failure(TOO_LARGE, f"request of {len(data)} bytes")
        try:
            request = json.loads(data)
        except ValueError as e:
            return failure(UNSUPPORTED, str(e))
        return self.handle(request)

    def handle(self, request: dict) -> dict:
        answers = {HELLO: self.hello, QUERY: self.query, STATUS: lambda _: self.status()}
        answer = answers.get(request.get("t")) if isinstance(request, dict) else None
        if answer is None:
            return failure(UNSUPPORTED, "unknown request")
        try:
            return answer(request)
        except QueryError as e:
            return failure(BAD_QUERY, str(e))
        except Exception as e:  # a client gets an answer, whatever happens
            return failure(INTERNAL, f"{type(e).__name__}: {e}"[:2000])

    def hello(self, request: dict) -> dict:
        """One version is spoken: a client whose range does not hold it is refused."""
        least, most = request["proto_min"], request["proto_max"]
        if not least <= PROTOCOL <= most:
            return failure(UNSUPPORTED, f"client speaks protocol {least} to {most}, this service {PROTOCOL}")
        return {"t": HELLO, "proto": PROTOCOL, "server": self.name, "ready": all(v.phase in COMPLETE for v in self.engine.volumes)}

    def query(self, request: dict) -> dict:
        sort = request.get("sort") or {}
        if sort.get("key", "name") not in _SORT_KEYS:
            return failure(UNSUPPORTED, f"sort key {sort['key']!r}")
        found = self.engine.query(
            request["query"], request.get("scope"), Sort(sort.get("key", "name"), sort.get("descending")), request.get("offset", 0), request.get("limit"),
            request.get("match_case", False), request.get("want_size", True), request.get("want_mtime", True),
        )
        items = [hit_dict(r.asDict()) for r in found.hits.toLocalIterator()]
        return {"t": RESULTS, "total": found.total, "generation": found.generation, "items": items, "more": False, "volumes_incomplete": found.volumes_incomplete, "metadata_pending": found.metadata_pending}

    def status(self) -> dict:
        rows = [r.asDict() for r in self.engine.status().orderBy("volume").collect()]
        return {"t": STATUS, "volumes": rows, "volumes_incomplete": not all(r["ready"] for r in rows)}
