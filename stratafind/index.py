"""The entry table of all volumes with its operations: snapshot, enrichment, changes, links, stats, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import changes
from .operators.paths import ROOT_FRN, dir_paths
from .operators.search import Engine, Result, locate
from .schema import ENTRIES, Sort
from .streaming.journal import merge_batch
from .tables import VersionedTable, work_folder


class Index:
    """A versioned entry table below a shared folder. Every operation publishes a new version;
    the paths of directories are built once per version, when a search asks for them, those of entries at its second search."""

    def __init__(self, spark: SparkSession, root: str, volumes: DataFrame, root_frn: int = ROOT_FRN, buckets: int = 64):
        self.spark, self.volumes, self.root_frn = spark, volumes, root_frn
        self.table = VersionedTable(spark, root, buckets)
        self._engine: tuple[int, Engine] | None = None

    @property
    def entries(self) -> DataFrame:
        return self.table.read(ENTRIES)

    def _publish(self, entries: DataFrame) -> int:
        state = self.table.state()
        return self.table.publish(entries, state["batch"], state["cursor"] or 0)

    def ingest_snapshot(self, records: DataFrame, cursor: int = 0) -> int:
        """Starts anew from a full enumeration; cursor is the journal position from before it began."""
        return self.table.publish(changes.snapshot(records), self.table.state()["batch"], cursor)

    def enrich(self, layout: DataFrame) -> int:
        return self._publish(changes.enrich(self.entries, layout))

    def apply_journal(self, journal: DataFrame) -> int:
        """One batch of change records; only the buckets it acts on are rewritten."""
        merge_batch(self.table, self.root_frn)(journal, self.table.state()["batch"] + 1)
        return self.table.state()["version"]

    def reconcile_links(self, actual: DataFrame) -> DataFrame:
        """Publishes the links that were found; returns the counters of walks skipped and dropped."""
        entries, counters = changes.reconcile_links(self.entries, actual, self.root_frn)
        self._publish(entries)
        return counters

    def set_stats(self, stats: DataFrame) -> int:
        return self._publish(changes.set_stats(self.entries, stats))

    def engine(self) -> Engine:
        version = self.table.state()["version"]
        if self._engine is None or self._engine[0] != version:
            entries = self.entries
            paths = dir_paths(entries, self.root_frn)
            self._engine = version, Engine(self.spark, entries, paths, self.volumes, lambda: locate(entries, paths, f"{work_folder(self.spark)}/located"))
        return self._engine[1]

    def query(self, text: str, scope: str | None = None, sort: Sort | None = Sort(), offset: int = 0, limit: int | None = None, match_case: bool = False) -> Result:
        return self.engine().query(text, scope, sort, offset, limit, match_case)

    def total(self, text: str, scope: str | None = None) -> int:
        return self.query(text, scope, sort=None).total

    def status(self, drift: DataFrame | None = None) -> DataFrame:
        return self.engine().status(drift)
