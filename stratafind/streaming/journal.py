"""Change streams into a versioned entry table, and the policies around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.changes import MASK, apply_references, references
from ..operators.paths import ROOT_FRN
from ..schema import COMPLETE, ENTRIES, JOURNAL
from ..tables import VersionedTable, keep, work_folder

# Supervision policy in seconds and counts; below, the names of outcomes, actions and phases.
BEAT_STALL, BUSY_STALL, MAX_REVIVES, HEALTHY_AFTER, BEAT_FRESH = 300, 30 * 60, 3, 10 * 60, 60
OFFLINE_AFTER, RESCAN_AFTER, BACKOFF_FIRST, BACKOFF_MOST, MAX_RESCANS = 5, 30, 0.5, 30.0, 3


def journal_since(rows: DataFrame, start_usn: int = 0, mask: int = MASK) -> DataFrame:
    """Records of a journal, batch or stream, from a position on that have a reason of interest."""
    return rows.filter((F.col("usn") >= start_usn) & (F.col("reason").bitwiseAND(F.lit(mask)) != 0))


def journal_stream(spark: SparkSession, path: str, start_usn: int = 0) -> DataFrame:
    """A folder of journal files as a stream, from a position on; records without a reason of interest are left out."""
    return journal_since(spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", 64).parquet(path), start_usn)


def merge_batch(table: VersionedTable, root_frn: int = ROOT_FRN):
    """foreachBatch writer: one batch is applied as a whole; a repeated batch id is skipped.

    Only the buckets of the record numbers that the batch acts on are read and rewritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        state = table.state()
        if batch_id <= state["batch"]:
            return
        # the position first: what a source gets meanwhile is applied again, never left out
        last = batch.agg(F.max("usn")).first()[0]
        refs = keep(references(batch, root_frn), f"{work_folder(table.spark)}/references")
        only = sorted(r[0] for r in refs.select(table.bucket()).distinct().collect())
        cursor = last if last is not None else state["cursor"] or 0
        table.publish(apply_references(table.read(ENTRIES, only), refs), batch_id, cursor, only)

    return write


def run_available(stream: DataFrame, table: VersionedTable, checkpoint: str) -> None:
    """Applies all that is there, then ends."""
    query = stream.writeStream.foreachBatch(merge_batch(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


@dataclass(frozen=True)
class Cursor:
    journal_id: int
    next_usn: int


@dataclass(frozen=True)
class JournalBounds:
    journal_id: int
    first_usn: int
    lowest_valid_usn: int
    next_usn: int


def cursor_check(saved: Cursor, live: JournalBounds) -> str:
    """InSync, or why all must be scanned anew."""
    if saved.journal_id != live.journal_id:
        return "JournalIdChanged"
    if saved.next_usn < live.first_usn:
        return "CursorPurged"
    inside = live.lowest_valid_usn <= saved.next_usn <= live.next_usn
    return "InSync" if inside else "RestampDiscontinuity"


def is_complete(phase: str) -> bool:
    return phase in COMPLETE


def failure_phase(failing_for: float) -> str:
    """What a read failure of so many seconds means for the volume."""
    return "Rescanning" if failing_for >= RESCAN_AFTER else "Offline" if failing_for >= OFFLINE_AFTER else "Live"


def backoff(failures: int) -> float:
    return min(BACKOFF_MOST, BACKOFF_FIRST * 2 ** max(0, failures - 1))


def may_rescan(consecutive: int) -> bool:
    """Rescans in a row are bounded; a healthy batch sets their number back."""
    return consecutive < MAX_RESCANS


def next_action(pulse: str, age: float, revives: int, proven: bool) -> str:
    """Supervision of one tail: pulse Beat, Busy or Retired, last seen age seconds ago."""
    if pulse == "Retired":
        return "GiveUp" if revives >= MAX_REVIVES else "Revive"
    if age >= (BUSY_STALL if pulse == "Busy" else BEAT_STALL):
        return "Cancel"
    return "ResetBudget" if pulse == "Beat" and revives and proven else "Nothing"


def healthy_since(before: float | None, pulse: str, age: float, phase: str, now: float) -> float | None:
    """Start of the unbroken run of fresh beats on a live volume."""
    if pulse == "Beat" and phase == "Live" and age < BEAT_FRESH:
        return now if before is None else before
    return None


def rescan(table: VersionedTable, scan, cursor: int) -> None:
    """Builds a new version from a full scan; cursor was taken before the scan began. The old
    version serves until the new one is published."""
    table.publish(scan(), table.state()["batch"], cursor)
