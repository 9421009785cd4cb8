"""Tails of change journals: checked start, batches, failures, rescans, supervision."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators.changes import MASK
from ..operators.paths import ROOT_FRN
from ..tables import VersionedTable
from . import journal as policy


class JournalGone(Exception):
    """The journal that was read is deleted, inactive or no longer holds the cursor."""


@dataclass
class Tail:
    """Keeps one volume's table up to date from its journal.

    bounds() tells the live journal's JournalBounds; read(cursor) returns the records from a
    position on, as a JOURNAL frame, and raises JournalGone or any other error; scan() returns
    (ENTRIES of a full scan). phase follows what happens; counts are kept for status reports.
    """

    table: VersionedTable
    bounds: Callable[[], policy.JournalBounds]
    read: Callable[[policy.Cursor], DataFrame]
    scan: Callable[[], DataFrame]
    root_frn: int = ROOT_FRN
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    phase: str = "Bootstrapping"
    reason: str | None = None
    cursor: policy.Cursor | None = None
    rescans: int = 0
    failures: int = 0
    failing_since: float | None = None
    log: list[str] = field(default_factory=list)

    def start(self, saved: policy.Cursor | None) -> None:
        """Goes on from a saved cursor if the live journal still holds it, else scans anew."""
        if saved is not None:
            verdict = policy.cursor_check(saved, self.bounds())
            if verdict == "InSync":
                self.cursor, self.phase = saved, "Live"
                return
            self.log.append(verdict)
        self.rescan()

    def rescan(self) -> None:
        """A new version from a full scan; the cursor is taken before it begins, and the old version serves until then."""
        if not policy.may_rescan(self.rescans):
            self.phase, self.reason = "Failed", f"{self.rescans} rescans in a row"
            return
        self.rescans += 1
        self.phase = "Rescanning" if self.table.state()["version"] >= 0 else "Bootstrapping"
        now = self.bounds()
        try:
            policy.rescan(self.table, self.scan, now.next_usn)
        except Exception as e:
            self.phase, self.reason = "Failed", f"{type(e).__name__}: {e}"
            return
        self.cursor, self.phase, self.reason = policy.Cursor(now.journal_id, now.next_usn), "Live", None
        self.failures, self.failing_since = 0, None

    def step(self) -> bool:
        """Reads and applies what is there; False where the tail has ended."""
        if self.phase == "Failed" or self.cursor is None:
            return False
        try:
            rows = self.read(self.cursor)
            last = rows.agg(F.max("usn")).first()[0]
            wanted = rows.filter(F.col("reason").bitwiseAND(F.lit(MASK)) != 0)
            if last is not None and last >= self.cursor.next_usn:
                policy.merge_batch(self.table, self.root_frn)(wanted, self.table.state()["batch"] + 1)
                self.cursor = policy.Cursor(self.cursor.journal_id, last + 1)
        except JournalGone as e:
            self.log.append(f"gone: {e}")
            self.rescan()
        except Exception as e:
            self._failed(e)
        else:
            self.phase, self.rescans, self.failures, self.failing_since = "Live", 0, 0, None
        return self.phase != "Failed"

    def _failed(self, error: Exception) -> None:
        """Any other failure is tried again, later each time; it shows as Offline, and in the end as a rescan."""
        self.failures += 1
        self.failing_since = self.clock() if self.failing_since is None else self.failing_since
        self.log.append(f"read: {type(error).__name__}")
        phase = policy.failure_phase(self.clock() - self.failing_since)
        if phase == "Rescanning":
            self.rescan()
            return
        self.phase = phase
        self.sleep(policy.backoff(self.failures))


def supervise(tails: dict[str, Tail], seen: dict[str, tuple[str, float]], revives: dict[str, int], healthy: dict[str, float | None], now: float) -> dict[str, str]:
    """One round over all tails: seen has each one's last pulse and when; returns the action taken by volume.

    A tail that ended is started anew from its cursor up to a bounded number of times, which a
    healthy run gives back; one whose pulse is too old is to be cancelled by its owner.
    """
    actions = {}
    for volume, tail in tails.items():
        pulse, at = seen[volume]
        pulse = "Retired" if tail.phase == "Failed" else pulse
        healthy[volume] = policy.healthy_since(healthy.get(volume), pulse, now - at, tail.phase, now)
        since = healthy[volume]
        proven = since is not None and now - since >= policy.HEALTHY_AFTER
        action = actions[volume] = policy.next_action(pulse, now - at, revives.get(volume, 0), proven)
        if action == "Revive":
            revives[volume] = revives.get(volume, 0) + 1
            tail.rescans, tail.reason, tail.phase = 0, None, "Rescanning"
            tail.start(tail.cursor)
        elif action == "ResetBudget":
            revives[volume] = 0
        elif action == "GiveUp":
            tail.phase = "Failed"
    return actions
