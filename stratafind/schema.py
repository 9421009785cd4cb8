"""Schemas and small value types of the file-metadata engine."""

from __future__ import annotations

from dataclasses import dataclass

ENTRIES = (
    "volume string, entry_id bigint, frn bigint, record_no bigint, seq int, parent_frn bigint, name string, name_raw binary, "
    "name_fold string, name_fold_raw binary, ext_fold string, is_dir boolean, is_placeholder boolean, non_unicode boolean, size bigint, mtime_ft bigint"
)
ENTRY_COLUMNS = tuple(c.split()[0] for c in ENTRIES.split(", "))
JOURNAL = (
    "volume string, usn bigint, frn bigint, parent_frn bigint, reason bigint, attributes bigint, name string, name_raw binary, "
    "name_lossy boolean, timestamp_ft bigint, major_version int"
)
LAYOUT = "volume string, frn bigint, attributes bigint, size bigint, mtime_ft bigint, names array<struct<parent_frn:bigint,name:string,name_raw:binary,name_lossy:boolean,dos_only:boolean>>"
SNAPSHOT = "volume string, position bigint, place int, frn bigint, parent_frn bigint, attributes bigint, name string, name_raw binary"
HITS = "path string, path_raw binary, is_dir boolean, size bigint, mtime_ft bigint"
VOLUMES = "volume string, guid string, mounts array<string>, phase string, phase_reason string, metadata_pending boolean, is_fixed boolean, is_ntfs boolean, generation bigint"

RECORD_MASK = (1 << 48) - 1
DIRECTORY = 0x10
MAX_I64 = (1 << 63) - 1

#: Phases whose results are whole.
COMPLETE = ("Live", "Snapshot")


def phase_text(phase: str, reason: str | None = None) -> str:
    """How a phase is shown to people."""
    # The words of two phases that say more than their name.
    if phase == "Snapshot":
        return "snapshot (no journal; cannot track changes)"
    return f"failed ({reason or ''})" if phase == "Failed" else phase.lower()


#: Default directions by sort key.
DESCENDING = {"name": False, "path": False, "size": True, "date": True}


@dataclass(frozen=True)
class Sort:
    """A sort key (name, path, size, date) with its direction; None takes the key's default."""

    key: str = "name"
    descending: bool | None = None

    @property
    def down(self) -> bool:
        return DESCENDING[self.key] if self.descending is None else self.descending
