"""Change records to operations, and operations to the next entry table (batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import extension, fold_ascii, frn_parts, with_folded
from ..schema import DIRECTORY, ENTRY_COLUMNS
from ..tables import keep, work_folder
from .paths import ROOT_FRN, unsent

# Reason bits.
REASON = {
    "data_overwrite": 0x1, "data_extend": 0x2, "data_truncation": 0x4, "create": 0x100, "delete": 0x200,
    "rename_old": 0x1000, "rename_new": 0x2000, "basic_info": 0x8000, "hard_link": 0x10000, "close": 0x80000000,
}
STAT_BITS = REASON["create"] | REASON["data_overwrite"] | REASON["data_extend"] | REASON["data_truncation"] | REASON["basic_info"]
MASK = 0
for _bit in ("data_overwrite", "data_extend", "data_truncation", "create", "delete", "rename_old", "rename_new", "basic_info", "hard_link"):
    MASK |= REASON[_bit]


def has(*names: str) -> Column:
    bits = 0
    for n in names:
        bits |= REASON[n]
    return F.col("reason").bitwiseAND(F.lit(bits)) != 0


def record_ops(journal: DataFrame) -> DataFrame:
    """One row per operation (op, sub): Delete alone; else Upsert, RenameOld, LinkDirty, StatDirty.

    Bits are tested, never compared as a whole; stateless, so it runs on streams as it is.
    """
    live = ~has("delete")
    claims = has("create", "rename_new")
    ops = F.array(
        F.when(has("delete"), F.lit("Delete")),
        F.when(live & claims, F.lit("Upsert")),
        F.when(live & has("rename_old") & ~claims, F.lit("RenameOld")),
        F.when(live & has("hard_link"), F.lit("LinkDirty")),
        F.when(live & (F.col("reason").bitwiseAND(F.lit(STAT_BITS)) != 0), F.lit("StatDirty")),
    )
    return journal.select("*", F.posexplode(F.filter(ops, lambda x: x.isNotNull())).alias("sub", "op"))


def _events(journal: DataFrame, root_frn: int) -> DataFrame:
    """record_events with its repeats, in one pass over the journal."""
    raw = journal if "name_raw" in journal.columns else journal.withColumn("name_raw", F.lit(None).cast("binary"))
    null = {c: F.lit(None).cast(t).alias(c) for c, t in (("parent", "bigint"), ("name", "string"), ("name_raw", "binary"), ("is_dir", "boolean"))}
    event = lambda step, frn, kind, *of: F.struct(F.lit(step).alias("step"), F.col(frn).alias("frn"), F.lit(kind).alias("kind"), *of)
    upsert = ~has("delete") & has("create", "rename_new")
    claim = event(1, "frn", "Claim", F.col("parent_frn").alias("parent"), F.col("name").alias("name"), F.col("name_raw").alias("name_raw"), (F.col("attributes").bitwiseAND(F.lit(DIRECTORY)) != 0).alias("is_dir"))
    of_record = F.array(F.when(upsert, event(0, "parent_frn", "Ensure", *null.values())), F.when(upsert, claim), F.when(has("delete"), event(1, "frn", "Kill", *null.values())))
    wanted = lambda x: x.isNotNull() & x["frn"].isNotNull() & (x["frn"] != root_frn)
    events = raw.select("volume", "usn", F.explode(F.filter(of_record, wanted)).alias("e")).select("volume", "usn", "e.*")
    return events.withColumn("record_no", frn_parts(F.col("frn"))[0])


def record_events(journal: DataFrame, root_frn: int = ROOT_FRN) -> DataFrame:
    """Ensure(parent) and Claim of every Upsert, Kill of every Delete, each on its record number."""
    return _events(journal, root_frn).dropDuplicates(["volume", "usn", "step", "frn", "kind"])


def references(journal: DataFrame, root_frn: int = ROOT_FRN) -> DataFrame:
    """(volume, record_no, frn, seen, killed, claim) of every reference that a journal acts on.

    All aggregates combine map-side, so a hot record costs one row per task; repeats change none of them."""
    at = F.struct("usn", "step")
    return _events(journal, root_frn).groupBy("volume", "record_no", "frn").agg(
        F.max(F.when(F.col("kind") != "Kill", at)).alias("seen"),
        F.max(F.when(F.col("kind") == "Kill", at)).alias("killed"),
        F.max(F.when(F.col("kind") == "Claim", F.struct("usn", "step", "parent", "name", "name_raw", "is_dir"))).alias("claim"),
    )


def latest_state(journal: DataFrame, root_frn: int = ROOT_FRN) -> tuple[DataFrame, DataFrame]:
    """(final, counters) of a journal alone: who holds each record number at its end.

    Every Upsert first ensures its parent and then claims its own record; both are events on
    their record numbers, ordered by (usn, step). The tenant is the reference of the last such
    event; it is present unless a Delete of it follows; its name, parent and kind are those of
    the last claim since it last vanished (none: a placeholder directory). Repeats are harmless:
    the last event decides.
    """
    return _final(references(journal, root_frn)), drift(record_events(journal, root_frn), record_ops(journal))


def _final(per_frn: DataFrame, rows: int = 0) -> DataFrame:
    """Who holds each record number at the end of a journal with these references."""
    tenant = per_frn.filter("seen is not null").groupBy("volume", "record_no").agg(F.max(F.struct("seen", "frn", "killed", "claim")).alias("t"))
    alive = tenant.filter(F.col("t.killed").isNull() | (F.col("t.seen") > F.col("t.killed")))
    # A claim counts only since the reference last vanished, by a Delete or by another tenant.
    others = per_frn.filter("seen is not null").select(F.col("volume").alias("v"), F.col("record_no").alias("r"), F.col("frn").alias("f"), F.col("seen").alias("other"))
    lost = (
        alive.join(unsent(others, rows), (F.col("volume") == F.col("v")) & (F.col("record_no") == F.col("r")) & (F.col("t.frn") != F.col("f")), "left")
        .groupBy("volume", "record_no").agg(F.first("t").alias("t"), F.max("other").alias("other"))
    )
    since = F.greatest(F.coalesce("t.killed", F.col("other")), F.coalesce("other", F.col("t.killed")))
    claim_at = F.struct(F.col("t.claim.usn").alias("usn"), F.col("t.claim.step").alias("step"))
    valid = F.col("t.claim").isNotNull() & (since.isNull() | (claim_at > since))
    return lost.select(
        "volume", "record_no", F.col("t.frn").alias("frn"), F.col("t.seen.usn").alias("usn"),
        F.when(valid, F.col("t.claim.parent")).alias("parent_frn"), F.when(valid, F.col("t.claim.name")).alias("name"), F.when(valid, F.col("t.claim.name_raw")).alias("name_raw"),
        F.when(valid, F.col("t.claim.is_dir")).otherwise(F.lit(True)).alias("is_dir"), (~valid).alias("is_placeholder"),
    )


def drift(events: DataFrame, ops: DataFrame) -> DataFrame:
    """Per volume stale_slots, delete_of_unknown and placeholders_created, by the order of events of each
    record number, and rename_old_seen, all for a journal that starts from nothing."""
    w = W.partitionBy("volume", "record_no").orderBy("usn", "step")
    before = F.lag(F.struct("frn", "kind")).over(w)
    rows = events.withColumn("p", before)
    live = F.col("p").isNotNull() & (F.col("p.kind") != "Kill")
    held = F.coalesce(live & (F.col("p.frn") == F.col("frn")), F.lit(False))
    old = ops.filter("op = 'RenameOld'").select("volume", "usn", "frn").distinct().select("volume", *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "c")], F.lit(1).cast("long").alias("d"))
    seen = rows.select(
        "volume",
        (live & (F.col("kind") != "Kill") & (F.col("p.frn") != F.col("frn"))).cast("long").alias("a"),
        ((F.col("kind") == "Kill") & ~held).cast("long").alias("b"),
        ((F.col("kind") == "Ensure") & ~held).cast("long").alias("c"),
        F.lit(0).cast("long").alias("d"),
    )
    names = {"a": "stale_slots", "b": "delete_of_unknown", "c": "placeholders_created", "d": "rename_old_seen"}
    return seen.unionByName(old).groupBy("volume").agg(*[F.sum(c).alias(n) for c, n in names.items()])


def completed(rows: DataFrame, ascii_names: bool = False) -> DataFrame:
    """ENTRIES rows from (volume, frn, parent_frn, name, is_dir, is_placeholder, size, mtime_ft), and
    name_raw and entry_id where they are there: all other columns are derived anew.

    Rows of any names are written down first: new and renamed ones, not those at rest.
    """
    have = set(rows.columns)
    if "name_raw" not in have:
        rows = rows.withColumn("name_raw", F.lit(None).cast("binary"))
    rows = rows.drop("name_fold", "name_fold_raw")
    if ascii_names:
        rows = rows.withColumn("name_fold", fold_ascii(F.col("name"))).withColumn("name_fold_raw", F.lit(None).cast("binary"))
    else:
        rows = with_folded(keep(rows, f"{work_folder(rows.sparkSession)}/named"), "name", "name_fold", "name_raw", "name_fold_raw")
    record, seq = frn_parts(F.col("frn"))
    rows = rows.withColumn("record_no", record).withColumn("seq", seq).withColumn("ext_fold", extension(F.col("name_fold")))
    fresh = F.xxhash64("volume", "frn", "parent_frn", "name", "name_raw")
    rows = rows.withColumn("entry_id", F.coalesce("entry_id", fresh) if "entry_id" in have else fresh).withColumn("non_unicode", F.col("name_raw").isNotNull())
    return rows.select(*ENTRY_COLUMNS)


#: What completed() asks for.
_GIVEN = ("volume", "entry_id", "frn", "parent_frn", "name", "name_raw", "is_dir", "is_placeholder", "size", "mtime_ft")


def snapshot(records: DataFrame) -> DataFrame:
    """ENTRIES of a full enumeration: records (volume, position, place, frn, parent_frn, attributes, name, name_raw).

    Of records of one number, a slot that was reused meanwhile, the last one by position and place counts.
    Unknown parents need no row: whatever lies below them is an orphan when it is looked up.
    """
    newest = F.max_by(F.struct("frn", "parent_frn", "attributes", "name", "name_raw"), F.struct("position", "place")).alias("r")
    last = records.withColumn("record_no", frn_parts(F.col("frn"))[0]).groupBy("volume", "record_no").agg(newest)
    null = F.lit(None).cast("bigint")
    is_dir = F.col("r.attributes").bitwiseAND(F.lit(DIRECTORY)) != 0
    return completed(last.select("volume", "r.frn", "r.parent_frn", "r.name", "r.name_raw", is_dir.alias("is_dir"), F.lit(False).alias("is_placeholder"), null.alias("size"), null.alias("mtime_ft")))


def apply_journal(entries: DataFrame, journal: DataFrame, root_frn: int = ROOT_FRN) -> DataFrame:
    """The entry table after a batch of change records, applied as one.

    Upsert of an unknown reference inserts; of a single-link one it renames in place and keeps
    size, time and row id; files with several links wait for reconcile_links. A record number that
    another reference claims or ensures loses its old tenant. Applying a batch twice changes
    nothing more. Rows that the batch does not rename come out with all their columns as they
    are, raw names included; rows of untouched record numbers take no part in any join but the
    one that tells them apart. What is derived is computed for new and renamed rows only.
    """
    folder = work_folder(entries.sparkSession)
    return apply_references(entries, keep(references(journal, root_frn), f"{folder}/references"))


def apply_references(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """apply_journal with the references of its batch, which are best written down: they are read many times."""
    rows = refs.count()
    final = keep(_final(refs, rows), f"{work_folder(entries.sparkSession)}/final")
    seen = refs.filter("seen is not null").groupBy(F.col("volume").alias("sv"), F.col("record_no").alias("sr")).agg(F.min("frn").alias("low"), F.max("frn").alias("high"))
    kills = refs.filter("killed is not null").select(F.col("volume").alias("kv"), F.col("frn").alias("kf"))
    touched = unsent(refs.select(F.col("volume").alias("tv"), F.col("record_no").alias("tr")).distinct(), rows)
    of_batch = (F.col("volume") == F.col("tv")) & (F.col("record_no") == F.col("tr"))
    rest = entries.join(touched, of_batch, "left_anti")
    mine = entries.join(touched, of_batch, "left_semi")
    # Gone are references that were deleted and those whose record another one took, even for a while.
    left = mine.join(unsent(kills, rows), (F.col("volume") == F.col("kv")) & (F.col("frn") == F.col("kf")), "left_anti")
    left = left.join(unsent(seen, rows), (F.col("volume") == F.col("sv")) & (F.col("record_no") == F.col("sr")), "left")
    left = left.filter(F.col("low").isNull() | ((F.col("low") == F.col("frn")) & (F.col("high") == F.col("frn")))).select(*ENTRY_COLUMNS)
    new = final.select(F.col("volume").alias("v"), F.col("frn").alias("f"), F.struct("parent_frn", "name", "name_raw", "is_dir", "is_placeholder").alias("new"))
    links = mine.groupBy(F.col("volume").alias("lv"), F.col("frn").alias("lf")).agg(F.count("*").alias("links"))
    both = left.join(unsent(new, rows), (F.col("volume") == F.col("v")) & (F.col("frn") == F.col("f")), "left").join(links, (F.col("volume") == F.col("lv")) & (F.col("frn") == F.col("lf")), "left")
    changes = [~F.col(c).eqNullSafe(F.col(f"new.{c}")) for c in ("parent_frn", "name", "name_raw", "is_dir", "is_placeholder")]
    renamed = F.col("f").isNotNull() & ~F.col("new.is_placeholder") & (F.coalesce("links", F.lit(1)) == 1)
    renamed = F.coalesce(renamed & (changes[0] | changes[1] | changes[2] | changes[3] | changes[4]), F.lit(False))
    same = both.filter(~renamed).select(*ENTRY_COLUMNS)
    moved = both.filter(renamed).select("volume", "entry_id", "frn", *[F.col(f"new.{c}").alias(c) for c in ("parent_frn", "name", "name_raw", "is_dir", "is_placeholder")], "size", "mtime_ft")
    there = left.select(F.col("volume").alias("ev"), F.col("frn").alias("ef")).distinct()
    fresh = final.join(there, (F.col("volume") == F.col("ev")) & (F.col("frn") == F.col("ef")), "left_anti")
    null = F.lit(None).cast("bigint")
    fresh = fresh.select("volume", null.alias("entry_id"), "frn", "parent_frn", "name", "name_raw", "is_dir", "is_placeholder", null.alias("size"), null.alias("mtime_ft"))
    return rest.select(*ENTRY_COLUMNS).unionByName(same).unionByName(completed(moved.select(*_GIVEN).unionByName(fresh.select(*_GIVEN))))


def enrich(entries: DataFrame, layout: DataFrame) -> DataFrame:
    """Adds missing hard links and sets size (files) and time of every link; never removes or renames.

    Rows at rest keep all their columns; names are told apart by their exact bytes.
    """
    facts = layout.select(F.col("volume").alias("v"), F.col("frn").alias("f"), F.col("size").alias("new_size"), F.col("mtime_ft").alias("new_time"))
    names = layout.select("volume", "frn", F.explode("names").alias("n")).filter("not n.dos_only")
    raw = F.col("n.name_raw") if "name_raw" in names.schema["n"].dataType.names else F.lit(None).cast("binary")
    names = names.select("volume", "frn", F.col("n.parent_frn").alias("parent_frn"), F.col("n.name").alias("name"), raw.alias("name_raw"))
    known = entries.select(F.col("volume").alias("kv"), F.col("frn").alias("kf"), F.col("is_dir").alias("kd"), F.col("parent_frn").alias("kp"), F.col("name").alias("kn"), F.col("name_raw").alias("kr"))
    of_frn = (F.col("volume") == F.col("kv")) & (F.col("frn") == F.col("kf"))
    files = known.filter("not kd").select("kv", "kf").distinct()
    lack = names.join(files, of_frn, "left_semi")
    lack = lack.join(known, of_frn & (F.col("parent_frn") == F.col("kp")) & (F.col("name") == F.col("kn")) & F.col("name_raw").eqNullSafe(F.col("kr")), "left_anti").distinct()
    null = F.lit(None).cast("bigint")
    lack = lack.select("*", F.lit(False).alias("is_dir"), F.lit(False).alias("is_placeholder"), null.alias("size"), null.alias("mtime_ft"))
    out = entries.select(*ENTRY_COLUMNS).unionByName(completed(lack)).join(facts, (F.col("volume") == F.col("v")) & (F.col("frn") == F.col("f")), "left")
    size = F.when(~F.col("is_dir"), F.coalesce("new_size", "size")).otherwise(F.col("size"))
    return out.withColumn("size", size).withColumn("mtime_ft", F.coalesce("new_time", "mtime_ft")).select(*ENTRY_COLUMNS)


def set_stats(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """Refreshes size (files) and time of every link of the references in stats (volume, frn, size, mtime_ft)."""
    new = stats.select(F.col("volume").alias("v"), F.col("frn").alias("f"), F.col("size").alias("s"), F.col("mtime_ft").alias("m"))
    out = entries.join(new, (F.col("volume") == F.col("v")) & (F.col("frn") == F.col("f")), "left")
    hit = F.col("f").isNotNull()
    return out.withColumn("size", F.when(hit & ~F.col("is_dir"), F.col("s")).otherwise(F.col("size"))).withColumn("mtime_ft", F.when(hit, F.col("m")).otherwise(F.col("mtime_ft"))).select(*entries.columns)


def reconcile_links(entries: DataFrame, actual: DataFrame, root_frn: int = ROOT_FRN) -> tuple[DataFrame, DataFrame]:
    """Sets the links of each reference in actual (volume, frn, links array<struct<parent_frn, name>>) to exactly those.

    links null: the walk was not possible, the reference stays and counts as skipped; an empty
    list deletes the file; a link whose parent is neither known nor the root drops the whole answer (counted).
    New links take the file's size and time. Returns (entries, counters).
    """
    dirs = entries.filter("is_dir").select(F.col("volume").alias("dv"), F.col("frn").alias("df")).distinct()
    links = actual.filter("links is not null").select("volume", "frn", F.explode_outer("links").alias("l"))
    raw = F.col("l.name_raw") if "name_raw" in links.schema["l"].dataType.names else F.lit(None).cast("binary")
    checked = links.join(dirs, (F.col("volume") == F.col("dv")) & (F.col("l.parent_frn") == F.col("df")), "left")
    bad = checked.filter("l is not null and df is null").filter(F.col("l.parent_frn") != root_frn).select(F.col("volume").alias("bv"), F.col("frn").alias("bf")).distinct()
    good = checked.join(bad, (F.col("volume") == F.col("bv")) & (F.col("frn") == F.col("bf")), "left_anti")
    want = good.filter("l is not null").select("volume", "frn", F.col("l.parent_frn").alias("parent_frn"), F.col("l.name").alias("name"), raw.alias("name_raw")).distinct()
    done = good.select(F.col("volume").alias("gv"), F.col("frn").alias("gf")).distinct()
    of_done = (F.col("volume") == F.col("gv")) & (F.col("frn") == F.col("gf"))
    rest = entries.join(done, of_done, "left_anti").select(*ENTRY_COLUMNS)
    mine = entries.join(done, of_done, "left_semi")
    keys = want.select(*[F.col(c).alias(f"w_{c}") for c in want.columns])
    equal = (F.col("volume") == F.col("w_volume")) & (F.col("frn") == F.col("w_frn")) & (F.col("parent_frn") == F.col("w_parent_frn")) & (F.col("name") == F.col("w_name")) & F.col("name_raw").eqNullSafe(F.col("w_name_raw"))
    stay = mine.join(keys, equal, "left_semi").select(*ENTRY_COLUMNS)
    had = mine.select(*[F.col(c).alias(f"w_{c}") for c in want.columns])
    facts = mine.groupBy("volume", "frn").agg(F.max("size").alias("size"), F.max("mtime_ft").alias("mtime_ft"), F.bool_or("is_dir").alias("is_dir"))
    new = want.join(had, equal, "left_anti").join(facts, ["volume", "frn"]).withColumn("is_placeholder", F.lit(False))
    flags = actual.select(F.col("links").isNull().cast("long").alias("skipped"), F.lit(0).cast("long").alias("dropped"))
    flags = flags.unionByName(bad.select(F.lit(0).cast("long").alias("skipped"), F.lit(1).cast("long").alias("dropped")))
    counters = flags.agg(F.sum("skipped").alias("skipped"), F.sum("dropped").alias("dropped"))
    return rest.unionByName(stay).unionByName(completed(new)), counters
