"""Queries over the driver's tables (as file metadata), each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions.filetime import format_utc, to_unix_ms
from .functions.text import frn_parts
from .operators import changes
from .operators.paths import dir_paths, orphans
from .operators.search import Engine, locate
from .schema import Sort
from .sources import adapters, outputs
from .tables import keep, work_folder

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_engines: dict[tuple, Engine] = {}


def entry_rows(spark: SparkSession, sf_dir: str, lose: int = 0) -> DataFrame:
    """Entries of both drives, read from their tables each time: no copy is written, so a query scans what it needs only."""
    rows = adapters.drive_c(spark, sf_dir, lose)
    return rows if lose else rows.unionByName(adapters.drive_d(spark, sf_dir))


def engine(spark: SparkSession, sf_dir: str, lose: int = 0) -> Engine:
    """Both drives: entries, their directory paths, and from the second search on entries with paths; the paths are written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, lose)
    if key not in _engines:
        entries = entry_rows(spark, sf_dir, lose)
        paths = dir_paths(entries, adapters.ROOT)
        _engines[key] = Engine(spark, entries, paths, adapters.volumes(spark), lambda: locate(entries, paths, f"{work_folder(spark)}/located"))
    return _engines[key]


# ---- SQL building blocks (chr(92) is the path separator)

_C = """
 SELECT 'C' AS volume, 1000 + r_regionkey AS frn, 5 AS parent_frn, r_name AS name, TRUE AS is_dir, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS mtime_ft FROM region
 UNION ALL SELECT 'C', 2000 + n_nationkey, 1000 + n_regionkey, n_name, TRUE, NULL, NULL FROM nation
 UNION ALL SELECT 'C', 1000000 + c_custkey, 2000 + c_nationkey, c_name, TRUE, NULL, NULL FROM customer {lose}
 UNION ALL SELECT 'C', 100000000 + o_orderkey, 1000000 + o_custkey, 'Order_' || o_orderkey || '.' || substr(o_orderpriority, 3), FALSE,
   CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END, CAST(floor(epoch(o_orderdate)) AS BIGINT) * 10000000 + 116444736000000000 FROM orders"""
_D = """
 UNION ALL SELECT DISTINCT 'D', p_type, '', p_type, TRUE, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM part
 UNION ALL SELECT DISTINCT 'D', p_type || '/' || p_brand, p_type, p_brand, TRUE, NULL, NULL FROM part
 UNION ALL SELECT 'D', 'f' || p_partkey, p_type || '/' || p_brand, p_name, FALSE, CAST(p_size AS BIGINT) * 1024, NULL FROM part"""
_C_TEXT = _C.replace("1000 + r_regionkey AS frn, 5 AS parent_frn", "CAST(1000 + r_regionkey AS VARCHAR) AS frn, '' AS parent_frn")
for _a in ("2000 + n_nationkey, 1000 + n_regionkey", "1000000 + c_custkey, 2000 + c_nationkey", "100000000 + o_orderkey, 1000000 + o_custkey"):
    _x, _y = _a.split(", ")
    _C_TEXT = _C_TEXT.replace(_a, f"CAST({_x} AS VARCHAR), CAST({_y} AS VARCHAR)")


def _tree(lose: str = "", d: bool = True) -> str:
    return f"""WITH RECURSIVE e AS ({_C_TEXT.format(lose=lose)}{_D if d else ''}),
 p AS (SELECT v AS volume, '' AS frn, '' AS path, 0 AS depth FROM (VALUES ('C'), ('D')) t(v)
   UNION ALL SELECT e.volume, e.frn, CASE WHEN p.path = '' THEN e.name ELSE p.path || chr(92) || e.name END, p.depth + 1
   FROM e JOIN p ON e.volume = p.volume AND e.parent_frn = p.frn WHERE e.is_dir),
 m AS (SELECT e.*, p.path AS dir_path, CASE WHEN p.path = '' THEN e.name ELSE p.path || chr(92) || e.name END AS inside, p.depth
   FROM e JOIN p ON e.volume = p.volume AND e.parent_frn = p.frn),
 h AS (SELECT *, volume || ':' || chr(92) || inside AS path, lower(name) AS low, lower(inside) AS low_path,
   CASE WHEN instr(name, '.') > 0 THEN lower(regexp_extract(name, '[^.]*$')) END AS ext FROM m) """


TREE = _tree()
SHOWN = ("path", "is_dir", "size", "mtime_ft")
HITS = "SELECT path, is_dir, size, mtime_ft FROM h WHERE "
_ORDER = {
    "name": "low {d}, volume {d}, inside {d}",
    "path": "volume {d}, lower(dir_path) {d}, low {d}, inside {d}",
    "size": "coalesce(size, 0) {d}, low {d}, volume {d}, inside {d}",
    "date": "coalesce(mtime_ft, -9223372036854775808) {d}, low {d}, volume {d}, inside {d}",
}


def _search(name: str, text: str, where: str, **how) -> None:
    """A search and the condition that it stands for."""

    def run(spark, sf_dir):
        return engine(spark, sf_dir).query(text, **how).hits.select(*SHOWN)

    QUERIES[name] = run
    tail = ""
    if how.get("limit") is not None or how.get("offset"):
        sort = how.get("sort", Sort())
        tail = " ORDER BY " + _ORDER[sort.key].format(d="DESC" if sort.down else "ASC")
        tail += f" LIMIT {how['limit']}" if how.get("limit") is not None else ""
        tail += f" OFFSET {how['offset']}" if how.get("offset") else ""
    SQL[name] = TREE + HITS + where + tail


_search("name_term", "urgent", "contains(low, 'urgent')", sort=None)
_search("name_and_terms", "order 99", "contains(low, 'order') AND contains(low, '99')", sort=None)
_search("phrase", '"not specified"', "contains(low, 'not specified')", sort=None)
_search("case_sensitive", "Order_1 case:", "contains(name, 'Order_1')", sort=None)
_search("case_sensitive_none", "order_1", "contains(name, 'order_1')", sort=None, match_case=True)
_search("glob_star", "order_*9.high", "low LIKE 'order\\_%9.high' ESCAPE '\\'", sort=None)
_search("glob_question", "order_??.*", "low LIKE 'order\\___.%' ESCAPE '\\'", sort=None)
_search("glob_escape", "*r_1*", "low LIKE '%r\\_1%' ESCAPE '\\'", sort=None)
_search("ext_single", "ext:urgent", "ext = 'urgent'", sort=None)
_search("ext_list", "ext:.HIGH;low", "ext IN ('high', 'low')", sort=None)
_search("ext_none", "ext:; file:", "NOT is_dir", sort=None)
_search("size_range", "size:10kb..100kb", "size BETWEEN 10240 AND 102400", sort=None)
_search("size_named", "size:tiny", "size BETWEEN 0 AND 10240", sort=None)
_search("size_cmp", "size:>=200000", "size >= 200000", sort=None)
_search("size_unknown_excluded", "size:>=0", "size IS NOT NULL", sort=None)
_search("ext_last_nonempty", "ext:urgent ext:;", "ext = 'urgent'", sort=None)
_search("size_open_both", "size:..", "size IS NOT NULL", sort=None)
_search("sorted_without_limit", "file:", "NOT is_dir", sort=Sort("path"))
_search("kind_file", "file:urgent", "NOT is_dir AND contains(low, 'urgent')", sort=None)
_search("kind_folder", "folder:", "is_dir", sort=None)
_search("path_term", "path:europe high", "contains(low_path, 'europe') AND contains(low, 'high')", sort=None)
_search("path_separator_term", "asia\\", "contains(low_path, 'asia' || chr(92))", sort=None)
_search("scope_ci", "urgent", "volume = 'C' AND contains(low, 'urgent') AND starts_with(low_path, 'europe' || chr(92))", sort=None, scope="c:\\EUROPE")
_search("scope_trailing_sep", "folder:", "volume = 'C' AND is_dir AND starts_with(low_path, 'asia' || chr(92))", sort=None, scope="C:/asia//")
_search("scope_missing", "order", "FALSE", sort=None, scope="C:\\nowhere")
_search("scope_other_volume", "order", "FALSE", sort=None, scope="Q:\\x")
_search("scope_excludes_self", "africa", "volume = 'C' AND contains(low, 'africa') AND starts_with(low_path, 'africa' || chr(92))", sort=None, scope="C:\\africa")
_search("scope_volume_root", "ext:high", "volume = 'C' AND ext = 'high'", sort=None, scope="C:\\")
_search("empty_query", "", "TRUE", sort=None)
_search("multi_volume_union", "1", "contains(low, '1')", sort=None)
for _key in ("name", "path", "size", "date"):
    for _down in (False, True):
        _search(f"sort_{_key}_{'desc' if _down else 'asc'}", "order", "contains(low, 'order')", sort=Sort(_key, _down), offset=10, limit=50)
_search("topk", "", "TRUE", sort=Sort("size"), limit=20)
_search("offset_page", "ext:low", "ext = 'low'", offset=100, limit=100)
_search("offset_past_end", "ext:low", "ext = 'low'", offset=1_000_000_000, limit=5)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(TREE + "SELECT count(*) AS total, count(*) FILTER (WHERE is_dir) AS folders FROM h WHERE contains(low, 'o')")
def total_count(spark, sf_dir):
    return engine(spark, sf_dir).query("o", sort=None).matches.agg(F.count("*").alias("total"), F.sum(F.col("is_dir").cast("long")).alias("folders"))


@query(TREE + "SELECT volume, path, depth FROM (SELECT volume, path, depth FROM p) q WHERE depth > 0")
def paths_all(spark, sf_dir):
    return engine(spark, sf_dir).paths.filter("status = 'Ok' and depth > 0").select("volume", "path", "depth")


@query(TREE + "SELECT volume, count(*) + 2 AS entries, TRUE AS ready FROM e GROUP BY volume")
def status_by_volume(spark, sf_dir):
    return engine(spark, sf_dir).status().select("volume", "entries", "ready")


@query(TREE + "SELECT volume, count(*) AS entries, count(DISTINCT name) AS names FROM e GROUP BY volume")
def name_dup_ratio(spark, sf_dir):
    return entry_rows(spark, sf_dir).groupBy("volume").agg(F.count("*").alias("entries"), F.countDistinct("name").alias("names"))


@query(TREE + "SELECT name, count(*) AS entries FROM e GROUP BY name HAVING count(*) > 1")
def shared_names(spark, sf_dir):
    return entry_rows(spark, sf_dir).groupBy("name").agg(F.count("*").alias("entries")).filter("entries > 1")


_LOST = _tree("WHERE c_custkey % 50 <> 0", d=False)


@query(_LOST + "SELECT path, is_dir, size, mtime_ft FROM h WHERE contains(low, 'high')")
def orphans_excluded(spark, sf_dir):
    return engine(spark, sf_dir, 50).query("high", sort=None).hits.select(*SHOWN)


@query(_LOST + "SELECT e.name FROM e WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.is_dir AND d.frn = e.parent_frn) AND e.parent_frn <> ''")
def orphans_list(spark, sf_dir):
    e = engine(spark, sf_dir, 50)
    return orphans(e.entries, e.paths).select("name")


@query("SELECT * FROM (VALUES (900000001, 'CycleDetected'), (900000002, 'CycleDetected'), (900000003, 'CycleDetected'), (900000004, 'InLostFound')) t(frn, status)")
def cycle_status(spark, sf_dir):
    more = [(900000001, 900000002, "a"), (900000002, 900000001, "b"), (900000003, 900000001, "c"), (900000004, 77, "d")]
    rows = spark.createDataFrame([("C", f, p, n, True, False, None, None) for f, p, n in more], "volume string, frn bigint, parent_frn bigint, name string, is_dir boolean, is_placeholder boolean, size bigint, mtime_ft bigint")
    entries = adapters.drive_c(spark, sf_dir).unionByName(changes.completed(rows, True))
    return dir_paths(entries, adapters.ROOT).filter("status <> 'Ok'").select("frn", "status")


_J = """WITH j AS (SELECT event_id AS usn, 281474976710656 * (1 + event_id // 5000) + 100 + user_id AS frn, 100 + user_id AS record_no,
   event_type || '_' || user_id || '_' || event_id || '.log' AS name,
   CASE event_type WHEN 'signup' THEN 'Upsert' WHEN 'purchase' THEN 'Upsert' WHEN 'error' THEN 'Delete' END AS op FROM events) """


@query(_J + """, o AS (SELECT usn, op, 0 AS n FROM j WHERE op IS NOT NULL UNION ALL
   SELECT event_id, 'StatDirty', 1 FROM events WHERE event_type IN ('signup', 'click')) SELECT op, count(*) AS records, min(usn) AS first_usn FROM o GROUP BY op""")
def journal_ops(spark, sf_dir):
    ops = changes.record_ops(adapters.journal(spark, sf_dir))
    return ops.groupBy("op").agg(F.count("*").alias("records"), F.min("usn").alias("first_usn"))


_FINAL = _J + """, u AS (SELECT record_no, max(usn) AS usn FROM j WHERE op = 'Upsert' GROUP BY record_no),
 t AS (SELECT j.* FROM j JOIN u USING (record_no, usn))
 SELECT t.record_no, t.frn, t.name FROM t WHERE NOT EXISTS (SELECT 1 FROM j k WHERE k.frn = t.frn AND k.op = 'Delete' AND k.usn > t.usn)"""


@query(_FINAL)
def journal_final_state(spark, sf_dir):
    final, _ = changes.latest_state(adapters.journal(spark, sf_dir), adapters.ROOT)
    return final.select("record_no", "frn", "name")


@query(_FINAL)
def journal_double_apply(spark, sf_dir):
    """The batch applied to an empty table, then again to the result."""
    journal = adapters.journal(spark, sf_dir)
    empty = adapters.drive_c(spark, sf_dir).limit(0)
    once = keep(changes.apply_journal(empty, journal, adapters.ROOT), f"{work_folder(spark)}/once")
    return changes.apply_journal(once, journal, adapters.ROOT).select("record_no", "frn", "name")


@query(_J + """, s AS (SELECT *, lag(frn) OVER w AS pf, lag(op) OVER w AS po FROM j WHERE op IS NOT NULL WINDOW w AS (PARTITION BY record_no ORDER BY usn))
 SELECT count(*) FILTER (WHERE op = 'Upsert' AND po = 'Upsert' AND pf <> frn) AS stale_slots,
  count(*) FILTER (WHERE op = 'Delete' AND NOT coalesce(po = 'Upsert' AND pf = frn, FALSE)) AS delete_of_unknown FROM s""")
def journal_drift(spark, sf_dir):
    return changes.latest_state(adapters.journal(spark, sf_dir), adapters.ROOT)[1].select("stale_slots", "delete_of_unknown")


@query("SELECT 2 AS major_version, count(*) AS records FROM events")
def records_by_version(spark, sf_dir):
    return adapters.journal(spark, sf_dir).groupBy("major_version").agg(F.count("*").alias("records"))


@query("SELECT DISTINCT 281474976710656 * (1 + event_id // 5000) + 100 + user_id AS frn FROM events WHERE event_type IN ('signup', 'click')")
def dirty_references(spark, sf_dir):
    return changes.record_ops(adapters.journal(spark, sf_dir)).filter("op = 'StatDirty'").select("frn").distinct()


_LAYOUT = """l AS (SELECT l_orderkey AS k, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS s, CAST(floor(epoch(max(l_shipdate))) AS BIGINT) * 10000000 + 116444736000000000 AS t FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {_LAYOUT}, f AS (SELECT 100000000 + o_orderkey AS frn, 'Order_' || o_orderkey || '.' || substr(o_orderpriority, 3) AS name, o_orderkey AS k,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS s0, CAST(floor(epoch(o_orderdate)) AS BIGINT) * 10000000 + 116444736000000000 AS t0 FROM orders)
 SELECT f.frn, f.name, coalesce(l.s, f.s0) AS size, coalesce(l.t, f.t0) AS mtime_ft FROM f LEFT JOIN l USING (k)
 UNION ALL SELECT 100000000 + l.k, 'Link_' || l.k || '.lnk', l.s, l.t FROM l JOIN f USING (k) WHERE l.k % 100 = 0""")
def enrich_add_only(spark, sf_dir):
    out = changes.enrich(adapters.drive_c(spark, sf_dir), adapters.layout(spark, sf_dir))
    return out.filter("not is_dir").select("frn", "name", "size", "mtime_ft")


@query(f"""WITH {_LAYOUT} SELECT 100000000 + o_orderkey AS frn, CASE WHEN l.k IS NOT NULL THEN l.s WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS size,
  coalesce(l.t, CAST(floor(epoch(o_orderdate)) AS BIGINT) * 10000000 + 116444736000000000) AS mtime_ft FROM orders LEFT JOIN l ON k = o_orderkey""")
def stat_refresh(spark, sf_dir):
    stats = adapters.layout(spark, sf_dir).select("volume", "frn", "size", "mtime_ft")
    return changes.set_stats(adapters.drive_c(spark, sf_dir), stats).filter("not is_dir").select("frn", "size", "mtime_ft")


@query("""SELECT 100000000 + o_orderkey AS frn, 'Order_' || o_orderkey || '.' || substr(o_orderpriority, 3) AS name FROM orders WHERE o_orderkey % 10 NOT IN (1, 2)
 UNION ALL SELECT 100000000 + o_orderkey, 'Moved_' || o_orderkey FROM orders WHERE o_orderkey % 10 = 1""")
def link_reconcile(spark, sf_dir):
    """Of ten files one gets exactly one new link, one loses all, one has an unknown parent (dropped), one was not walked."""
    entries = adapters.drive_c(spark, sf_dir)
    key = F.col("frn") - 100_000_000
    link = lambda parent, name: F.array(F.struct(F.lit(parent).cast("bigint").alias("parent_frn"), name.alias("name")))
    kind = F.array().cast("array<struct<parent_frn:bigint,name:string>>")
    moved = link(1000, F.concat(F.lit("Moved_"), key))
    links = F.when(key % 10 == 1, moved).when(key % 10 == 2, kind).when(key % 10 == 3, link(77, F.lit("x")))
    actual = entries.filter("not is_dir").filter(key % 10 < 5).select("volume", "frn", links.alias("links"))
    return changes.reconcile_links(entries, actual)[0].filter("not is_dir").select("frn", "name")


@query("""SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS utc, CAST(floor(epoch(o_orderdate)) AS BIGINT) * 1000 AS ms FROM orders""")
def filetime_format(spark, sf_dir):
    rows = adapters.drive_c(spark, sf_dir).filter("not is_dir")
    return rows.select((F.col("frn") - 100_000_000).alias("k"), format_utc(F.col("mtime_ft")).alias("utc"), to_unix_ms(F.col("mtime_ft")).alias("ms"))


@query(TREE + """SELECT CASE WHEN is_dir OR size IS NULL THEN '' ELSE CAST(size AS VARCHAR) END || ',' || CASE WHEN instr(path, ',') + instr(path, '"') > 0 THEN '"' || replace(path, '"', '""') || '"' ELSE path END AS line FROM h WHERE volume = 'C'""")
def csv_line(spark, sf_dir):
    hits = engine(spark, sf_dir).query("", scope="C:\\", sort=None).hits
    return hits.select(outputs.csv_line(["size"], double_quote=False).alias("line"))


@query("SELECT event_id AS usn, 100 + user_id AS record_no, CAST(1 + event_id // 5000 AS INTEGER) AS seq FROM events")
def frn_split(spark, sf_dir):
    record, seq = frn_parts(F.col("frn"))
    return adapters.journal(spark, sf_dir).select("usn", record.alias("record_no"), seq.alias("seq"))


@query(_FINAL)
def stream_journal_final_state(spark, sf_dir):
    """The journal as a stream of files, merged batch by batch into a versioned table."""
    from .schema import ENTRIES, JOURNAL
    from .streaming.journal import journal_stream, merge_batch
    from .tables import VersionedTable

    folder = work_folder(spark)
    adapters.journal(spark, sf_dir).repartitionByRange(3, "usn").write.parquet(f"{folder}/journal")
    table = VersionedTable(spark, f"{folder}/table")
    merge = merge_batch(table, adapters.ROOT)
    stream = spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", 8).parquet(f"{folder}/journal")
    done = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    return table.read(ENTRIES).select("record_no", "frn", "name")


@query("""WITH RECURSIVE u AS (SELECT DISTINCT list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p FROM pages),
 e AS (SELECT DISTINCT p[1:i] AS p FROM u, unnest(range(1, len(p) + 1)) t(i))
 SELECT array_to_string(p, chr(92)) AS path, p[len(p)] AS name, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], chr(92)) END AS parent,
  EXISTS (SELECT 1 FROM e c WHERE len(c.p) = len(e.p) + 1 AND c.p[1:len(e.p)] = e.p) AS is_dir FROM e""")
def path_import(spark, sf_dir):
    """URLs as a path dump: every prefix an entry, directories found as parents; parents by their reference."""
    from .sources.records import entries_from_paths

    pages = adapters.read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    rows = entries_from_paths(pages)
    above = rows.select(F.col("frn").alias("f"), F.col("path").alias("parent"))
    return rows.join(above, rows["parent_frn"] == above["f"], "left").select("path", "name", "parent", "is_dir")


# ---- plans of the command line


def _line(size: bool, date: bool, quote: str, first: str = "size") -> str:
    """SQL of a CSV line; dates half past five hours east of UTC."""
    cells = {
        "size": "CASE WHEN is_dir OR size IS NULL THEN '' ELSE CAST(size AS VARCHAR) END || ','" if size else "",
        "date": "coalesce(strftime(make_timestamp((mtime_ft // 10 - 11644473600000000)::BIGINT) + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S'), '') || ','" if date else "",
    }
    order = [first, *[c for c in cells if c != first]]
    name = {"always": "'\"' || replace(path, '\"', '\"\"') || '\"'", "needed": "CASE WHEN instr(path, ',') + instr(path, '\"') > 0 THEN '\"' || replace(path, '\"', '\"\"') || '\"' ELSE path END"}[quote]
    return TREE + "SELECT " + " || ".join([*[cells[c] for c in order if cells[c]], name]) + " AS line FROM h WHERE "


def _plan(name: str, argv: list[str], sql: str) -> None:
    def run(spark, sf_dir):
        from .plans.arguments import parse_arguments
        from .plans.runner import csv_lines

        return csv_lines(parse_arguments(argv), engine(spark, sf_dir), "+05:30")

    QUERIES[name], SQL[name] = run, sql


_plan("plan_csv_size_date", ["-size", "-dm", "urgent"], _line(True, True, "always") + "contains(low, 'urgent')")
_plan("plan_csv_date_size_plain", ["-dm", "-size", "-no-double-quote", "ext:low"], _line(True, True, "needed", "date") + "ext = 'low'")
_plan("plan_csv_name_only", ["folder:"], _line(False, False, "always") + "is_dir")
_plan("plan_csv_scope_sort_limit", ["-path", "c:/europe", "-size", "-sort-size", "-n", "40", "file:"], _line(True, False, "always") + "volume = 'C' AND NOT is_dir AND starts_with(low_path, 'europe' || chr(92)) ORDER BY " + _ORDER["size"].format(d="DESC") + " LIMIT 40")
_plan("plan_csv_case", ["-match-case", "-dm", "Order_1"], _line(False, True, "always") + "contains(name, 'Order_1')")


# ---- further operators


@query(TREE + "SELECT name, inside AS path_in_volume FROM h WHERE volume = 'C' AND frn = '1000007'")
def frn_lookup(spark, sf_dir):
    found = engine(spark, sf_dir).lookup("C", 1_000_007)
    return found.select("name", F.concat_ws("\\", "dir_path", "name").alias("path_in_volume"))


@query("SELECT 0 AS links WHERE FALSE")
def frn_lookup_stale(spark, sf_dir):
    """The same record number under another sequence finds nothing."""
    return engine(spark, sf_dir).lookup("C", 1_000_007 | 1 << 48).select(F.lit(0).alias("links"))


@query(TREE + "SELECT path, low AS folded FROM h")
def folded_file_names(spark, sf_dir):
    from .functions.text import folded_file_name

    hits = engine(spark, sf_dir).query("", sort=None).hits
    return hits.select("path", folded_file_name(F.col("path")).alias("folded"))


_WORDS = ("ÉCOLE.TXT", "Straße", "ΑΣ", "Ж\u0416ж", "naïve", "ÀÉÎÕÜ", "日本", "İ", "x\U0001f600Y", "ẞ", "ASCII")
_FOLDED = ("école.txt", "straße", "ασ", "жжж", "naïve", "àéîõü", "日本", "i\u0307", "x\U0001f600y", "ß", "ascii")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in zip(_WORDS, _FOLDED)) + ") t(name, folded)")
def folding_rule(spark, sf_dir):
    """Letters of several scripts, one by one; accents stay."""
    from .functions.text import with_folded

    return with_folded(spark.createDataFrame([(w,) for w in _WORDS], "name string"), "name", "folded")


@query("SELECT 700000000 + i AS frn, CASE WHEN i <= 39 THEN 'Ok' ELSE 'CycleDetected' END AS status, CAST(CASE WHEN i <= 39 THEN i END AS INTEGER) AS depth FROM range(1, 71) t(i)")
def deep_chain_excluded(spark, sf_dir):
    """A chain of 70 directories where at most 40 entries may lie on a way (production: 4,096)."""
    i = F.col("id")
    rows = spark.range(1, 71).select(
        F.lit("C").alias("volume"), (700_000_000 + i).alias("frn"), F.when(i == 1, F.lit(adapters.ROOT)).otherwise(700_000_000 + i - 1).cast("bigint").alias("parent_frn"),
        F.concat(F.lit("d"), i).alias("name"), F.lit(True).alias("is_dir"), F.lit(False).alias("is_placeholder"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("mtime_ft"),
    )
    entries = adapters.drive_c(spark, sf_dir).filter("is_dir").unionByName(changes.completed(rows, True))
    return dir_paths(entries, adapters.ROOT, most_hops=40).filter("frn > 700000000").select("frn", "status", "depth")


@query(TREE + "SELECT path, is_dir, size, mtime_ft FROM h WHERE volume = 'C' AND contains(low, 'a')")
def placeholders_excluded(spark, sf_dir):
    """Placeholders among the entries are never found."""
    base = adapters.drive_c(spark, sf_dir)
    ghosts = base.filter("is_dir").withColumn("is_placeholder", F.lit(True)).withColumn("frn", F.col("frn") + 800_000_000)
    entries = keep(base.unionByName(ghosts), f"{work_folder(spark)}/entries")
    return Engine(spark, entries, dir_paths(entries, adapters.ROOT), adapters.volumes(spark, ("C",))).query("a", sort=None).hits.select(*SHOWN)


_PHASES = [("Live", None), ("Snapshot", None), ("Offline", None), ("Rescanning", None), ("Bootstrapping", None), ("Failed", "no access")]


def _in_phases(spark, sf_dir) -> Engine:
    from .schema import VOLUMES

    e = engine(spark, sf_dir)
    rows = [(f"V{i}", f"g{i}", [f"{'CDEFGH'[i]}:"], p, why, i % 2 == 1, True, True, 1) for i, (p, why) in enumerate(_PHASES)]
    return Engine(spark, e.entries, e.paths, spark.createDataFrame(rows, VOLUMES))


@query("""SELECT * FROM (VALUES ('V0', 'live', TRUE, FALSE), ('V1', 'snapshot (no journal; cannot track changes)', TRUE, TRUE), ('V2', 'offline', FALSE, FALSE),
 ('V3', 'rescanning', FALSE, TRUE), ('V4', 'bootstrapping', FALSE, FALSE), ('V5', 'failed (no access)', FALSE, TRUE)) t(volume, phase_text, ready, metadata_pending)""")
def status_phases(spark, sf_dir):
    return _in_phases(spark, sf_dir).status().select("volume", "phase_text", "ready", "metadata_pending")


@query("SELECT * FROM (VALUES ('all', TRUE, TRUE), ('C:/', FALSE, FALSE), ('D:/x', FALSE, TRUE), ('E:/', TRUE, FALSE), ('Q:/', FALSE, FALSE)) t(scope, incomplete, pending)")
def result_flags(spark, sf_dir):
    """Whether results may be incomplete or metadata are pending, over the volumes that a scope reaches."""
    e = _in_phases(spark, sf_dir)
    found = [(s, e.query("x", scope=None if s == "all" else s, sort=None)) for s in ("all", "C:/", "D:/x", "E:/", "Q:/")]
    return spark.createDataFrame([(s, r.volumes_incomplete, r.metadata_pending) for s, r in found], "scope string, incomplete boolean, pending boolean")


@query(_J + """, r AS (SELECT usn, op, name, frn FROM j)
 SELECT usn, name FROM (SELECT event_id AS usn, event_type || '_' || user_id || '_' || event_id || '.log' AS name, event_type FROM events) WHERE usn >= 1234 AND event_type <> 'view'""")
def journal_from_cursor(spark, sf_dir):
    from .streaming.journal import journal_since

    return journal_since(adapters.journal(spark, sf_dir), 1234).select("usn", "name")


_NESTED = """WITH j AS (SELECT event_id AS usn, 281474976710656 * (1 + event_id // 5000) + 100 + user_id AS frn, 281474976710656 + 100 + (user_id * 7 + 3) % 150 AS parent,
  event_type AS t FROM events),
 v AS (SELECT usn, 0 AS step, parent AS frn, 'Ensure' AS kind FROM j WHERE t IN ('signup', 'purchase')
  UNION ALL SELECT usn, 1, frn, 'Claim' FROM j WHERE t IN ('signup', 'purchase') UNION ALL SELECT usn, 1, frn, 'Kill' FROM j WHERE t = 'error'),
 w AS (SELECT *, lag(frn) OVER k AS pf, lag(kind) OVER k AS pk FROM v WINDOW k AS (PARTITION BY frn % 281474976710656 ORDER BY usn, step)),
 x AS (SELECT *, pk IS NOT NULL AND pk <> 'Kill' AS live FROM w) """


def _nested_journal(spark, sf_dir) -> DataFrame:
    """The journal with files below other files' references, and views as first halves of renames."""
    user = (F.col("frn").bitwiseAND(F.lit((1 << 48) - 1)) - 100).cast("bigint")
    reason = F.when(F.col("name").startswith("view"), F.lit(0x1000)).otherwise(F.col("reason")).cast("bigint")
    return adapters.journal(spark, sf_dir).withColumn("parent_frn", F.lit(1 << 48) + 100 + (user * 7 + 3) % 150).withColumn("reason", reason)


@query(_NESTED + """SELECT count(*) FILTER (WHERE kind = 'Ensure' AND NOT (live AND pf = frn)) AS placeholders_created,
  count(*) FILTER (WHERE kind <> 'Kill' AND live AND pf <> frn) AS stale_slots, count(*) FILTER (WHERE kind = 'Kill' AND NOT (live AND pf = frn)) AS delete_of_unknown,
  (SELECT count(*) FROM j WHERE t = 'view') AS rename_old_seen FROM x""")
def journal_counters(spark, sf_dir):
    return changes.latest_state(_nested_journal(spark, sf_dir), adapters.ROOT)[1].select("placeholders_created", "stale_slots", "delete_of_unknown", "rename_old_seen")


@query("""SELECT 1000000 + c_custkey AS frn, hex(c_name) || CASE WHEN c_custkey % 7 = 0 THEN 'EDA080' ELSE '' END AS exact, c_custkey % 7 = 0 AS non_unicode,
  CASE WHEN c_custkey % 7 = 0 THEN lower(c_name) || 'x' ELSE lower(c_name) END AS name_fold FROM customer WHERE c_custkey % 10 <> 1
 UNION ALL SELECT 1000000 + c_custkey, hex('Moved_' || c_custkey), FALSE, 'moved_' || c_custkey FROM customer WHERE c_custkey % 10 = 1""")
def raw_names_after_journal(spark, sf_dir):
    """Names that are no Unicode, at rest while a batch renames every tenth row: their exact bytes stay."""
    base = adapters.drive_c(spark, sf_dir).filter("frn between 1000000 and 99999999")
    odd = (F.col("frn") - 1_000_000) % 7 == 0
    raw = F.when(odd, F.concat(F.encode("name", "utf-8"), F.lit(b"\xed\xa0\x80")))
    base = base.withColumns({"name_raw": raw, "non_unicode": odd, "name_fold": F.when(odd, F.concat("name_fold", F.lit("x"))).otherwise(F.col("name_fold"))})
    key = F.col("frn") - 1_000_000
    journal = base.filter(key % 10 == 1).select(
        "volume", F.monotonically_increasing_id().alias("usn"), "frn", "parent_frn", F.lit(0x2000).cast("bigint").alias("reason"), F.lit(16).cast("bigint").alias("attributes"),
        F.concat(F.lit("Moved_"), key).alias("name"), F.lit(None).cast("binary").alias("name_raw"),
    )
    out = changes.apply_journal(base, journal, adapters.ROOT).filter("not is_placeholder")
    return out.select("frn", F.hex(F.coalesce("name_raw", F.encode("name", "utf-8"))).alias("exact"), "non_unicode", "name_fold")


@query("SELECT 281474976710656 + 5000 + c_custkey AS frn, 'new_' || c_name AS name, c_custkey % 2 = 0 AS is_dir FROM customer")
def snapshot_ingest(spark, sf_dir):
    """An enumeration in which every record number had another tenant before."""
    c = F.col
    t = adapters.read(spark, sf_dir, "customer")
    record = lambda seq, place, name: t.select(
        F.lit("C").alias("volume"), (c("c_custkey") + place * 1_000_000_000).cast("bigint").alias("position"), F.lit(0).alias("place"), (F.lit(seq << 48) + 5000 + c("c_custkey")).cast("bigint").alias("frn"),
        F.lit(adapters.ROOT).cast("bigint").alias("parent_frn"), F.when(c("c_custkey") % 2 == 0, 16).otherwise(32).cast("bigint").alias("attributes"), F.concat(F.lit(name), "c_name").alias("name"), F.lit(None).cast("binary").alias("name_raw"),
    )
    return changes.snapshot(record(1, 2, "new_").unionByName(record(3, 1, "old_"))).select("frn", "name", "is_dir")


@query(_FINAL)
def compaction_keeps_rows(spark, sf_dir):
    """The journal in two batches into an index in buckets, which is then compacted."""
    from .index import Index

    index = Index(spark, f"{work_folder(spark)}/index", adapters.volumes(spark, ("C",)), adapters.ROOT, buckets=8)
    journal = adapters.journal(spark, sf_dir)
    index.apply_journal(journal.filter("usn % 3 < 3 and usn < 2000"))
    index.apply_journal(journal.filter("usn >= 2000"))
    from .schema import ENTRIES

    index.table.compact(ENTRIES)
    index.table.vacuum(1)
    return index.entries.select("record_no", "frn", "name")
