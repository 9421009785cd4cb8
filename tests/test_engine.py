"""Parser, folding, outputs, decoders, replay and policies on small fixtures."""

import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from stratafind.functions import filetime, text
from stratafind.operators import changes
from stratafind.operators.paths import ROOT_FRN, dir_paths
from stratafind.operators.search import Engine
from stratafind.plans.arguments import ArgumentError, parse_arguments
from stratafind.plans.query_text import Malformed, UnsupportedOperator, parse_query, size_range, tokens
from stratafind.schema import VOLUMES, Sort
from stratafind.sources import outputs, records
from stratafind.streaming import journal as policy

BASE = "volume string, frn bigint, parent_frn bigint, name string, is_dir boolean, is_placeholder boolean, size bigint, mtime_ft bigint"
S = 1 << 48


@pytest.fixture(scope="module")
def five(spark):
    rows = [(100, None, "papers", True, None, None), (101, 100, "old", True, None, None), (102, 101, "Budget.XLS", False, 5000, 2000), (103, 100, "todo.md", False, 300, 2000), (104, None, "Sunset.PNG", False, 3000000, 2000), (105, 999, "lost.tmp", False, 1, 1)]
    data = [("C", r | S, ROOT_FRN if p is None else p | S, n, d, False, s, m) for r, p, n, d, s, m in rows]
    entries = changes.completed(spark.createDataFrame(data, BASE)).persist()
    volumes = spark.createDataFrame([("C", "g", ["C:"], "Live", None, False, True, True, 7)], VOLUMES)
    return Engine(spark, entries, dir_paths(entries), volumes)


@pytest.mark.parametrize("query,want", [
    ("budget", ["papers\\old\\Budget.XLS"]), ("BUDGET", ["papers\\old\\Budget.XLS"]), ("todo md", ["papers\\todo.md"]), ("todo zzz", []),
    ("ext:xls", ["papers\\old\\Budget.XLS"]), ("ext:png", ["Sunset.PNG"]), ("size:>1mb", ["Sunset.PNG"]), ("size:tiny", ["papers\\old\\Budget.XLS", "papers\\todo.md"]),
    ("folder:", ["papers\\old", "papers"]), ("*.xls", ["papers\\old\\Budget.XLS"]), ("*.zip", []), ("papers\\old", ["papers\\old\\Budget.XLS", "papers\\old"]),
    ("budget case:", []), ("Budget case:", ["papers\\old\\Budget.XLS"]), ("Budget ext:xls case:", ["papers\\old\\Budget.XLS"]), ("lost", []),
])
def test_five_rows(five, query, want):
    got = five.query(query)
    assert [r.path for r in got.hits.collect()] == ["C:\\" + w for w in want] and got.total == len(want)


def test_five_rows_order(five):
    path = [r.path[3:] for r in five.query("", sort=Sort("path")).hits.collect()]
    assert path == ["papers", "Sunset.PNG", "papers\\old", "papers\\todo.md", "papers\\old\\Budget.XLS"]
    page = five.query("", offset=1, limit=2)
    assert page.hits.count() == 2 and page.total == 5 and page.generation == 7 and not page.volumes_incomplete
    assert [r.path for r in five.query("", scope="c:/papers/old").hits.collect()] == ["C:\\papers\\old\\Budget.XLS"]


def test_query_text():
    assert tokens('a "b c"d  ""') == [("a", False), ("b cd", True), ("", True)]
    for bad in ("a|b", "x!", "!"):
        with pytest.raises(UnsupportedOperator):
            parse_query(bad)
    assert parse_query('"a|b!"').terms == ["a|b!"]
    q = parse_query("Foo *.TXT a\\B ext:.x;Y path:Q foo:bar dir:zed size:empty case:0")
    assert (q.terms, q.globs, q.paths, q.extensions, q.is_dir, q.size) == (["foo", "foo:bar", "zed"], ["*.txt"], ["a\\b", "q"], ["x", "y"], True, (0, 0))
    assert size_range("10..20kb") == (10, 20480) and size_range("<0") == (0, 0) and size_range("..5") == (0, 5) and size_range("+7") == (7, 7)
    assert size_range("..") == (0, (1 << 64) - 1) == size_range(" .. ") and size_range(" > 1 kb ") == (1025, (1 << 64) - 1)
    assert parse_query("ext:a ext:; ext:").extensions == ["a"] and parse_query("ext:a ext:.").extensions == [""]
    for bad in ("", "1.5kb", "x", "99999999999999999999"):
        with pytest.raises(Malformed):
            size_range(bad)


def test_arguments():
    plan = parse_arguments(["-size", "-dm", "-size", "-sort-size-ascending", "-n", "5", "a", "b", "--json", "/export-csv", "f.csv", "-nodoublequote"])
    assert (plan.columns, plan.sort, plan.limit, plan.query, plan.json, plan.export, plan.double_quote) == (["date", "size"], Sort("size", False), 5, "a b", True, "f.csv", False)
    for argv, code in ((["-n", "x"], 4), (["-n"], 4), (["--bogus"], 6), (["-bogus"], 6)):
        with pytest.raises(ArgumentError) as e:
            parse_arguments(argv)
        assert e.value.code == code


def test_fold(spark):
    for a, b in (("ΑΣ", "ας"), ("É", "é"), ("E\u0301", "é"), ("Straße", "straße")):
        assert text.fold_text(a) == (b if a != "ΑΣ" else "ασ") and text.fold_text(text.fold_text(a)) == text.fold_text(a)
    rows = ["ABC", "ÉCOLE", None, "ΑΣ", "\U0001f600X"]
    got = spark.createDataFrame([(r,) for r in rows], "name string").select(text.fold(F.col("name"))).collect()
    assert [r[0] for r in got] == [None if r is None else text.fold_text(r) for r in rows]
    for units in ([0x61, 0xD800, 0x62], [0xD83D, 0xDE00], []):
        lossy, raw = text.from_utf16(units)
        assert text.to_utf16(raw if raw is not None else lossy.encode()) == units


def test_filetime(spark):
    fixed = {0: "1601-01-01T00:00:00", 116444736000000000: "1970-01-01T00:00:00", (1 << 63) - 1: "30828-09-14T02:48:05"}
    for ticks, want in fixed.items():
        assert filetime.format_ticks(ticks) == want
    values = [0, 1, 116444736000000000, 116444735999999999, 133000000000000001, -1]
    rows = spark.createDataFrame([(v,) for v in values], "t bigint").select("t", filetime.format_utc(F.col("t")), filetime.to_unix_ms(F.col("t"))).collect()
    for t, shown, ms in rows:
        assert ms == (t - filetime.EPOCH) // 10_000 and shown == filetime.format_ticks(t)


def test_outputs(five, tmp_path):
    path = tmp_path / "o.csv"
    outputs.write_csv(five.query("").hits, str(path), ["size"])
    lines = path.read_bytes().split(b"\r\n")
    assert lines[0] == b"\xef\xbb\xbfSize,Filename" and lines[1] == b'5000,"C:\\papers\\old\\Budget.XLS"' and lines[2] == b',"C:\\papers\\old"' and lines[-1] == b""
    out = io.StringIO()
    outputs.plain_paths(five.query("ext:xls").hits, out)
    assert out.getvalue() == "C:\\papers\\old\\Budget.XLS\n"
    assert '"size": 5000' in outputs.to_json(five.query("ext:xls").hits, 1, 0, False, False)
    items = [(f"p{i}".encode(), i % 2 == 0, i if i % 3 else None, -i if i % 5 else None) for i in range(5000)]
    pages = [outputs.read_page(p) for p in outputs.pages(items, 5000, 3, True, False)]
    assert [len(p["items"]) for p in pages] == [4096, 904] and [p["more"] for p in pages] == [True, False] and pages[0]["volumes_incomplete"]
    assert [(i["path"].encode(), i["is_dir"], i["size"], i["mtime_ft"]) for p in pages for i in p["items"]] == items
    empty = list(outputs.pages([], 0, 0, False, False))
    assert len(empty) == 1 and not outputs.read_page(empty[0])["items"]
    with pytest.raises(ValueError):
        outputs.read_page(empty[0][:-1])
    reader, data, got = outputs.FrameReader(10), outputs.frame(b"abc") + outputs.frame(b""), []
    for i in range(len(data)):
        got += reader.feed(data[i : i + 1])
    assert got == [b"abc", b""]
    for _ in range(2):
        with pytest.raises(ValueError):
            list(reader.feed(struct.pack("<I", 11)))


def change(version, frn, parent, usn, reason, name):
    raw = name.encode("utf-16-le")
    if version == 2:
        head = [frn, parent, usn, 9, reason, 0, 0, 32, len(raw), 60]
        body = records.V2.pack(-(-(60 + len(raw)) // 8) * 8, 2, 0, *head)
    else:
        head = [frn, 0, parent, 0, usn, 9, reason, 0, 0, 32, len(raw), 76]
        body = records.V3.pack(-(-(76 + len(raw)) // 8) * 8, 3, 0, *head)
    return (body + raw).ljust(-(-(len(body) + len(raw)) // 8) * 8, b"\xee")


def test_decoders():
    data = struct.pack("<q", 77) + change(2, 5, 6, 1, 256, "a.txt") + struct.pack("<IHH", 8, 4, 0) + change(3, 7, 8, 2, 512, "bü")
    following, rows, skipped = records.journal_buffer(data)
    assert (following, skipped) == (77, {4: 1}) and [(r["frn"], r["parent_frn"], r["usn"], r["reason"], r["name"]) for r in rows] == [(5, 6, 1, 256, "a.txt"), (7, 8, 2, 512, "bü")]
    for bad in (b"", data[:-4], struct.pack("<qIHH", 0, 0, 2, 0), data[:8] + struct.pack("<IHH", 16, 2, 0) + bytes(8)):
        with pytest.raises(records.DecodeError):
            records.journal_buffer(bad)
    name = "x.txt".encode("utf-16-le")
    entry = records.LAYOUT_NAME.pack(0, 1, 9, len(name), 0) + name
    stream = records.LAYOUT_STREAM.pack(1, 0, 0, 0, 0, 1234, 0, 0x80, 0, 0)
    info = struct.pack("<qqqqII", 1, 2, 555, 4, 0, 0)
    size = records.LAYOUT_FILE.size
    file = records.LAYOUT_FILE.pack(1, 0, 0, 32, 42, size, size + len(entry), size + len(entry) + len(stream), len(info))
    got = records.layout_buffer(records.LAYOUT_HEAD.pack(1, 16, 0, 0) + file + entry + stream + info)
    assert got == [{"frn": 42, "attributes": 32, "size": 1234, "mtime_ft": 555, "names": [{"parent_frn": 9, "name": "x.txt", "name_raw": None, "name_lossy": False, "dos_only": False}]}]
    with pytest.raises(records.DecodeError):
        records.layout_buffer(records.LAYOUT_HEAD.pack(1, 900, 0, 0))


def test_replay_matches_a_sequential_model(spark):
    """Random tapes of creates, renames and deletes, applied whole, twice and in two batches."""
    rng, schema = random.Random(3), "volume string, usn bigint, frn bigint, parent_frn bigint, reason bigint, attributes bigint, name string"
    tape, model = [], {}
    for usn in range(150):
        record = rng.randrange(100, 115)
        seq = model.get(record, (0, None))[0] or 1
        if record in model and rng.random() < 0.3:
            tape.append(("C", usn, seq * S | record, ROOT_FRN, 512, 32, "x"))
            del model[record]
        else:
            if rng.random() < 0.2:
                seq += 1
            model[record] = (seq, f"n{usn}")
            tape.append(("C", usn, seq * S | record, ROOT_FRN, 256 if rng.random() < 0.5 else 8192, 32, f"n{usn}"))
    want = sorted((s * S | r, n) for r, (s, n) in model.items())
    frame = spark.createDataFrame(tape, schema)
    empty = changes.completed(spark.createDataFrame([], BASE))
    state = lambda e: sorted((r.frn, r.name) for r in e.collect())
    once = changes.apply_journal(empty, frame)
    assert state(once) == want and state(changes.apply_journal(once, frame)) == want
    half = changes.apply_journal(empty, frame.filter("usn < 70"))
    assert state(changes.apply_journal(half, frame.filter("usn >= 70"))) == want


def test_policies():
    c, b = policy.Cursor, policy.JournalBounds(7, 100, 0, 1000)
    assert [policy.cursor_check(c(*x), b) for x in ((7, 500), (8, 500), (7, 99), (7, 1001))] == ["InSync", "JournalIdChanged", "CursorPurged", "RestampDiscontinuity"]
    assert policy.next_action("Retired", 0, 3, False) == "GiveUp" and policy.next_action("Retired", 0, 2, False) == "Revive"
    assert policy.next_action("Beat", 300, 0, False) == "Cancel" and policy.next_action("Busy", 300, 0, False) == "Nothing" and policy.next_action("Beat", 1, 1, True) == "ResetBudget"
    assert [policy.backoff(n) for n in (1, 2, 8)] == [0.5, 1.0, 30.0] and policy.failure_phase(6) == "Offline" and not policy.may_rescan(3)
    assert policy.healthy_since(None, "Beat", 1, "Live", 9.0) == 9.0 and policy.healthy_since(1.0, "Beat", 61, "Live", 9.0) is None

# ---- exact names, index, runner, service, tails, decoding


def full(spark, rows, schema=BASE):
    return changes.completed(spark.createDataFrame(rows, schema))


def test_folding_by_letters(spark):
    import sys
    import unicodedata

    from stratafind.functions.text import fold_text, with_folded

    rng = random.Random(1)
    pool = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")] + ["\U0001f600", "\U00010400", "İ", "ẞ", "K"]
    names = ["".join(rng.choices(pool, k=rng.randrange(1, 8))) for _ in range(4000)] + [chr(c) for c in range(0x80, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    for r in with_folded(rows, "name", "low").collect():
        assert r.low == fold_text(r.name), ascii(r.name)
    plan = rows.select(text.fold_letters(F.col("name")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_exact_names_stay(spark):
    raw = b"a\xed\xa0\x80B"
    rows = [("C", 100 | S, ROOT_FRN, "a\ufffdB", True, False, None, 5, raw), ("C", 101 | S, 100 | S, "in.txt", False, False, 9, 6, None), ("C", 102 | S, ROOT_FRN, "z", False, False, 1, 1, None)]
    entries = full(spark, rows, BASE + ", name_raw binary").persist()
    one = entries.filter("record_no = 100").first()
    assert one.non_unicode and bytes(one.name_raw) == raw and bytes(one.name_fold_raw) == b"a\xed\xa0\x80b"
    journal = spark.createDataFrame([("C", 1, 102 | S, ROOT_FRN, 0x2000, 32, "z2", None), ("C", 2, 103 | S, ROOT_FRN, 0x100, 32, "q\ufffd", b"q\xed\xb0\x80")], "volume string, usn bigint, frn bigint, parent_frn bigint, reason bigint, attributes bigint, name string, name_raw binary")
    after = changes.apply_journal(entries, journal).persist()
    assert after.filter("record_no in (100, 101)").collect() == entries.filter("record_no in (100, 101)").collect()
    assert after.filter("record_no = 102").first().name == "z2" and after.filter("record_no = 102").first().entry_id == entries.filter("record_no = 102").first().entry_id
    assert bytes(after.filter("record_no = 103").first().name_raw) == b"q\xed\xb0\x80"
    layout = spark.createDataFrame([("C", 101 | S, 32, 77, 8, [(ROOT_FRN, "link", None, False, False)])], "volume string, frn bigint, attributes bigint, size bigint, mtime_ft bigint, names array<struct<parent_frn:bigint,name:string,name_raw:binary,name_lossy:boolean,dos_only:boolean>>")
    rich = changes.enrich(after, layout)
    assert bytes(rich.filter("record_no = 100").first().name_raw) == raw and sorted(r.name for r in rich.filter("record_no = 101").collect()) == ["in.txt", "link"]
    actual = spark.createDataFrame([("C", 101 | S, [(100 | S, "in.txt"), (ROOT_FRN, "new")])], "volume string, frn bigint, links array<struct<parent_frn:bigint,name:string>>")
    linked = changes.reconcile_links(rich, actual)[0].persist()
    assert bytes(linked.filter("record_no = 100").first().name_raw) == raw and sorted((r.name, r.size) for r in linked.filter("record_no = 101").collect()) == [("in.txt", 77), ("new", 77)]
    volumes = spark.createDataFrame([("C", "g", ["C:"], "Live", None, False, True, True, 7)], VOLUMES)
    engine = Engine(spark, linked, dir_paths(linked), volumes)
    hits = {r.path: r for r in engine.query("").hits.collect()}
    assert bytes(hits["C:\\a\ufffdB\\in.txt"].path_raw) == b"C:\\" + raw + b"\\in.txt" and hits["C:\\new"].path_raw is None
    assert '"path_u16"' in outputs.to_json(engine.query("in.txt").hits, 1, 0, False, False)
    page = outputs.read_page(next(outputs.hit_pages(engine.query("in.txt").hits, 1)))
    assert page["items"][0]["path_u16"] == outputs.to_utf16(b"C:\\" + raw + b"\\in.txt")
    assert engine.lookup("C", 102 | S).count() == 1 and engine.lookup("C", 102 | 2 * S).count() == 0


def test_chains_of_many_entries(spark):
    rows = [("C", 1000 + i, ROOT_FRN if i == 1 else 999 + i, f"d{i}", True, False, None, None) for i in range(1, 31)]
    rows += [("C", 5000, 1010, "f10", False, False, 1, 1), ("C", 5001, None, "nowhere", True, False, None, None), ("C", 5002, 5002, "self", True, False, None, None)]
    entries = full(spark, rows).persist()
    for most in (3, 12, 31, 4096):
        got = {r.frn: r for r in dir_paths(entries, most_hops=most).collect()}
        for i in range(1, 31):
            ok = i + 1 <= most
            assert got[1000 + i].status == ("Ok" if ok else "CycleDetected") and got[1000 + i].depth == (i if ok else None), (most, i)
        assert got[5001].status == "InLostFound" and got[5002].status == "CycleDetected"


def test_local_time(spark):
    ticks = [0, 133_000_000_000_000_001, 116444736000000000, (1 << 63) - 1, -(1 << 63), None]
    rows = spark.createDataFrame([(t,) for t in ticks], "t bigint")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", session)
            got = [r[0] for r in rows.select(filetime.format_utc(F.col("t"))).collect()]
            assert got == [None if t is None else filetime.format_ticks(t) for t in ticks]
            got = [r[0] for r in rows.select(filetime.format_local(F.col("t"), "Europe/Berlin")).collect()]
            assert got[1:] == ["2022-06-18T06:26:40", "1970-01-01T01:00:00", "", "", None]
            here = rows.select(filetime.format_local(F.col("t"))).collect()[2][0]
            assert here == {"UTC": "1970-01-01T00:00:00", "America/New_York": "1969-12-31T19:00:00", "Asia/Kolkata": "1970-01-01T05:30:00"}[session]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_runner(five, tmp_path):
    from stratafind.plans import runner

    def run(*argv, engine=five):
        out, err = io.StringIO(), io.StringIO()
        return runner.run(list(argv), lambda: engine, out, err, "UTC"), out.getvalue(), err.getvalue()

    assert run("ext:xls") == (0, "C:\\papers\\old\\Budget.XLS\n", "")
    assert run("-sort-size", "-n", "2", "file:")[1] == "C:\\Sunset.PNG\nC:\\papers\\old\\Budget.XLS\n"
    assert run("-path", "papers/old", "*")[1] == "C:\\papers\\old\\Budget.XLS\n" == run("-path", "C:\\papers\\x\\..\\old", "*")[1]
    file = tmp_path / "o.csv"
    assert run("-export-csv", str(file), "-size", "-dm", "ext:png")[0] == 0
    assert file.read_bytes() == b'\xef\xbb\xbfSize,Date Modified,Filename\r\n3000000,1601-01-01T00:00:00,"C:\\Sunset.PNG"\r\n'
    assert run("-export-csv", str(file), "-no-header", "-no-utf8-bom", "-no-double-quote", "ext:png")[0] == 0 and file.read_bytes() == b"C:\\Sunset.PNG\r\n"
    code, out, err = run("-export-csv", str(file), "a|b")
    assert code == 4 and err and file.read_bytes() == b""
    assert run("-export-csv", str(tmp_path / "no" / "o.csv"), "x")[0] == 5 and run("--bogus")[0] == 6 and run("-n", "x")[0] == 4 and run("size:x")[0] == 4
    assert '"total": 1' in run("--json", "ext:xls")[1]
    report = io.StringIO()
    assert runner.show_scan(five, report, "ext:xls") == 8 and report.getvalue().endswith("1 match(es) of 'ext:xls'\nC:\\papers\\old\\Budget.XLS\n")
    code, out, _ = run("--status")
    assert code == 0 and out.startswith("status: 1 volume(s)\n  C:") and out.endswith("entries  phase=live\n")


def test_service(five):
    import json

    from stratafind.service import Service

    s = Service(five)
    assert s.handle({"t": "Hello", "proto_min": 1, "proto_max": 3, "client": "x"})["ready"] and s.handle({"t": "Hello", "proto_min": 2, "proto_max": 3})["code"] == "Unsupported"
    found = s.handle_bytes(json.dumps({"t": "Query", "query": "", "sort": {"key": "size", "descending": True}, "limit": 1, "offset": 1}).encode())
    assert found["total"] == 5 and [i["path"] for i in found["items"]] == ["C:\\papers\\old\\Budget.XLS"]
    assert s.handle({"t": "Query", "query": "a|b"})["code"] == "BadQuery" and s.handle({"t": "Query"})["code"] == "Internal"
    assert s.handle_bytes(b"x" * (2 << 20))["code"] == "TooLarge" and s.handle({"t": "Nope"})["code"] == "Unsupported" and s.handle_bytes(b"{")["code"] == "Unsupported"
    assert s.handle({"t": "Status"})["volumes"][0]["phase_text"] == "live"


def journal_rows(spark, rows):
    data = [("C", u, f, p, r, a, n, None, False, 0, 2) for u, f, p, r, a, n in rows]
    from stratafind.schema import JOURNAL

    return spark.createDataFrame(data, JOURNAL)


def test_index(spark, tmp_path):
    from stratafind.index import Index
    from stratafind.schema import ENTRIES

    volumes = spark.createDataFrame([("C", "g", ["C:"], "Live", None, False, True, True, 7)], VOLUMES)
    index = Index(spark, str(tmp_path / "index"), volumes, buckets=4)
    raw = "volume string, position bigint, place int, frn bigint, parent_frn bigint, attributes bigint, name string, name_raw binary"
    index.ingest_snapshot(spark.createDataFrame([("C", 9, i, (100 + i) | S, ROOT_FRN if i < 2 else 100 | S, 16 if i < 2 else 32, f"n{i}", None) for i in range(8)], raw))
    assert index.total("n") == 8 and index.total("n", "C:\\n0") == 6
    version = index.table.state()["version"]
    index.apply_journal(journal_rows(spark, [(1, 102 | S, 100 | S, 0x2000, 32, "renamed"), (2, 103 | S, 100 | S, 0x200, 32, "n3")]))
    held = index.table.manifest()
    assert sorted(set(held.values())) == [version, version + 1] and {b for b, v in held.items() if v > version} <= {100 % 4, 102 % 4, 103 % 4}
    assert [r.path for r in index.query("renamed").hits.collect()] == ["C:\\n0\\renamed"] and index.total("n3") == 0
    index.set_stats(spark.createDataFrame([("C", 102 | S, 55, 66)], "volume string, frn bigint, size bigint, mtime_ft bigint"))
    assert index.query("renamed").hits.first()["size"] == 55
    before = sorted(map(str, index.entries.collect()))
    index.table.compact(ENTRIES)
    index.table.vacuum(1)
    assert sorted(map(str, index.entries.collect())) == before and index.status().first().entries == 9


def test_buffers_from_files(spark, tmp_path):
    folder = tmp_path / "j" / "C"
    folder.mkdir(parents=True)
    (folder / "a").write_bytes(struct.pack("<q", 77) + change(2, 5, 6, 1, 256, "a.txt") + struct.pack("<IHH", 8, 4, 0) + change(3, 7, 8, 2, 512, "b"))
    (folder / "b").write_bytes(struct.pack("<q", 99) + struct.pack("<IHH", 0, 2, 0))
    (folder / "c").write_bytes(struct.pack("<q", 78) + change(2, 5 | 2 * S, 6, 1, 256, "later"))
    path = str(tmp_path / "j")
    assert sorted((r.volume, r.frn, r.name) for r in records.read_journal(spark, path).collect()) == [("C", 5, "a.txt"), ("C", 7, "b"), ("C", 5 | 2 * S, "later")]
    report = {(r.what, r.detail): r.n for r in records.scan_report(spark, path).collect()}
    assert report == {("buffers", ""): 3, ("records", ""): 3, ("skipped", "4"): 1, ("rejected", "length 0"): 1}
    got = changes.snapshot(records.read_snapshot(spark, path)).collect()
    assert sorted((r.record_no, r.name) for r in got) == [(5, "later"), (7, "b")]
    (tmp_path / "l" / "C").mkdir(parents=True)
    name = "x.txt".encode("utf-16-le")
    entry = records.LAYOUT_NAME.pack(0, 1, 9, len(name), 0) + name
    size = records.LAYOUT_FILE.size
    (tmp_path / "l" / "C" / "a").write_bytes(records.LAYOUT_HEAD.pack(1, 16, 0, 0) + records.LAYOUT_FILE.pack(1, 0, 0, 32, 42, size, 0, 0, 0) + entry)
    row = records.read_layout(spark, str(tmp_path / "l")).first()
    assert (row.volume, row.frn, row["size"], [n.name for n in row.names]) == ("C", 42, None, ["x.txt"])


def test_tail(spark, tmp_path):
    from stratafind.schema import ENTRIES
    from stratafind.streaming.tail import JournalGone, Tail, supervise
    from stratafind.tables import VersionedTable

    now, slept, state = [0.0], [], {"id": 7, "first": 0, "next": 10, "fail": None}
    table = VersionedTable(spark, str(tmp_path / "t"), 4)
    scanned = full(spark, [("C", 100 | S, ROOT_FRN, "scan", False, False, 1, 1)])
    feed = [journal_rows(spark, [(10, 101 | S, ROOT_FRN, 0x100, 32, "new"), (11, 101 | S, ROOT_FRN, 0x80000000, 32, "new")])]

    def read(cursor):
        if state["fail"]:
            raise state["fail"]
        return feed[0].filter(F.col("usn") >= cursor.next_usn)

    tail = Tail(table, lambda: policy.JournalBounds(state["id"], state["first"], 0, state["next"]), read, lambda: scanned, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    tail.start(policy.Cursor(6, 3))
    assert tail.log == ["JournalIdChanged"] and tail.phase == "Live" and tail.cursor == policy.Cursor(7, 10)
    names = lambda: sorted(r.name for r in table.read(ENTRIES).filter("not is_placeholder").collect())
    assert tail.step() and names() == ["new", "scan"] and tail.cursor.next_usn == 12 and tail.rescans == 0
    state["fail"] = OSError("drive not ready")
    for _ in range(5):
        assert tail.step()
    assert slept == [0.5, 1.0, 2.0, 4.0, 8.0] and tail.phase == "Offline"
    while tail.rescans == 0:
        assert tail.step()
    assert names() == ["scan"] and now[0] >= 30 and tail.phase == "Live" and tail.cursor == policy.Cursor(7, 10)
    state["fail"] = JournalGone("deleted")
    assert tail.step() and tail.step() and not tail.step() and tail.phase == "Failed"
    seen, revives, healthy = {"C": ("Beat", now[0])}, {}, {}
    state["fail"] = None
    assert supervise({"C": tail}, seen, revives, healthy, now[0]) == {"C": "Revive"} and tail.phase == "Live" and revives == {"C": 1} and tail.step()
    for minutes in range(0, 12):
        actions = supervise({"C": tail}, {"C": ("Beat", minutes * 60.0)}, revives, healthy, minutes * 60.0)
    assert actions == {"C": "Nothing"} and revives == {"C": 0}
    saved = Tail(table, tail.bounds, read, lambda: scanned)
    saved.start(policy.Cursor(7, 10))
    assert saved.phase == "Live" and saved.rescans == 0

