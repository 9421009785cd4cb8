"""Every query that has SQL gives DuckDB's rows."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stratafind.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = Counter(tuple(r[c] for c in names) for r in got.collect())
    want = duck.execute(SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == names
    assert rows == Counter(tuple(r[order.index(c)] for c in names) for r in want.fetchall())


def test_first_search_writes_no_located_entries(spark, sf_dir, monkeypatch):
    """One search joins its matches; entries with paths are written once, at the second, with the same rows."""
    from stratafind import queries

    written = []
    monkeypatch.setattr(queries, "locate", lambda *a, make=queries.locate: written.append(1) or make(*a))
    monkeypatch.setattr(queries, "_engines", {})
    hits = [Counter(map(tuple, QUERIES["kind_file"](spark, sf_dir).collect())) for _ in range(3)]
    assert len(written) == 1 and len(hits) == 3 and hits[0] and hits[0] == hits[1] == hits[2]
    monkeypatch.setattr(queries, "_engines", {})
    QUERIES["kind_file"](spark, sf_dir).collect()
    assert len(written) == 1


def test_leaf_directories_stay_out_of_the_rounds(spark, sf_dir, monkeypatch):
    """Only directories that hold others go through the rounds."""
    from stratafind.operators import paths
    from stratafind.sources import adapters

    rows = {}
    monkeypatch.setattr(paths, "keep", lambda df, at, make=paths.keep: rows.setdefault(at.rsplit("/", 1)[1], make(df, at)))
    got = paths.dir_paths(adapters.drive_c(spark, sf_dir), adapters.ROOT)
    assert rows["r0"].count() == 30 < got.count()


def test_orphans_send_no_directories_to_the_driver(spark, sf_dir, monkeypatch):
    """Directories beyond the limit are never broadcast, however small their files are."""
    from stratafind.operators import paths
    from stratafind.sources import adapters

    known = paths.dir_paths(adapters.drive_c(spark, sf_dir, 50), adapters.ROOT)
    monkeypatch.setattr(paths, "PLANNED_IDS", 0)
    lost = paths.orphans(adapters.drive_c(spark, sf_dir, 50), known)
    assert lost.count() > 0 and "BroadcastHashJoin" not in lost._jdf.queryExecution().executedPlan().toString()


def test_name_counts_build_no_paths(spark, sf_dir, monkeypatch):
    from stratafind import queries

    monkeypatch.setattr(queries, "engine", None)
    assert {r.volume for r in QUERIES["name_dup_ratio"](spark, sf_dir).collect()} == {"C", "D"}


def test_paths_send_no_directories_to_the_driver(spark, sf_dir, monkeypatch):
    """Every join of the directory paths is hinted once its table is beyond the limit."""
    from stratafind.operators import paths
    from stratafind.sources import adapters

    sides = []
    monkeypatch.setattr(paths, "unsent", lambda df, ids, make=paths.unsent: sides.append(make(df, ids)) or sides[-1])
    monkeypatch.setattr(paths, "PLANNED_IDS", 0)
    assert paths.dir_paths(adapters.drive_c(spark, sf_dir), adapters.ROOT).filter("status = 'Ok'").count() > 30
    assert len(sides) > 3 and all("strategy=merge" in x._jdf.queryExecution().analyzed().toString() for x in sides)


def test_a_batch_reads_its_journal_once(spark, sf_dir, monkeypatch):
    """One pass for the references and one for the position, not one for every join."""
    from stratafind import queries

    read, seen = spark.sparkContext.accumulator(0), F.udf(lambda x: read.add(1) or x, "bigint").asNondeterministic()
    make = queries.adapters.journal
    monkeypatch.setattr(queries.adapters, "journal", lambda *a: make(*a).withColumn("reason", seen("reason")))
    assert QUERIES["compaction_keeps_rows"](spark, sf_dir).count() > 0
    rows = make(spark, sf_dir).count()
    assert rows <= read.value <= 2 * rows
