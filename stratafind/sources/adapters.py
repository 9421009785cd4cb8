"""The driver's star-schema tables as file metadata (test inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.changes import completed

ROOT = 5
SEQ1 = 1 << 48


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, volume: str, frn, parent, name, is_dir: bool, size=None, mtime=None) -> DataFrame:
    null = F.lit(None).cast("bigint")
    return df.select(
        F.lit(volume).alias("volume"), frn.cast("bigint").alias("frn"), parent.cast("bigint").alias("parent_frn"), name.alias("name"), F.lit(is_dir).alias("is_dir"),
        F.lit(False).alias("is_placeholder"), (null if size is None else size.cast("bigint")).alias("size"), (null if mtime is None else mtime.cast("bigint")).alias("mtime_ft"), frn.cast("bigint").alias("entry_id"),
    )


def ticks(ts):
    return F.unix_seconds(ts.cast("timestamp")) * 10_000_000 + 116_444_736_000_000_000


def drive_c(spark: SparkSession, sf_dir: str, lose: int = 0) -> DataFrame:
    """region / nation / customer / order; lose > 0 leaves out customers divisible by it."""
    t = lambda n: read(spark, sf_dir, n)
    c, customers = F.col, t("customer")
    customers = customers.filter(c("c_custkey") % lose != 0) if lose else customers
    name = F.concat(F.lit("Order_"), c("o_orderkey"), F.lit("."), F.substring("o_orderpriority", 3, 100))
    size = F.when(c("o_orderkey") % 17 != 0, F.floor("o_totalprice"))
    rows = _rows(t("region"), "C", 1000 + c("r_regionkey"), F.lit(ROOT), c("r_name"), True)
    rows = rows.unionByName(_rows(t("nation"), "C", 2000 + c("n_nationkey"), 1000 + c("n_regionkey"), c("n_name"), True))
    rows = rows.unionByName(_rows(customers, "C", 1_000_000 + c("c_custkey"), 2000 + c("c_nationkey"), c("c_name"), True))
    rows = rows.unionByName(_rows(t("orders"), "C", 100_000_000 + c("o_orderkey"), 1_000_000 + c("o_custkey"), name, False, size, ticks(c("o_orderdate"))))
    return completed(rows, ascii_names=True)


def drive_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts below directories of type and brand; names repeat often."""
    c, part = F.col, read(spark, sf_dir, "part")
    of = lambda *x: F.crc32(F.concat_ws("/", *x).cast("binary"))
    types = part.select("p_type").distinct()
    brands = part.select("p_type", "p_brand").distinct()
    rows = _rows(types, "D", (10_000_000_000 + of("p_type")), F.lit(ROOT), c("p_type"), True)
    rows = rows.unionByName(_rows(brands, "D", 20_000_000_000 + of("p_type", "p_brand"), 10_000_000_000 + of("p_type"), c("p_brand"), True))
    rows = rows.unionByName(_rows(part, "D", 500_000_000 + c("p_partkey"), 20_000_000_000 + of("p_type", "p_brand"), c("p_name"), False, c("p_size") * 1024))
    return completed(rows, ascii_names=True)


def volumes(spark: SparkSession, names=("C", "D")) -> DataFrame:
    rows = [(v, f"guid-{v}", [f"{v}:"], "Live", None, False, True, True, 1) for v in names]
    from ..schema import VOLUMES

    return spark.createDataFrame(rows, VOLUMES)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change journal of volume C."""
    c = F.col
    kinds = {"signup": 256, "click": 2, "purchase": 8192, "error": 512, "view": 0x80000000}
    reason = F.lit(0)
    for k, bits in kinds.items():
        reason = F.when(c("event_type") == k, F.lit(bits)).otherwise(reason)
    return read(spark, sf_dir, "events").select(
        F.lit("C").alias("volume"), c("event_id").cast("bigint").alias("usn"), (F.lit(SEQ1) * (1 + F.floor(c("event_id") / 5000)) + 100 + c("user_id")).cast("bigint").alias("frn"),
        F.lit(ROOT).cast("bigint").alias("parent_frn"), reason.cast("bigint").alias("reason"), F.lit(32).cast("bigint").alias("attributes"),
        F.concat_ws("_", "event_type", "user_id", F.concat(c("event_id"), F.lit(".log"))).alias("name"), F.lit(None).cast("binary").alias("name_raw"),
        F.lit(False).alias("name_lossy"), ticks(c("ts")).cast("bigint").alias("timestamp_ft"), F.lit(2).alias("major_version"),
    )


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a layout pass over the orders' files: size, time and one alias to leave out."""
    c = F.col
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.floor("l_extendedprice")).alias("size"), ticks(F.max("l_shipdate")).alias("mtime_ft"))
    link = F.struct((F.lit(1000) + c("l_orderkey") % 5).cast("bigint").alias("parent_frn"), F.concat(F.lit("Link_"), c("l_orderkey"), F.lit(".lnk")).alias("name"), F.lit(False).alias("name_lossy"), F.lit(False).alias("dos_only"))
    alias = F.struct(F.lit(ROOT).cast("bigint").alias("parent_frn"), F.lit("ORDER~1").alias("name"), F.lit(False).alias("name_lossy"), F.lit(True).alias("dos_only"))
    names = F.when(c("l_orderkey") % 100 == 0, F.array(link, alias)).otherwise(F.array(alias))
    return rows.select(F.lit("C").alias("volume"), (100_000_000 + c("l_orderkey")).cast("bigint").alias("frn"), F.lit(32).cast("bigint").alias("attributes"), c("size").cast("bigint"), c("mtime_ft").cast("bigint"), names.alias("names"))
