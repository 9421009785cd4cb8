"""Quality rules: a bitmask ledger of all rules, policies over it, and their ablations [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, Workspace

SYMBOLS = r"[#*$%&|<>]"

#: Rules in the order of their bits: name, and the failure as a function of the measurements.
RULES = (
    ("too_few_words", lambda m: m("n_words") < 50),
    ("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("symbols_per_word", lambda m: 2 * m("n_symbols") > m("n_words")),
    ("duplicate_lines", lambda m: (m("n_lines") >= 4) & (2 * m("n_dup_lines") > m("n_lines"))),
    ("mean_word_short", lambda m: 2 * m("word_chars") < 3 * m("n_words")),
    ("mean_word_long", lambda m: m("word_chars") > 25 * m("n_words")),
    ("too_many_words", lambda m: m("n_words") > 1_000_000),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure drops a document.
POLICIES = {
    "base-1": ("too_few_words", "repeated_windows"),
    "web-1": ("too_few_words", "repeated_windows", "symbols_per_word", "duplicate_lines", "mean_word_long"),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measure(docs: DataFrame) -> DataFrame:
    """docs' doc_id with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    n_repeat_words counts the words that lie in a 3-word window which the text holds twice or
    more. Windows are compared by 64-bit hashes; sorting (hash, place) pairs finds the repeated
    ones in n log n, so a text of a million words takes no quadratic step. Everything happens
    within the row: no shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    rows = docs.select("doc_id", text.alias("t"))
    rows = rows.select(
        "doc_id",
        F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).alias("c"))).alias("w"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    rows = rows.select(
        "doc_id", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: x["h"]).alias("h"),
    )
    second = F.slice("h", F.lit(2), F.greatest(F.size("h"), F.lit(1)))
    third = F.slice("h", F.lit(3), F.greatest(F.size("h"), F.lit(1)))
    pairs = F.zip_with("h", second, lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, third, lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size("h") - 2, F.lit(0)))
    rows = rows.withColumn("g", windows).drop("h")
    rows = rows.withColumn("some", F.size(F.array_distinct("g")) < F.size("g"))
    pair = "array<struct<h:bigint,i:int>>"
    placed = F.when(F.col("some"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast(pair))
    rows = rows.withColumn("s", placed).drop("g", "some")
    same = F.zip_with("s", F.slice("s", F.lit(2), F.greatest(F.size("s"), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    rows = rows.withColumn("e", same)
    # A window is repeated if it equals its neighbour on either side in sorted order.
    before = F.concat(F.array(F.lit(False)), "e")
    flagged = F.filter(F.zip_with(F.zip_with("e", before, lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))), "s", lambda f, s: F.when(f, s["i"])), lambda x: x.isNotNull())
    rows = rows.withColumn("p", F.array_sort(flagged)).drop("s", "e")
    steps = F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("p")
    return rows


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements with failures: one bit per rule, every rule evaluated once.

    A null or empty text has no words and fails what asks for words. Null ids and repeated rows
    are rows of their own; an empty table gives an empty ledger; other columns are ignored.
    """
    failed = sum((F.when(test(F.col), F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in RULES), F.lit(0))
    return measure(docs).withColumn("failures", failed.cast("int"))


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations read its bits, not the texts again."""
    return Workspace(spark, "quality-rules").keep(ledger(docs), "ledger")


def kept(failures: Column, policy: str) -> Column:
    return failures.bitwiseAND(mask(policy)) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many rows fail it, and how many are dropped by it alone.

    Rows are grouped by their failure bits first (at most 2 to the number of rules), so any
    policy of the ledger is evaluated on those few rows.
    """
    bits = rows.groupBy("failures").count()
    names = POLICIES[policy]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in names])).alias("r")
    flat = bits.select("failures", "count", each)
    inside = F.col("failures").bitwiseAND(mask(policy))
    return flat.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failures").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("failed"),
        F.sum(F.when(inside == F.col("r.bit"), F.col("count")).otherwise(0)).alias("failed_alone"),
        F.sum("count").alias("rows"),
    )
