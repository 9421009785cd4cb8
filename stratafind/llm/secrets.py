"""Secret scans over a trigram inverted index [native]."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Workspace, broadcast_small
from .trigrams import grams_of, trigram_query

#: Documents of one posting block, about.
BLOCK_DOCS = 16_384


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern (Java syntax, leftmost, non-overlapping), of which
    those stay whose group `part` has at least `least` characters."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


#: Marks around matches and before their part; a text that holds one has it replaced by the last.
MATCH, PART, OTHER = "\x01", "\x02", "\x03"
_RUN = re.compile(r"([A-Za-z0-9]*)(\[[^\[\]^\\]+\])\+")


def searched(rule: Rule) -> str:
    """The pattern that finds the rule's matches of sufficient length.

    Where the pattern is a run of one class, begun by letters of that class, a match that is too
    short reaches to the end of its run, and no later start in the run gives a longer one. So the
    least length goes into the pattern, and only starts of runs are tried where nothing precedes.
    """
    run = _RUN.fullmatch(rule.pattern)
    if rule.part or not run or rule.least <= len(run[1]) or not all(re.match(run[2], c) for c in run[1]):
        return rule.pattern
    start = "" if run[1] else f"(?<!{run[2]})"
    return f"{start}{run[1]}{run[2]}{{{rule.least - len(run[1])},}}"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches, in code points, end exclusive.

    One pass puts marks around the matches, and the text is cut at them: what lies between and
    the matches take turns, and places are running sums of their lengths.
    """
    safe = F.when(F.contains(text, F.lit(MATCH)) | F.contains(text, F.lit(PART)), F.translate(text, MATCH + PART, OTHER * 2)).otherwise(text)
    pieces = F.split(F.regexp_replace(safe, F.lit(searched(rule)), F.lit(f"{MATCH}$0{PART}${rule.part}{MATCH}")), MATCH)
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def step_on(acc, x):
        end = acc["at"] + F.length(F.when(acc["hit"], F.substring_index(x, PART, 1)).otherwise(x))
        long = acc["hit"] & (F.length(F.substring_index(x, PART, -1)) >= rule.least)
        one = F.when(long, F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).otherwise(none)
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.concat(acc["out"], one).alias("out"))

    return F.when(F.size(pieces) > 1, F.aggregate(pieces, zero, step_on, lambda acc: acc["out"])).otherwise(none)


def postings(docs: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """Inverted index (gram, block, ids): the doc_ids whose lower-cased text holds the trigram.

    Only trigrams that some rule demands are entered; one pass finds all of them, also where they
    overlap. A posting list is stored in blocks of documents (by hash of doc_id), so no list is
    gathered whole, however common its trigram.
    """
    by_first: dict[str, list[str]] = {}
    for g in grams:
        by_first.setdefault(g[0], []).append(re.escape(g[1:]))
    any_gram = "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + "))"
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_gram), F.lit(1)))
    place = F.create_map(*[x for i, g in enumerate(grams) for x in (F.lit(g), F.lit(i))])
    rows = docs.select("doc_id", F.explode(held).alias("g")).select("doc_id", F.element_at(place, F.col("g")).alias("gram"))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", block).groupBy("gram", "block").agg(F.collect_set("doc_id").alias("ids"), F.max(F.col("doc_id").isNull()).alias("has_null"))


def candidates(index: DataFrame, queries: dict[int, object], grams: list[str]) -> DataFrame:
    """(doc_id, rules): for each rule its query's intersections and unions of posting blocks."""
    at = {g: i for i, g in enumerate(grams)}
    ids = [F.coalesce(F.first(F.when(F.col("gram") == i, F.col("ids")), ignorenulls=True), F.array().cast(dict(index.dtypes)["ids"])).alias(f"p{i}") for i in range(len(grams))]
    nulls = [F.coalesce(F.max(F.when(F.col("gram") == i, F.col("has_null"))), F.lit(False)).alias(f"z{i}") for i in range(len(grams))]
    by_block = index.groupBy("block").agg(*ids, *nulls)

    def lists(query) -> Column:
        if isinstance(query, str):
            return F.col(f"p{at[query]}")
        parts = [lists(q) for q in sorted(query[1], key=str)]
        return reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)

    def null(query) -> Column:
        if isinstance(query, str):
            return F.col(f"z{at[query]}")
        return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [null(q) for q in sorted(query[1], key=str)])

    out = []
    for rule, query in queries.items():
        found = by_block.select(F.explode(lists(query)).alias("doc_id"), F.lit(1 << rule).alias("rule"))
        lost = by_block.filter(null(query)).select(F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), F.lit(1 << rule).alias("rule"))
        out.append(found.unionByName(lost))
    if not out:
        return None
    return reduce(DataFrame.unionByName, out).groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


def scan(spark: SparkSession, docs: DataFrame, rules=BASE + MORE) -> DataFrame:
    """(doc_id, found): found is array<struct<start, rank, end>> of all rules' spans.

    Rules with a trigram query only verify the documents their postings leave; rules without
    mandatory trigrams scan every text. rank is the rule's place in rules. Texts are whole; a
    null text is empty. Repeated rows are scanned each on its own, and rows that share a
    doc_id share candidates, which only adds verifications. Null ids are found through a flag
    of each posting block. An empty table gives an empty result.
    """
    work = Workspace(spark, "secrets")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {i: q for i, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) is not True}
    grams = sorted(set().union(set(), *map(grams_of, queries.values())))
    marked = rows.withColumn("rules", F.lit(0))
    if queries:
        blocks = max(1, -(-docs.select(F.lit(1)).count() // BLOCK_DOCS))
        index = work.keep(postings(rows, grams, blocks), "postings")
        chosen = work.keep(candidates(index, queries, grams), "candidates").withColumnRenamed("doc_id", "c_id")
        few = broadcast_small(chosen)
        marked = rows.join(few, rows["doc_id"].eqNullSafe(few["c_id"]), "left").drop("c_id").withColumn("rules", F.coalesce("rules", F.lit(0)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        got = spans(F.col("text"), rule)
        if i in queries:
            got = F.when(F.col("rules").bitwiseAND(1 << i) != 0, got).otherwise(none)
        parts.append(_ranked(got, i))
    return marked.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _of_rank(rank: int) -> Column:
    return F.filter("found", lambda s: s["rank"] == rank)


def span_text(found: Column, rules) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, rules=BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans, and all spans as text."""
    own = F.filter("found", lambda s: s["rank"] < base)
    counts = [F.size(_of_rank(i)).cast("long").alias(f"n_{rules[i].kind}") for i in range(base)]
    return found.select("doc_id", *counts, F.sha2(span_text(own, rules), 256).alias("base_sha256"), span_text(F.col("found"), rules).alias("spans"))
