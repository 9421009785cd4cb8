"""Mixing sources to target weights: capped water-filling, then seeded repetitions [native]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import WORD, Workspace, join_dimension

#: Hexadecimal digits by which the hash order is refined at a time (256 sums a source), and the
#: rows in which a limit may fall before their order is looked at one by one.
DIGITS, FEW = 2, 4_096


def ranked_sources(work: Workspace, totals: DataFrame) -> DataFrame:
    """Adds rank (from 0) by code point with null last, by a range-partitioned sort.

    Each partition ranks its own rows; only one row count per partition reaches the driver.
    """
    ordered = totals.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    at = work.keep(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered", small=True)
    part = F.shiftright("_id", 33)
    before, base = 0, F.lit(0)
    for p, n in sorted(at.groupBy(part.alias("p")).count().collect()):
        base = F.when(part == p, F.lit(before)).otherwise(base)
        before += n
    return at.withColumn("rank", base + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def water_fill(work: Workspace, totals: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """Targets per source: (source, source_size, target).

    All sources rise together in proportion to their weight; one that would pass max_epochs
    times its size is clamped there and what it leaves is shared again by weight among the
    others, until none is above. Each round is one aggregate over the source table; only its
    two sums reach the driver. If every source is clamped, the targets stay below the budget.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = work.keep(
        ranked_sources(work, totals).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)), "sources", small=True
    )
    budget = share * float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:
        above = F.col("cap") <= F.col("weight") * level
        used, free = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if free <= 0 or (budget - used) / free <= level:
            break
        level = (budget - used) / free
    if free <= 0:  # every source is clamped
        level = float("inf")
    return sources.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _sized(docs: DataFrame, seed: int, row: bool = False) -> DataFrame:
    """(_doc_id, _source, _size, _h), and the whole row as _row: names of their own, whatever docs' columns are.

    _h orders the documents of a source: the MD5 of seed, doc_id and the text's MD5.
    """
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    place = F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    own = [docs["doc_id"].alias("_doc_id"), docs["source"].alias("_source"), size.alias("_size"), F.md5(place.cast("binary")).alias("_h")]
    return docs.select(*own, *[F.struct(*[docs[c] for c in docs.columns]).alias("_row")] * row)


def _plan(work: Workspace, rows: DataFrame, weights, share: float, max_epochs: float) -> DataFrame:
    """Per source (_source): source_size, target, whole repetitions, and where the fractional one ends.

    Hashes below `edge`, and those below `cut`, are inside the fraction; of the `copies` rows of
    hash `cut` itself, `more` are. The limit is found digit by digit: at most 256 sums a source
    are ordered at a time, and only rows below the prefix in which it falls go on.
    """
    digits, sums = DIGITS, _prefix_sums(rows, DIGITS)
    sums = work.keep(sums, "sums", small=True)
    totals = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = water_fill(work, totals, list(weights), share, max_epochs)
    targets = targets.withColumn("whole", F.floor(epochs).cast("long")).withColumn("part", (epochs - F.floor(epochs)) * F.col("source_size"))
    targets = work.keep(targets.withColumnRenamed("source", "_source"), "targets", small=True)
    sums = join_dimension(sums, targets.filter("part > 0").select("_source", "part"), "_source", "inner").withColumn("base", F.lit(0.0))
    while True:
        running = W.partitionBy("_source").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)
        after = sums.withColumn("after", F.col("base") + F.sum("size").over(running)).filter(F.col("after") > F.col("part"))
        first = after.groupBy("_source", "part").agg(F.min_by(F.struct("prefix", (F.col("after") - F.col("size")).alias("base"), "n", "low", "high"), "prefix").alias("e"))
        edge = work.keep(first.select("_source", "part", F.col("e.prefix").alias("edge"), F.col("e.base").alias("base"), F.col("e.n").alias("n"), (F.col("e.low") == F.col("e.high")).alias("one")), f"edge-{digits}", small=True)
        most = edge.agg(F.max(F.when(~F.col("one"), F.col("n")))).first()[0] or 0
        inside = join_dimension(rows, edge.select("_source", "part", "edge", "base"), "_source", "inner").filter(F.col("_h").startswith(F.col("edge")))
        if most <= FEW or digits >= 32:
            break
        digits += DIGITS
        sums = work.keep(_prefix_sums(inside, digits, "part", "base"), f"sums-{digits}", small=True)
    # The few different hashes of that prefix, in order; rows of one hash are copies of one text.
    same = inside.groupBy("_source", "part", "base", "_h").agg(F.max("_size").alias("size"), F.count("*").alias("copies"))
    running = W.partitionBy("_source").orderBy("_h").rowsBetween(W.unboundedPreceding, 0)
    left = F.col("part") - F.col("base") - (F.sum(F.col("size") * F.col("copies")).over(running) - F.col("size") * F.col("copies")) - F.col("size") / 2
    same = same.filter("size > 0").withColumn("more", F.least(F.when(left >= 0, F.floor(left / F.col("size")) + 1).otherwise(0), F.col("copies")).cast("long"))
    cut = same.filter("more > 0").groupBy("_source").agg(F.max_by(F.struct("_h", "more", "copies"), "_h").alias("c"))
    cut = work.keep(cut.select("_source", F.col("c._h").alias("cut"), F.col("c.more").alias("more"), F.col("c.copies").alias("copies")), "cut", small=True)
    plan = join_dimension(targets, edge.select("_source", "edge"), "_source")
    return work.keep(join_dimension(plan, cut, "_source"), "plan", small=True)


def _prefix_sums(rows: DataFrame, digits: int, *also: str) -> DataFrame:
    prefix = F.substring("_h", 1, digits).alias("prefix")
    return rows.groupBy("_source", *also, prefix).agg(F.sum("_size").alias("size"), F.count("*").alias("n"), F.min("_h").alias("low"), F.max("_h").alias("high"))


def _repeats(work: Workspace, rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins the plan and adds repeats: the whole repetitions, and one more within the fraction."""
    no = F.lit(False)
    inside = F.coalesce(F.col("_h") < F.col("edge"), no) | F.coalesce(F.col("_h") < F.col("cut"), no)
    at_cut = F.coalesce(F.col("_h") == F.col("cut"), no)
    joined = join_dimension(rows, plan, "_source")
    if plan.filter("more < copies").isEmpty():
        return joined.withColumn("repeats", F.col("whole") + (inside | at_cut).cast("long"))
    # Copies of one text on both sides of a limit are told apart by their number.
    apart = at_cut & (F.col("more") < F.col("copies"))
    rest = joined.filter(~apart).withColumn("repeats", F.col("whole") + (inside | at_cut).cast("long"))
    copies = _numbered(work, work.keep(joined.filter(apart), "copies"))
    return rest.unionByName(copies.withColumn("repeats", F.col("whole") + (F.col("_number") <= F.col("more")).cast("long")).drop("_number"))


def _numbered(work: Workspace, rows: DataFrame) -> DataFrame:
    """rows of a written table with _number, from 1 within (_source, _h): each file part counts its own, and
    starts from the counts of the parts before, so that a third of all rows may be copies of one."""
    marked = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).withColumn("_key", F.concat(F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")), F.lit(":"), "_h"))
    counts = marked.groupBy("_key", "_part").count()
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = work.keep(counts.select("_key", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")), "copy-bases")
    own = F.row_number().over(W.partitionBy("_key", "_part").orderBy("_at"))
    return marked.withColumn("_own", own).join(bases, ["_key", "_part"]).withColumn("_number", F.col("_own") + F.col("_base")).drop("_key", "_part", "_at", "_own", "_base")


def mix(spark: SparkSession, docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """Repetitions of each document: doc_id, source, size, source_size, target, repeats, taken.

    Every document gets the whole part of its source's target/size; the fractional part goes to
    a seeded random subset: documents in order of a seeded hash, as far as the fraction of the
    source's words reaches. The limit is found by sums over prefixes of the hash, and only among
    a few thousand rows by a running sum, so a hot source is never sorted in one task. The sum
    of words lies within half a document of the target, also where a source is one text many
    times over. Reruns agree, as the order depends on seed, doc_id and text alone.

    Nulls: a null text has size 0, a null source is a source of its own (ranked last), a null
    doc_id is hashed as the empty one. Repeated rows count each on its own; of rows with equal
    doc_id and text any may be those inside the limit. Texts of any length count whole. Documents
    of size 0 never repeat more often than the cap allows; sources of size 0 get target 0 and
    are left out. An empty table gives an empty result. Other columns are ignored, whatever
    their names.
    """
    work = Workspace(spark, "mix")
    rows = work.keep(_sized(docs.select("doc_id", "source", "text"), seed), "rows")
    out = _repeats(work, rows, _plan(work, rows, weights, share, max_epochs))
    size = F.col("_size")
    return out.select(F.col("_doc_id").alias("doc_id"), F.col("_source").alias("source"), size.alias("size"), "source_size", "target", "repeats", (size * F.col("repeats")).alias("taken"))


def repeat_documents(spark: SparkSession, docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """The mixed corpus: every document as often as mix() says, with all its columns.

    The texts are not shuffled: they meet the plan of their source by a guarded join, each row
    as one value, so that columns of any name and type pass through. Nulls, repeated rows,
    empty and very long texts and empty tables are treated as in mix().
    """
    work = Workspace(spark, "mixed")
    rows = work.keep(_sized(docs.select("doc_id", "source", "text"), seed), "rows")
    plan = _plan(work, rows, weights, share, max_epochs)
    out = _repeats(work, _sized(docs, seed, row=True), plan).filter(F.col("repeats") > 0)
    return out.select(F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))), "_row").select("_row.*")
