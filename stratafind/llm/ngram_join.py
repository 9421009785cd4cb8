"""N-gram Jaccard join: exact, by prefix index lists that are skipped by set relations.

Method. Every distinct shingle set is ordered by one global order (rare buckets first) and the
first n - ceil(t n) + 1 tokens of it are entered in index lists. Two sets that link share a
list, and at their first common token the rest of both sets bounds the overlap; so within a
list, blocks of entries are skipped by size and position without being read. What is left is
answered in two steps, following set relations:

* every entry is tried against the head of its size block and against its neighbour, which is
  linear in the list and joins the members of a group of near copies;
* answers of other pairs are derived from these: a pair inside one component needs none, and
  with |m & L| and |c & L| known for the block's head L, |m & c| is at most
  |m & L| + |c| - |c & L|, so that most pairs are settled without being read. Only the rest is
  verified on the full sets.

An exact parity-bitmap bound (Hamming distance <= symmetric difference) precedes verification.
No list, partner or candidate is capped; exact copies are one class from the start. A list of
more than CELL entries is cut into cells by size block and a hash of the node: each cell has its
own head and neighbours, heads are tried against the least head of their block, and what stays
open is looked for within every cell and between every two cells of one block or of neighbouring
ones (others differ too much in size), so that no task ever holds more than two cells of a list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from .common import Workspace, broadcast_small, chunks, join_dimension, row_hash
from .components import connected_components
from .shingles import bitmap, distance, folded, forget, shingle_sets

#: Buckets of the token order: a table of counts of 2 MB, whatever the corpus.
ORDER_BITS, CHUNK = 18, 4096
#: Entries of a list that are handled together, about; bitmaps that are compared at once.
CELL, AT_ONCE = 1024, 256


def _count_buckets(k: int):
    def run(batches):
        counts = np.zeros(1 << ORDER_BITS, dtype=np.int64)
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                sets = shingle_sets(texts, k)
                if sets:
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts))
        forget()
        if counts.any():
            small = counts.astype(np.int32) if counts.max() < 2**31 else counts
            parts = [x.tobytes() for x in small.reshape(-1, CHUNK)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(parts)), pa.int32()), "counts": pa.array(parts, pa.binary())})

    return run


def _sum_buckets(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            values = np.frombuffer(raw, dtype=np.int32 if len(raw) == 4 * CHUNK else np.int64)
            sums[chunk] = sums.get(chunk, 0) + values.astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles per hash bucket over all documents; a fixed 2 MB, summed in the executors."""
    schema = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(_count_buckets(k), schema)
    total = np.zeros(1 << ORDER_BITS, dtype=np.int64)
    for chunk, raw in parts.repartition("chunk").mapInArrow(_sum_buckets, schema).collect():
        total[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(raw, dtype=np.int64)
    return total


def _signatures(k: int, num: int, den: int, order):
    def run(batches):
        counts = order.value
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                sets = shingle_sets(texts, k)
                ids, prefixes, maps, common = [], [], [], []
                for s in sets:
                    n = len(s)
                    if not n:
                        ids.append(None), prefixes.append(None), maps.append(None), common.append(None)
                        continue
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                    p = n - -(-num * n // den) + 1
                    c = counts[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                    if p < n:  # only the first p in order of (count, token)
                        limit = np.partition(c, p - 1)[p - 1]
                        near = np.flatnonzero(c <= limit)
                        s2, c2 = s[near], c[near]
                    else:
                        s2, c2 = s, c
                    first = np.argsort(c2, kind="stable")[:p]
                    prefixes.append(s2[first].view(np.int64))
                    # only tokens of a full bucket can have a long list
                    common.append(s2[first][c2[first] > CELL].view(np.int64))
                    maps.append(bitmap(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("row_hash")[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(common, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                    names=["doc_id", "row_hash", "n", "cid", "prefix", "common", "bits"],
                )
        forget()

    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                sets = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["cid", "tokens"],
                )
        forget()

    return run


def _overlaps(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            common = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
                both.sort(kind="stable")
                common.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])


def _required(na, nb, num, den):
    """Least overlap at which den * common >= num * union holds."""
    return -(-num * (na + nb) // (num + den))


def _list_runs(batches, columns):
    """Whole index lists, or pairs of their cells (runs of one token and group), as dicts of arrays, from sorted batches."""
    held = None
    for batch in batches:
        got = {c: (batch.column(c).to_numpy(zero_copy_only=False) if c != "bits" else np.array([*batch.column(c).to_pylist(), None], dtype=object)[:-1]) for c in columns}
        if held is not None:
            got = {c: np.concatenate([held[c], got[c]]) for c in columns}
        token, group = got["token"], got["group"]
        if not len(token):
            continue
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (group[1:] != group[:-1])) + 1
        starts = np.concatenate([[0], cuts])
        for s, e in zip(starts[:-1], cuts):
            yield {c: got[c][s:e] for c in columns}
        held = {c: got[c][starts[-1] :] for c in columns}
    if held is not None:
        yield held


def _apart(bits, i: int, j: np.ndarray) -> np.ndarray:
    """Hamming distances of entry i to entries j, each at the narrower width of the two."""
    out = np.empty(len(j), dtype=np.int64)
    sizes = np.array([min(len(bits[x]), len(bits[i])) for x in j])
    for size in np.unique(sizes):
        own, same = folded(bits[i], size), np.flatnonzero(sizes == size)
        for first in range(0, len(same), AT_ONCE):
            at = same[first : first + AT_ONCE]
            out[at] = np.bitwise_count(np.stack([folded(bits[x], size) for x in j[at]]) ^ own).sum(axis=1)
    return out


def _near_enough(num: int, den: int):
    """Pairs that size and parity bitmaps do not rule out."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            need = _required(na, nb, num, den)
            x, y = batch.column("xa").to_pylist(), batch.column("xb").to_pylist()
            fits = np.minimum(na, nb) >= need
            good = [i for i in np.flatnonzero(fits) if na[i] + nb[i] - distance(x[i], y[i]) >= 2 * need[i]]
            yield batch.select(["a", "b", "na", "nb"]).take(pa.array(good, pa.int64()))

    return run


def _residual(num: int, den: int, one: bool):
    """Pairs of one list that lie in different components and that no bound settles.

    one: of each entry's partners only the smallest node of each other component. side tells the
    two cells of a pair of cells apart (-1: one cell, or a whole list).
    """

    def run(batches):
        for got in _list_runs(batches, ("token", "group", "side", "node", "n", "pos", "root", "head", "shared", "bits")):
            root = got["root"]
            if (root == root[0]).all():
                continue
            n, pos, node, side, head, shared, bits = (got[c] for c in ("n", "pos", "node", "side", "head", "shared", "bits"))
            left, right = [], []
            for i in range(1, len(n)):
                # sizes ascend: entries that are too small for this one end before first
                first = int(np.searchsorted(n[:i], -(-num * int(n[i]) // den)))
                j = np.flatnonzero((root[first:i] != root[i]) & ((side[first:i] < 0) | (side[first:i] != side[i]))) + first
                if not len(j):
                    continue
                need = _required(n[i], n[j], num, den)
                most = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
                same = (head[j] == head[i]) & (shared[j] >= 0) & (shared[i] >= 0)
                derived = np.minimum(shared[i] + n[j] - shared[j], shared[j] + n[i] - shared[i])
                most = np.where(same, np.minimum(most, derived), most)
                j = j[most >= need]
                if len(j):
                    need = _required(n[i], n[j], num, den)
                    j = j[n[i] + n[j] - _apart(bits, i, j) >= 2 * need]
                if one and len(j) > 1:
                    j = j[np.argsort(node[j], kind="stable")]
                    j = j[np.unique(root[j], return_index=True)[1]]
                if len(j):
                    left.append(np.full(len(j), node[i]))
                    right.append(node[j])
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["a", "b"])

    return run


def _groups():
    """(group, side) of an entry: 0 for a whole list; in a long one its own cell, and each pair of it with
    another part of its block or with any part of the block below or above."""

    def group(b1, p1, b2, p2):
        return F.xxhash64(b1, p1, b2, p2)

    def one(key, side):
        return F.struct(key.alias("group"), F.lit(side).alias("side"))

    block, part = F.col("block"), F.col("part")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.transform(others, lambda q: F.when(q == part, one(group(block, part, block, part), -1)).when(q < part, one(group(block, q, block, part), 1)).otherwise(one(group(block, part, block, q), 0)))
    above = F.transform(others, lambda q: one(group(block, part, block + 1, q), 0))
    below = F.transform(others, lambda q: one(group(block - 1, q, block, part), 1))
    whole = F.array(one(F.lit(0).cast("long"), -1))
    return F.explode(F.when(F.col("parts") > 1, F.concat(own, above, below)).otherwise(whole)).alias("g")


class NgramJoin:
    """Links all documents whose shingle sets have Jaccard similarity >= num/den.

    rows: doc_id, row_hash, n, cid of every document; classes: one row per distinct set
    (node, cid, rep = smallest doc_id, n); links: verified pairs (a, b, na, nb, common) of
    nodes that span all components; components: (node, root).
    Null doc_ids take part like any row. Null or wordless texts have an empty set and no link.
    Sets are 64-bit hashes of whole shingles, classes 128-bit hashes of whole sets.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, row_hash: Column | None = None):
        self.spark, self.k, self.num, self.den = spark, k, num, den
        self.work = work = Workspace(spark, "ngram-join")
        self.docs = docs.select(docs["doc_id"], docs["text"], (row_hash if row_hash is not None else F.lit(0).cast("long")).alias("row_hash"))
        order = spark.sparkContext.broadcast(bucket_counts(docs, k))
        own = self.docs.select("doc_id", "row_hash").schema.fields
        schema = StructType([*own, *StructType.fromDDL("n long, cid binary, prefix array<long>, common array<long>, bits binary").fields])
        signed = work.keep(self.docs.mapInArrow(_signatures(k, num, den, order), schema), "signed")
        self.rows = signed.select("doc_id", "row_hash", "n", "cid")
        first = signed.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("common").alias("common"), F.first("bits").alias("bits"))
        self.classes = work.keep(work.fewer(first.withColumn("node", F.monotonically_increasing_id()), "signed"), "classes")
        self._link()

    def _link(self) -> None:
        work, num, den = self.work, self.num, self.den
        lists = self.classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
        # Lists that are too long for one task: how many parts each of their size blocks has.
        long = self.classes.select(F.explode("common").alias("token")).groupBy("token").count().filter(F.col("count") > CELL)
        long = work.keep(long.select("token", F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "long-lists", small=True)
        lists = join_dimension(lists, long, "token").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", block)
        part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0).cast("int")
        lists = lists.withColumn("part", part).withColumn("cell", F.when(F.col("parts") > 1, F.col("block")).otherwise(0))
        in_list = W.partitionBy("token", "cell", "part").orderBy("block", "n", "pos", "node")
        lists = lists.withColumn("prev", F.lag(F.struct("node", "n", "pos")).over(in_list)).withColumn("after", F.lead("n").over(in_list))
        third = F.coalesce(F.lag("n", 2).over(in_list), F.lead("n", 2).over(in_list), F.when(F.col("prev").isNotNull(), F.col("after")))
        lists = lists.withColumn("third", third.isNotNull() | (F.col("parts") > 1))
        head = F.first(F.struct("node", "n", "pos")).over(W.partitionBy("token", "cell", "part", "block").orderBy("n", "pos", "node"))
        # Sizes ascend in a whole list: an entry has a partner by size only if its neighbour is one.
        before = F.coalesce(den * F.col("prev.n") >= num * F.col("n"), F.lit(False))
        behind = F.coalesce(den * F.col("n") >= num * F.col("after"), F.lit(False))
        lists = lists.filter((F.col("parts") > 1) | before | behind).withColumn("head", head).drop("after", "cell")
        lists = work.keep(work.fewer(lists, "signed"), "lists")
        # Linear candidates: the head of the size block, the neighbour in the list, and for the
        # heads of a long list's parts the least head of their block.
        tries = lists.select("node", "n", "pos", F.explode(F.array("head", "prev")).alias("o")).filter("o is not null and o.node <> node")
        heads = lists.filter("parts > 1 and head.node = node").select("token", "block", "node", "n", "pos")
        least = heads.groupBy("token", "block").agg(F.min(F.struct("n", "pos", "node")).alias("m"))
        o = F.struct(F.col("m.node").alias("node"), F.col("m.n").alias("n"), F.col("m.pos").alias("pos")).alias("o")
        tries = tries.unionByName(heads.join(least, ["token", "block"]).filter("m.node <> node").select("node", "n", "pos", o))
        need = F.ceil((F.col("n") + F.col("o.n")) * num / (num + den))
        tries = tries.filter((1 + F.least(F.col("n") - F.col("pos") - 1, F.col("o.n") - F.col("o.pos") - 1)) >= need)
        pairs = tries.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
        pairs = work.keep(self._bounded(pairs), "tries", dealt=True)
        tried = self._verify(pairs, "tried")
        self.links = self._true(tried)
        roots = work.keep(connected_components(work, self.links), "roots-1")
        # One candidate per entry and foreign component first, which joins groups of copies;
        # then every pair that is still open. The second turn always runs: the first is empty
        # too where the one candidate was tried before and others of its component were not.
        for turn, one in enumerate((True, False)):
            rest = work.keep(self._rest(lists, roots, tried, one), f"rest-{turn}", small=True)
            if rest.isEmpty():
                continue
            more = self._verify(rest, f"verified-{turn}")
            tried = tried.unionByName(more)
            self.links = self.links.unionByName(self._true(more))
            roots = work.keep(connected_components(work, self.links, f"cc-{turn}"), f"roots-{turn + 2}")
        self.components = roots
        work.drop("lists", "tries", "rest-0", "rest-1")

    def _true(self, pairs: DataFrame) -> DataFrame:
        return pairs.filter(self.den * F.col("common") >= self.num * (F.col("na") + F.col("nb") - F.col("common")))

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """Adds sizes and keeps pairs that the parity bitmaps do not rule out."""
        for x in "ab":
            pairs = pairs.join(self.classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}")), x)
        pairs = pairs.select("a", "b", "na", "nb", "xa", "xb")
        return pairs.mapInArrow(_near_enough(self.num, self.den), "a long, b long, na long, nb long")

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Exact overlaps of pairs (a, b, na, nb), from the whole texts of their nodes."""
        work = self.work
        nodes = work.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.classes.select("node", "cid", "rep"), "node"), f"{name}-nodes", small=True)
        reps = broadcast_small(nodes.select("rep").distinct().withColumnRenamed("rep", "_rep"))
        texts = self.docs.join(reps, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
        sets = texts.mapInArrow(_full_sets(self.k), "cid binary, tokens binary")
        # Both joins read one shuffle of the sets, by node.
        sets = sets.join(nodes.select("cid", "node"), "cid").groupBy("node").agg(F.first("tokens").alias("tokens"))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        out = work.keep(both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_overlaps, "a long, b long, na long, nb long, common long"), name, dealt=True)
        work.drop(f"{name}-nodes")
        return out

    def _rest(self, lists: DataFrame, roots: DataFrame, tried: DataFrame, one: bool) -> DataFrame:
        """Pairs across components that no bound or derived answer settles, with sizes."""
        got = tried.select(F.col("a").alias("x"), F.col("b").alias("y"), "common")
        got = got.union(got.select("y", "x", "common")).withColumnRenamed("common", "shared")
        # In a list of two the one pair was tried.
        entries = lists.filter("third").select("token", "node", "n", "pos", "block", "part", "parts", F.col("head.node").alias("head"))
        entries = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Lists whose entries are all of one component are answered already. Those of a long list
        # meet this by its parts.
        split = entries.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("parts").alias("parts")).filter("lo <> hi")
        split = split.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        entries = entries.join(split, ["token", "part"], "left_semi")
        entries = entries.join(got, (F.col("node") == F.col("x")) & (F.col("head") == F.col("y")), "left").drop("x", "y")
        shared = F.when(F.col("node") == F.col("head"), F.col("n")).otherwise(F.coalesce("shared", F.lit(-1)))
        entries = entries.withColumn("shared", shared.cast("long")).join(self.classes.select("node", "bits"), "node")
        entries = entries.select("token", _groups(), "node", "n", F.col("pos").cast("long").alias("pos"), "root", "head", "shared", "bits")
        entries = entries.select("token", "g.group", "g.side", "node", "n", "pos", "root", "head", "shared", "bits")
        dealt = entries.repartition("token", "group").sortWithinPartitions("token", "group", "n", "pos", "node")
        pairs = dealt.mapInArrow(_residual(self.num, self.den, one), "a long, b long").distinct()
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        size = self.classes.select("node", "n")
        return pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "na", "nb")

    def labelled(self) -> DataFrame:
        """rows with component (its smallest doc_id; the own doc_id where the set is empty)."""
        of = self.classes.select("node", "cid", "rep").join(self.components, "node", "left").withColumn("root", F.coalesce("root", "node"))
        of = self.work.keep(of.select("cid", "root", "rep"), "class-roots", small=True)
        least = of.groupBy("root").agg(F.min("rep").alias("component"), F.min("root").alias("_r"))
        of = of.join(least.select("root", "component"), "root").select(F.col("cid").alias("_cid"), "root", "component")
        out = self.rows.join(of, F.col("cid") == F.col("_cid"), "left").drop("_cid")
        return out.withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near copies: of each component the row of the smallest doc_id stays.

    Ties of doc_id are broken by a hash of the whole row; of fully equal rows one stays. Texts
    without words (null, empty) link with nothing and all stay; null ids come last; very long
    texts count whole; an empty table stays empty. Columns of any name and type pass through.
    Only keys are shuffled; the texts meet the kept keys by a semi join, each row as one value.
    """
    rows = NgramJoin(spark, docs, k, num, den, row_hash=row_hash(docs))
    work = rows.work
    labelled = work.keep(rows.labelled().select("doc_id", "row_hash", "n", "root"), "labelled")
    in_order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_hash"))
    best = labelled.filter("n > 0").groupBy("root").agg(F.min(in_order).alias("m"))
    best = work.keep(best.select(F.col("m.doc_id").alias("k_id"), F.col("m.row_hash").alias("k_hash")), "kept", small=True)
    is_best = labelled["doc_id"].eqNullSafe(best["k_id"]) & (labelled["row_hash"] == best["k_hash"])
    gone = work.keep(labelled.filter("n > 0").join(best, is_best, "left_anti").select(F.col("doc_id").alias("g_id"), F.col("row_hash").alias("g_hash")).distinct(), "gone", small=True)
    twice = labelled.filter("n > 0").join(best, is_best, "left_semi").groupBy("doc_id", "row_hash").count().filter("count > 1")
    twice = work.keep(twice.select(F.col("doc_id").alias("t_id"), F.col("row_hash").alias("t_hash")), "twice", small=True)
    keyed = docs.select(docs["doc_id"].alias("_id"), row_hash(docs).alias("_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    few = broadcast_small(gone)
    kept = keyed.join(few, keyed["_id"].eqNullSafe(few["g_id"]) & (keyed["_hash"] == few["g_hash"]), "left_anti")
    if not twice.isEmpty():
        among = kept["_id"].eqNullSafe(twice["t_id"]) & (kept["_hash"] == twice["t_hash"])
        once = kept.join(twice, among, "left_semi").dropDuplicates(["_id", "_hash"])
        kept = kept.join(twice, among, "left_anti").unionByName(once)
    return kept.select("_row.*")
