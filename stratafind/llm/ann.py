"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Vectors are rotated by one random orthogonal matrix, so that any leading block of dimensions is
a random sample of the distance. Within every probed list the scan reads column blocks; after
each it tests, per candidate, the hypothesis that the whole distance is below the current
tenth-best: if the scaled partial distance exceeds it by more than the test's margin, the
candidate is abandoned. Survivors are measured exactly, on the original vectors in double
precision. A first turn scans the nearest list of every query; its tenth-best is the limit with
which the second turn enters all others, and every block of rows that is read tightens it.

Lists have two levels: centres of a sample, and offsets from them that all centres share. So the
number of lists follows the rows, though the sample that fits them is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import Workspace

#: Fixed bounds: rows that fit the lists, rows of one chunk of a list, queries of one block, rows
#: that are scanned with one limit.
SAMPLE_ROWS, CHUNK_ROWS, QUERY_BLOCK, SCAN_ROWS = 20_000, 4_096, 16_384, 512
#: Most centres, most offsets, and the rows of a list from which offsets are added.
MOST_CENTRES, MOST_OFFSETS, LIST_ROWS = 1024, 64, 1000


def valid_vectors(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, empty or all zero and has only finite components."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return rows.filter(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def nearest_lists(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    d = (centres**2).sum(1)[None] - 2 * x @ centres.T
    if count >= len(centres):
        return np.argsort(d, axis=1, kind="stable")
    part = np.argpartition(d, count - 1, axis=1)[:, :count]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def fit_lists(sample: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of a bounded sample."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        own = nearest_lists(sample, centres, 1)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        full = counts > 0
        centres[full] = sums[full] / counts[full][:, None]
    return centres


class Lists:
    """Lists of a rotated space: list c * offsets + o is around centre c plus offset o."""

    def __init__(self, sample: np.ndarray, centres: int, offsets: int, seed: int):
        self.centres = fit_lists(sample, centres, seed)
        own = nearest_lists(sample, self.centres, 1)[:, 0]
        self.offsets = fit_lists(sample - self.centres[own], offsets, seed + 1) if offsets > 1 else np.zeros((1, sample.shape[1]))
        self.count = len(self.centres) * len(self.offsets)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: its nearest centre, then the offset nearest to what is left."""
        c = nearest_lists(x, self.centres, 1)[:, 0]
        return c * len(self.offsets) + nearest_lists(x - self.centres[c], self.offsets, 1)[:, 0]

    def near(self, x: np.ndarray, count: int) -> np.ndarray:
        """The lists nearest to each row, nearest first."""
        every = (self.centres[:, None] + self.offsets[None]).reshape(self.count, -1)
        step = max(1, (8 << 20) // self.count)
        return np.concatenate([nearest_lists(x[i : i + step], every, min(count, self.count)) for i in range(0, len(x), step)])


def probes_needed(sample: np.ndarray, lists: Lists, k: int, target: float, seed: int) -> int:
    """Least number of probed lists that reaches the target recall on the sample (brute force)."""
    pick = np.random.default_rng(seed).permutation(len(sample))[:200]
    own = lists.own(sample)
    order = lists.near(sample[pick], lists.count)
    needed = []
    for row, i in enumerate(pick):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        best = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        place = np.empty(lists.count, dtype=np.int64)
        place[order[row]] = np.arange(lists.count)
        needed.append(place[own[best]])
    if not needed or not len(needed[0]):
        return lists.count
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def adaptive_scan(base, ids, turned, q, q_turned, q_id, k: int, block: int, margin: float, limit: float):
    """The k nearest of one list chunk to one query: (distances, ids), ties to smaller ids."""
    dim = turned.shape[1]
    left = np.arange(len(ids))
    if np.isfinite(limit):
        partial = np.zeros(len(ids))
        for start in range(0, dim, block):
            end = min(dim, start + block)
            partial[left] += ((turned[left, start:end] - q_turned[start:end]) ** 2).sum(1)
            if end < dim:
                bound = limit**2 * (end / dim) * (1 + margin / np.sqrt(end)) ** 2
            else:
                bound = limit**2 * (1 + 1e-9)
            left = left[partial[left] <= bound]
            if not len(left):
                return np.empty(0), np.empty(0, dtype=np.int64)
    left = left[ids[left] != q_id]
    d = np.sqrt(((base[left] - q) ** 2).sum(axis=1))
    if len(left) > k:
        # every row that ties with the k-th stays a candidate
        kth = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= kth)
        left, d = left[near], d[near]
    order = np.lexsort((ids[left], d))[:k]
    return d[order], ids[left][order]


def scan_rows(base, ids, turned, q, q_turned, q_id, k: int, block: int, margin: float, limit: float):
    """The k nearest of a chunk within limit, block of rows by block: what is found tightens the limit."""
    d, near = np.empty(0), np.empty(0, dtype=np.int64)
    for at in range(0, len(ids), SCAN_ROWS):
        rows = slice(at, at + SCAN_ROWS)
        more, found = adaptive_scan(base[rows], ids[rows], turned[rows], q, q_turned, q_id, k, block, margin, limit)
        if len(more):
            d, near = np.concatenate([d, more]), np.concatenate([near, found])
            order = np.lexsort((near, d))[:k]
            d, near = d[order], near[order]
            if len(d) == k:
                limit = min(limit, d[-1])
    return d, near


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, target: float = 0.97, block: int = 16, margin: float = 2.1, seed: int = 7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first.

    vectors and queries have (vec_id, embedding). Every valid vector is indexed: it goes to its
    nearest list, and a list to chunks of about 4,096 rows, so a vector that is repeated a
    million times fills many chunks and no single task. The lists, whose number grows with the
    square root of the rows and beyond 1,024 centres with the rows, are fitted on a seeded
    sample of at most sample_rows vectors, and the number of probed lists is the least that
    reaches the target recall on that sample. Queries go to the chunks of their probed lists;
    only where more than 16,384 queries probe one list are its chunks copied, once per block of
    so many. What a chunk returns is at most k rows a query.

    Nulls, zero vectors and non-finite components take no part, as query or candidate; a row
    with null vec_id is no query but a candidate that can't be named, so it takes no part
    either. Vectors only meet vectors of their own length. Repeated rows each count; ties go to
    the smaller vec_id. A query row that is repeated is asked once. The own row of a query is left out by its id. Fewer than k candidates
    give fewer rows. Empty tables give an empty result.
    """
    work = Workspace(spark, "ann")
    as_double = F.col("embedding").cast("array<double>").alias("embedding")
    rows = valid_vectors(vectors).filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), as_double)
    asked = valid_vectors(queries).filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), as_double)
    asked = asked.dropDuplicates(["vec_id", "embedding"]).withColumn("q", F.xxhash64("embedding"))
    out = None
    for dim in sorted(r[0] for r in asked.select(F.size("embedding")).distinct().collect()):
        of_dim = F.size("embedding") == dim
        part = _search(spark, work, rows.filter(of_dim), asked.filter(of_dim), dim, k, lists, target, block, margin, seed, sample_rows)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _search(spark, work, rows, asked, dim, k, lists, target, block, margin, seed, sample_rows):
    total = rows.count()
    drawn = rows.select("embedding").sample(min(1.0, 0.98 * sample_rows / max(1, total)), seed) if total > sample_rows else rows.select("embedding")
    drawn = drawn.limit(sample_rows).toPandas()["embedding"]
    sample = np.stack([np.asarray(x, dtype=np.float64) for x in drawn]) if len(drawn) else np.zeros((0, dim))
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    turn = rotation(dim, seed)
    count = lists or int(min(MOST_CENTRES, len(sample) // 8 + 1, max(1, np.sqrt(total) // 2)))
    index = Lists(sample @ turn, count, int(min(MOST_OFFSETS, max(1, total // (count * LIST_ROWS)))), seed)
    probes = probes_needed(sample @ turn, index, k, target, seed)
    model = spark.sparkContext.broadcast((turn, index))

    def to_numpy(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)

    def assign(batches):
        turn, index = model.value
        for batch in batches:
            if batch.num_rows:
                own = index.own(to_numpy(batch.column("embedding")) @ turn)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(own.astype(np.int32))], names=["vec_id", "embedding", "list"])

    def probe(batches):
        turn, index = model.value
        for batch in batches:
            if batch.num_rows:
                near = index.near(to_numpy(batch.column("embedding")) @ turn, probes)
                take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                place = np.tile(np.arange(near.shape[1], dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("vec_id", "embedding", "q")] + [pa.array(near.ravel().astype(np.int32)), pa.array(place)], names=["vec_id", "embedding", "q", "list", "place"])

    indexed = work.keep(rows.mapInArrow(assign, "vec_id long, embedding array<double>, list int"), f"index-{dim}")
    sent = work.keep(asked.mapInArrow(probe, "vec_id long, embedding array<double>, q long, list int, place int"), f"probes-{dim}")
    # Chunks of a list as its rows ask for, blocks of its queries as those do: at most 65,536 rows.
    chunks = indexed.groupBy("list").count().select("list", F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks"))
    blocks = sent.groupBy("list").count().select(F.col("list").alias("l"), F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("blocks"))
    sizes = chunks.join(blocks, F.col("list") == F.col("l")).select("list", "chunks", "blocks")
    sizes = work.keep(sizes, f"sizes-{dim}")

    def scan(key, left, right):
        turn, _ = model.value
        schema = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        base, ids = to_numpy(left.column("embedding").chunk(0)), left.column("vec_id").to_numpy()
        q, q_ids = to_numpy(right.column("embedding").chunk(0)), right.column("vec_id").to_numpy()
        q_hash, limits = right.column("q").to_numpy(), right.column("limit").to_numpy(zero_copy_only=False)
        turned, q_turned = base @ turn, q @ turn
        got = []
        for i in range(len(q_ids)):
            d, near = scan_rows(base, ids, turned, q[i], q_turned[i], q_ids[i], k, block, margin, limits[i])
            got.append((np.full(len(d), q_ids[i]), np.full(len(d), q_hash[i]), near, d))
        return pa.table([pa.array(np.concatenate([g[j] for g in got])) for j in range(4)], schema=schema)

    def turn_of(these, name):
        """The nearest found by these queries (with their limits) in the lists they are sent to."""
        keys = ["list", "chunk", "block"]
        to = these.join(F.broadcast(sizes), "list")
        to = to.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = indexed.join(F.broadcast(sizes), "list").withColumn("chunk", F.pmod(F.xxhash64(F.col("vec_id"), F.rand(seed)), F.col("chunks")).cast("int"))
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = dealt.select(*keys, "vec_id", "embedding").groupBy(*keys).cogroup(to.select(*keys, "vec_id", "embedding", "q", "limit").groupBy(*keys))
        return work.keep(found.applyInArrow(scan, "query_id long, q long, vec_id long, score double"), name)

    best = W.partitionBy("query_id", "q").orderBy("score", "vec_id")

    def nearest(found):
        return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)

    first = nearest(turn_of(sent.filter("place = 0").withColumn("limit", F.lit(float("inf"))), f"first-{dim}"))
    limits = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "q", F.col("score").alias("limit"))
    rest = sent.filter("place > 0").join(limits, ["vec_id", "q"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    more = turn_of(rest, f"rest-{dim}")
    return nearest(first.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "score")
