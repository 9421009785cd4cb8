"""Quality classifier by co-training: a text-content view and a page-metadata view.

The measures of all unlabelled documents are written down once. In every round each view scores
all of them, and what it is sure of, drawn evenly by class up to a documented number, becomes
training rows of the other view.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import Workspace, broadcast_small, chunks, free_names, release, seeded_rows
from .learning import BoostedTrees, Logistic

#: Most labelled rows that are fitted; rounds; pseudo-labels that are fitted a round and view, and how
#: far from even the odds of a sure one are.
MOST_LABELS, ROUNDS, TAKEN, SURE = 20_000, 4, 500, 0.4
#: Names of the columns from which metadata are taken, by type.
METADATA = {"lang": "string", "source": "string", "n_chars": "long"}
SLOTS, CONTENT = 64, 14
META = 2 * SLOTS + 3
MARKS = "#$%&*|!<>"


def content_features(texts: list) -> np.ndarray:
    """Dense measures of each text (null and empty: zeros)."""
    out = np.zeros((len(texts), CONTENT))
    for i, text in enumerate(texts):
        words = text.split() if text else []
        n = len(words)
        if not n:
            continue
        size, kinds = len(text), len(set(words))
        letters = sum(map(len, words))
        lines = text.split("\n")
        repeated = sum(a == b for a, b in zip(words, words[1:]))
        marks = [text.count(c) / n for c in MARKS[:5]]
        out[i] = [
            math.log1p(n), letters / n, kinds / n, repeated / n, sum(map(str.isupper, words)) / n, sum(marks), text.count("|") / n, text.count("!") / n,
            text.count("\n") / n, 1 - len(set(lines)) / len(lines), sum(map(text.count, "0123456789")) / size, (text.count(".") + text.count(",")) / n, sum(map(text.count, "<>{}=;")) / n,
            max(map(text.count, set(words[:3]))) / n,
        ]
    return out


def metadata_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Hashed language and source, and the stated length."""
    out = np.zeros((len(langs), META))
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes)):
        out[i, zlib.crc32(f"l{lang}".encode("utf-8", "replace")) % SLOTS] = 1
        out[i, SLOTS + zlib.crc32(f"s{source}".encode("utf-8", "replace")) % SLOTS] = 1
        log = math.log1p(max(0, size or 0))
        out[i, -3:] = [log, log * log, float(size is None)]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class CoTrained:
    """Both views and their calibrated combination."""

    def fit(self, content, meta, y, fold, surest, rounds=ROUNDS):
        """y: 0/1 of the labelled rows; fold 1 calibrates, other folds train.

        surest(view, model, share, turn): what a view is surest of among all unlabelled documents,
        as (content, meta, label), of which share is of class 1.
        """
        grow = fold != 1 if 0 < y[fold == 1].sum() < (fold == 1).sum() and (fold != 1).any() and len(set(y[fold != 1])) == 2 else np.ones(len(y), bool)
        settle = ~grow if (~grow).any() else grow
        cx, cy, mx, my = content[grow], y[grow], meta[grow], y[grow]
        for turn in range(rounds + 1):
            self.content = BoostedTrees(trees=50).fit(cx, cy)
            self.meta = Logistic().fit(mx, my)
            if turn == rounds:
                break
            # Each view labels what it is surest of, in the classes' shares, for the other.
            _, m, label = surest("content", self.content, y[grow].mean(), turn)
            mx, my = np.concatenate([mx, m]), np.concatenate([my, label])
            c, _, label = surest("meta", self.meta, y[grow].mean(), turn)
            cx, cy = np.concatenate([cx, c]), np.concatenate([cy, label])
        views = np.c_[self.content.decide(content[settle]), self.meta.decide(meta[settle])]
        self.own = [Logistic().fit(views[:, [j]], y[settle]) for j in (0, 1)]
        both = np.c_[[self.own[j].decide(views[:, [j]]) for j in (0, 1)]].T
        self.joint = Logistic().fit(both, y[settle])
        return self

    def scores(self, content, meta):
        """Calibrated content, metadata and joint probabilities of quality 1."""
        views = [self.own[0].decide(self.content.decide(content)[:, None]), self.own[1].decide(self.meta.decide(meta)[:, None])]
        return _sigmoid(views[0]), _sigmoid(views[1]), _sigmoid(self.joint.decide(np.c_[views[0], views[1]]))


def _columns(docs: DataFrame) -> list:
    own = set(docs.columns)
    return [F.col(c).cast(t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in METADATA.items()]


def _measured(rows: DataFrame, names: list) -> DataFrame:
    """(x, metadata, names) of rows: the measures of each whole text, and what the metadata view reads."""
    kept = [*METADATA, *names]

    def run(batches):
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(content_features(texts).tolist(), pa.list_(pa.float64())), *[batch.column(c)[a:b] for c in kept]], names=["x", *kept])
        release()

    return rows.mapInArrow(run, StructType([StructField("x", ArrayType(DoubleType())), *rows.select(*kept).schema.fields]))


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, CONTENT)
    return x, metadata_features(*[batch.column(c).to_pylist() for c in METADATA])


def _surest(pool: DataFrame, taken: int, seed: int):
    """How a view's surest rows of the whole pool are found: (view, model, share, turn) -> (content, meta, label)."""
    fields = [StructField("positive", BooleanType()), StructField("draw", LongType()), *pool.schema.fields]
    names = [f.name for f in fields]

    def surest(view, model, share, turn):
        sent = pool.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            fitted = sent.value
            for batch in batches:
                if batch.num_rows:
                    views = _views(batch)
                    p = _sigmoid(fitted.decide(views[0] if view == "content" else views[1]))
                    sure = pa.array(np.abs(p - 0.5) > SURE)
                    draw = pa.array(_order(batch.column("key").to_numpy(), seed + 2 * turn + (view == "meta")))
                    yield pa.RecordBatch.from_arrays([pa.array(p > 0.5), draw, *batch.columns], names=names).filter(sure)

        # each task keeps at most so many a class before any row moves
        drawn = F.row_number().over(W.partitionBy("positive").orderBy("draw", "key"))
        most = F.when(F.col("positive"), int(round(taken * share))).otherwise(int(round(taken * (1 - share))))
        rows = pool.mapInArrow(run, StructType(fields)).withColumn("n", drawn).filter(F.col("n") <= taken).filter(F.col("n") <= most)
        got = rows.drop("n").orderBy("positive", "draw", "key").toArrow().combine_chunks()
        sent.unpersist()
        if not got.num_rows:
            return np.zeros((0, CONTENT)), np.zeros((0, META)), np.zeros(0)
        return (*_views(got), got.column("positive").to_numpy().astype(float))

    return surest


def _order(keys: np.ndarray, seed: int) -> np.ndarray:
    """A seeded order of 64-bit keys, one multiply-and-shift mix a key."""
    with np.errstate(over="ignore"):
        x = (keys.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, taken: int = TAKEN, seed: int = 5) -> CoTrained | None:
    """Fits on at most most_labels labelled rows, drawn by a seeded hash of the id (fold 0 of crc32(doc_id)
    mod 5 is held out), and at most `taken` pseudo-labels a round and view. Both views score all
    unlabelled documents in every round, from measures that are taken once."""
    work = Workspace(spark, "cotraining")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).cast("int")
    all_known = work.keep(labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")), "known")
    known = work.keep(seeded_rows(all_known.withColumn("fold", fold).filter("fold <> 0"), "doc_id", seed, most_labels), "labels")
    rows = docs.select("doc_id", "text", *_columns(docs))
    got = _measured(rows.join(F.broadcast(known), "doc_id").drop("doc_id"), ["quality", "fold"]).orderBy("x", *METADATA, "quality", "fold").toArrow().combine_chunks()
    if len(set(got.column("quality").to_pylist())) < 2:
        return None
    content, meta = _views(got)
    y, of = got.column("quality").to_numpy().astype(float), got.column("fold").to_numpy()
    free = rows.filter("doc_id is not null").join(broadcast_small(all_known.select("doc_id")), "doc_id", "left_anti")
    pool = work.keep(_measured(free.withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit("")))), ["key"]), "pool")
    model = CoTrained().fit(content, meta, y, of, _surest(pool, taken, seed))
    work.drop("pool")
    return model


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs with content_score, metadata_score and quality_score (probability of quality 1).

    Null and empty texts are scored by zero measures, missing or null metadata have values of
    their own, null ids and repeated rows are scored like any row, extra columns pass through
    (those named like the results are replaced), equal rows have equal scores, whole texts of any
    length count, an empty table gives an empty result, and
    without labels of both classes every score is 0.5.
    """
    model = spark.sparkContext.broadcast(fit(spark, docs, labels, **how))
    added = ("content_score", "metadata_score", "quality_score")
    base = docs.drop(*added)
    names = base.columns
    held = free_names(names, "_m_0", "_m_1", "_m_2")
    wide = base.select("*", *[c.alias(n) for n, c in zip(held, _columns(docs))])
    at = names.index("text")

    def run(batches):
        fitted = model.value
        for batch in batches:
            meta = [batch.column(n).to_pylist() for n in held]
            for a, b, texts in chunks(batch.column(at)):
                if fitted is None:
                    got = [np.full(b - a, 0.5)] * 3
                else:
                    got = fitted.scores(content_features(texts), metadata_features(*[c[a:b] for c in meta]))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(names))], *[pa.array(g, pa.float64()) for g in got]], names=[*names, *added])
        release()

    return wide.mapInArrow(run, StructType([*base.schema.fields, *[StructField(c, DoubleType()) for c in added]]))
