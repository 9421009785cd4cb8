"""Toxicity: boosted trees over dense lexical features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Workspace, chunks, release, seeded_rows
from .learning import BoostedTrees, Isotonic

#: Insults of everyday English; the words the labels add are learned.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers clown clowns trash garbage scum filth pathetic worthless disgusting imbecile cretin jerk fool ugly hate hateful vile scumbag bastard bitch asshole shit fuck fucking crap damn whore slut retard retarded pig pigs rat vermin parasite".split())
SECOND = frozenset("you your yours yourself yourselves u ur tu toi vous votre vos du dich dir dein deine ihr euch usted ustedes ti tuyo vosotros".split())
#: Look-alikes that hide letters.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
#: What is no letter or digit at the ends of words (as bare() has it); linear in the text.
_EDGES = r"(?<!\S)[^\p{L}\p{N}\s]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}\s]++(?!\S)"
_HIDDEN = re.compile(r"[^\W\d_][\d@$!*._-]+[^\W\d_]")

INSULT, LEARNED, HIDDEN, YOU, CAPITAL, STRONG = 1, 2, 4, 8, 16, 32
#: Most labelled rows that are fitted, words that are learned, and words a task keeps.
MOST_LABELS, MOST_WORDS, KEPT_WORDS, KEPT_LENGTH = 20_000, 5_000, 50_000, 64
#: A learned word is in LEAST toxic texts or more; its smoothed purity reaches WEAK, or SURE.
LEAST, WEAK, SURE = 4, 0.7, 0.9
NEAR = 5
FEATURES = ("insults_per_100", "learned_per_100", "strong_per_100", "kinds", "hits", "hidden_per_100", "you_per_100", "near_you", "capitals", "exclaims_per_100", "punctuation", "digits", "log_words")


def bare(word: str) -> str:
    """word from its first to its last letter or digit."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


class WordCodes(dict):
    """Word to bits, filled on demand up to a bound."""

    def __init__(self, learned: dict):
        super().__init__()
        self.learned = learned

    def __missing__(self, word: str) -> int:
        plain = bare(word)
        low = plain.lower()
        code = self.learned.get(low, 0)
        if low in INSULTS:
            code |= INSULT
        if low in SECOND:
            code |= YOU
        if len(plain) > 1 and plain.isupper():
            code |= CAPITAL
        if not code & (INSULT | LEARNED) and _HIDDEN.search(plain):
            shown = low.translate(PLAIN)
            if shown in INSULTS or shown in self.learned:
                code |= HIDDEN
        if len(self) < KEPT_WORDS and len(word) <= KEPT_LENGTH:
            self[word] = code
        return code


def features(texts: list, codes: WordCodes) -> np.ndarray:
    """One row of FEATURES per text (null and empty: zeros), for a batch at once."""
    split = [text.split() if text else [] for text in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), dtype=np.uint8, count=int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sums = {}
    for bit in (INSULT, LEARNED, STRONG, HIDDEN, YOU, CAPITAL):
        run = np.concatenate([[0], np.cumsum((flat & bit) > 0)])
        sums[bit] = (run[starts[1:]] - run[starts[:-1]]).astype(float)
    hit = np.flatnonzero(flat & (INSULT | LEARNED | HIDDEN))
    you = np.flatnonzero(flat & YOU)
    near = np.zeros(len(texts))
    kinds = np.zeros(len(texts))
    if len(hit):
        doc = np.searchsorted(starts, hit, side="right") - 1
        if len(you):
            at = np.searchsorted(you, hit)
            for side in (np.maximum(at - 1, 0), np.minimum(at, len(you) - 1)):
                y = you[side]
                close = (np.abs(y - hit) <= NEAR) & (np.searchsorted(starts, y, side="right") - 1 == doc)
                near += np.bincount(doc[close], minlength=len(texts))
        for d in np.unique(doc):
            words = split[d]
            kinds[d] = len({bare(words[i - starts[d]]).lower() for i in hit[doc == d]})
    hits = sums[INSULT] + sums[LEARNED] + sums[HIDDEN]
    per = 100.0 / np.maximum(sizes, 1)
    size = np.array([max(1, len(t)) if t else 1 for t in texts], dtype=float)
    count = lambda marks: np.array([sum(map(t.count, marks)) if t else 0 for t in texts], dtype=float)
    return np.stack(
        [sums[INSULT] * per, sums[LEARNED] * per, sums[STRONG] * per, kinds, hits, sums[HIDDEN] * per, sums[YOU] * per, near, sums[CAPITAL] / np.maximum(sizes, 1), count("!?") * per, count(".,;:") / size, count("0123456789") / size, np.log1p(sizes)],
        axis=1,
    )


class ToxicityModel:
    """Fitted word list, trees and calibration; a few hundred kB at most."""

    def __init__(self, learned: dict, trees: BoostedTrees | None, step: Isotonic | None, share: float):
        self.learned, self.trees, self.step, self.share = learned, trees, step, share

    def score(self, texts: list, codes: WordCodes) -> np.ndarray:
        """codes keeps the bits of frequent words for one task."""
        x = features(texts, codes)
        if self.trees is None:  # no labels: a plain rule
            return np.where(x[:, FEATURES.index("hits")] > 0, 0.9, 0.1)
        margin = self.trees.decide(x)
        smooth = 1 / (1 + np.exp(-margin))
        # steps tie many scores; a little of the margin keeps their order
        return np.clip(0.98 * self.step(margin) + 0.02 * smooth, 0.0, 1.0)


def learned_words(rows: DataFrame, least: int = LEAST, weak: float = WEAK, sure: float = SURE, most: int = MOST_WORDS) -> dict[str, int]:
    """Words of toxic texts, in any language, to LEARNED, or LEARNED | STRONG.

    rows: (text, toxic). A word counts once in each different text. Its purity, the share of
    toxic texts among those that hold it, is smoothed by two texts of the overall share, so that
    rare words have to be purer; the support is absolute, as insults of a language that few
    texts are in are rare among all. Counted in the executors; at most `most` words, those in
    the most toxic texts, reach the driver.
    """
    total, share = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.avg("toxic")).first()
    if not total:
        return {}
    once = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), _EDGES, ""), r"\s+"))
    counts = once.select("toxic", F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    purity = (F.col("bad") + 2 * share) / (F.col("n") + 2)
    counts = counts.filter(F.col("bad") >= least).withColumn("purity", purity).filter(F.col("purity") >= weak)
    found = counts.orderBy(F.desc("bad"), "word").limit(most).select("word", "purity").collect()
    return {word: LEARNED | STRONG if p >= sure else LEARNED for word, p in found}


def fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo folds (null id: null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, held: int = 0, most_labels: int = MOST_LABELS, seed: int = 3) -> ToxicityModel:
    """Fits on labelled rows whose fold is not `held`: folds 2.. grow the trees, fold 1 calibrates.

    At most most_labels rows (by a seeded hash of the id) are read; that bound is the memory of
    the fit. Null labels and null ids are left out, of repeated labels the largest counts.
    """
    work = Workspace(spark, "toxicity")
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", fold()).filter(F.col("fold") != held)
    known = work.keep(seeded_rows(known, "doc_id", seed, most_labels), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", "fold")
    rows = work.keep(rows, "sample")
    learned = learned_words(rows.filter("fold > 1"))

    def measure(batches):
        codes = WordCodes(learned)
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                x = features(texts, codes)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("toxic")[a:b], batch.column("fold")[a:b]], names=["x", "toxic", "fold"])
        codes.clear()
        release()

    got = rows.select("text", "toxic", F.col("fold").cast("int").alias("fold")).mapInArrow(measure, "x array<double>, toxic int, fold int").orderBy("x", "toxic", "fold").toPandas()
    work.drop("sample")
    if not len(got) or got.toxic.nunique() < 2:
        return ToxicityModel(learned, None, None, 0.0)
    x, y, of = np.stack(got.x), got.toxic.to_numpy(float), got.fold.to_numpy()
    # with few positives, one set of rows has to do for both
    enough = min(y[of == 1].sum(), y[of > 1].sum(), (1 - y[of == 1]).sum()) >= 5
    grow, settle = (of > 1, of == 1) if enough else (of > 0, of > 0)
    trees = BoostedTrees(least=10 if len(y) >= 1000 else 2).fit(x[grow], y[grow])
    return ToxicityModel(learned, trees, Isotonic().fit(trees.decide(x[settle]), y[settle]), float(y.mean()))


def score(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """docs with toxicity (or the column named), the calibrated score of every whole text (null: as empty)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(column)
    at, names = base.columns.index("text"), base.columns

    def run(batches):
        model = sent.value
        codes = WordCodes(model.learned)
        for batch in batches:
            for a, b, texts in chunks(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], pa.array(model.score(texts, codes), pa.float64())], names=[*names, column])
        codes.clear()
        release()

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(column, DoubleType())]))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str = "toxicity", **how) -> DataFrame:
    """docs with toxicity (or the column named) by a model fitted on labels (doc_id, toxic).

    The score uses the text alone, all of it: a very long text is one chunk by itself. Null and
    empty texts have scores too, null ids and repeated rows are scored like any row, equal texts
    (ties) have equal scores, extra columns pass through (one of that name is replaced), an
    empty table gives an empty result, and without usable labels a lexicon rule decides.
    """
    return score(docs, fit(spark, docs, labels, **how), column)
