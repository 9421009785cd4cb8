"""Packing token sequences: histogram packing by non-negative least squares.

Lengths beyond a window are cut into full windows and a rest; rests are cut on a grid, so that
all pieces but the smallest fill a window without padding. Shallow combinations of grid lengths
that fill a window are enumerated, their repeat counts are solved against the histogram by
non-negative least squares, rounded down, and what is left is packed greedily. The plan is
bounded by the window, never by the corpus; pieces find their place in it by their rank within
their length.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import Workspace, chunks, release

WINDOW, GRID, DEPTH, END_ID = 4096, 128, 4, 2
#: Parts in which the pieces of one length are numbered.
PARTS = 256
#: Most parts of words, and most words, whose ids a task keeps per generation, and their most bytes;
#: bits that remember what was asked for once.
KEPT_PARTS, KEPT_WORDS, KEPT_LENGTH, SEEN_BITS = 120_000, 40_000, 64, 1 << 20
# The normalizer and the splits of the tokenizer for which the short cut holds.
_STEPS = [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of these characters alone are cut by the second rule; others word by word, by encode() where need be.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile("[\t-\r !-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PART = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\t-\r ]+")
#: Byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SYMBOLS = dict(zip((b for b in range(256) if b not in _PRINTS), map(chr, range(256, 512))))


def _cuts_as_known(path: str) -> bool:
    """Whether a tokenizer file drops white space, lowers, cuts and spells bytes as the short cut does."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = (file.get("normalizer") or {}).get("normalizers") or []
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [(x["type"], x.get("pattern"), x.get("content")) for x in steps] != _STEPS or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
        return False
    split, spell = splits
    known = split["pattern"] == {"Regex": _SPLIT} and split["behavior"] == "Removed" and split["invert"] and not spell["add_prefix_space"] and not spell["use_regex"]
    plain = all("<|" in t["content"] and not t["normalized"] for t in file.get("added_tokens", []))
    return known and plain and file["model"]["type"] == "BPE" and not file["model"]["dropout"] and file.get("post_processor") is None


class _Kept(dict):
    """A dictionary of two generations: what is asked for stays, the rest goes with its generation.

    What is asked for the first time is only remembered by a bit: most words of a corpus come once.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.old, self.make, self.most = {}, make, most
        self.seen, self.marked = bytearray(SEEN_BITS // 8), 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            at = hash(key) % SEEN_BITS
            bit = 1 << (at & 7)
            if not self.seen[at >> 3] & bit or len(key) > KEPT_LENGTH:
                self.seen[at >> 3] |= bit
                self.marked += 1
                if self.marked > SEEN_BITS // 2:
                    self.seen, self.marked = bytearray(SEEN_BITS // 8), 0
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.seen, self.marked = {}, bytearray(SEEN_BITS // 8), 0


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Little-endian uint32 ids of texts, part by part.

    The tokenizer drops white space and never joins across it, so the ids of a text are those
    of its words in turn. Within a plain word (ASCII without apostrophes, Latin-1 letters) its
    letters, digits and other runs are tokens' bounds too, so a plain text is lowered and cut
    into those at once, and the merge model is asked for each. Texts with other characters go word
    by word, and words that are not plain through the whole tokenizer. Frequent parts and words
    are kept until the task ends. The file's normalizer and splits are read; where they are not
    those for which this holds, whole texts go through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_part = Tokenizer.from_file(path), _cuts_as_known(path)
        self.model = self.tokenizer.model
        self.parts = _Kept(self._part, KEPT_PARTS)
        self.words = _Kept(self._word, KEPT_WORDS)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_SYMBOLS)
        return _packed([t.id for t in self.model.tokenize(part)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PART.findall(text.lower())))

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        return self._plain(text) if _is_plain(text) else self._encoded(text)

    def _encoded(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_part:
            return self._encoded(text)
        if _is_plain(text):
            return self._plain(text)
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split()))

    def forget(self) -> None:
        self.parts.forget()
        self.words.forget()


def _is_plain(text: str) -> bool:
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


_by_path: dict[str, WordIds] = {}


def cut_lengths(total: int, window: int = WINDOW, grid: int = GRID) -> list[int]:
    """Full windows, then the rest up to the grid, then what is below the grid."""
    rest = total % window
    return [window] * (total // window) + [x for x in (rest - rest % grid, rest % grid) if x]


def pieces_of(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, grid: int = GRID, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        if tokenizer_path not in _by_path:
            _by_path[tokenizer_path] = WordIds(tokenizer_path)
        words = _by_path[tokenizer_path]
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, texts in chunks(batch.column("text")):
                at, start, length, crc, total = [], [], [], [], []
                for i, raw in enumerate(map(words.text, texts), a):
                    raw, place = raw + end, 0
                    for n in cut_lengths(len(raw) // 4, window, grid):
                        at.append(i), start.append(place), length.append(n), total.append(len(raw) // 4)
                        crc.append(zlib.crc32(memoryview(raw)[4 * place : 4 * (place + n)]))
                        place += n
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
        words.forget()
        release()

    schema = docs.select("doc_id").schema
    for c in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(c, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def combinations(bins: list[int], window: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most depth lengths from bins that add up to exactly the window."""
    have, out = sorted(bins, reverse=True), []
    known = set(have)

    def grow(prefix: tuple, left: int, most: int):
        if left in known and left <= most:
            out.append((*prefix, left))
        if len(prefix) + 1 < depth:
            for b in have:
                if b <= most and b < left:
                    # the rest has to be no longer than b each
                    if (depth - len(prefix) - 1) * b >= left - b:
                        grow((*prefix, b), left - b, b)

    grow((), window, window)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by an active set."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    slope = a.T @ b
    for _ in range(rounds):
        gain = np.where(active, -np.inf, slope)
        if not len(gain) or gain.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[int(gain.argmax())] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            drop = at[(x[at] <= 1e-12)]
            drop = drop if len(drop) else at[low][:1]
            active[drop], x[drop] = False, 0
            if not active.any():
                break
        slope = a.T @ (b - a @ x)
    return x


def plan_packing(histogram: dict[int, int], window: int = WINDOW, grid: int = GRID, depth: int = DEPTH) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), sequences), ...] that uses every piece of the histogram once."""
    left = {n: c for n, c in histogram.items() if c}
    plan: list = []

    def use(pattern: dict[int, int], times: int):
        if times > 0:
            plan.append((tuple(sorted(pattern.items(), reverse=True)), int(times)))
            for n, c in pattern.items():
                left[n] -= c * int(times)
                if not left[n]:
                    del left[n]

    if left.get(window):
        use({window: 1}, left[window])
    bins = [n for n in left if n % grid == 0]
    found = combinations(bins, window, depth)
    if found:
        row = {n: i for i, n in enumerate(bins)}
        a = np.zeros((len(bins), len(found)))
        for j, parts in enumerate(found):
            for n in parts:
                a[row[n], j] += 1
        want = np.array([left[n] for n in bins], dtype=float)
        # long lengths weigh more, as they leave more padding
        weight = np.sqrt(np.array(bins, dtype=float) / window)[:, None]
        times = np.floor(nonnegative_least_squares(a * weight, want * weight[:, 0]) + 1e-6)
        for j in np.argsort(-times, kind="stable"):
            parts = {n: found[j].count(n) for n in set(found[j])}
            use(parts, min(int(times[j]), *(left.get(n, 0) // c for n, c in parts.items())) if len(parts) else 0)
    # Greedy rest: largest first, then the largest that still fits; equal sequences in bulk.
    while left:
        pattern, room = {}, window
        for n in sorted(left, reverse=True):
            c = min(room // n, left[n])
            if c:
                pattern[n], room = c, room - c * n
            if not room:
                break
        use(pattern, max(1, min(left[n] // c for n, c in pattern.items())))
    return plan


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, window: int = WINDOW, grid: int = GRID, end_id: int = END_ID, depth: int = DEPTH) -> DataFrame:
    """Pieces with their sequence_id and offset in it.

    Every document (null text: empty) ends in end_id, so it has at least one piece. Repeated
    rows and null ids are documents like any other. A piece takes the place of its rank among
    the pieces of its length; ranks are running numbers within (length, part) plus the counts
    of earlier parts, so a length that a third of all documents share is numbered by many
    tasks. Sequences hold at most window tokens; only the last few of a plan are padded. An
    empty table gives an empty result.
    """
    work = Workspace(spark, "pack")
    pieces = work.keep(
        pieces_of(docs, tokenizer_path, window, grid, end_id).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(PARTS)).cast("int")),
        "pieces",
    )
    counts = sorted(pieces.groupBy("length", "part").count().collect())  # at most lengths x PARTS rows
    histogram: dict[int, int] = {}
    bases = []
    for length, part, n in counts:
        bases.append((length, part, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    slots, used, sequence = [], {}, 0
    for pattern, times in plan_packing(histogram, window, grid, depth):
        offset = 0
        for length, each in pattern:
            first = used.get(length, 0)
            slots.append((length, first, first + each * times, each, sequence, offset))
            used[length] = first + each * times
            offset += length * each
        sequence += times
    base = spark.createDataFrame(bases, "length long, part int, base long")
    places = spark.createDataFrame(slots, "length long, first long, last long, each long, sequence0 long, offset0 long")
    by_length = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "each", "sequence0", "offset0"))).alias("slots"))
    rank = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = pieces.withColumn("rank", rank).join(F.broadcast(base), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = placed.join(F.broadcast(by_length), "length")
    slot = F.get(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"])), F.lit(0))
    placed = placed.withColumn("slot", slot).withColumn("in", F.col("rank") - F.col("slot.first"))
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.sequence0") + F.floor(F.col("in") / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset0") + F.pmod("in", F.col("slot.each")) * F.col("length")).cast("long").alias("offset"),
    )
    return work.fewer(placed, "pieces")
