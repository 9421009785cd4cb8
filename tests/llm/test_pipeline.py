"""The pipeline's stages against a plain chain of them, and on odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratafind.llm import mixing, packing, pii, queries, toxicity
from stratafind.llm.common import Workspace
from tests.llm.test_operators import DOCS, brute_components, brute_targets, odd_documents, words


def brute_mix(rows, weights=(5, 2, 1)):
    """Each row as often as its source's target says, in order of the documents' hashes."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((md5(f"1:{'' if r['doc_id'] is None else r['doc_id']}:{md5(r['text'] or '')}"), len(words(r["text"])), r))
    target = brute_targets({s: sum(x[1] for x in d) for s, d in by.items()}, weights)
    out = []
    for s, d in by.items():
        size = sum(x[1] for x in d)
        epochs = target[s] / size if size else 0.0
        part, before = (epochs - int(epochs)) * size, 0
        for h, n, r in sorted(d, key=lambda x: x[0]):
            more = part > 0 and n > 0 and before + n / 2 <= part
            before += n
            out += [(r, n)] * (int(epochs) + more)
    return out


def test_run_is_the_chain_of_its_stages(spark, sf_dir):
    """run()'s rows from the texts in plain Python; of the classifier only its verdicts are taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxicity.toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    clean = [r for r in scored if r.toxicity < 0.5]
    assert 0 < len(clean) < len(scored)
    groups = Counter(c for (_, n, c), m in brute_components(clean, 5, 80, 100).items() if n)
    kept = [r for r in clean if not words(r.text) or r.doc_id in groups]
    assert len(kept) < len(clean)
    own = pii.Pseudonyms(pii.pseudonym_key(spark))
    hidden = [{**r.asDict(), "text": own.text(r.text) if r.text else r.text} for r in kept]
    mixed = brute_mix(hidden)
    model = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r, n in mixed:
        ids, place = model.encode(r["text"] or "", add_special_tokens=False).ids + [2], 0
        for size in packing.cut_lengths(len(ids)):
            if n:  # which empty documents repeat is left open
                want[(r["doc_id"], place, size, zlib.crc32(np.array(ids[place : place + size], dtype="<u4").tobytes()))] += 1
            place += size
    got = corpus_pipeline.run(spark, sf_dir).persist()
    empty = {r["doc_id"] for r in hidden if not words(r["text"])}
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect() if r.doc_id not in empty) == want
    by = defaultdict(list)
    for r in got.collect():
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, empty tables."""
    names = "toxicity n_card _hash repeats _size target part _row prefix g_id".split()
    frame = spark.createDataFrame(odd_documents(), DOCS).drop("n", "h").select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)], F.create_map(F.lit("a"), F.lit(1)).alias("map"))
    for docs in (frame, frame.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns, name
            rows = docs.collect()
            if name != "pii":
                assert all(tuple(r[c] for c in names) == tuple(range(len(names))) for r in rows), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert sum(r.start == 0 for r in packed) == len(rows)


def test_repeats_follow_the_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = Counter(r.doc_id for r in mixing.repeat_documents(spark, docs).collect())
    rows = [r.asDict() for r in docs.collect()]
    want = Counter(r["doc_id"] for r, n in brute_mix(rows) if n)
    assert Counter({i: c for i, c in out.items() if i in want}) == want


def test_wide_shuffles_of_small_tables_write_few_files(spark, sf_dir, monkeypatch):
    """Each file starts a process in an executor, which for a moment counts with the memory of the whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keep, parts = Workspace.keep, {}

    def counted(self, df, name, **how):
        out = keep(self, df, name, **how)
        parts[name] = len(out.inputFiles())
        return out

    want = Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, sf_dir).select("doc_id", "text").collect()))
    wide = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    monkeypatch.setattr(Workspace, "keep", counted)
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
        assert Counter(map(tuple, kept.select("doc_id", "text").collect())) == want
        assert set(parts) >= {"classes", "lists", "kept", "gone", "twice"}
        assert max(parts.values()) <= 2 * spark.sparkContext.defaultParallelism, parts
        packed = corpus_pipeline.pack_sequences(spark, docs, sf_dir)
        assert packed.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert packed.filter("start = 0").count() == docs.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
