"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, cotraining, mixing, packing, pii, quality_rules, secrets, sql, toxicity, warc
from .common import table
from .ngram_join import NgramJoin


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"), (5.0, 2.0, 1.0), 1.5, 2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = NgramJoin(spark, table(spark, sf_dir, "documents"), k=3, num=90, den=100).labelled()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", *[f"n_{k}" for k in pii.KINDS])


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(spark, rows, rows.filter(F.pmod("vec_id", F.lit(100)) == 0), k=10)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(spark, table(spark, sf_dir, "documents")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    kept = (F.col("quality_score") >= 0.5).alias("kept")
    return scored.select("doc_id", "content_score", "metadata_score", "quality_score", kept)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.stored(spark, table(spark, sf_dir, "documents"))
    failed = ~quality_rules.kept(F.col("failures"), "base-1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), quality_rules.kept(F.col("failures"), "web-1").alias("kept"), "failures",
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stored ledger, per rule of a policy: rows that fail it, and rows that it alone drops."""
    return quality_rules.ablations(quality_rules.stored(spark, table(spark, sf_dir, "documents")), "web-1")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def queries() -> dict:
    own = (op1_mixing, op2_ngram_jaccard_join, op3_pii_pseudonyms, op4_nearest_neighbours, op5_warc, op6_secret_scan, op7_quality_classifier, op8_packing, op9_quality_rules, rule_ablations, op10_toxicity)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Not SQL: pseudonyms (3), approximate search (4), fitted models (7, 10), the tokenizer (8)."""
    return {
        "op1_mixing": sql.mixing(), "op2_ngram_jaccard_join": sql.ngram_join(), "op5_warc": sql.warc(), "op6_secret_scan": sql.secret_scan(), "op9_quality_rules": sql.quality(), "rule_ablations": sql.ablations(),
    }
