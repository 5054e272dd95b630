"""The registered queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard_join, language, mixing, negatives, oracles, packing, pages, passages, phrases, pii, quality_model, quality_rules, secrets
from .shared import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of a text, as the unit of its length.
N_WORDS = "regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')"
#: What a text is about, as far as its layout tells.
TOPIC = "CASE WHEN contains(text, 'icens') THEN 'licence' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '%%%') OR contains(text, '!!') THEN 'noise' ELSE 'prose' END"
#: Target shares: sources flattened, languages given, topics given.
TARGETS: mixing.Targets = {"source": 0.5, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": {"prose": 0.85, "licence": 0.05, "table": 0.07, "noise": 0.03}}
#: Grades: 0 for low quality, 1 for good but toxic, 2 for good.
GRADE = "CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END"


def mixing_dims() -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": F.expr(TOPIC)}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 256 to 2048 words."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), F.expr(N_WORDS), spread=F.col("text"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability and draw under the target shares of sources, languages and topics."""
    return mixing.mixture(_table(spark, sf_dir, "documents"), F.expr(N_WORDS), mixing_dims(), TARGETS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; profiles are learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    profiles = language.learn(docs.where(~held_out))
    return language.identify(docs.withColumn("held_out", held_out), profiles, keep=("doc_id", "held_out"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a Jaccard similarity of 0.9 of their sets of three-word shingles."""
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, and whether it is selected."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, _table(spark, sf_dir, "labels"), F.expr(GRADE))
    return quality_model.score_documents(docs, model, tail=2).withColumn("selected", F.col("tail_probability") >= 0.5)


def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    rows = ann.vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(ann.build_index(rows, k=5), rows.where("id % 50 = 0"), k=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of policy v1 on every document, with the ledger's bits, from a stored ledger."""
    ledger = quality_rules.store_ledger(_table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(ledger, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits")


def quality_rules_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under every version of the policy: how many it keeps, from one stored ledger."""
    return quality_rules.compare_policies(quality_rules.store_ledger(_table(spark, sf_dir, "documents")))


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of policy v2 rejects, by itself and alone, from a stored ledger."""
    return quality_rules.ablation(quality_rules.store_ledger(_table(spark, sf_dir, "documents")), "v2")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words removed from every document."""
    return passages.remove_repeated_passages(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 100) and each of its five positives."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    rows = negatives.candidates(_table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return negatives.mine(rows, F.expr("id % 100 = 0"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a labeller fitted on some of them."""
    table = _table(spark, sf_dir, "pages")
    return pages.extract(table, pages.learn(table), ("page_id", "url"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words of every language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_language_id": op3_language_id,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_vector_graph": op6_vector_graph,
    "op7_quality_rules": op7_quality_rules,
    "quality_rules_versions": quality_rules_versions,
    "quality_rules_ablation": quality_rules_ablation,
    "op8_secret_scan": op8_secret_scan,
    "op9_pii": op9_pii,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_html_text": op12_html_text,
    "op13_collocations": op13_collocations,
}
SQL: dict[str, str] = oracles.sql(TOPIC, TARGETS)
