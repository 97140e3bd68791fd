"""Queries of this subpackage: name -> plan, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from likeness.llm import bpe, exact_topk, filter_audit, near_dup, neighbours, packing, pii, prefix_trie, quality, quality_rules, secrets, token_counts, toxicity
from likeness.llm.samples import labelled_sample
from likeness.runtime import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, BYTE_BPE).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def remainder(by: int):
    """crc32 of a document's id as text, modulo ``by``: the folds of the classifiers."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


def quality_model(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_bytes: int = 6000) -> quality.Net:
    """Fit on labelled rows of the training fold: at most 1.5 * ``per_class`` of each label, with texts of at most ``max_bytes``."""
    return quality.fit(*labelled_sample(docs, labels, "quality", remainder(3) != 1, per_class, max_bytes))


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = 1200, max_bytes: int = 8000) -> toxicity.Machine:
    """Fit on labelled rows of the training fold: at most 1.5 * ``per_class`` of each label, with texts of at most ``max_bytes``.

    Of a label with fewer than 100 such texts longer ones are taken too. The
    two labels weigh the same: a missed toxic document costs more than the
    share of toxic ones says. Where nothing parts the labels, every score is
    the share of label 1 among all labelled rows of the fold, 0.001 without any.
    """
    texts, label, share = labelled_sample(docs, labels, "toxic", remainder(5) != 0, per_class, max_bytes, least=100)
    model = toxicity.fit(texts, label)
    return model if model.landmarks else toxicity.constant(share or 0.0)


def _judged(scored: DataFrame, by: int, held: int) -> DataFrame:
    return scored.select("doc_id", (remainder(by) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels"))), 3, 1)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(packing.pack(table(spark, sf_dir, "documents"), WORD_BPE))


def pieces(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits: a note set in at a third of it, seven characters taken out at two thirds, a line added at its end."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda at, delete, insert: F.struct(at.cast("long").alias("at"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))
    edits = F.array(edit(F.floor(n / 3), 0, " [see note 7]"), edit(F.floor(n * 2 / 3), 7, ""), edit(n + 1000, 0, "\nEnd of document."))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts.count_edits(docs, BYTE_BPE)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[native] Only Spark's own functions run on the executors."""
    return quality_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.BASE_MEASURES, "base_failed", "kept")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_pii, op4_neighbours, op5_secrets, op6_packing, op7_topk, op8_near_dup, op9_token_counts, op10_toxicity, op11_filter_audit, op12_quality_rules, op13_prefix_trie)}


OP7_SQL = """
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM own q JOIN own c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP4_SQL = """
WITH own AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM own q JOIN own c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_neighbours": OP4_SQL, "op7_topk": OP7_SQL, "op11_filter_audit": filter_audit.SQL, "op12_quality_rules": quality_rules.sql(), "op13_prefix_trie": prefix_trie.SQL}
