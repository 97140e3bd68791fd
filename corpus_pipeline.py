"""A corpus from raw documents to training sequences, in five stages.

Each stage is a function of (session, documents, input folder). All but the
last return documents with their columns; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from likeness.llm import near_dup, packing, pii, quality, registry, toxicity
from likeness.runtime import cut, table

#: Rows of document ids to broadcast, at most; beyond it the join is dealt by id.
BROADCAST_IDS = 1_000_000

#: Model scoring, packing and near-duplicate classes are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject (score of at least 0.5).

    Whole rows are kept as they are, with all columns of whatever name; rows that
    repeat each other are judged alike and each kept. A null text is judged as
    an empty one, a text of any length as a whole. Without usable labels nothing
    parts the documents, and all have one score. An empty table stays empty.
    """
    model = registry.quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep_row=True).where(F.col("score") >= 0.5).select("_row.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not call toxic (score below 0.5).

    Rows, nulls, long texts and empty tables as in ``good_quality``; an empty text
    has the score of one without any landmark. Without labels nothing is called toxic.
    """
    model = registry.toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep_row=True).where(F.col("score") < 0.5).select("_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, of several texts with that id the one with the smallest hash.

    Decided by id and text, so unlike texts under one id all stay; of rows that
    repeat an id and its text one stays. Documents without an id or without
    words (a null text, too) are like nothing else. An empty table stays empty.
    """
    found = cut(near_dup.classes(docs).select("doc_id", "text_hash", "stays"))
    known = found.where(F.col("doc_id").isNotNull())
    gone = known.where(~F.col("stays")).select("doc_id", "text_hash").distinct()
    twice = cut(known.where("stays").groupBy("doc_id", "text_hash").count().where(F.col("count") > 1).select("doc_id", "text_hash"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    out = keyed.join(small(gone), ["doc_id", "text_hash"], "left_anti")
    if not twice.isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.to_json("_row")))
        repeated = out.join(small(twice), ["doc_id", "text_hash"], "left_semi").withColumn("turn", first).where(F.col("turn") == 1).drop("turn")
        out = out.join(small(twice), ["doc_id", "text_hash"], "left_anti").unionByName(repeated)
    return out.select("_row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows.

    A null text stays null and keeps its n_chars; an empty one stays empty. Each row of
    repeated ones is treated alike, other columns are kept, an empty table stays empty.
    """
    found = pii.find(docs, keep_row=True)
    new = {"text": F.when(F.col("_row.text").isNotNull(), F.col("redacted")), "n_chars": F.when(F.col("_row.text").isNotNull(), F.length("redacted").cast("long")).otherwise(F.col("_row.n_chars"))}
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences, as the packing query returns them.

    A null or empty text is a document of one id, the end of text; a long one is cut into
    whole windows and a rest. Rows that repeat an id are packed each. Other columns
    than id and text are not read; an empty table gives no pieces.
    """
    return registry.pieces(packing.pack(docs, registry.WORD_BPE))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dup", one_of_each),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
