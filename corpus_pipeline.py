"""The corpus pipeline: quality, near duplicates, personal data, mix, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import jaccard_join, mixing, packing, pii, quality
from knotwork.llm.common import cut, discard, rowed, table

#: Share of all tokens that the mix takes, each document at most once.
MIX_SHARE, MIX_EPOCHS = (9, 10), 1


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1 for; all of them where there are no labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).where("score >= 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles one row, the one with the smallest id (of its texts the one with the
    smallest hash); documents without words and rows without an id all stay."""
    linked = jaccard_join.jaccard_components(docs)
    keys = linked.where("component is not null").groupBy("component", F.struct("doc_id", "text_hash").alias("key")).agg(F.count(F.lit(1)).alias("times"))
    groups = keys.groupBy("component").agg(F.sum("times").alias("size"), F.min("key").alias("first")).where("size > 1")
    stays = F.col("key") == F.col("first")
    # What goes, and of what stays the rows that repeat; all other rows pass by without a join.
    marked = keys.join(groups, "component").where(~stays | (F.col("times") > 1))
    marked = cut(marked.select(F.col("key.doc_id").alias("id"), F.col("key.text_hash").alias("hash"), stays.alias("stays")))
    discard(linked)
    n = marked.count()
    if not n:
        return docs
    rows = rowed(docs, doc_id=F.col("doc_id").cast("long"), text_hash=F.xxhash64(F.col("text").cast("string")))
    maybe = jaccard_join.maybe_among(marked.select(F.xxhash64("id", "hash")), n)(F.xxhash64("doc_id", "text_hash"))
    rows = rows.withColumn("maybe", maybe)
    of = rows.where("maybe").join(marked, (rows["doc_id"] == marked["id"]) & (rows["text_hash"] == marked["hash"]), "left")
    out = rows.where("not maybe").select("row").union(of.where("stays is null").select("row"))
    if not marked.where("stays").isEmpty():
        out = out.union(of.where("stays").dropDuplicates(["id", "hash"]).select("row"))
    return out.select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars as the new text has it."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights of domains and languages ask for."""
    return mixing.mixed(docs, share=MIX_SHARE, epochs=MIX_EPOCHS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place."""
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier is no SQL; tests/llm holds the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
