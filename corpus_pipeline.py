"""Corpus pipeline: documents through five of the training-data operators.

Every stage takes all documents its predecessor kept and returns them with the columns of ``documents``; the last returns
the packed pieces.  Stages read nothing but their input and, for toxicity, the labels.

Defined results: rows with nulls in any column pass each stage as its operator defines; empty tables give empty results;
columns beyond those of ``documents`` are dropped at the first stage.

Stages are computed when their caller writes them, so each makes its session hand whole texts to Python in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, minhash, packing, substrings, toxicity
from gridloom.llm.common import table, texts_in_small_batches, written

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
#: Toxicity score from which a document goes.
TOXIC = 0.5
#: Share of the votes from which a predicted language replaces the given one.
SURE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that can be told (without a letter) go; if no language can be learnt, all stay.

    The others carry the predicted language where theirs is missing, or where the prediction is ``SURE`` and says another.
    """
    texts_in_small_batches(spark)
    filters = langid.learn(docs)
    if not filters.languages:
        return _documents(docs)
    found = langid.identify(_documents(docs), filters).where(F.col("lang_pred") != langid.UNKNOWN)
    told = F.when(F.col("lang").isNull() | (F.col("lang_score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return _documents(found.withColumn("lang", told))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    texts_in_small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _documents(toxicity.score_toxicity(_documents(docs), model).where(F.col("toxic_score") < TOXIC))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component stays."""
    texts_in_small_batches(spark)
    found = minhash.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return _documents(_documents(docs).join(found, F.col("doc_id").eqNullSafe(F.col("kept_id"))))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start earlier are cut; n_chars follows the text."""
    texts_in_small_batches(spark)
    own = _documents(docs)
    cut = substrings.cut_passages(own, keep=["lang", "source", "n_chars"])
    return _documents(cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts cut and packed into windows of 4096 tokens."""
    texts_in_small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packed)]

#: Learnt stages and packing have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
