"""A training corpus from raw documents: five stages, each written as a table that the next one reads.

Every stage but the last returns the columns of ``documents``; the last returns packed pieces.

For all stages: a null text is judged as the empty one and stays null; very long texts are read whole; an empty table
gives an empty one with the same columns; columns beyond those of ``documents`` keep names, types and values, whatever
they are called (they travel in a struct). Null and repeated ids are allowed. What ties and repeated rows do is stated
with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import minhash, packing, quality, queries, suffixes, toxicity
from tideline.llm.common import documents, row_key, unwrapped, wrapped, written


def _judged(docs: DataFrame, judge, model, keep) -> DataFrame:
    return unwrapped(judge.score(wrapped(docs), model, ("rest", "text")).where(keep), docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3, learned as in op5.

    Repeated rows have one score and stay or go together; texts without words have the model's base score. A score of
    0.3 itself goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries.fold(4, 2))
    return _judged(docs, toxicity, toxicity.fit(docs, labels), F.col("score") < 0.3)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more, learned as in op2.

    Repeated rows have one score and stay or go together; null and empty texts are one empty line. A score of 0.5 stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries.fold(3, 1))
    return _judged(docs, quality, quality.fit(docs, labels), F.col("score") >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8; those without words stay.

    Of a group the least id stays (null last), of equal ids the least key of id and text. Repeated rows are one document,
    also without words, where all columns count.
    """
    kept = minhash.one_of_each(docs, 5, 80)
    keyed = row_key(wrapped(docs).withColumn("given", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))))
    one = keyed.join(kept, "key", "left_semi")
    again = F.when(F.col("text") == "", F.xxhash64(F.to_json("rest", {"ignoreNullFields": "false"}))).otherwise(F.lit(0))  # repeated rows are one document
    one = one.withColumn("again", again).dropDuplicates(["key", "again"])
    return unwrapped(one.withColumn("text", F.col("given")), docs.columns)


#: Repeated passages: strings of so many bytes are searched, and what they cover goes if it has more words than this.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that stand elsewhere too; ``n_chars`` follows the text.

    Every copy of a passage goes, also of one that comes twice in one document; so repeated rows lose such passages
    altogether. No row goes: a document may end up empty.
    """
    out = suffixes.without_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of up to 2,048 tokens; a repeated row is packed as often as it comes."""
    return packing.pack(docs, queries.WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("packing", pack),
]

#: SQL can express neither the scores nor the packing; the tests compare run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
