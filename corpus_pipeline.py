"""The corpus pipeline: language ID, exact dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), keeps whole rows of ``docs`` and returns them with the columns of ``documents``; the last returns
pieces in sequences. run() writes every stage to the shared folder and reads it again, so that a lost executor costs one stage's
tasks at most.

Every stage carries other columns, whatever their names, as they are. An empty table goes through all stages and gives no rows. What a stage does with nulls,
empty and very long texts, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionmill.llm import common, decontam, exact_dedup, jaccard_join, langid, packing
from ionmill.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. The model never learns from the held-out fold.

    A null, empty or letterless text is rejected; a null doc_id is judged like any other; repeated rows share their fate; texts are read whole.
    """
    common.slim(spark)
    return langid.keep_identified(docs, langid.fit(docs.where(~langid.held_out(F.col("doc_id")))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, by A-Z lower-cased bytes: the largest doc_id.

    Null and empty texts are equal; a null doc_id stays only in a group of nulls; of rows that repeat the id that stays, one stays.
    """
    common.slim(spark)
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Null, empty and wordless texts are in no group and stay; null doc_ids come last; of rows that share an id and a group, one stays.
    """
    common.slim(spark)
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null or empty text holds none, a null item is held by none; repeated rows share their fate.
    """
    common.slim(spark)
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens. Workers still hold what earlier stages left, so the caches are smaller.

    A null or empty text is its end id; repeated rows and null doc_ids are packed like others; a text longer than a sequence is cut into pieces.
    """
    common.slim(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0, cache_bytes=48 << 20)


STAGES = [("language ID", language), ("exact dedup", exact), ("near duplicates", near), ("decontamination", decontaminate), ("packing", pack)]

#: Compression sizes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.scratch(spark, f"stage-{name.replace(' ', '-')}")
        docs = common.materialize(stage(spark, docs, sf_dir), name, path)
        if last:
            common.drop_folder(spark, last)
        last = path
    return docs
