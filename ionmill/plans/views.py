"""The relational model as views of the supplied tables: peaks, fragments, transitions, features, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spectrum_id, energy, source, mass, intensity from order lines."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("spectrum_id"), ((F.col("l_linenumber") - 1) % 3).alias("energy"),
        F.when(F.col("l_linestatus") == "F", "measured").otherwise("predicted").alias("source"),
        (F.col("l_extendedprice") / 100).alias("mass"), F.col("l_quantity").alias("intensity"),
    )


def event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, cand_id, energy, mass, intensity: denser spectra from events; a user's ``view`` events are the target."""
    t = table(spark, sf_dir, "events")
    return t.select(
        F.col("user_id").alias("target_id"), F.col("event_type").alias("cand_id"), (F.col("event_id") % 3).alias("energy"),
        F.col("value").alias("mass"), (1 + F.col("event_id") % 97).cast("double").alias("intensity"), F.col("event_id").alias("peak_id"),
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, frag_id, mass, theta: fifty parts make one fragmentation graph."""
    t = table(spark, sf_dir, "part")
    return t.select(
        F.floor(F.col("p_partkey") / 50).cast("long").alias("mol_id"), (F.col("p_partkey") % 50).alias("frag_id"),
        F.col("p_retailprice").alias("mass"), ((F.col("p_size") - 25) / 10).alias("theta"),
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, from_id, to_id, theta: two parents per fragment where they differ."""
    f = fragments(spark, sf_dir).where("frag_id > 0")
    parents = F.array_distinct(F.array(F.floor(F.col("frag_id") / 2).cast("long"), F.floor(F.col("frag_id") / 3).cast("long")))
    return f.select("mol_id", F.explode(parents).alias("from_id"), F.col("frag_id").alias("to_id"), "theta")


def doc_features(spark: SparkSession, sf_dir: str, buckets: int = 256) -> DataFrame:
    """doc_id, idx: the distinct hashed words of each document, read whole."""
    t = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[ \n]+"))
    word = t.select("doc_id", F.explode(words).alias("word")).where("word <> ''")
    return word.select("doc_id", (F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 4), 16, 10).cast("int") % buckets).alias("idx")).distinct()


#: The same views as SQL, for checking.
SQL = {
    "peaks": "peaks AS (SELECT l_orderkey AS spectrum_id, (l_linenumber - 1) % 3 AS energy, CASE WHEN l_linestatus = 'F' THEN 'measured' ELSE 'predicted' END AS source, l_extendedprice / 100 AS mass, l_quantity AS intensity FROM lineitem)",
    "event_peaks": "event_peaks AS (SELECT user_id AS target_id, event_type AS cand_id, event_id % 3 AS energy, value AS mass, CAST(1 + event_id % 97 AS DOUBLE) AS intensity, event_id AS peak_id FROM events)",
    "fragments": "fragments AS (SELECT p_partkey // 50 AS mol_id, p_partkey % 50 AS frag_id, p_retailprice AS mass, (p_size - 25) / 10 AS theta FROM part)",
    "transitions": "transitions AS (SELECT DISTINCT mol_id, unnest([frag_id // 2, frag_id // 3]) AS from_id, frag_id AS to_id, theta FROM fragments WHERE frag_id > 0)",
    "doc_features": "doc_features AS (SELECT DISTINCT doc_id, ('0x' || md5(word)[1:4])::INT % 256 AS idx FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[ \\n]+')) AS word FROM documents) WHERE word <> '')",
}
