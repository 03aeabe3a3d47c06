"""Libraries as streams: new files of records are parsed and appended as they arrive. An extra; the model itself is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record_stream(spark: SparkSession, folder: str, blank: str = "\n\n") -> DataFrame:
    """spectrum_id, energy, mass, intensity of the records of new files; a record without an energy comment has energy 0."""
    rows = spark.readStream.format("text").option("lineSep", blank).load(folder)
    number = lambda p: F.expr(f"try_cast(nullif(regexp_extract(value, '{p}', 1), '') as int)")
    n = F.coalesce(number(r"(?im)^num peaks:\\s*(\\d+)"), F.lit(0))
    body = F.regexp_extract("value", r"(?is)(?:^|\n)num peaks:[^\n]*\n(.*)$", 1)
    tokens = F.slice(F.filter(F.split(body, r"[;:\n]"), lambda t: F.length(t) >= 2), 1, F.greatest(n, F.lit(1)))
    one = rows.where(n > 0).select(F.regexp_extract("value", r"(?im)^id:\s*(\S+)", 1).alias("spectrum_id"), F.coalesce(number(r"(?m)^Comment: Energy(\\d+)"), F.lit(0)).alias("energy"), F.explode(tokens).alias("t"))
    pair = F.split(F.trim("t"), r"\s+")
    return one.select("spectrum_id", "energy", pair[0].cast("double").alias("mass"), pair[1].cast("double").alias("intensity"))


def ingest(spark: SparkSession, folder: str, out: str, progress: str) -> None:
    """Append everything that is new in ``folder`` to the Parquet table ``out``, exactly once."""
    query = record_stream(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
