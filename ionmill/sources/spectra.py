"""Readers S1-S8: peak lists, spectrum libraries and molecule lists, as DataFrames with fixed schemas. Text is split, exploded and parsed by built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"(\d+(?:\.\d*)?)"


def peak_list(spark: SparkSession, path: str, source: str = "measured") -> DataFrame:
    """spectrum_id (file name), energy, source, mass, intensity.

    Reading stops at the first line shorter than two characters; # lines are skipped; a line that starts with low, med, high or energy begins the
    next spectrum; only lines of two plain numbers are peaks.
    """
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1), r"\.[^.]*$", "")
    return peak_sections(spark.read.text(path, wholetext=True).select(name.alias("spectrum_id"), "value"), source)


def peak_sections(files: DataFrame, source: str = "measured") -> DataFrame:
    """S1 of texts that are there already: (spectrum_id, value)."""
    lines = files.select("spectrum_id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    file = Window.partitionBy("spectrum_id")
    end = F.min(F.when(F.length("line") < 2, F.col("pos"))).over(file)
    head = F.col("line").rlike("^(low|med|high|energy)")
    kept = lines.withColumn("end", end).where("(end is null or pos < end) and line not like '#%'").withColumn("head", head)
    run = F.sum(F.col("head").cast("int")).over(file.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    marked = kept.withColumn("energy", F.greatest(run - 1, F.lit(0)).cast("int")).where("not head")
    got = marked.select("spectrum_id", "energy", F.lit(source).alias("source"), F.regexp_extract("line", rf"^\s*{NUMBER}\s+{NUMBER}\s*$", 1).alias("m"), F.regexp_extract("line", rf"^\s*{NUMBER}\s+{NUMBER}\s*$", 2).alias("i"))
    return got.where("m <> ''").select("spectrum_id", "energy", "source", F.col("m").cast("double").alias("mass"), F.col("i").cast("double").alias("intensity"))


def msp(spark: SparkSession, path: str, prefix: str = "", blank: str = "\n\n") -> DataFrame:
    """spectrum_id, energy, mass, intensity of a library of records between blank lines.

    Records are the rows of the read, so a large library is split over tasks. A record without an energy comment has the energy of the record before;
    only these narrow headers are ordered. A record with peaks and no id is an error. Equal (id, energy) records add their peaks.
    """
    rows = spark.read.text(path, lineSep=blank).withColumn("record", F.monotonically_increasing_id()).withColumn("file", F.input_file_name())
    text = F.regexp_replace("value", "\r", "")
    rows = rows.withColumn("value", text).where(F.length(F.trim("value")) > 2)
    parsed = rows.select(
        "file", "record", F.regexp_extract("value", r"(?im)^id:\s*(\S+)", 1).alias("id"), F.expr("try_cast(nullif(regexp_extract(value, '(?m)^Comment: Energy(\\\\d+)', 1), '') as int)").alias("own"),
        F.expr("try_cast(nullif(regexp_extract(value, '(?im)^num peaks:\\\\s*(\\\\d+)', 1), '') as int)").alias("n"), F.regexp_extract("value", r"(?is)(?:^|\n)num peaks:[^\n]*\n(.*)$", 1).alias("body"),
    ).where("n is not null")
    energy = F.coalesce(F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    heads = parsed.select("record", energy.alias("energy"))
    checked = F.when(F.col("id") == "", F.raise_error(F.concat(F.lit("a record has no ID: "), F.col("body")))).otherwise(F.concat(F.lit(prefix), F.col("id")))
    tokens = F.slice(F.filter(F.split("body", r"[;:\n]"), lambda t: F.length(t) >= 2), 1, F.greatest("n", F.lit(1)))
    one = parsed.where("n > 0").join(heads, "record").select(checked.alias("spectrum_id"), "energy", F.explode(tokens).alias("t"))
    pair = F.split(F.trim("t"), r"\s+")
    return one.select("spectrum_id", "energy", pair[0].cast("double").alias("mass"), pair[1].cast("double").alias("intensity"))


def fetch(library: DataFrame, ids: DataFrame, key: str = "spectrum_id") -> tuple[DataFrame, DataFrame]:
    """S3: (peaks of the wanted ids, ids that are missing)."""
    return library.join(ids.select(key).distinct(), key, "left_semi"), ids.select(key).distinct().join(library.select(key).distinct(), key, "left_anti")


def _words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length("value") >= 3).select(F.split(F.trim("value"), r"\s+").alias("w"))


def training_list(spark: SparkSession, path: str) -> DataFrame:
    """mol_id, structure, cv_group; the count line has one word and drops out."""
    return _words(spark, path).where(F.size("w") >= 3).select(F.col("w")[0].alias("mol_id"), F.col("w")[1].alias("structure"), F.col("w")[2].cast("int").alias("cv_group"))


def predict_list(spark: SparkSession, path: str) -> DataFrame:
    """cand_id, structure."""
    return _words(spark, path).where(F.size("w") >= 2).select(F.col("w")[0].alias("cand_id"), F.col("w")[1].alias("structure"))


def precomputed_list(spark: SparkSession, path: str) -> DataFrame:
    """cand_id, structure, spectrum_ref; libraries named many times are joined once each."""
    return _words(spark, path).where(F.size("w") >= 3).select(F.col("w")[0].alias("cand_id"), F.col("w")[1].alias("structure"), F.col("w")[2].alias("spectrum_ref"))


def candidate_spectra(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """The peaks of each candidate whose spectrum_ref is ``library:record``; library: lib, spectrum_id, energy, mass, intensity. An equi join, so each library is read once."""
    named = candidates.select("cand_id", "structure", F.substring_index("spectrum_ref", ":", 1).alias("lib"), F.substring_index("spectrum_ref", ":", -1).alias("_record"))
    return named.join(library, (named["lib"] == library["lib"]) & (named["_record"] == library["spectrum_id"].cast("string"))).select("cand_id", "structure", named["lib"], "spectrum_id", "energy", "mass", "intensity")
