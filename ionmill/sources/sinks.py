"""Writers K1-K10, K12-K15: text rows made by built-in functions, one per record, ready for df.write.text; graphs go to Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectrum import displayed

APP = "ionmill"


def _lines(peaks: DataFrame, keys: list[str], places: int) -> DataFrame:
    """K1: value: the peak lines of each spectrum, by mass; n_all counts peaks that are not shown, too."""
    shown = displayed(peaks, keys).select(*keys, "mass", F.format_string(f"%.{places}f %.2f", "mass", "shown").alias("line"))
    text = shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mass", "line"))), lambda p: p["line"]), "\n").alias("lines"))
    return peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all")).join(text, keys, "left").withColumn("lines", F.coalesce("lines", F.lit("")))


def peak_text(peaks: DataFrame, key: str = "spectrum_id", places: int = 5) -> DataFrame:
    """K5, K6: key, value: sections energyN with their peaks."""
    each = _lines(peaks, [key, "energy"], places)
    part = F.struct("energy", F.concat(F.lit("energy"), F.col("energy").cast("string"), F.lit("\n"), F.col("lines")).alias("text"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n").alias("value"))


def _sign(mode: str) -> str:
    return {"positive": "+ve in-silico MS/MS", "negative": "-ve in-silico MS/MS", "impact": "+ve in-silico MS"}[mode]


def msp_records(peaks: DataFrame, key: str = "spectrum_id", structure: Column | None = None, mode: str = "positive", places: int = 5) -> DataFrame:
    """One MSP record per (key, energy); Num peaks counts every peak."""
    each = _lines(peaks, [key, "energy"], places)
    name = F.col(key).cast("string")
    return each.select(key, "energy", F.concat(
        F.lit(f"Name: {_sign(mode)} by {APP} for "), name, F.lit("\nID: "), name, F.lit("\nSmiles/Inchi:"), structure if structure is not None else F.lit(""),
        F.lit("\nComment: Energy"), F.col("energy").cast("string"), F.lit("\nNum peaks: "), F.col("n_all").cast("string"), F.lit("\n"), F.col("lines"), F.lit("\n")).alias("value"))


def mgf_records(peaks: DataFrame, parent_mass: Column, key: str = "spectrum_id", mode: str = "positive", places: int = 5) -> DataFrame:
    """K4."""
    each = _lines(peaks, [key, "energy"], places)
    return each.select(key, "energy", F.concat(
        F.lit("BEGIN IONS\nPEPMASS="), F.format_string("%.6f", parent_mass), F.lit(f"\nCHARGE=1{'-' if mode == 'negative' else '+'}\nTITLE="), F.col(key).cast("string"),
        F.lit(";Energy"), F.col("energy").cast("string"), F.lit(f";{_sign(mode)} by {APP};\n"), F.col("lines"), F.lit("\nEND IONS")).alias("value"))


def enumeration_text(distinct: DataFrame, key: str = "mol_id", places: int = 5) -> DataFrame:
    """K7 from X8 rows (mass, height)."""
    row = F.struct("mass", F.format_string(f"%.{places}f %.2f", "mass", "height").alias("line"))
    return distinct.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda p: p["line"]), "\n").alias("value"))


def fragment_text(fragments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """K8: mol_id, frag_id, value; ``ids`` limits to displayed fragments (K2)."""
    rows = fragments if ids is None else fragments.join(ids, ["mol_id", "frag_id"], "left_semi")
    return rows.select("mol_id", "frag_id", F.format_string("%d %.5f %s", "frag_id", "mass", F.coalesce("ion_smiles", F.lit(""))).alias("value"))


def graph_text(fragments: DataFrame, transitions: DataFrame) -> DataFrame:
    """K9: fragments, then edges without duplicates; mol_id, part, place, value."""
    a = fragment_text(fragments).select("mol_id", F.lit(0).alias("part"), F.col("frag_id").cast("long").alias("place"), "value")
    own = transitions.where("not is_duplicate") if "is_duplicate" in transitions.columns else transitions
    b = own.select("mol_id", F.lit(1).alias("part"), (F.col("from_id") * 1_000_000 + F.col("to_id")).cast("long").alias("place"), F.format_string("%d %d %s", "from_id", "to_id", F.coalesce("nl_smiles", F.lit(""))).alias("value"))
    return a.unionByName(b)


def scatter_text(matched: DataFrame) -> DataFrame:
    """K12."""
    return matched.select(F.format_string("%.5f %.5f %.5f %.5f", "mass", "intensity", "mass2", "intensity2").alias("value"))


def ranked_text(ranked: DataFrame) -> DataFrame:
    """Place, score to eight digits, id."""
    return ranked.select("target_id", "place", F.format_string("%d %.8g %s", "place", "score", F.col("cand_id").cast("string")).alias("value"))


def report_text(scores: DataFrame, names: list[str], key: str = "spectrum_id") -> DataFrame:
    """One tab-separated row per spectrum."""
    return scores.select(key, "energy", F.concat_ws("\t", F.col(key).cast("string"), F.col("energy").cast("string"), *(F.format_string("%.6f", n) for n in names)).alias("value"))


def save_graph(fragments: DataFrame, transitions: DataFrame, path: str) -> None:
    """Parquet, both tables sorted by molecule so that a reader prunes row groups."""
    fragments.repartition("mol_id").sortWithinPartitions("mol_id", "frag_id").write.mode("overwrite").parquet(f"{path}/fragment")
    transitions.repartition("mol_id").sortWithinPartitions("mol_id", "from_id", "to_id").write.mode("overwrite").parquet(f"{path}/transition")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S13."""
    return spark.read.parquet(f"{path}/fragment"), spark.read.parquet(f"{path}/transition")
