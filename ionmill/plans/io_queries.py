"""Registered queries of readers, writers, isotopes, the molecule kernel and break features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chemistry, features, isotopes, matching, scores
from ..sources import sinks, spectra
from . import views
from .queries import QUERIES, ROW, SIDE, TOL, register, rounded, with_


def _formulas(spark: SparkSession, d: str) -> DataFrame:
    part = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    s = F.col("p_size")
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(part("C", 1 + s % 20), part("H", 2 + s % 30), part("O", 1 + s % 5)).alias("formula"))


@register("isotope_pattern")
def isotope_pattern(spark: SparkSession, d: str) -> DataFrame:
    return rounded(isotopes.isotope_peaks(_formulas(spark, d), "id"), "mass", "intensity")


@register("molecule_fragments")
def molecule_fragments(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*[F.lit(s) for s in ("CC(=O)O", "c1cncnc1", "CCN", "CC(C)O", "C1CCCCC1O", "NCC(=O)O", "CCOC(C)=O")])
    mols = views.table(spark, d, "part").select(F.col("p_partkey").alias("mol_id"), known[F.col("p_size") % 7].alias("structure"))
    return rounded(chemistry.fragment_table(mols, depth=2), "mass")


def _breaks(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    symbol = F.array(*[F.lit(x) for x in ("C", "N", "O", "P", "S", "Zn")])
    bit = lambda k: (s % k == 0)
    return views.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), symbol[s % 6].alias("ion_root"), symbol[(s + 1) % 6].alias("nl_root"), bit(2).alias("ring_break"), (1 + s % 3).alias("bond"), bit(5).alias("aromatic"), bit(7).alias("conjugated"),
        bit(11).alias("ionic"), bit(13).alias("h_only"), F.array(1 + s % 2, F.lit(1)).alias("ion_bonds"), F.array(1 + s % 5).alias("nl_bonds"), ((s % 12) - 6 + 0.2).alias("h_shift_ion"), ((s % 10) - 5.0).alias("h_shift_nl"),
        bit(3).alias("ion_radical"), bit(4).alias("nl_radical"), bit(6).alias("ion_in_ring"), bit(8).alias("nl_in_ring"), bit(9).alias("ion_plus"), bit(10).alias("ion_minus"), bit(12).alias("nl_plus"), bit(14).alias("nl_minus"), F.array(1 + s % 7, 1 + s % 3).alias("history"),
    )


@register("break_features")
def break_features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_vector(_breaks(spark, d), list(features.FEATURES)).select("id", "features", "feature_len")


@register("break_atom_pair", "SELECT p_partkey AS id, list_concat([0], CASE WHEN p_size % 2 = 0 THEN [(p_size % 6) * 6 + (p_size + 1) % 6 + 1, 37] ELSE [(p_size % 6) * 6 + (p_size + 1) % 6 + 1] END) AS features, 38 AS feature_len FROM part")
def break_atom_pair(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_vector(_breaks(spark, d), ["BreakAtomPair"]).select("id", "features", "feature_len")


@register("matched_scatter")
def matched_scatter(spark: SparkSession, d: str) -> DataFrame:
    return sinks.scatter_text(matching.match(*scores.sides(views.peaks(spark, d), SIDE), SIDE, 0.0, TOL))


@register("ranked_text")
def ranked_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ranked_text(QUERIES["rank_candidates"](spark, d))


@register("library_fetch", with_("peaks") + f"SELECT {ROW}, intensity FROM peaks SEMI JOIN orders ON o_orderkey = spectrum_id AND o_orderpriority = '1-URGENT'")
def library_fetch(spark: SparkSession, d: str) -> DataFrame:
    wanted = views.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("spectrum_id"))
    return spectra.fetch(views.peaks(spark, d), wanted)[0]

