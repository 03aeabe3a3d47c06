"""Candidate ranking O3-O6, J9-J11. A candidate's score is the sum over the target's energies; failures keep score 0 and their row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scores import SCORES, pair_table
from .spectrum import merge_energies, normalize, post_process


def against_target(target: DataFrame, candidates: DataFrame, energies: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The target's peaks once per candidate, and the candidates' peaks at the energies that the target has (O3's rule)."""
    if energies is not None:
        target = target.where(F.col("energy").isin(list(energies)))
    there = target.select("target_id", "energy").distinct()
    q = candidates.join(there, ["target_id", "energy"], "left_semi")
    who = q.select("target_id", "cand_id").distinct()
    return target.join(who, "target_id"), q


def rank(target: DataFrame, candidates: DataFrame, name: str = "dice", ppm: float = 10.0, abs_tol: float = 0.01, post: bool = False, merged: bool = False, top: int = 0) -> DataFrame:
    """target_id, cand_id, score, place. Ties go to the lower cand_id. top: keep so many per target."""
    everyone = candidates.select("target_id", "cand_id").distinct()
    if merged:
        target, candidates = (merge_energies(x, k).withColumn("energy", F.lit(0)) for x, k in ((target, ["target_id"]), (candidates, ["target_id", "cand_id"])))
    p = normalize(target, ["target_id", "energy"])
    q = normalize(candidates, ["target_id", "cand_id", "energy"])
    if post:
        q = post_process(q, ["target_id", "cand_id", "energy"])
    p, q = against_target(p, q)
    on = ["target_id", "cand_id", "energy"]
    got = pair_table(p, q, on, ppm, abs_tol).groupBy("target_id", "cand_id").agg(F.sum(SCORES[name]()).alias("score"))
    full = everyone.join(got, ["target_id", "cand_id"], "left").select("target_id", "cand_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    out = full.withColumn("place", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("score"), "cand_id")))
    return out.where(F.col("place") <= top) if top > 0 else out


def missing(measured: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """J9's report: ids that were measured and not predicted."""
    return measured.select(key).distinct().join(predicted.select(key).distinct(), key, "left_anti")
