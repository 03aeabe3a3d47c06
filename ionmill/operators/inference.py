"""Message passing over fragmentation graphs: I3-I12, P11, P12, A15, A20. Messages are rows (mol_id, frag_id, logp); a missing row is log zero.

A pass is unrolled over the model depth (2 or 3): every step is one equi join on (mol_id, node) and one log-sum-exp aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_sum_exp, mass_tolerance
from ..plans.lineage import cut
from .graph import log_probs, persistence
from .matching import annotate
from .spectrum import normalize, scale_annotations

NODE = ["mol_id", "frag_id"]


class Model:
    """Log-probabilities of moving and staying, cut from the plan that made them."""

    def __init__(self, transitions: DataFrame, fragments: DataFrame):
        self.edges = cut(log_probs(transitions).select("mol_id", "from_id", "to_id", F.col("logp").alias("move")))
        self.stay = cut(persistence(transitions, fragments).withColumnRenamed("logp", "stay").where("stay is not null"))
        self.fragments = fragments

    def root(self, root: int = 0) -> DataFrame:
        return self.stay.select("mol_id").distinct().select("mol_id", F.lit(root).cast("long").alias("frag_id"), F.lit(0.0).alias("logp"))

    def down(self, message: DataFrame) -> DataFrame:
        """One step away from the root."""
        stayed = message.join(self.stay, NODE).select(*NODE, (F.col("logp") + F.col("stay")).alias("logp"))
        moved = message.withColumnRenamed("frag_id", "from_id").join(self.edges, ["mol_id", "from_id"]).select("mol_id", F.col("to_id").alias("frag_id"), (F.col("logp") + F.col("move")).alias("logp"))
        return log_sum_exp(stayed.unionByName(moved), NODE, "logp", "logp")

    def up(self, message: DataFrame) -> DataFrame:
        """One step towards the root."""
        stayed = message.join(self.stay, NODE).select(*NODE, (F.col("logp") + F.col("stay")).alias("logp"))
        moved = message.withColumnRenamed("frag_id", "to_id").join(self.edges, ["mol_id", "to_id"]).select("mol_id", F.col("from_id").alias("frag_id"), (F.col("logp") + F.col("move")).alias("logp"))
        return log_sum_exp(stayed.unionByName(moved), NODE, "logp", "logp")

    def downs(self, depth: int) -> list[DataFrame]:
        """Messages at depths 0 to ``depth``."""
        out = [cut(self.root())]
        for _ in range(depth):
            out.append(cut(self.down(out[-1])))
        return out


def spectrum_message(down: DataFrame, peaks: DataFrame, fragments: DataFrame, ppm: float, abs_tol: float, uniform: bool = False) -> DataFrame:
    """What the peaks say about fragments. ``fragments`` has one row per mass; rows with iso_intensity are isotope peaks."""
    iso = F.log(0.01 * F.col("iso_intensity")) if "iso_intensity" in fragments.columns else F.lit(0.0)
    able = fragments.join(down.where("logp >= -1e4"), NODE).withColumn("logp", F.col("logp") + iso).select("mol_id", "frag_id", F.col("mass").alias("frag_mass"), "logp")
    near = annotate(peaks, able, ["mol_id"], ppm, abs_tol)
    sigma = mass_tolerance(F.col("mass"), ppm, abs_tol) * 0.33
    gap = F.abs(F.col("mass") - F.col("frag_mass"))
    square = F.lit(0.0) if uniform else gap * gap
    rows = near.withColumn("sigma", sigma).where(gap <= 3 * F.col("sigma")).withColumn("v", -0.5 * F.log(4 * math.pi * F.col("sigma") * F.col("sigma")) - square / (4 * F.col("sigma") * F.col("sigma")) + F.col("logp"))
    top = F.max("v").over(Window.partitionBy("mol_id", "mass"))
    total = top + F.log(F.sum(F.exp(F.col("v") - top)).over(Window.partitionBy("mol_id", "mass")))
    weighed = rows.select(*NODE, (F.col("v") - total + F.log(0.01 * F.col("intensity"))).alias("logp"))
    return log_sum_exp(weighed, NODE, "logp", "logp")


def normalise_message(message: DataFrame) -> DataFrame:
    """I11."""
    return message.join(log_sum_exp(message, ["mol_id"], "logp", "total"), "mol_id").select(*NODE, (F.col("logp") - F.col("total")).alias("logp"))


def corrected(spectrum: DataFrame, down: DataFrame) -> DataFrame:
    """I9."""
    return spectrum.join(down.withColumnRenamed("logp", "d"), NODE).select(*NODE, (F.col("logp") - F.col("d")).alias("logp"))


def beliefs(model: Model, downs: list[DataFrame], spectrum: DataFrame) -> DataFrame:
    """mol_id, depth, kind (move or stay), from_id, to_id, logp; normalised per depth."""
    depth = len(downs) - 1
    up = cut(corrected(spectrum, downs[-1]))
    parts = []
    for d in range(depth - 1, -1, -1):
        a = downs[d].select("mol_id", F.col("frag_id").alias("from_id"), F.col("logp").alias("down"))
        b = up.select("mol_id", F.col("frag_id").alias("to_id"), F.col("logp").alias("up"))
        move = a.join(model.edges, ["mol_id", "from_id"]).join(b, ["mol_id", "to_id"]).select("mol_id", "from_id", "to_id", F.lit("move").alias("kind"), (F.col("down") + F.col("move") + F.col("up")).alias("raw"))
        still = a.join(model.stay.withColumnRenamed("frag_id", "from_id"), ["mol_id", "from_id"]).withColumn("to_id", F.col("from_id")).join(b, ["mol_id", "to_id"]).select("mol_id", "from_id", "to_id", F.lit("stay").alias("kind"), (F.col("down") + F.col("stay") + F.col("up")).alias("raw"))
        parts.append(move.unionByName(still).withColumn("depth", F.lit(d)))
        if d:
            up = cut(model.up(up))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("mol_id", "depth")
    top = F.max("raw").over(w)
    return rows.withColumn("logp", F.col("raw") - top - F.log(F.sum(F.exp(F.col("raw") - top)).over(w))).drop("raw")


def concat_energies(found: list[DataFrame], depth: int) -> DataFrame:
    """Beliefs of several energies one after the other, depths offset."""
    out = found[0]
    for k, b in enumerate(found[1:], 1):
        out = out.unionByName(b.withColumn("depth", F.col("depth") + k * depth))
    return out


def sufficient_statistics(found: DataFrame) -> DataFrame:
    """Expected uses of each edge and stay. At depth 0 only the root has a message, so only its rows are there."""
    return found.groupBy("mol_id", "kind", "from_id", "to_id").agg(F.sum(F.exp("logp")).alias("nu"))


def fragment_evidence(found: DataFrame) -> DataFrame:
    """Log-belief that a fragment is reached at the last depth."""
    last = found.where(F.col("depth") == found.agg(F.max("depth")).first()[0])
    return log_sum_exp(last.select("mol_id", F.col("to_id").alias("frag_id"), "logp"), NODE, "logp", "logp")


def predicted_peaks(down: DataFrame, fragments: DataFrame) -> DataFrame:
    """Intensities from a final message, merged by exact mass; n_frags counts the annotations. With iso_intensity the isotope peaks share a fragment's probability."""
    share = 0.01 * F.col("iso_intensity") if "iso_intensity" in fragments.columns else F.lit(1.0)
    rows = down.join(fragments, NODE).groupBy("mol_id", "mass").agg(F.sum(F.exp("logp") * share).alias("intensity"), F.count(F.lit(1)).alias("n_frags"))
    return normalize(rows, ["mol_id"])


def peak_annotations(peaks: DataFrame, fragments: DataFrame, evidence: DataFrame, ppm: float, abs_tol: float) -> DataFrame:
    """mol_id, mass, intensity, frag_id, score."""
    able = fragments.join(evidence, NODE).select("mol_id", "frag_id", F.col("mass").alias("frag_mass"), F.exp("logp").alias("score"))
    return scale_annotations(annotate(peaks, able, ["mol_id"], ppm, abs_tol), ["mol_id", "mass"]).select("mol_id", "mass", "intensity", "frag_id", "score")
