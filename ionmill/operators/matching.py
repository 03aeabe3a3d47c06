"""Band joins J1, J4, X6 and one-to-one peak matching J2, J3, P13.

A band condition alone plans as a nested loop. Here each side gets a bucket of at least the widest tolerance: one side keeps its
bucket, the other is copied to the bucket and its neighbours, and the exact condition is the rest of an equi join. The widest
tolerance comes from the parameters and the largest mass, one aggregate, never from a collected column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mass_tolerance


def _width(side: DataFrame, mass: str, ppm: float, abs_tol: float) -> float:
    if not ppm:
        return float(abs_tol)
    top = side.agg(F.max(F.abs(mass))).first()[0] or 0.0
    return max(abs_tol, top / 1e6 * ppm * 1.01)


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_mass: str, right_mass: str, tolerance: Column, width: float, inclusive: bool = False, how: str = "inner") -> DataFrame:
    """Rows with abs(left_mass - right_mass) < tolerance (<= if inclusive) and equal ``on``. how: inner, left_semi or left_anti."""
    l = left.withColumn("_bucket", F.floor(F.col(left_mass) / width))
    r = right.withColumn("_near", F.floor(F.col(right_mass) / width)).withColumn("_bucket", F.explode(F.array(F.col("_near") - 1, F.col("_near"), F.col("_near") + 1))).drop("_near")
    gap = F.abs(F.col(left_mass) - F.col(right_mass))
    fits = gap <= tolerance if inclusive else gap < tolerance
    keys = [*on, "_bucket"]
    r = r.withColumnsRenamed({k: f"_{k}_r" for k in keys})
    equal = [F.col(k) == F.col(f"_{k}_r") for k in keys]
    if how == "inner":
        return l.join(r, [*equal, fits]).drop(*(f"_{k}_r" for k in keys), "_bucket")
    return l.join(r, [*equal, fits], how).drop("_bucket")


def candidate_pairs(p: DataFrame, q: DataFrame, on: Sequence[str], ppm: float, abs_tol: float) -> DataFrame:
    """Measured (mass, intensity) with predicted (mass2, intensity2) of the same spectrum within tolerance."""
    q = q.withColumnsRenamed({"mass": "mass2", "intensity": "intensity2"})
    tol = mass_tolerance(F.greatest("mass", "mass2"), ppm, abs_tol)
    width = max(_width(p, "mass", ppm, abs_tol), _width(q, "mass2", ppm, abs_tol))
    return band_join(p, q, on, "mass", "mass2", tol, width)


def best_chain(pairs: list[tuple[float, float, float, float]]) -> list[int]:
    """Indexes of the order-preserving one-to-one choice of greatest total 0.5 * (i1 + i2).

    Pairs are (mass, intensity, mass2, intensity2). Of equal totals the last pair has the lowest right mass, then the lowest left mass, and so on backwards.
    """
    if len(pairs) == 1:
        return [0]
    left = sorted({(p[0], p[1]) for p in pairs})
    right = sorted({(p[2], p[3]) for p in pairs})
    at = {p: k + 1 for k, p in enumerate(left)}
    to = {p: k + 1 for k, p in enumerate(right)}
    gain = {(at[p[0], p[1]], to[p[2], p[3]]): (0.5 * (p[1] + p[3]), k) for k, p in enumerate(pairs)}
    n, m = len(left), len(right)
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            v = max(best[i - 1, j], best[i, j - 1])
            if (i, j) in gain:
                v = max(v, best[i - 1, j - 1] + gain[i, j][0])
            best[i, j] = v
    chosen, i, j = [], n, m
    while i and j:
        if abs(best[i, j] - best[i, j - 1]) < 1e-12:
            j -= 1
        elif abs(best[i, j] - best[i - 1, j]) < 1e-12:
            i -= 1
        else:
            chosen.append(gain[i, j][1])
            i, j = i - 1, j - 1
    return chosen[::-1]


def match(p: DataFrame, q: DataFrame, on: Sequence[str], ppm: float = 10.0, abs_tol: float = 0.01) -> DataFrame:
    """On, mass, intensity, mass2, intensity2 of the matched peaks.

    Only spectra with a candidate pair reach the kernel, one row each with their candidates; a spectrum with one candidate needs none.
    """
    pairs = candidate_pairs(p.select(*on, "mass", "intensity"), q.select(*on, "mass", "intensity"), on, ppm, abs_tol)
    packed = pairs.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("mass", "intensity", "mass2", "intensity2"))).alias("_pairs"))
    kind = packed.schema["_pairs"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("_pairs")
            out = []
            for row in batch.column(at).to_pylist():
                chosen = best_chain([(r["mass"], r["intensity"], r["mass2"], r["intensity2"]) for r in row])
                out.append([row[k] for k in chosen])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != at), pa.array(out, batch.schema.field(at).type)], [*(n for n in batch.schema.names if n != "_pairs"), "_pairs"])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name != "_pairs")
    many = packed.where(F.size("_pairs") > 1).mapInArrow(run, f"{keys}, _pairs {kind}")
    every = packed.where(F.size("_pairs") == 1).unionByName(many)
    return every.select(*on, F.explode("_pairs").alias("m")).select(*on, "m.mass", "m.intensity", "m.mass2", "m.intensity2")


def match_outer(p: DataFrame, q: DataFrame, on: Sequence[str], ppm: float = 10.0, abs_tol: float = 0.01) -> DataFrame:
    """J2 and the unmatched peaks of either side, paired with nothing at their own mass. A mass that is matched counts as matched wherever it occurs."""
    both = match(p, q, on, ppm, abs_tol)
    left = p.select(*on, "mass", "intensity").join(both.select(*on, "mass").distinct(), [*on, "mass"], "left_anti").select(*on, "mass", "intensity", F.col("mass").alias("mass2"), F.lit(0.0).alias("intensity2"))
    right = q.select(*on, F.col("mass").alias("mass2"), F.col("intensity").alias("intensity2")).join(both.select(*on, "mass2").distinct(), [*on, "mass2"], "left_anti").select(*on, F.col("mass2").alias("mass"), F.lit(0.0).alias("intensity"), "mass2", "intensity2")
    return both.unionByName(left).unionByName(right)


def explained(peaks: DataFrame, fragments: DataFrame, on: Sequence[str], ppm: float, abs_tol: float, keep: bool = True) -> DataFrame:
    """Peaks with (or, keep = False, without) a fragment strictly within tolerance of their mass."""
    f = fragments.select(*on, F.col("mass").alias("frag_mass")).distinct()
    tol = mass_tolerance(F.col("mass"), ppm, abs_tol)
    return band_join(peaks, f, on, "mass", "frag_mass", tol, _width(peaks, "mass", ppm, abs_tol), how="left_semi" if keep else "left_anti")


def annotate(peaks: DataFrame, fragments: DataFrame, on: Sequence[str], ppm: float, abs_tol: float) -> DataFrame:
    """Every peak with every fragment (mass as frag_mass) within tolerance, bounds included."""
    tol = mass_tolerance(F.col("mass"), ppm, abs_tol)
    return band_join(peaks, fragments, on, "mass", "frag_mass", tol, _width(peaks, "mass", ppm, abs_tol), inclusive=True)


def selected_masses(outer: DataFrame, on: Sequence[str], difference: float = 0.1, most: int = 30) -> DataFrame:
    """The predicted masses with the largest intensity differences; a peak missing in the prediction counts 100 more. Equal differences collapse to the lowest mass."""
    gap = F.abs(F.col("intensity") - F.col("intensity2")) + F.when(F.col("intensity2") == 0, 100.0).otherwise(0.0)
    far = outer.select(*on, F.round(gap, 6).alias("difference"), F.floor(F.col("mass2") * 10000 + 0.5).cast("long").alias("fixed_mass")).where(F.col("difference") > difference)
    one = far.groupBy(*on, "difference").agg(F.min("fixed_mass").alias("fixed_mass"))
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("difference")))
    return one.withColumn("place", rank).where(F.col("place") <= most)
