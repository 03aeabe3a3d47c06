"""Spectrum operators P1-P11, K1, K2: windows and aggregations over peak tables.

``keys`` name a spectrum, e.g. (spectrum_id, energy, source). A spectrum's peaks meet in one window partition; spectra hold
hundreds of peaks, not millions, so partitions stay small however many spectra there are. Ties in intensity go to the lower mass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display_intensity, fixed_point, mass_tolerance


def normalize(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intensities of a spectrum sum to 100; a spectrum of no intensity stays."""
    total = F.sum("intensity").over(Window.partitionBy(*keys))
    return peaks.withColumn("intensity", F.when(total > 0, F.col("intensity") * 100 / total).otherwise(F.col("intensity")))


def quantize(peaks: DataFrame, keys: Sequence[str], places: int) -> DataFrame:
    """Masses to ``places`` decimals, equal ones merged, then P1."""
    scale = 10.0**places
    merged = peaks.groupBy(*keys, fixed_point(F.col("mass"), scale).alias("_key")).agg(F.sum("intensity").alias("intensity"))
    return normalize(merged.select(*keys, (F.col("_key") / scale).alias("mass"), "intensity"), keys)


def post_process(peaks: DataFrame, keys: Sequence[str], perc: float = 80.0, least: int = 1, most: int = 30, min_rel: float = 0.0, renormalize: bool = False) -> DataFrame:
    """P3 on normalised peaks: the intense peaks that make up ``perc`` of the energy. All tests are monotone along the order, so a row-wise filter keeps a prefix."""
    least = max(1, least)
    by = Window.partitionBy(*keys).orderBy(F.desc("intensity"), "mass")
    kept, total, top = F.row_number().over(by) - 1, F.sum("intensity").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.max("intensity").over(Window.partitionBy(*keys))
    stop = ((F.round(total, 9) > perc) & (kept > least)) | (kept > most) | (F.col("intensity") / top * 100 < min_rel)
    out = peaks.withColumn("_stop", stop).where("not _stop").drop("_stop")
    return normalize(out, keys) if renormalize else out


def clean(peaks: DataFrame, keys: Sequence[str], abs_tol: float = 0.01, ppm: float = 10.0, floor: float = 0.01) -> DataFrame:
    """Drops peaks next to a larger one within tolerance (of equal ones the later), and peaks below ``floor``."""
    by = Window.partitionBy(*keys).orderBy("mass", F.desc("intensity"))
    tol = mass_tolerance(F.col("mass"), ppm, abs_tol)
    before, after = F.lag("mass").over(by), F.lead("mass").over(by)
    left = (F.col("mass") - before < tol) & (F.lag("intensity").over(by) >= F.col("intensity"))
    right = (after - F.col("mass") < tol) & (F.lead("intensity").over(by) > F.col("intensity"))
    return peaks.withColumn("_drop", F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)) | (F.col("intensity") < floor)).where("not _drop").drop("_drop")


def scale_annotations(annotated: DataFrame, peak_keys: Sequence[str]) -> DataFrame:
    """P5 on flat rows (peak, intensity, frag_id, score): scores of a peak sum to its share of 100."""
    total = F.sum("score").over(Window.partitionBy(*peak_keys))
    return annotated.withColumn("score", F.col("score") * F.col("intensity") / (100 * total))


def log_scale(peaks: DataFrame, keys: Sequence[str], renormalize: bool = False) -> DataFrame:
    """P6."""
    top = F.max("intensity").over(Window.partitionBy(*keys))
    out = peaks.withColumn("intensity", F.log(F.greatest(F.col("intensity") / top * 100, F.lit(1.0))))
    return normalize(out, keys) if renormalize else out


def linear_scale(peaks: DataFrame, keys: Sequence[str], renormalize: bool = False) -> DataFrame:
    """P7; not the inverse of P6."""
    top = F.max("intensity").over(Window.partitionBy(*keys))
    out = peaks.withColumn("intensity", F.exp(F.col("intensity") / top / (F.lit(100.0) / F.log(F.lit(101.0)))) - 1)
    return normalize(out, keys) if renormalize else out


def max_intensity(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P8."""
    return peaks.groupBy(*keys).agg(F.greatest(F.max("intensity"), F.lit(0.0)).alias("max_intensity"))


def merge_energies(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P10: intensities of equal masses are added over energies, then P1. ``keys`` are without energy."""
    return normalize(peaks.groupBy(*keys, "mass").agg(F.sum("intensity").alias("intensity")), keys)


def displayed(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K1: the intensity that is printed; peaks that round to nothing go."""
    top = F.max("intensity").over(Window.partitionBy(*keys))
    return peaks.withColumn("shown", display_intensity(F.col("intensity"), top)).where("shown > 0")


def empty_energies(peaks: DataFrame, spectra: DataFrame, energies: Sequence[int], key: str) -> DataFrame:
    """(key, energy) of spectra without peaks; a missing energy is empty."""
    levels = F.explode(F.array(*[F.lit(e) for e in energies])).alias("energy")
    return spectra.select(key).distinct().select(key, levels).join(peaks.select(key, "energy").distinct(), [key, "energy"], "left_anti")


def distinct_masses(masses: DataFrame, keys: Sequence[str], gap: float = 1e-10) -> DataFrame:
    """Masses that lie more than ``gap`` above the one before, with the uniform height 100 / n."""
    by = Window.partitionBy(*keys).orderBy("mass")
    last = F.lag("mass").over(by)
    kept = masses.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("mass") - F.col("_last") > gap)).drop("_last")
    return kept.withColumn("height", F.lit(100.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
