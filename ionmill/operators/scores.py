"""Similarity scores A1-A12 and their reports A13, A14, A21, A22, over matched peaks and per-side totals.

Each side's totals are one aggregation, the match one join; every score is an expression over the joined row, so asking for all costs
what asking for one costs. New scores register in SCORES (E1).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import adjusted_intensity
from .matching import match
from .spectrum import normalize


def _ratio(top: Column, below: Column) -> Column:
    return F.when(below > 0, top / below).otherwise(F.lit(0.0))


c = F.col
#: Score by name, over the columns of pair_table().
SCORES: dict[str, Callable[[], Column]] = {
    "dot_product": lambda: _ratio(c("aa") * c("aa"), c("app") * c("aqq")),
    "stein_dot_product": lambda: _ratio(c("ss") * c("ss"), c("spp") * c("sqq")),
    "precision": lambda: _ratio(100.0 * c("k"), c("n_q")),
    "recall": lambda: _ratio(100.0 * c("k"), c("n_p")),
    "weighted_recall": lambda: _ratio(100.0 * c("ip"), c("sum_p")),
    "weighted_precision": lambda: _ratio(100.0 * c("iq"), c("sum_q")),
    "weighted_jaccard": lambda: _ratio(c("least"), 200.0 - c("least")),
    "jaccard": lambda: _ratio(c("k").cast("double"), c("n_p") + c("n_q") - c("k")),
    "weighted_dice": lambda: 2.0 * c("least") / 200.0,
    "dice": lambda: _ratio(2.0 * c("k"), c("n_p") + c("n_q")),
    "combined": lambda: 100.0 * SCORES["dot_product"]() + 100.0 * SCORES["dice"]() + SCORES["weighted_precision"]() + SCORES["weighted_recall"](),
}
METRIC_TUPLE = ("dice", "dot_product", "precision", "recall")  # A12


def _side(peaks: DataFrame, on: Sequence[str], tag: str) -> DataFrame:
    a, s = adjusted_intensity(c("intensity"), c("mass")), adjusted_intensity(c("intensity"), c("mass"), stein=True)
    return peaks.groupBy(*on).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.sum("intensity").alias(f"sum_{tag}"), F.sum(a * a).alias(f"a{tag}{tag}"), F.sum(s * s).alias(f"s{tag}{tag}"))


def pair_table(p: DataFrame, q: DataFrame, on: Sequence[str], ppm: float = 10.0, abs_tol: float = 0.01) -> DataFrame:
    """One row per spectrum with peaks on both sides: counts, totals, and sums over the matched pairs. p and q are normalised."""
    m = match(p, q, on, ppm, abs_tol)
    a = adjusted_intensity(c("intensity"), c("mass")) * adjusted_intensity(c("intensity2"), c("mass2"))
    s = adjusted_intensity(c("intensity"), c("mass"), True) * adjusted_intensity(c("intensity2"), c("mass2"), True)
    pairs = m.groupBy(*on).agg(F.count(F.lit(1)).alias("k"), F.sum(a).alias("aa"), F.sum(s).alias("ss"), F.sum("intensity").alias("ip"), F.sum("intensity2").alias("iq"), F.sum(F.least("intensity", "intensity2")).alias("least"))
    return _side(p, on, "p").join(_side(q, on, "q"), list(on)).join(pairs, list(on), "left").fillna(0, ["k", "aa", "ss", "ip", "iq", "least"])


def score(p: DataFrame, q: DataFrame, on: Sequence[str], names: Sequence[str] = tuple(SCORES), ppm: float = 10.0, abs_tol: float = 0.01, places: int = 6) -> DataFrame:
    """A1-A11 per spectrum."""
    return pair_table(p, q, on, ppm, abs_tol).select(*on, "k", *(F.round(SCORES[n](), places).alias(n) for n in names))


def sides(peaks: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Normalised measured and predicted peaks of a table with a source column."""
    scaled = normalize(peaks, [*keys, "source"])
    return scaled.where("source = 'measured'").drop("source"), scaled.where("source = 'predicted'").drop("source")


def report(scores: DataFrame, names: Sequence[str], by: Sequence[str], places: int = 6) -> DataFrame:
    """Mean and population deviation."""
    cols = [f for n in names for f in (F.round(F.avg(n), places).alias(f"mean_{n}"), F.round(F.stddev_pop(n), places).alias(f"std_{n}"))]
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *cols)


def totals(scores: DataFrame, names: Sequence[str], key: str, energies: int = 3, places: int = 6) -> DataFrame:
    """A molecule's overall score is its sum over energies divided by how many energies there are."""
    return scores.groupBy(key).agg(*(F.round(F.sum(n) / energies, places).alias(n) for n in names))
