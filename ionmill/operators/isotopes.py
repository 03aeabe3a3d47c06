"""Isotope patterns of formulas by convolution of element patterns, powers by doubling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..functions import ELECTRON

#: Isotopes (mass, abundance) of the elements of organic molecules.
ISOTOPES: dict[str, list[tuple[float, float]]] = {
    "H": [(1.00782503207, 0.999885), (2.0141017778, 0.000115)], "C": [(12.0, 0.9893), (13.0033548378, 0.0107)], "N": [(14.0030740048, 0.99636), (15.0001088982, 0.00364)],
    "O": [(15.99491461956, 0.99757), (16.9991317, 0.00038), (17.999161, 0.00205)], "F": [(18.99840322, 1.0)], "Na": [(22.9897692809, 1.0)], "Si": [(27.9769265325, 0.92223), (28.9764947, 0.04685), (29.97377017, 0.03092)],
    "P": [(30.97376163, 1.0)], "S": [(31.972071, 0.9499), (32.97145876, 0.0075), (33.9678669, 0.0425), (35.96708076, 0.0001)], "Cl": [(34.96885268, 0.7576), (36.96590259, 0.2424)],
    "K": [(38.96370668, 0.932581), (39.96399848, 0.000117), (40.96182576, 0.067302)], "Se": [(73.9224764, 0.0089), (75.9192136, 0.0937), (76.919914, 0.0763), (77.9173091, 0.2377), (79.9165213, 0.4961), (81.9166994, 0.0873)],
    "Br": [(78.9183371, 0.5069), (80.9162906, 0.4931)], "I": [(126.904473, 1.0)],
}
Pattern = dict[int, tuple[float, float]]


def element_mass(symbol: str) -> float:
    """Mass of the most common isotope."""
    return max(ISOTOPES[symbol], key=lambda x: x[1])[0]


def formula(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for symbol, n in re.findall(r"([A-Z][a-z]?)(\d*)", text):
        out[symbol] = out.get(symbol, 0) + int(n or 1)
    return out


def convolve(a: Pattern, b: Pattern, floor: float = 1e-12) -> Pattern:
    """Patterns by nominal mass: shares multiply, masses are weighed by them."""
    out: dict[int, list[float]] = {}
    for i, (ma, sa) in a.items():
        for j, (mb, sb) in b.items():
            cell = out.setdefault(i + j, [0.0, 0.0])
            cell[0] += sa * sb * (ma + mb)
            cell[1] += sa * sb
    return {k: (m / s, s) for k, (m, s) in out.items() if s > floor}


def power(p: Pattern, n: int) -> Pattern:
    out: Pattern = {0: (0.0, 1.0)}
    while n:
        if n & 1:
            out = convolve(out, p)
        p, n = convolve(p, p), n >> 1
    return out


def pattern(text: str, threshold: float = 1.0, charge: int = 0) -> list[tuple[float, float]]:
    """(mass, intensity) of peaks of at least ``threshold`` percent of the largest, summing to 100; an ion loses or gains an electron's mass."""
    total: Pattern = {0: (0.0, 1.0)}
    for symbol, n in sorted(formula(text).items()):
        total = convolve(total, power({round(m): (m, s) for m, s in ISOTOPES[symbol]}, n))
    top = max(s for _, s in total.values())
    kept = [(m - charge * ELECTRON, s) for _, (m, s) in sorted(total.items()) if s * 100 / top >= threshold]
    whole = sum(s for _, s in kept)
    return [(m, 100 * s / whole) for m, s in kept]


def mass(text: str, charge: int = 0) -> float:
    """X9."""
    return sum(n * element_mass(s) for s, n in formula(text).items()) - charge * ELECTRON


def isotope_peaks(formulas: DataFrame, key: str, threshold: float = 1.0, charge: int = 1) -> DataFrame:
    """key, mass, intensity of (key, formula) rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [pattern(f, threshold, charge) for f in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(got)), [len(g) for g in got])
            flat = [p for g in got for p in g]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([m for m, _ in flat], pa.float64()), pa.array([i for _, i in flat], pa.float64())], [key, "mass", "intensity"])

    return formulas.select(key, "formula").mapInArrow(run, f"{key} {formulas.schema[key].dataType.simpleString()}, mass double, intensity double")
