"""Column functions of the mass-spectrometry model (X1-X16, K1). All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Masses in Da.
PROTON, ELECTRON = 1.007276, 0.000548579909
SCALER = 10_000


def mass_tolerance(mass: Column, ppm: float, abs_tol: float) -> Column:
    """X1."""
    return F.greatest(mass / F.lit(1e6) * F.lit(float(ppm)), F.lit(float(abs_tol)))


def fixed_point(mass: Column, scale: float = SCALER) -> Column:
    """Half-up fixed-point key; the same in every engine, which decimal rounding is not."""
    return F.floor(mass * F.lit(float(scale)) + F.lit(0.5)).cast("long")


def rounded_mass(mass: Column, scale: float = SCALER) -> Column:
    return fixed_point(mass, scale) / F.lit(float(scale))


def log_sum_exp_over(x: Column, window: WindowSpec) -> Column:
    """Log of the sum of exponentials over a window, shifted by the maximum."""
    top = F.max(x).over(window)
    return top + F.log(F.sum(F.exp(x - top)).over(window))


def softmax_over(x: Column, window: WindowSpec) -> Column:
    """X3."""
    return F.exp(x - log_sum_exp_over(x, window))


def log_sum_exp(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """X2 as an aggregation with map-side combination: one pass for the maxima, one for the sums."""
    top = df.groupBy(*keys).agg(F.max(x).alias("_top"))
    return df.join(top, keys).groupBy(*keys).agg((F.max("_top") + F.log(F.sum(F.exp(F.col(x) - F.col("_top"))))).alias(out))


def parent_ion_mass(neutral: Column, mode: Column) -> Column:
    """Modes positive, negative; else an electron is lost."""
    return F.when(mode == "positive", neutral + PROTON).when(mode == "negative", neutral - PROTON).otherwise(neutral - ELECTRON)


def adjusted_intensity(intensity: Column, mass: Column, stein: bool = False) -> Column:
    """X11."""
    return F.pow(intensity, F.lit(0.6)) * F.pow(mass, F.lit(3.0)) if stein else F.pow(intensity, F.lit(0.5)) * F.pow(mass, F.lit(0.5))


#: Symbols that features tell apart.
SYMBOLS = ("C", "N", "O", "P", "S")
MORE_SYMBOLS = ("Br", "C", "Cl", "F", "I", "N", "O", "P", "S", "Se", "Si")


def fold_symbol(symbol: Column, known: tuple[str, ...] = SYMBOLS) -> Column:
    """X12."""
    return F.when(symbol.isin(*known), symbol).otherwise("X")


def activation(x: Column, kind: str, node: Column | None = None) -> Column:
    """Linear, relu, leaky (0.01), alternating (negative ReLU at odd nodes)."""
    relu = F.greatest(x, F.lit(0.0))
    if kind == "linear":
        return x
    if kind == "relu":
        return relu
    if kind == "leaky":
        return F.when(x > 0, x).otherwise(x * 0.01)
    if kind == "alternating":
        return F.when(node % 2 == 1, F.least(x, F.lit(0.0))).otherwise(relu)
    raise ValueError(f"no activation {kind}")


def bond_class(order: Column, aromatic: Column, conjugated: Column) -> Column:
    """X14."""
    return F.when(aromatic, 4).when(conjugated, 5).otherwise(order)


def decayed_rate(rate: float, step: int, method: str = "none", decay: float = 0.1, k: float = 0.001, drop: float = 0.5, every: float = 10) -> float:
    """The next learning rate, from the last."""
    if method == "time":
        return rate / (1 + decay * (step - 1))
    if method == "exponential":
        return rate * math.exp(-k * step)
    if method == "step":
        return rate * drop ** math.floor(step / every)
    if method == "none":
        return rate
    raise ValueError(f"no decay {method}")


def sink_format(path: str) -> str:
    """X16."""
    for suffix in ("msp", "mgf", "txt", "log"):
        if path.endswith("." + suffix):
            return suffix
    return "folder"


def spectrum_window(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def display_intensity(intensity: Column, top: Column) -> Column:
    """K1: half-up to two places of a scale to 100."""
    return F.floor(intensity / top * 100 * 100 + F.lit(0.5)) / F.lit(100.0)
