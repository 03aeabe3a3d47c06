"""Break features as column expressions (E2): each builder gives the array of set indexes of one feature, offset by those before it.

A break row has: ion_root, nl_root (symbols), ring_break, bond (order), aromatic, conjugated, ionic, h_only, ion_bonds and nl_bonds (arrays of bond classes around the
roots), h_shift_ion, h_shift_nl (masses), ion_radical, nl_radical, ion_in_ring, nl_in_ring, ion_plus, ion_minus, nl_plus, nl_minus, history (array of earlier bond classes).
Features over fingerprints, functional groups, partial charges and force-field types (F4, F12-F19, F24-F27, F29-F64, F66, F67) need a chemistry toolkit and are not offered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SYMBOLS, bond_class, fold_symbol

#: Symbols of F7 and F8, in index order; then hydrogen and others.
ROOT_SYMBOLS = ("Br", "C", "Cl", "F", "I", "N", "O", "P", "S", "Se", "Si", "X")


def _place(symbol: Column, known: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in known]), symbol).cast("int") - 1


def _pair(c: dict[str, Column]) -> Column:
    known = (*SYMBOLS, "X")
    hot = _place(fold_symbol(c["ion_root"]), known) * 6 + _place(fold_symbol(c["nl_root"]), known)
    return F.when(c["ring_break"], F.array(hot, F.lit(36))).otherwise(F.array(hot))


def _bond(c: dict[str, Column]) -> Column:
    kind = F.when(c["ionic"], 6).when(c["h_only"], 7).otherwise(bond_class(c["bond"], c["aromatic"], c["conjugated"]))
    return F.array((kind - 1).cast("int"))


def _around(c: dict[str, Column]) -> Column:
    six = lambda x, start: F.transform(F.array_distinct(F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(0)))), lambda b: (b + start).cast("int"))
    return F.array_sort(F.concat(six(c["ion_bonds"], 0), six(c["nl_bonds"], 6)))


def _shift(x: Column) -> Column:
    near = F.round(x).cast("int")
    return F.array(F.when((F.abs(near) <= 4) & (F.abs(x - near) < 0.5), near + 4).otherwise(9))


def _root(symbol: Column) -> Column:
    return F.array(F.when(symbol == "H", 12).otherwise(_place(F.when(symbol.isin(*ROOT_SYMBOLS), symbol).otherwise("X"), ROOT_SYMBOLS)))


def _flags(*flags: Column, none: int | None = None) -> Column:
    hot = F.filter(F.array(*[F.when(f, k) for k, f in enumerate(flags)]), lambda x: x.isNotNull())
    return hot if none is None else F.when(F.size(hot) == 0, F.array(F.lit(none))).otherwise(hot)


def _history(c: dict[str, Column]) -> Column:
    counts = [F.aggregate(c["history"], F.lit(0), _counter(k)) for k in range(1, 8)]
    return F.filter(F.array(*[F.when(n > 0, (k * 6 + F.least(n, F.lit(6)) - 1).cast("int")) for k, n in enumerate(counts)]), lambda x: x.isNotNull())


def _counter(kind: int) -> Callable[[Column, Column], Column]:
    return lambda total, b: total + F.when(b == kind, 1).otherwise(0)


#: Name: (size, builder). F1-F3, F5-F9, F22, F23, F65.
FEATURES: dict[str, tuple[int, Callable[[dict[str, Column]], Column]]] = {
    "BreakAtomPair": (37, _pair), "BrokenOrigBondType": (7, _bond), "NeighbourOrigBondTypes": (12, _around),
    "HydrogenMovement": (10, lambda c: _shift(c["h_shift_ion"])), "HydrogenRemoval": (10, lambda c: _shift(c["h_shift_nl"])),
    "IonRootAtom": (13, lambda c: _root(c["ion_root"])), "NLRootAtom": (13, lambda c: _root(c["nl_root"])),
    "IonicFeatures": (5, lambda c: _flags(c["nl_plus"], c["nl_minus"], c["ion_plus"], c["ion_minus"], none=4)),
    "RadicalFeatures": (3, lambda c: _flags(c["ion_radical"], c["nl_radical"], none=2)),
    "ExtraRingFeatures": (3, lambda c: _flags(~c["ring_break"], c["ion_in_ring"], c["nl_in_ring"])),
    "BreakHistoryFeature": (42, _history),
}


def feature_vector(breaks: DataFrame, names: list[str], quadratic: bool = False) -> DataFrame:
    """Adds ``features`` (sorted set indexes, bias 0 first) and feature_len. quadratic (F28) adds all pairs without the bias."""
    c = {n: F.col(n) for n in breaks.columns}
    parts, at = [F.array(F.lit(0))], 1
    for name in names:
        size, build = FEATURES[name]
        start = at
        parts.append(F.transform(build(c), _offset(start)))
        at += size
    out = breaks.withColumn("features", F.concat(*parts))
    if quadratic:
        n = at
        own = F.filter("features", lambda x: x > 0)
        pairs = F.flatten(F.transform(own, lambda x, k: F.transform(F.slice(own, k + 2, F.size(own)), lambda y: (n + (y - 1) * (y - 2) / 2 + x - 1).cast("int"))))
        out, at = out.withColumn("features", F.concat("features", pairs)), n + (n - 1) * (n - 2) // 2
    return out.withColumn("feature_len", F.lit(at))


def _offset(start: int) -> Callable[[Column], Column]:
    return lambda x: (x + start).cast("int")
