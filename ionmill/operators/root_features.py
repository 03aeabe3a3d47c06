"""Features of the atoms around the two roots of a break: paths (F10, F11, F20, F21) and breadth-first fingerprints.

A row has both sides of a break as structures of the molecule kernel's subset with the number of the root atom: ion, ion_root, nl, nl_root, and ring_break. Every name comes
for the ion and for the neutral loss (``Ion...``, ``NL...``). The fingerprints order the atoms breadth first from the root; neighbours come by
their own symbol and the symbols of what hangs below them. Bond classes: 1 to 3 the order, 4 aromatic, 5 conjugated.
``GeneralizedMatrixFP`` counts (at least 1, 2, 3) the pairs of bond class and symbol at the root and flags them farther out.

A null or unreadable structure, or a root that it does not have, gives only the bias and a status. Repeated rows are alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..functions import MORE_SYMBOLS, SYMBOLS
from .chemistry import Molecule, parse

#: Symbols in index order, the last one for all others.
FEW, MORE = (*SYMBOLS, "X"), (*MORE_SYMBOLS, "X")
BOND_BITS, DEGREES, BOND_CLASSES = 6, 5, 7


def _folded(symbol: str, known: tuple[str, ...] = FEW) -> str:
    return symbol if symbol in known else "X"


class Rooted:
    """A molecule seen from one of its atoms."""

    def __init__(self, mol: Molecule, root: int):
        if not 0 <= root < len(mol.symbols):
            raise ValueError(f"no atom {root}")
        self.mol, self.root, self.near = mol, root, mol.neighbours()
        self.kind = [self._class(k) for k in range(len(mol.bonds))]
        self.distance = {root: 0}
        front = [root]
        while front:
            step = []
            for a in front:
                for b, _ in self.near[a]:
                    if b not in self.distance:
                        self.distance[b] = self.distance[a] + 1
                        step.append(b)
            front = step

    def _class(self, k: int) -> int:
        """X14, with a bond conjugated when it is a single bond from an atom with a double or triple bond to another such atom or to N, O, S, or that multiple bond."""
        a, b, order = self.mol.bonds[k]
        if order == 1.5:
            return 4
        multiple = lambda x, but: any(self.mol.bonds[e][2] > 1 and e != but for _, e in self.near[x])
        open_to = lambda x, but: multiple(x, but) or self.mol.symbols[x] in ("N", "O", "S")
        if order == 1:
            return 5 if multiple(a, k) and open_to(b, k) or multiple(b, k) and open_to(a, k) else 1
        beside = any(self.mol.bonds[e][2] == 1 and open_to(y, e) for x in (a, b) for y, e in self.near[x] if e != k)
        return 5 if beside else int(order)

    def paths(self, length: int) -> list[tuple[str, ...]]:
        """Symbols along walks of ``length`` atoms from the root that do not turn back at once."""
        found = [((_folded(self.mol.symbols[self.root]),), self.root, self.root)]
        for _ in range(length - 1):
            found = [((*p, _folded(self.mol.symbols[b])), b, a) for p, a, before in found for b, _ in self.near[a] if b != before]
        return [p for p, _, _ in found]

    def order(self, most: int, depth: int) -> list[int]:
        """Atoms breadth first, at most ``most`` of them and nearer than ``depth``."""
        key = lambda x: ("1" if self.distance[x] else "") + _folded(self.mol.symbols[x]).ljust(2)
        label = {x: key(x) + "".join(f"[{k}]" for k in sorted(key(b) for b, _ in self.near[x] if self.distance[b] > d)) for x, d in self.distance.items()}
        out, queue = [], [self.root]
        for at in queue:  # grows
            if at in out:
                continue
            if len(out) >= most or self.distance[at] >= depth:
                break
            out.append(at)
            queue += sorted((b for b, _ in self.near[at]), key=label.__getitem__)
        return out


def root_paths(side: Rooted, ring_break: bool, length: int) -> list[int]:
    """a flag for no paths; then per path seen, seen again, and both again for ring breaks."""
    counts = Counter(side.paths(length))
    if not counts:
        return [0]
    out = []
    for path, n in counts.items():
        place = 0
        for symbol in path:
            place = place * len(FEW) + FEW.index(symbol)
        first = 1 + 4 * place + 2 * ring_break
        out += [first, first + 1] if n > 1 else [first]
    return sorted(out)


def matrix(side: Rooted, atoms: int, depth: int, bonds: bool, symbols: tuple[str, ...]) -> list[int]:
    """Bond classes of each pair of ordered atoms, then symbols, then degrees."""
    order = side.order(atoms, depth)
    place, out, at = {a: k for k, a in enumerate(order)}, [], 0
    if bonds:
        kinds = {}
        for k, (a, b, _) in enumerate(side.mol.bonds):
            if a in place and b in place:
                kinds[min(place[a], place[b]), max(place[a], place[b])] = side.kind[k]
        for i in range(atoms):
            for j in range(i + 1, atoms):
                if (i, j) in kinds:
                    out.append(at + min(kinds[i, j], BOND_BITS - 1))
                at += BOND_BITS
    out += [at + k * len(symbols) + symbols.index(_folded(side.mol.symbols[a], symbols)) for k, a in enumerate(order)]
    at += atoms * len(symbols)
    return out + [at + k * DEGREES + min(len(side.near[a]), DEGREES - 1) for k, a in enumerate(order)]


def generalized(side: Rooted, depth: int) -> list[int]:
    """F55-F58."""
    keys = {(c, s): k for k, (c, s) in enumerate((c, s) for c in range(1, BOND_CLASSES + 1) for s in FEW)}
    seen: Counter = Counter()
    for a, d in side.distance.items():
        if d < depth:
            for b, e in side.near[a]:
                seen[d, keys[side.kind[e], _folded(side.mol.symbols[b])]] += 1
    out = [3 * k + n for (d, k), count in seen.items() if d == 0 for n in range(min(count, 3))]
    return sorted(out + [3 * len(keys) + (d - 1) * len(keys) + k for d, k in seen if d])


def _matrix(atoms: int, depth: int, bonds: bool = True, symbols: tuple[str, ...] = FEW) -> tuple[int, Callable]:
    size = bonds * BOND_BITS * atoms * (atoms - 1) // 2 + atoms * (len(symbols) + DEGREES)
    return size, lambda side, ring_break: matrix(side, atoms, depth, bonds, symbols)


def _generalized(depth: int) -> tuple[int, Callable]:
    return (depth + 2) * BOND_CLASSES * len(FEW), lambda side, ring_break: generalized(side, depth)


def _paths(length: int) -> tuple[int, Callable]:
    return 1 + 4 * len(FEW) ** length, lambda side, ring_break: root_paths(side, ring_break, length)


_KINDS: dict[str, tuple[int, Callable]] = {
    "RootPairs": _paths(2), "RootTriples": _paths(3),
    "RootMatrixFPN6": _matrix(6, 6), "RootMatrixFPN6D2": _matrix(6, 2), "RootMatrixFPN8": _matrix(8, 8), "RootMatrixFPN8D3": _matrix(8, 3), "RootMatrixFPN10": _matrix(10, 10), "RootMatrixFPN16": _matrix(16, 16),
    "RootMatrixSimpleFPN8D3": _matrix(8, 3, False), "RootMatrixSimpleFPN10": _matrix(10, 10, False), "RootMatrixSimpleFPN16": _matrix(16, 16, False), "RootMatrixSimpleFPN32": _matrix(32, 32, False),
    "RootMatrixFPN10MoreSymbols": _matrix(10, 10, True, MORE), "RootMatrixFPN16MoreSymbols": _matrix(16, 16, True, MORE),
    "RootGeneralizedMatrixFPN8": _generalized(8), "RootGeneralizedMatrixFPN10": _generalized(10),
}
#: Name: (size, builder of the set indexes from a Rooted side and whether the break is a ring break).
FEATURES: dict[str, tuple[int, Callable]] = {side + name: v for name, v in _KINDS.items() for side in ("Ion", "NL")}


def vector(ion: str, ion_root: int, nl: str, nl_root: int, ring_break: bool, names: list[str]) -> list[int]:
    """Sorted set indexes, bias 0 first, of the named features one after the other."""
    sides = {"Ion": Rooted(parse(ion), ion_root), "NL": Rooted(parse(nl), nl_root)}
    out, at = [0], 1
    for name in names:
        size, build = FEATURES[name]
        out += [at + k for k in build(sides["Ion" if name.startswith("Ion") else "NL"], ring_break)]
        at += size
    return out


def root_features(breaks: DataFrame, names: list[str]) -> DataFrame:
    """id, features, feature_len, status of (id, ion, ion_root, nl, nl_root, ring_break) rows."""
    length = 1 + sum(FEATURES[n][0] for n in names)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got, status, held = [], [], {}  # equal breaks of a batch are described once
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                if row not in held:
                    try:
                        if None in row:
                            raise ValueError("a part of the break is null")
                        held[row] = vector(*row, names), "ok"
                    except ValueError as e:
                        held[row] = [0], str(e)
                got.append(held[row][0])
                status.append(held[row][1])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32())), pa.array([length] * n, pa.int32()), pa.array(status, pa.string())], ["id", "features", "feature_len", "status"])

    return breaks.selectExpr("cast(id as long) id", "ion", "cast(ion_root as int) ion_root", "nl", "cast(nl_root as int) nl_root", "ring_break").mapInArrow(run, "id long, features array<int>, feature_len int, status string")
