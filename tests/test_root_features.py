"""Root features and skeletons of the molecule kernel: published values, hand-made cases, rows that cannot be read."""

import pytest

from ionmill.operators import chemistry, root_features


@pytest.mark.parametrize(("ion", "want"), [("C(N)(N)B", [0, 6, 7, 22]), ("B(B)N", [0, 126, 142]), ("C", [0, 1])])
def test_root_pairs(ion, want):
    assert root_features.vector(ion, 0, "C", 0, False, ["IonRootPairs"]) == want
    assert root_features.vector("C", 0, ion, 0, False, ["NLRootPairs"]) == want


def test_ring_breaks_have_their_own_flags():
    assert root_features.vector("CN", 0, "C", 0, True, ["IonRootPairs"]) == [0, 8]


def test_sizes():
    sizes = {k.removeprefix("Ion"): v[0] for k, v in root_features.FEATURES.items() if k.startswith("Ion")}
    assert sizes["RootTriples"] == 865 and sizes["RootMatrixFPN16"] == 896 and sizes["RootMatrixSimpleFPN32"] == 352 and sizes["RootMatrixFPN16MoreSymbols"] == 992 and sizes["RootGeneralizedMatrixFPN10"] == 504
    for name, (size, _) in root_features.FEATURES.items():
        got = root_features.vector("CC(=O)Oc1ccccc1C(=O)NC2CCCCC2Br", 8, "CC(C)(C)C", 1, False, [name])
        assert got == sorted(set(got)) and got[-1] <= size


def test_bond_classes():
    side = lambda s: root_features.Rooted(chemistry.parse(s), 0).kind
    assert side("CC=C") == [1, 2] and side("C=CC=C") == [5, 5, 5] and side("CC(=O)O") == [1, 5, 5] and side("c1ccccc1") == [4] * 6 and side("C#N") == [3]


def test_rows_that_cannot_be_read(spark):
    rows = [(1, "CN", 0, "C", 0, False), (2, None, 0, "C", 0, False), (3, "C)", 0, "C", 0, True), (4, "CN", 5, "C", 0, True), (None, "CN", 0, "C", 0, False)]
    got = root_features.root_features(spark.createDataFrame(rows, "id long, ion string, ion_root int, nl string, nl_root int, ring_break boolean"), ["IonRootPairs"]).collect()
    assert {r.id: (r.features, r.status == "ok") for r in got} == {1: ([0, 6], True), 2: ([0], False), 3: ([0], False), 4: ([0], False), None: ([0, 6], True)}


@pytest.mark.parametrize("bad", ["C)", "1CC1", "(C", "C(", "C=", "", "C11", "%12", "C.C", "InChI=1S/CH4/h1H4"])
def test_structures_outside_the_subset(bad):
    with pytest.raises(ValueError):
        chemistry.parse(bad)


def test_skeletons_are_compared_exactly():
    a, b = chemistry.parse("C1CCC2CCCCC2C1"), chemistry.parse("C1CCC(C1)C1CCCC1")
    n = len(a.symbols)
    both = chemistry.Molecule(a.symbols + b.symbols, a.aromatic + b.aromatic, a.charges + b.charges, a.hydrogens + b.hydrogens, a.bonds + [(x + n, y + n, o) for x, y, o in b.bonds])
    one, other = frozenset(range(n)), frozenset(range(n, 2 * n))
    assert chemistry.skeleton(both, set(one)) == chemistry.skeleton(both, set(other)) and not chemistry.same_skeleton(both, one, other)
    assert chemistry.same_skeleton(both, frozenset([0, 1, 2]), frozenset([n, n + 1, n + 2])) and not chemistry.same_skeleton(both, frozenset([0, 1]), frozenset([0, 5]))
