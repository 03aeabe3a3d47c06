"""Golden values and invariants of the mass-spectrometry operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionmill.operators import chemistry, features, isotopes, learning, matching, scores, spectrum
from ionmill.sources import settings as files
from ionmill.sources import sinks, spectra

MEASURED = "low\n50.0 100.0\nmed\n10.0 20.0\n40.0 30.0\n60.0 35.0\n76.0 5.0\n76.43 5.0\n76.8 5.0\nhigh\n40.0 50.0\n60.0 50.0\n"
PREDICTED = "low\n50.0 40.0\n60.0 30.0\nmed\n10.0 20.0\n50.99 20.0\n60.0 35.0\n76.008 5.0\n76.31 5.0\n76.431 5.0\n76.432 10.0\nhigh\n40.0 100.0\n43.0 80.0\n"
GOLDEN = {
    "recall": (100, 66.666667, 50), "weighted_recall": (100, 65, 50), "precision": (50, 57.142857, 50), "weighted_precision": (57.142857, 70, 55.555556), "dice": (0.666667, 0.615385, 0.5),
    "jaccard": (0.5, 0.444444, 0.333333), "weighted_jaccard": (0.4, 0.481481, 0.333333), "weighted_dice": (0.571429, 0.65, 0.5), "dot_product": (0.526316, 0.426993, 0.215054), "stein_dot_product": (0.321102, 0.527848, 0.037008),
}


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lists")
    (d / "m").mkdir(), (d / "p").mkdir()
    (d / "m" / "Test3.txt").write_text(MEASURED)
    (d / "p" / "Test3.txt").write_text(PREDICTED)
    return spectra.peak_list(spark, str(d / "m")), spectra.peak_list(spark, str(d / "p"), "predicted")


def test_golden_scores(pair):
    on = ["spectrum_id", "energy"]
    p, q = (spectrum.normalize(x, on) for x in pair)
    rows = {r.energy: r for r in scores.score(p, q, on, ppm=10.0, abs_tol=0.01).collect()}
    assert [rows[e].k for e in range(3)] == [1, 4, 1]
    for name, want in GOLDEN.items():
        assert [rows[e][name] for e in range(3)] == pytest.approx(want, abs=2e-6), name


def test_quantize_golden(pair):
    rows = spectrum.quantize(pair[1].where("energy = 1"), ["energy"], 0).orderBy("mass").collect()
    assert [r.mass for r in rows] == [10, 51, 60, 76] and sum(r.intensity for r in rows) == pytest.approx(100)


def brute(pairs):
    best = (0, [])
    for mask in range(1 << len(pairs)):
        pick = sorted(p for k, p in enumerate(pairs) if mask >> k & 1)
        if all(a[0] < b[0] and a[2] < b[2] for a, b in zip(pick, pick[1:])):
            best = max(best, (sum(0.5 * (p[1] + p[3]) for p in pick), pick))
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=9, unique=True))
def test_matching_is_best_one_to_one_and_ordered(cells):
    pairs = [(float(a), float(a * 7 % 5 + 1), float(b), float(b * 3 % 4 + 1)) for a, b in cells]
    pick = [pairs[k] for k in matching.best_chain(pairs)]
    assert all(a[0] < b[0] and a[2] < b[2] for a, b in zip(pick, pick[1:]))
    assert sum(0.5 * (p[1] + p[3]) for p in pick) == pytest.approx(brute(pairs))


def test_msp_round_trip(spark, tmp_path, pair):
    text = "Name: a\nID: A\nComment: Energy0\nNum peaks: 2\n54.07 0.10\n76.08 0.90\n\nName: b\nid: B\nNum Peaks: 3\n1.5 2;2.5 3\n9.5 1\n\nID: B\nComment: Energy2\nnum peaks: 1\n7.25 4\n"
    (tmp_path / "lib.msp").write_text(text)
    rows = [tuple(r) for r in spectra.msp(spark, str(tmp_path / "lib.msp")).orderBy("spectrum_id", "energy", "mass").collect()]
    assert rows == [("A", 0, 54.07, 0.1), ("A", 0, 76.08, 0.9), ("B", 0, 1.5, 2.0), ("B", 0, 2.5, 3.0), ("B", 0, 9.5, 1.0), ("B", 2, 7.25, 4.0)]
    out = str(tmp_path / "out")
    sinks.msp_records(pair[0].drop("source")).select("value").write.text(out)
    back = spectra.msp(spark, out)
    assert back.count() == pair[0].count() and back.select("energy").distinct().count() == 3
    (tmp_path / "bad.msp").write_text("Name: x\nNum peaks: 1\n1.0 2.0\n")
    with pytest.raises(Exception, match="no ID"):
        spectra.msp(spark, str(tmp_path / "bad.msp")).collect()
    have, missing = spectra.fetch(spectra.msp(spark, str(tmp_path / "lib.msp")), spark.createDataFrame([("B",), ("Z",)], "spectrum_id string"))
    assert have.count() == 4 and [r[0] for r in missing.collect()] == ["Z"]


def test_other_sinks(spark, pair, tmp_path):
    from pyspark.sql import functions as F

    text = sinks.mgf_records(pair[0].drop("source"), F.lit(100.5)).where("energy = 0").first().value
    assert text.startswith("BEGIN IONS\nPEPMASS=100.500000\nCHARGE=1+") and "50.00000 100.00" in text
    assert "energy2\n40.00000 100.00" in sinks.peak_text(pair[0].drop("source")).first().value
    f = spark.createDataFrame([(1, 0, 18.5, "O"), (1, 1, 1.5, "H")], "mol_id long, frag_id int, mass double, ion_smiles string")
    t = spark.createDataFrame([(1, 0, 1, "x", False), (1, 0, 1, "x", True)], "mol_id long, from_id int, to_id int, nl_smiles string, is_duplicate boolean")
    assert sinks.graph_text(f, t).count() == 3
    sinks.save_graph(f, t, str(tmp_path / "g"))
    a, b = sinks.load_graph(spark, str(tmp_path / "g"))
    assert a.count() == 2 and b.count() == 2


def test_stream(spark, tmp_path):
    from ionmill.streaming.spectra import ingest

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.msp").write_text(f"ID: S{k}\nNum peaks: 2\n1.5 2\n2.5 3\n")
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_settings_files():
    with pytest.warns(UserWarning, match="unknown"):
        c = files.config("# x\nlambda 0.5\nlambda 0.25\nspectrum_depth 2\nspectrum_depth 3\nnonsense 1\nfg_depth 3\n")
    assert c["lambda"] == 0.25 and c["spectrum_depth"] == [2.0, 3.0] and c["fg_depth"] == 3
    assert files.feature_list("RadicalFeatures\n\nIonRootAtom\n", features.FEATURES) == ["RadicalFeatures"]
    for bad in ("Nope\n", ""):
        with pytest.raises(ValueError):
            files.feature_list(bad, features.FEATURES)
    for w in (np.arange(130.0), np.eye(1, 130, 7)[0]):
        p = files.Parameters(["A", "B"], 2, w, [(4, 1, 0.1, 0), (1, 0, 0.0, 1)])
        q = files.read_parameters(files.write_parameters(p), network=True)
        assert np.array_equal(q.weights, w) and q.layers == p.layers
    with pytest.raises(ValueError):
        files.read_parameters(files.write_parameters(files.Parameters(["A"], 1, np.ones(3))), network=True)
    assert files.isotope_table("S\n32 0.9\n34 0.1\n\nH\n1 1\n") == {"S": [(32.0, 0.9), (33.0, 0.0), (34.0, 0.1)], "H": [(1.0, 1.0)]}


def test_isotopes_and_chemistry(spark):
    p = isotopes.pattern("C2H4O2", threshold=0.1)
    assert p[0][0] == pytest.approx(60.021129, abs=1e-5) and sum(i for _, i in p) == pytest.approx(100) and p[0][1] > 97
    assert isotopes.isotope_peaks(spark.createDataFrame([("a", "CCl2")], "id string, formula string"), "id").count() >= 3
    for smiles, mass in (("CC(=O)O", 60.021129), ("c1cncnc1", 80.037448), ("c1ccccc1O", 94.041865), ("CCN", 45.057849)):
        assert chemistry.parse(smiles).mass() == pytest.approx(mass, abs=1e-4), smiles
    assert chemistry.breaks(chemistry.parse("CC(=O)O")) == [(0,), (1,), (2,)]
    assert len(chemistry.ring_bonds(chemistry.parse("C1CCC2CCCC2C1"))) == 2
    assert chemistry.skeleton(chemistry.parse("CCO")) == chemistry.skeleton(chemistry.parse("OCC")) != chemistry.skeleton(chemistry.parse("COC"))
    found, edges = chemistry.fragments("CC(=O)O", depth=1)
    assert found[0]["mass"] == pytest.approx(61.028405, abs=1e-4) and any(f["mass"] == pytest.approx(43.01784, abs=1e-3) for f in found) and all(a < b for a, b in edges)
    t = chemistry.fragment_table(spark.createDataFrame([("a", "CCO"), ("b", "InChI=1"), ("c", None)], "mol_id string, structure string"))
    assert {r.mol_id for r in t.where("status = 'ok'").collect()} >= {"a"} and t.where("mol_id = 'b'").first().status.startswith("InChI")


def test_fragments_of_fragments(spark):
    t = chemistry.fragment_table(spark.createDataFrame([("a", "CC(=O)O"), ("b", "CC(=O)O")], "mol_id string, structure string")).collect()
    want = {(f["depth"], f["skeleton"], f["mass"]) for f in chemistry.fragments("CC(=O)O", depth=2)[0]}
    assert max(r.depth for r in t) == 2 and all({(r.depth, r.skeleton, r.mass) for r in t if r.mol_id == k} == want for k in "ab")


def test_graph_loops_reach_the_end(spark):
    from ionmill.operators import graph

    n = 11
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(n)] + [(1, n, n - 1), (1, 0, n + 1)], "mol_id long, from_id long, to_id long")
    ends = spark.createDataFrame([(1, n), (1, n + 1)], "mol_id long, frag_id long")
    assert {r.frag_id: r.depth for r in graph.min_depth(edges).collect()} == {**{k: k for k in range(n + 1)}, n + 1: 1}
    only = spark.createDataFrame([(1, k) for k in range(1, n + 1)], "mol_id long, frag_id long")
    assert graph.direct_paths(edges, only).count() == n + 1
    assert {r.frag_id for r in graph.needed(edges, ends.where("frag_id = 11")).collect()} == set(range(n + 1))
    assert {(r.from_id, r.to_id) for r in graph.paths_to(edges, ends).collect()} == {(k, k + 1) for k in range(n)} | {(n, n - 1), (0, n + 1)}
    assert {(r.ancestor, r.n_targets) for r in graph.common_ancestors(edges, ends).collect()} == {(0, 2)}


def test_break_features(spark):
    row = ("C", "Zn", True, 2, False, False, False, False, [1, 2], [], 1.2, -7.0, True, False, True, False, False, False, False, False, [1, 1, 4])
    kinds = "ion_root string, nl_root string, ring_break boolean, bond int, aromatic boolean, conjugated boolean, ionic boolean, h_only boolean, ion_bonds array<int>, nl_bonds array<int>, h_shift_ion double, h_shift_nl double, ion_radical boolean, nl_radical boolean, ion_in_ring boolean, nl_in_ring boolean, ion_plus boolean, ion_minus boolean, nl_plus boolean, nl_minus boolean, history array<int>"
    df = spark.createDataFrame([row], kinds)
    for name, (size, _) in features.FEATURES.items():
        got = features.feature_vector(df, [name]).first()
        assert got.feature_len == size + 1 and got.features[0] == 0 and all(0 < i <= size for i in got.features[1:]), name
    assert features.feature_vector(df, ["BreakAtomPair"]).first().features == [0, 6, 37]
    assert features.feature_vector(df, ["BreakHistoryFeature"]).first().features == [0, 2, 19]
    q = features.feature_vector(df, ["BreakAtomPair", "RadicalFeatures"], quadratic=True).first()
    assert q.feature_len == 41 + 40 * 39 // 2 and len(q.features) == 4 + 3 and len(set(q.features)) == 7


def test_solvers_and_network():
    for number in range(6):
        w, target = np.zeros(4), np.array([1.0, -2.0, 0.5, 0.0])
        step = learning.solver(number, 4)
        for _ in range(4000 if number == 3 else 800):
            step.step(w, target - w, np.array([0, 1, 2]), 0.05)
        assert np.allclose(w[:3], target[:3], atol=0.1), number
        assert w[3] == 0
    rng = np.random.default_rng(1)
    net = learning.Network(6, (4, 2, 1), ("alternating", "leaky", "linear"), rng.normal(size=6 * 4 + 5 * 2 + 3))
    g, f = net.gradient([0, 3, 5]), [0, 3, 5]
    for k in range(len(net.weights)):
        w = net.weights.copy()
        w[k] += 1e-6
        assert (learning.Network(6, (4, 2, 1), net.acts, w).forward(f)[0] - net.forward(f)[0]) / 1e-6 == pytest.approx(g[k], abs=1e-4)
    assert learning.dropout_mask(10, 0.35, 1).sum() == 7
    assert learning.initial_weights(5, "zero")[1:].sum() == 0 and -3 <= learning.initial_weights(5)[0] <= 0


def test_decay():
    from ionmill.functions import decayed_rate

    assert decayed_rate(1.0, 11, "time", decay=0.1) == pytest.approx(0.5)
    assert decayed_rate(1.0, 10, "step") == 0.5 and decayed_rate(2.0, 3) == 2.0 and decayed_rate(1.0, 1, "exponential", k=math.log(2)) == pytest.approx(0.5)
