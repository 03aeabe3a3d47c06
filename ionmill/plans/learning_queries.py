"""Registered queries of message passing and learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, learning
from . import views
from .queries import register, rounded, with_

TOL_M, DEPTH = 0.5, 3

# Messages ------------------------------------------------------------------------------------------------------------------------

MOL_PEAKS = "mp0 AS (SELECT mol_id, round(mass, 0) AS mass, sum(theta + 3) AS intensity FROM fragments WHERE frag_id % 3 = 0 GROUP BY ALL), mp AS (SELECT mol_id, mass, intensity * 100 / sum(intensity) OVER (PARTITION BY mol_id) AS intensity FROM mp0)"
MOVE = "e AS (SELECT mol_id, from_id, to_id, theta - ln(1 + sum(exp(theta)) OVER (PARTITION BY mol_id, from_id)) AS move FROM transitions), s AS (SELECT f.mol_id, f.frag_id, coalesce(-ln(1 + sum(exp(t.theta))), 0.0) AS stay FROM fragments f LEFT JOIN transitions t ON t.mol_id = f.mol_id AND t.from_id = f.frag_id GROUP BY ALL)"



def lse_sql(rows: str, keys: str) -> str:
    """Log-sum-exp of column x of ``rows`` by ``keys``."""
    return f"(SELECT {keys}, top + ln(sum(exp(x - top))) AS logp FROM (SELECT *, max(x) OVER (PARTITION BY {keys}) AS top FROM ({rows})) GROUP BY {keys}, top)"


def downs_sql(depth: int) -> str:
    out = ["d0 AS (SELECT DISTINCT mol_id, CAST(0 AS BIGINT) AS frag_id, 0.0::DOUBLE AS logp FROM s)"]
    for k in range(1, depth + 1):
        rows = f"SELECT d.mol_id, d.frag_id, d.logp + s.stay AS x FROM d{k - 1} d JOIN s ON s.mol_id = d.mol_id AND s.frag_id = d.frag_id UNION ALL SELECT d.mol_id, e.to_id, d.logp + e.move FROM d{k - 1} d JOIN e ON e.mol_id = d.mol_id AND e.from_id = d.frag_id"
        out.append(f"d{k} AS {lse_sql(rows, 'mol_id, frag_id')}")
    return ", ".join(out)


SPEC = f"""near AS (SELECT f.mol_id, f.frag_id, mp.mass, mp.intensity, abs(mp.mass - f.mass) AS gap, 0.33 * greatest(mp.mass / 1e6 * 10.0, {TOL_M}) AS sigma, d.logp FROM mp JOIN fragments f ON f.mol_id = mp.mol_id JOIN d{DEPTH} d ON d.mol_id = f.mol_id AND d.frag_id = f.frag_id WHERE abs(mp.mass - f.mass) <= greatest(mp.mass / 1e6 * 10.0, {TOL_M})),
v AS (SELECT *, -0.5 * ln(4 * pi() * sigma * sigma) - gap * gap / (4 * sigma * sigma) + logp AS v FROM near WHERE gap <= 3 * sigma),
w AS (SELECT mol_id, frag_id, v - ln(sum(exp(v)) OVER (PARTITION BY mol_id, mass)) + ln(0.01 * intensity) AS x FROM v), spec AS {lse_sql('SELECT mol_id, frag_id, x FROM w', 'mol_id, frag_id')}"""


def ups_sql() -> str:
    out = [f"u{DEPTH} AS (SELECT spec.mol_id, spec.frag_id, spec.logp - d.logp AS logp FROM spec JOIN d{DEPTH} d ON d.mol_id = spec.mol_id AND d.frag_id = spec.frag_id)"]
    for k in range(DEPTH - 1, 0, -1):
        rows = f"SELECT u.mol_id, u.frag_id, u.logp + s.stay AS x FROM u{k + 1} u JOIN s ON s.mol_id = u.mol_id AND s.frag_id = u.frag_id UNION ALL SELECT u.mol_id, e.from_id, u.logp + e.move FROM u{k + 1} u JOIN e ON e.mol_id = u.mol_id AND e.to_id = u.frag_id"
        out.append(f"u{k} AS {lse_sql(rows, 'mol_id, frag_id')}")
    return ", ".join(out)


def beliefs_sql() -> str:
    parts = []
    for k in range(DEPTH):
        parts.append(f"SELECT e.mol_id, e.from_id, e.to_id, 'move' AS kind, d.logp + e.move + u.logp AS raw, {k} AS depth FROM d{k} d JOIN e ON e.mol_id = d.mol_id AND e.from_id = d.frag_id JOIN u{k + 1} u ON u.mol_id = e.mol_id AND u.frag_id = e.to_id")
        parts.append(f"SELECT s.mol_id, s.frag_id, s.frag_id, 'stay', d.logp + s.stay + u.logp, {k} FROM d{k} d JOIN s ON s.mol_id = d.mol_id AND s.frag_id = d.frag_id JOIN u{k + 1} u ON u.mol_id = s.mol_id AND u.frag_id = s.frag_id")
    return f"b AS (SELECT mol_id, from_id, to_id, kind, depth, raw - ln(sum(exp(raw)) OVER (PARTITION BY mol_id, depth)) AS logp FROM ({' UNION ALL '.join(parts)}))"


DOWNS = with_("fragments", "transitions", extra=f"{MOL_PEAKS}, {MOVE}, {downs_sql(DEPTH)}")
BELIEFS = DOWNS + f", {SPEC}, {ups_sql()}, {beliefs_sql()} "


def mol_peaks(spark: SparkSession, d: str) -> DataFrame:
    f = views.fragments(spark, d).where("frag_id % 3 = 0")
    merged = f.groupBy("mol_id", F.round("mass", 0).alias("mass")).agg(F.sum(F.col("theta") + 3).alias("intensity"))
    from ..operators.spectrum import normalize

    return normalize(merged, ["mol_id"])


def _model(spark: SparkSession, d: str) -> tuple[inference.Model, DataFrame]:
    f = views.fragments(spark, d)
    return inference.Model(views.transitions(spark, d), f), f.select("mol_id", "frag_id", "mass")


def _spectrum(spark: SparkSession, d: str) -> tuple[inference.Model, list[DataFrame], DataFrame, DataFrame]:
    model, masses = _model(spark, d)
    downs = model.downs(DEPTH)
    return model, downs, inference.spectrum_message(downs[-1], mol_peaks(spark, d), masses, 10.0, TOL_M), masses


def _beliefs(spark: SparkSession, d: str) -> DataFrame:
    model, downs, spec, _ = _spectrum(spark, d)
    return inference.beliefs(model, downs, spec)


for _k in (1, 2, 3):
    register(f"message_down_d{_k}", DOWNS + f"SELECT mol_id, frag_id, round(logp, 6) AS logp FROM d{_k}")(lambda spark, d, _k=_k: rounded(_model(spark, d)[0].downs(_k)[_k], "logp"))


@register("spectrum_message", DOWNS + f", {SPEC} SELECT mol_id, frag_id, round(logp, 6) AS logp FROM spec")
def spectrum_message(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_spectrum(spark, d)[2], "logp")


@register("message_normalised", DOWNS + f", {SPEC}, n AS {lse_sql('SELECT mol_id, logp AS x FROM spec', 'mol_id')} SELECT spec.mol_id, frag_id, round(spec.logp - n.logp, 6) AS logp FROM spec JOIN n ON n.mol_id = spec.mol_id")
def message_normalised(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.normalise_message(_spectrum(spark, d)[2]), "logp")


@register("message_up", DOWNS + f", {SPEC}, {ups_sql()} SELECT mol_id, frag_id, round(logp, 6) AS logp FROM u{DEPTH - 1}")
def message_up(spark: SparkSession, d: str) -> DataFrame:
    model, downs, spec, _ = _spectrum(spark, d)
    return rounded(model.up(inference.corrected(spec, downs[-1])), "logp")


@register("beliefs_norm", BELIEFS + "SELECT mol_id, from_id, to_id, kind, depth, round(logp, 6) AS logp FROM b")
def beliefs_norm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_beliefs(spark, d), "logp")


@register("beliefs_concat", BELIEFS + f"SELECT mol_id, from_id, to_id, kind, depth + k * {DEPTH} AS depth, round(logp, 6) AS logp FROM b CROSS JOIN (SELECT unnest([0, 1]) AS k)")
def beliefs_concat(spark: SparkSession, d: str) -> DataFrame:
    b = _beliefs(spark, d)
    return rounded(inference.concat_energies([b, b], DEPTH), "logp")


@register("suft_counts", BELIEFS + "SELECT mol_id, kind, from_id, to_id, round(sum(exp(logp)), 6) AS nu FROM b GROUP BY ALL")
def suft_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.sufficient_statistics(_beliefs(spark, d)), "nu")


@register("fragment_evidence", BELIEFS + f", ev AS {lse_sql(f'SELECT mol_id, to_id AS frag_id, logp AS x FROM b WHERE depth = {DEPTH - 1}', 'mol_id, frag_id')} SELECT mol_id, frag_id, round(logp, 6) AS logp FROM ev")
def fragment_evidence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.fragment_evidence(_beliefs(spark, d)), "logp")


@register("evidence_graph", BELIEFS + "SELECT DISTINCT mol_id, from_id, to_id FROM b WHERE kind = 'move' AND logp >= -4.0")
def evidence_graph(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.graph import evidence_edges

    return evidence_edges(views.transitions(spark, d), _beliefs(spark, d).where("kind = 'move'"), -4.0).select("mol_id", "from_id", "to_id")


@register("predicted_peaks", DOWNS + f", pp AS (SELECT f.mol_id, f.mass, sum(exp(d.logp)) AS intensity, count(*) AS n_frags FROM d{DEPTH} d JOIN fragments f ON f.mol_id = d.mol_id AND f.frag_id = d.frag_id GROUP BY ALL) SELECT mol_id, mass, n_frags, round(intensity * 100 / sum(intensity) OVER (PARTITION BY mol_id), 6) AS intensity FROM pp")
def predicted_peaks(spark: SparkSession, d: str) -> DataFrame:
    model, masses = _model(spark, d)
    return rounded(inference.predicted_peaks(model.downs(DEPTH)[-1], masses), "intensity")


@register(
    "peak_annotation",
    BELIEFS + f", ev AS {lse_sql(f'SELECT mol_id, to_id AS frag_id, logp AS x FROM b WHERE depth = {DEPTH - 1}', 'mol_id, frag_id')}, an AS (SELECT mp.mol_id, mp.mass, mp.intensity, f.frag_id, exp(ev.logp) AS score FROM mp JOIN fragments f ON f.mol_id = mp.mol_id AND abs(mp.mass - f.mass) <= greatest(mp.mass / 1e6 * 10.0, {TOL_M}) JOIN ev ON ev.mol_id = f.mol_id AND ev.frag_id = f.frag_id) SELECT mol_id, mass, round(intensity, 6) AS intensity, frag_id, round(score * intensity / (100 * sum(score) OVER (PARTITION BY mol_id, mass)), 6) AS score FROM an",
)
def peak_annotation(spark: SparkSession, d: str) -> DataFrame:
    model, downs, spec, masses = _spectrum(spark, d)
    evidence = inference.fragment_evidence(inference.beliefs(model, downs, spec))
    return rounded(inference.peak_annotations(mol_peaks(spark, d), masses, evidence, 10.0, TOL_M), "intensity", "score")


@register("displayed_ids", with_("fragments", extra=MOL_PEAKS) + f"SELECT DISTINCT mp.mol_id, f.frag_id FROM mp JOIN fragments f ON f.mol_id = mp.mol_id AND abs(mp.mass - f.mass) <= {TOL_M}")
def displayed_ids(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.matching import annotate

    f = views.fragments(spark, d).select("mol_id", "frag_id", F.col("mass").alias("frag_mass"))
    return annotate(mol_peaks(spark, d), f, ["mol_id"], 0.0, TOL_M).select("mol_id", "frag_id").distinct()


# Learning ------------------------------------------------------------------------------------------------------------------------

PARAM = "param AS (SELECT range AS idx, (range % 11 - 5) / 50.0 AS weight FROM range(256))"
THETA = f"{PARAM}, th AS (SELECT doc_id, sum(weight) AS theta FROM doc_features JOIN param USING (idx) GROUP BY doc_id), g AS (SELECT doc_id, theta, doc_id // 5 AS from_id, (doc_id % 7 + 1) / 7.0 AS nu, 0.5 AS nu_stay FROM th), sh AS (SELECT *, ln(1 + sum(exp(theta)) OVER (PARTITION BY from_id)) AS ld, sum(nu) OVER (PARTITION BY from_id) + nu_stay AS total FROM g)"


def _param(spark: SparkSession) -> DataFrame:
    return spark.range(256).select(F.col("id").alias("idx"), ((F.col("id") % 11 - 5) / 50.0).alias("weight"))


def _grouped(thetas: DataFrame) -> DataFrame:
    return thetas.select("doc_id", "theta", F.floor(F.col("doc_id") / 5).cast("long").alias("from_id"), ((F.col("doc_id") % 7 + 1) / 7.0).alias("nu"), F.lit(0.5).alias("nu_stay"))


def _thetas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    features = views.doc_features(spark, d)
    return features, _grouped(learning.theta_linear(features, _param(spark), "doc_id"))


@register("used_feature_idx", with_("doc_features") + "SELECT DISTINCT idx FROM doc_features")
def used_feature_idx(spark: SparkSession, d: str) -> DataFrame:
    return learning.used_features(views.doc_features(spark, d))


@register("theta_linear", with_("doc_features", extra=THETA) + "SELECT doc_id, round(theta, 6) AS theta FROM th")
def theta_linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.theta_linear(views.doc_features(spark, d), _param(spark), "doc_id"), "theta")


@register("feature_pairs_quadratic", with_("doc_features", extra="f AS (SELECT doc_id, idx % 32 AS idx FROM doc_features GROUP BY ALL)") + "SELECT x.idx AS a, y.idx AS b, count(*) AS n FROM f x JOIN f y ON x.doc_id = y.doc_id AND 0 < x.idx AND x.idx < y.idx GROUP BY ALL")
def feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = views.doc_features(spark, d).select("doc_id", (F.col("idx") % 32).alias("idx")).distinct()
    return learning.quadratic_pairs(f, "doc_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@register("gradient_linear", with_("doc_features", extra=THETA) + "SELECT idx, round(sum(nu - total * exp(theta - ld)), 4) AS grad FROM sh JOIN doc_features USING (doc_id) GROUP BY idx")
def gradient_linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.gradient_linear(*_thetas(spark, d), "doc_id", "from_id"), "grad", places=4)


@register("loss_q", with_("doc_features", extra=THETA) + "SELECT round(sum(q - stay), 4) AS q FROM (SELECT from_id, sum(nu * (theta - ld)) AS q, max(nu_stay) * max(ld) AS stay FROM sh GROUP BY from_id)")
def loss_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.loss(_thetas(spark, d)[1], "from_id"), "q", places=4)


@register("l2_term", f"WITH {PARAM} SELECT round(-0.5 * 0.01 * sum(CASE WHEN idx = 0 THEN 0.0 ELSE weight * weight END), 9) AS l2 FROM param")
def l2_term(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.penalty(_param(spark), 0.01), "l2", places=9)


@register("zero_unused_weights", with_("doc_features", extra=PARAM) + "SELECT idx, CASE WHEN idx IN (SELECT idx FROM doc_features WHERE idx % 3 = 0) THEN weight ELSE 0.0 END AS weight FROM param")
def zero_unused(spark: SparkSession, d: str) -> DataFrame:
    return learning.zero_unused(_param(spark), learning.used_features(views.doc_features(spark, d)).where("idx % 3 = 0"))


def _stepped(number: int, steps: int = 2):
    """Weights after ``steps`` equal steps from the first gradient, which the driver holds as one number per feature."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        g, w = np.zeros(256), np.array([(k % 11 - 5) / 50.0 for k in range(256)])
        for r in learning.gradient_linear(*_thetas(spark, d), "doc_id", "from_id").collect():
            g[r.idx] = r.grad
        step = learning.solver(number, 256)
        for _ in range(steps):
            step.step(w, g, np.arange(256), 0.001)
        return spark.createDataFrame([(k, round(float(x), 4)) for k, x in enumerate(w)], "idx long, weight double")

    return run


GRAD = with_("doc_features", extra=THETA + ", gr AS (SELECT param.idx, any_value(weight) AS w, coalesce(sum(nu - total * exp(theta - ld)), 0.0) AS g FROM param LEFT JOIN (doc_features JOIN sh USING (doc_id)) USING (idx) GROUP BY param.idx) ")
register("sgd_step", GRAD + "SELECT idx, round(w + 2 * 0.001 * g, 4) AS weight FROM gr")(_stepped(0))
register("momentum_step", GRAD + "SELECT idx, round(w + 0.001 * g * 2.9, 4) AS weight FROM gr")(_stepped(1))
register("adam_step", GRAD + "SELECT idx, round(w + 0.001 * 2 * CASE WHEN g = 0 THEN 0 ELSE g / (abs(g) + 1e-8) END, 4) AS weight FROM gr")(_stepped(2))
register("adadelta_step", GRAD + "SELECT idx, round(w + m1 + sqrt(0.05 * m1 * m1 + 1e-8) / sqrt(0.0975 * g * g + 1e-8) * g, 4) AS weight FROM (SELECT *, sqrt(1e-8) / sqrt(0.05 * g * g + 1e-8) * g AS m1 FROM gr)")(_stepped(3))
register("adamw_step", GRAD + "SELECT idx, round((w * keep + m) * keep + m, 4) AS weight FROM (SELECT *, CASE WHEN idx = 0 THEN 1 - 0.001 * 0.01 ELSE 1 END AS keep, 0.001 * CASE WHEN g = 0 THEN 0 ELSE g / (abs(g) + 1e-8) END AS m FROM gr)")(_stepped(4))
register("adabelief_step", GRAD + "SELECT idx, round(w + 0.001 * 0.1 * g / (sqrt(v1 / (1 - 0.999)) + 1e-8) + 0.001 * 0.19 * g / (sqrt((0.999 * v1 + 0.001 * 0.6561 * g * g + 1e-8) / (1 - 0.999 * 0.999)) + 1e-8), 4) AS weight FROM (SELECT *, 0.001 * 0.81 * g * g + 1e-8 AS v1 FROM gr)")(_stepped(5))


def _network() -> learning.Network:
    rng = np.random.default_rng(5)
    shape = 256 * 8 + 9 * 4 + 5
    return learning.Network(256, (8, 4, 1), ("relu", "leaky", "linear"), rng.normal(0, 0.05, shape))


@register("theta_nn")
def theta_nn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.theta_network(views.doc_features(spark, d), "doc_id", _network()), "theta")


@register("gradient_nn")
def gradient_nn(spark: SparkSession, d: str) -> DataFrame:
    features, net = views.doc_features(spark, d), _network()
    thetas = _grouped(learning.theta_network(features, "doc_id", net))
    return rounded(learning.gradient_network(features, thetas, "doc_id", "from_id", net), "grad")


@register("minibatch_flags")
def minibatch_flags(spark: SparkSession, d: str) -> DataFrame:
    return learning.minibatch(views.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 20)


@register("em_train_smoke")
def em_train(spark: SparkSession, d: str) -> DataFrame:
    """EM on the fragment view: a transition's features are its two nodes modulo 16; expected counts come from the beliefs."""
    f, t = views.fragments(spark, d), views.transitions(spark, d)
    edge = F.concat_ws(":", "mol_id", "from_id", "to_id")
    features = learning.cut(t.select(edge.alias("edge"), F.explode(F.array(F.lit(0).cast("long"), 1 + F.col("from_id") % 16, 17 + F.col("to_id") % 16)).alias("idx")))
    masses, peaks = f.select("mol_id", "frag_id", "mass"), learning.cut(mol_peaks(spark, d))

    def expect(w: np.ndarray):
        param = spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "idx long, weight double")
        thetas = learning.theta_linear(features, F.broadcast(param), "edge")
        parts = F.split("edge", ":")
        edges = learning.cut(thetas.select(*(parts[k].cast("long").alias(n) for k, n in enumerate(("mol_id", "from_id", "to_id"))), "theta"))
        model = inference.Model(edges, f)
        downs = model.downs(2)
        spec = inference.spectrum_message(downs[-1], peaks, masses, 10.0, TOL_M)
        nu = learning.cut(inference.sufficient_statistics(inference.beliefs(model, downs, spec)))
        group = F.concat_ws(":", "mol_id", "from_id")
        moved = nu.where("kind = 'move'").select(edge.alias("edge"), "nu")
        stay = nu.where("kind = 'stay'").select(group.alias("from_id"), F.col("nu").alias("nu_stay"))

        def of(got: DataFrame) -> DataFrame:
            parts = F.split("edge", ":")
            full = got.withColumn("from_id", F.concat_ws(":", parts[0], parts[1])).join(moved, "edge", "left").join(stay, "from_id", "left")
            return full.fillna(0.0, ["nu", "nu_stay"])

        return of, 0.0

    w, _ = learning.em(expect, features, 33, "edge", "from_id", rounds=2, init="zero", steps=3)
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(w)], "idx long, weight double")
