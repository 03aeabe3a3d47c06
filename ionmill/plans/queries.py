"""Registered queries of the mass-spectrometry operators, and SQL that computes the same in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import activation, adjusted_intensity, fold_symbol, mass_tolerance, parent_ion_mass, rounded_mass, softmax_over, spectrum_window
from ..operators import graph, matching, ranking, scores, spectrum
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS, SIDE, PAIR = ["spectrum_id", "energy", "source"], ["spectrum_id", "energy"], ["target_id", "cand_id", "energy"]
TOL, EVENT_TOL = 50.0, 0.5


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def with_(*names: str, extra: str = "", recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ", ".join([*(views.SQL[n] for n in names), *([extra] if extra else [])]) + " "


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# P and X ------------------------------------------------------------------------------------------------------------------------

NORM = "norm AS (SELECT spectrum_id, energy, source, mass, intensity * 100 / sum(intensity) OVER (PARTITION BY spectrum_id, energy, source) AS intensity FROM peaks)"
ROW = "spectrum_id, energy, source, mass"


@register("spectrum_normalize", with_("peaks", extra=NORM) + f"SELECT {ROW}, round(intensity, 6) AS intensity FROM norm")
def spectrum_normalize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum.normalize(views.peaks(spark, d), KEYS), "intensity")


def _quantize(places: int) -> None:
    s = 10.0**places
    sql = with_("peaks", extra=f"q AS (SELECT spectrum_id, energy, source, floor(mass * {s} + 0.5) / {s} AS mass, sum(intensity) AS intensity FROM peaks GROUP BY ALL)") + f"SELECT {ROW}, round(intensity * 100 / sum(intensity) OVER (PARTITION BY spectrum_id, energy, source), 6) AS intensity FROM q"
    register(f"spectrum_quantize_{places}", sql)(lambda spark, d: rounded(spectrum.quantize(views.peaks(spark, d), KEYS, places), "intensity"))


for _places in (0, 1, 2):
    _quantize(_places)


def _post(name: str, perc: float, least: int, most: int, min_rel: float) -> None:
    sql = with_("peaks", extra=NORM + ", r AS (SELECT *, row_number() OVER w - 1 AS k, sum(intensity) OVER (w ROWS UNBOUNDED PRECEDING) AS total, max(intensity) OVER (PARTITION BY spectrum_id, energy, source) AS top FROM norm WINDOW w AS (PARTITION BY spectrum_id, energy, source ORDER BY intensity DESC, mass))")
    sql += f"SELECT {ROW}, round(intensity, 6) AS intensity FROM r WHERE NOT ((round(total, 9) > {perc} AND k > {least}) OR k > {most} OR intensity / top * 100 < {min_rel})"
    register(name, sql)(lambda spark, d: rounded(spectrum.post_process(spectrum.normalize(views.peaks(spark, d), KEYS), KEYS, perc, least, most, min_rel), "intensity"))


_post("spectrum_postprocess", 60.0, 1, 30, 0.0)
_post("spectrum_postprocess_minrel", 80.0, 1, 2, 30.0)


@register("spectrum_log", with_("peaks") + f"SELECT {ROW}, round(ln(greatest(intensity / max(intensity) OVER (PARTITION BY spectrum_id, energy, source) * 100, 1.0)), 6) AS intensity FROM peaks")
def spectrum_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum.log_scale(views.peaks(spark, d), KEYS), "intensity")


@register("spectrum_linear", with_("peaks") + f"SELECT {ROW}, round(exp(intensity / max(intensity) OVER (PARTITION BY spectrum_id, energy, source) / (100.0 / ln(101.0))) - 1, 6) AS intensity FROM peaks")
def spectrum_linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum.linear_scale(views.peaks(spark, d), KEYS), "intensity")


@register("spectrum_merge_energies", with_("peaks", extra="m AS (SELECT spectrum_id, source, mass, sum(intensity) AS intensity FROM peaks GROUP BY ALL)") + "SELECT spectrum_id, source, mass, round(intensity * 100 / sum(intensity) OVER (PARTITION BY spectrum_id, source), 6) AS intensity FROM m")
def spectrum_merge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum.merge_energies(views.peaks(spark, d), ["spectrum_id", "source"]), "intensity")


@register(
    "spectrum_clean",
    with_("event_peaks", extra="c AS (SELECT *, lag(mass) OVER w AS m0, lag(intensity) OVER w AS i0, lead(mass) OVER w AS m1, lead(intensity) OVER w AS i1, greatest(mass / 1e6 * 10.0, 1.0) AS tol FROM (SELECT DISTINCT target_id, cand_id, mass, max(intensity) AS intensity FROM event_peaks GROUP BY ALL) WINDOW w AS (PARTITION BY target_id, cand_id ORDER BY mass, intensity DESC))")
    + "SELECT target_id, cand_id, mass, intensity FROM c WHERE NOT (coalesce(mass - m0 < tol AND i0 >= intensity, false) OR coalesce(m1 - mass < tol AND i1 > intensity, false) OR intensity < 0.01)",
)
def spectrum_clean(spark: SparkSession, d: str) -> DataFrame:
    one = views.event_peaks(spark, d).groupBy("target_id", "cand_id", "mass").agg(F.max("intensity").alias("intensity"))
    return spectrum.clean(one, ["target_id", "cand_id"], abs_tol=1.0)


@register("spectrum_max_intensity", with_("peaks") + "SELECT spectrum_id, energy, source, greatest(max(intensity), 0.0) AS max_intensity FROM peaks GROUP BY ALL")
def spectrum_max(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.max_intensity(views.peaks(spark, d), KEYS)


@register("display_intensity", with_("peaks") + f"SELECT * FROM (SELECT {ROW}, intensity, floor(intensity / max(intensity) OVER (PARTITION BY spectrum_id, energy, source) * 100 * 100 + 0.5) / 100.0 AS shown FROM peaks) WHERE shown > 0")
def display_intensity(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.displayed(views.peaks(spark, d), KEYS)


@register("empty_energies", with_("peaks") + "SELECT s.spectrum_id, e.energy FROM (SELECT DISTINCT spectrum_id FROM peaks) s CROSS JOIN (SELECT unnest([0, 1, 2]) AS energy) e ANTI JOIN peaks p ON p.spectrum_id = s.spectrum_id AND p.energy = e.energy")
def empty_energies(spark: SparkSession, d: str) -> DataFrame:
    p = views.peaks(spark, d)
    return spectrum.empty_energies(p, p, (0, 1, 2), "spectrum_id")


@register("distinct_masses_chained", with_("fragments", extra="m AS (SELECT mol_id, mass, lag(mass) OVER (PARTITION BY mol_id ORDER BY mass) AS last FROM fragments), k AS (SELECT mol_id, mass FROM m WHERE last IS NULL OR mass - last > 1e-10)") + "SELECT mol_id, mass, round(100.0 / count(*) OVER (PARTITION BY mol_id), 6) AS height FROM k")
def distinct_masses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum.distinct_masses(views.fragments(spark, d).select("mol_id", "mass"), ["mol_id"]), "height")


@register("mass_tolerance", with_("peaks") + "SELECT spectrum_id, energy, source, mass, round(greatest(mass / 1e6 * 10.0, 0.01), 9) AS tol, floor(mass * 10000.0 + 0.5) / 10000.0 AS rounded_mass FROM peaks")
def tolerance(spark: SparkSession, d: str) -> DataFrame:
    return views.peaks(spark, d).select("spectrum_id", "energy", "source", "mass", F.round(mass_tolerance(F.col("mass"), 10, 0.01), 9).alias("tol"), rounded_mass(F.col("mass")).alias("rounded_mass"))


@register(
    "scalar_functions",
    with_("fragments") + """SELECT mol_id, frag_id, round(mass + 1.007276, 6) AS positive, round(mass - 1.007276, 6) AS negative, round(mass - 0.000548579909, 6) AS impact,
    round(sqrt(abs(theta)) * sqrt(mass), 6) AS adjusted, round(pow(abs(theta), 0.6) * pow(mass, 3) / 1e6, 6) AS stein, greatest(theta, 0.0) AS relu, round(CASE WHEN theta > 0 THEN theta ELSE theta * 0.01 END, 9) AS leaky,
    CASE WHEN frag_id % 2 = 1 THEN least(theta, 0.0) ELSE greatest(theta, 0.0) END AS alternating, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN p_brand ELSE 'X' END AS folded FROM fragments JOIN part ON p_partkey = mol_id * 50 + frag_id""",
)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    brand = views.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 50).cast("long").alias("mol_id"), (F.col("p_partkey") % 50).alias("frag_id"), "p_brand")
    f, m, t = views.fragments(spark, d).join(brand, ["mol_id", "frag_id"]), F.col("mass"), F.col("theta")
    ion = {k: F.round(parent_ion_mass(m, F.lit(k)), 6).alias(k) for k in ("positive", "negative", "impact")}
    return f.select("mol_id", "frag_id", *ion.values(), F.round(adjusted_intensity(F.abs(t), m), 6).alias("adjusted"), F.round(adjusted_intensity(F.abs(t), m, True) / 1e6, 6).alias("stein"), activation(t, "relu").alias("relu"), F.round(activation(t, "leaky"), 9).alias("leaky"), activation(t, "alternating", F.col("frag_id")).alias("alternating"), fold_symbol(F.col("p_brand"), ("Brand#11", "Brand#12")).alias("folded"))


@register("softmax_check", with_("fragments", "transitions") + "SELECT mol_id, from_id, to_id, round(exp(theta) / sum(exp(theta)) OVER (PARTITION BY mol_id, from_id), 6) AS p FROM transitions")
def softmax_check(spark: SparkSession, d: str) -> DataFrame:
    return views.transitions(spark, d).select("mol_id", "from_id", "to_id", F.round(softmax_over(F.col("theta"), spectrum_window(["mol_id", "from_id"])), 6).alias("p"))


# J ------------------------------------------------------------------------------------------------------------------------------

P_SQL = "p AS (SELECT spectrum_id, energy, mass, intensity FROM norm WHERE source = 'measured'), q AS (SELECT spectrum_id, energy, mass AS mass2, intensity AS intensity2 FROM norm WHERE source = 'predicted')"
PAIRS_SQL = f"cand AS (SELECT p.spectrum_id, p.energy, mass, intensity, mass2, intensity2 FROM p JOIN q ON p.spectrum_id = q.spectrum_id AND p.energy = q.energy AND abs(mass - mass2) < {TOL})"
#: All order-preserving one-to-one choices, and of those the best with the least reversed list of (right, left) masses.
CHAIN_SQL = """chain AS (SELECT KEYS, mass, mass2, 0.5 * (intensity + intensity2) AS total, [[mass2, mass]] AS path, [{'mass': mass, 'intensity': intensity, 'mass2': mass2, 'intensity2': intensity2}] AS pairs FROM cand
UNION ALL SELECT CKEYS, c.mass, c.mass2, h.total + 0.5 * (c.intensity + c.intensity2), list_prepend([c.mass2, c.mass], h.path), list_append(h.pairs, {'mass': c.mass, 'intensity': c.intensity, 'mass2': c.mass2, 'intensity2': c.intensity2}) FROM chain h JOIN cand c ON SAME AND c.mass > h.mass AND c.mass2 > h.mass2),
top AS (SELECT KEYS, max(total) AS top FROM chain GROUP BY ALL),
best AS (SELECT KEYS, arg_min(pairs, path) AS pairs, min(top) AS top FROM chain JOIN top USING (KEYS) WHERE total > top - 1e-9 GROUP BY ALL),
matched AS (SELECT KEYS, m.mass AS mass, m.intensity AS intensity, m.mass2 AS mass2, m.intensity2 AS intensity2 FROM (SELECT KEYS, unnest(pairs) AS m FROM best))"""


def chain_sql(keys: list[str]) -> str:
    return CHAIN_SQL.replace("CKEYS", ", ".join(f"c.{k}" for k in keys)).replace("SAME", " AND ".join(f"c.{k} = h.{k}" for k in keys)).replace("KEYS", ", ".join(keys))


MATCH_SQL = with_("peaks", extra=", ".join([NORM, P_SQL, PAIRS_SQL, chain_sql(SIDE)]), recursive=True)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return scores.sides(views.peaks(spark, d), SIDE)


@register("band_join_abs", with_("peaks", extra=", ".join([NORM, P_SQL, PAIRS_SQL])) + "SELECT spectrum_id, energy, mass, mass2, round(intensity, 6) AS intensity, round(intensity2, 6) AS intensity2 FROM cand")
def band_join_abs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.candidate_pairs(*_sides(spark, d), SIDE, 0.0, TOL), "intensity", "intensity2")


@register("band_join_ppm", with_("peaks", extra=f"{NORM}, {P_SQL}") + "SELECT p.spectrum_id, p.energy, mass, mass2, round(intensity, 6) AS intensity, round(intensity2, 6) AS intensity2 FROM p JOIN q ON p.spectrum_id = q.spectrum_id AND p.energy = q.energy AND abs(mass - mass2) < greatest(greatest(mass, mass2) / 1e6 * 100000.0, 0.01)")
def band_join_ppm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.candidate_pairs(*_sides(spark, d), SIDE, 100_000.0, 0.01), "intensity", "intensity2")


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order peaks against all fragment masses, without a common key: the bucket alone keeps the join equi."""
    f = views.fragments(spark, d).select((F.col("mass") + F.col("theta") * 100).alias("mass"))
    return views.peaks(spark, d).where("source = 'measured'"), f


LIBRARY = "lib AS (SELECT DISTINCT mass + theta * 100 AS mass FROM fragments), m AS (SELECT * FROM peaks WHERE source = 'measured')"


@register("band_semi_explained", with_("peaks", "fragments", extra=LIBRARY) + f"SELECT {ROW}, intensity FROM m SEMI JOIN lib ON abs(m.mass - lib.mass) < greatest(m.mass / 1e6 * 10.0, 0.01)")
def band_semi(spark: SparkSession, d: str) -> DataFrame:
    return matching.explained(*_library(spark, d), [], 10.0, 0.01).select(*KEYS, "mass", "intensity")


@register("band_anti_unexplained", with_("peaks", "fragments", extra=LIBRARY) + f"SELECT {ROW}, intensity FROM m ANTI JOIN lib ON abs(m.mass - lib.mass) < greatest(m.mass / 1e6 * 10.0, 0.01)")
def band_anti(spark: SparkSession, d: str) -> DataFrame:
    return matching.explained(*_library(spark, d), [], 10.0, 0.01, keep=False).select(*KEYS, "mass", "intensity")


@register("fixed_point_semi", with_("peaks", "fragments") + f"SELECT {ROW}, intensity FROM peaks SEMI JOIN (SELECT DISTINCT floor(mass * 1.0 + 0.5) AS k FROM fragments) f ON floor(peaks.mass * 1.0 + 0.5) = f.k")
def fixed_point_semi(spark: SparkSession, d: str) -> DataFrame:
    key = lambda: F.floor(F.col("mass") * 1.0 + 0.5).cast("long")
    lib = views.fragments(spark, d).select(key().alias("k")).distinct()
    return views.peaks(spark, d).withColumn("k", key()).join(lib, "k", "left_semi").drop("k")


@register("match_pairs", MATCH_SQL + "SELECT spectrum_id, energy, mass, mass2, round(intensity, 6) AS intensity, round(intensity2, 6) AS intensity2 FROM matched")
def match_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.match(*_sides(spark, d), SIDE, 0.0, TOL), "intensity", "intensity2")


@register("match_dp_total", MATCH_SQL + "SELECT spectrum_id, energy, len(pairs) AS k, round(top, 6) AS total FROM best")
def match_total(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(*_sides(spark, d), SIDE, 0.0, TOL).groupBy(*SIDE).agg(F.count(F.lit(1)).alias("k"), F.round(F.sum((F.col("intensity") + F.col("intensity2")) * 0.5), 6).alias("total"))


OUTER_SQL = """, outr AS (SELECT spectrum_id, energy, mass, intensity, mass2, intensity2 FROM matched
UNION ALL SELECT spectrum_id, energy, mass, intensity, mass, 0.0 FROM p ANTI JOIN matched m ON m.spectrum_id = p.spectrum_id AND m.energy = p.energy AND m.mass = p.mass
UNION ALL SELECT spectrum_id, energy, mass2, 0.0, mass2, intensity2 FROM q ANTI JOIN matched m ON m.spectrum_id = q.spectrum_id AND m.energy = q.energy AND m.mass2 = q.mass2) """


@register("match_full_outer", MATCH_SQL + OUTER_SQL + "SELECT spectrum_id, energy, mass, mass2, round(intensity, 6) AS intensity, round(intensity2, 6) AS intensity2 FROM outr")
def match_outer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.match_outer(*_sides(spark, d), SIDE, 0.0, TOL), "intensity", "intensity2")


@register(
    "selected_masses",
    MATCH_SQL + OUTER_SQL + """, s AS (SELECT spectrum_id, energy, round(abs(intensity - intensity2) + CASE WHEN intensity2 = 0 THEN 100.0 ELSE 0.0 END, 6) AS difference, CAST(floor(mass2 * 10000 + 0.5) AS BIGINT) AS fixed_mass FROM outr),
    o AS (SELECT spectrum_id, energy, difference, min(fixed_mass) AS fixed_mass FROM s WHERE difference > 0.1 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, energy ORDER BY difference DESC) AS place FROM o) WHERE place <= 30""",
)
def selected(spark: SparkSession, d: str) -> DataFrame:
    return matching.selected_masses(matching.match_outer(*_sides(spark, d), SIDE, 0.0, TOL), SIDE)


# A ------------------------------------------------------------------------------------------------------------------------------

SCORE_SQL = {
    "dot_product": "CASE WHEN app * aqq > 0 THEN aa * aa / (app * aqq) ELSE 0.0 END", "stein_dot_product": "CASE WHEN spp * sqq > 0 THEN ss * ss / (spp * sqq) ELSE 0.0 END",
    "precision": "100.0 * k / n_q", "recall": "100.0 * k / n_p", "weighted_recall": "100.0 * ip / sum_p", "weighted_precision": "100.0 * iq / sum_q", "weighted_jaccard": "le / (200.0 - le)",
    "jaccard": "1.0 * k / (n_p + n_q - k)", "weighted_dice": "2.0 * le / 200.0", "dice": "2.0 * k / (n_p + n_q)",
}
SCORE_SQL["combined"] = f"100.0 * ({SCORE_SQL['dot_product']}) + 100.0 * ({SCORE_SQL['dice']}) + {SCORE_SQL['weighted_precision']} + {SCORE_SQL['weighted_recall']}"


def tables_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""sp AS (SELECT {k}, count(*) AS n_p, sum(intensity) AS sum_p, sum(intensity * mass) AS app, sum(pow(pow(intensity, 0.6) * pow(mass, 3.0), 2)) AS spp FROM p GROUP BY ALL),
    sq AS (SELECT {k}, count(*) AS n_q, sum(intensity2) AS sum_q, sum(intensity2 * mass2) AS aqq, sum(pow(pow(intensity2, 0.6) * pow(mass2, 3.0), 2)) AS sqq FROM q GROUP BY ALL),
    sm AS (SELECT {k}, count(*) AS k, sum(sqrt(intensity * mass) * sqrt(intensity2 * mass2)) AS aa, sum(pow(intensity, 0.6) * pow(mass, 3.0) * pow(intensity2, 0.6) * pow(mass2, 3.0)) AS ss, sum(intensity) AS ip, sum(intensity2) AS iq, sum(least(intensity, intensity2)) AS le FROM matched GROUP BY ALL),
    st AS (SELECT {", ".join("sp." + x for x in keys)}, n_p, n_q, sum_p, sum_q, app, aqq, spp, sqq, coalesce(k, 0) AS k, coalesce(aa, 0) AS aa, coalesce(ss, 0) AS ss, coalesce(ip, 0) AS ip, coalesce(iq, 0) AS iq, coalesce(le, 0) AS le FROM sp JOIN sq USING ({k}) LEFT JOIN sm USING ({k})),
    sc AS (SELECT {k}, k, {", ".join(f"round({e}, 6) AS {n}" for n, e in SCORE_SQL.items())} FROM st) """


SCORED = MATCH_SQL + ", " + tables_sql(SIDE)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.score(*_sides(spark, d), SIDE, ppm=0.0, abs_tol=TOL)


@register("score_all_wide", SCORED + "SELECT * FROM sc")
def score_all(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


for _name in SCORE_SQL:
    register(f"score_{_name}", SCORED + f"SELECT spectrum_id, energy, {_name} FROM sc")(lambda spark, d, _name=_name: scores.score(*_sides(spark, d), SIDE, [_name], ppm=0.0, abs_tol=TOL).drop("k"))

_NAMES = ["dice", "dot_product", "precision", "recall"]
_REPORT = ", ".join(f"round(avg({n}), 6) AS mean_{n}, round(stddev_pop({n}), 6) AS std_{n}" for n in _NAMES)


@register("score_mean_std_by_energy", SCORED + f"SELECT energy, count(*) AS n, {_REPORT} FROM sc GROUP BY energy")
def score_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return scores.report(_scores(spark, d), _NAMES, ["energy"])


@register("score_totals", SCORED + f"SELECT spectrum_id, {', '.join(f'round(sum({n}) / 3, 6) AS {n}' for n in _NAMES)} FROM sc GROUP BY spectrum_id")
def score_totals(spark: SparkSession, d: str) -> DataFrame:
    return scores.totals(_scores(spark, d), _NAMES, "spectrum_id")


@register("score_rollup", SCORED + "SELECT energy, count(*) AS n, round(avg(dice), 6) AS mean_dice FROM sc GROUP BY ROLLUP (energy)")
def score_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).rollup("energy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dice"), 6).alias("mean_dice"))


@register("score_by_fold", SCORED + "SELECT CAST(o_custkey % 10 AS BIGINT) AS fold, count(*) AS n, round(avg(dice), 6) AS mean_dice, round(avg(CASE WHEN energy = 0 THEN recall END), 6) AS recall_0 FROM sc JOIN orders ON o_orderkey = spectrum_id GROUP BY 1")
def score_by_fold(spark: SparkSession, d: str) -> DataFrame:
    fold = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("spectrum_id"), (F.col("o_custkey") % 10).alias("fold"))
    return _scores(spark, d).join(fold, "spectrum_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dice"), 6).alias("mean_dice"), F.round(F.avg(F.when(F.col("energy") == 0, F.col("recall"))), 6).alias("recall_0"))


# O ------------------------------------------------------------------------------------------------------------------------------

RANK_SQL = f"""one AS (SELECT target_id, cand_id, energy, mass, max(intensity) AS intensity FROM event_peaks GROUP BY ALL),
t AS (SELECT target_id, energy, mass, intensity * 100 / sum(intensity) OVER (PARTITION BY target_id, energy) AS intensity FROM one WHERE cand_id = 'view'),
c AS (SELECT target_id, cand_id, energy, mass AS mass2, intensity * 100 / sum(intensity) OVER (PARTITION BY target_id, cand_id, energy) AS intensity2 FROM one WHERE cand_id <> 'view'),
who AS (SELECT DISTINCT target_id, cand_id FROM c), q AS (SELECT c.* FROM c SEMI JOIN t ON t.target_id = c.target_id AND t.energy = c.energy), p AS (SELECT t.*, cand_id FROM t JOIN (SELECT DISTINCT target_id, cand_id FROM q) USING (target_id)),
cand AS (SELECT target_id, cand_id, energy, mass, intensity, mass2, intensity2 FROM p JOIN q USING (target_id, cand_id, energy) WHERE abs(mass - mass2) < {EVENT_TOL}), {chain_sql(PAIR)}, {tables_sql(PAIR)},
ranked AS (SELECT who.target_id, who.cand_id, round(coalesce(sum(2.0 * k / (n_p + n_q)), 0.0), 6) AS score FROM who LEFT JOIN st USING (target_id, cand_id) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, cand_id) AS place FROM ranked) """


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    one = views.event_peaks(spark, d).groupBy("target_id", "cand_id", "energy", "mass").agg(F.max("intensity").alias("intensity"))
    return one.where("cand_id = 'view'").drop("cand_id"), one.where("cand_id <> 'view'")


RANKED = with_("event_peaks", extra=RANK_SQL, recursive=True)


@register("rank_candidates", RANKED + "SELECT * FROM placed")
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank(*_targets(spark, d), ppm=0.0, abs_tol=EVENT_TOL)


@register("rank_topn", RANKED + "SELECT * FROM placed WHERE place <= 2")
def rank_topn(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank(*_targets(spark, d), ppm=0.0, abs_tol=EVENT_TOL, top=2)


@register("rank_merged")
def rank_merged(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank(*_targets(spark, d), ppm=0.0, abs_tol=EVENT_TOL, merged=True, post=True)


@register("rank_nonempty_energies", with_("event_peaks") + "SELECT DISTINCT target_id, energy, cand_id FROM event_peaks c WHERE cand_id <> 'view' AND EXISTS (SELECT 1 FROM event_peaks t WHERE t.cand_id = 'view' AND t.target_id = c.target_id AND t.energy = c.energy)")
def rank_nonempty(spark: SparkSession, d: str) -> DataFrame:
    return ranking.against_target(*_targets(spark, d))[1].select("target_id", "energy", "cand_id").distinct()


@register("missing_prediction_report", with_("peaks") + "SELECT DISTINCT spectrum_id FROM peaks WHERE source = 'measured' AND spectrum_id NOT IN (SELECT spectrum_id FROM peaks WHERE source = 'predicted')")
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    p = views.peaks(spark, d)
    return ranking.missing(p.where("source = 'measured'"), p.where("source = 'predicted'"), "spectrum_id")


# G and I3 -----------------------------------------------------------------------------------------------------------------------

TL = "tl AS (SELECT *, theta - ln(1 + sum(exp(theta)) OVER (PARTITION BY mol_id, from_id)) AS logp FROM transitions)"


@register("transition_logprob", with_("fragments", "transitions", extra=TL) + "SELECT mol_id, from_id, to_id, round(logp, 6) AS logp FROM tl")
def transition_logprob(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.log_probs(views.transitions(spark, d)).select("mol_id", "from_id", "to_id", "logp"), "logp")


@register("persistence_logprob", with_("fragments", "transitions") + "SELECT f.mol_id, f.frag_id, round(coalesce(-ln(1 + sum(exp(t.theta))), 0.0), 6) AS logp FROM fragments f LEFT JOIN transitions t ON t.mol_id = f.mol_id AND t.from_id = f.frag_id GROUP BY ALL")
def persistence_logprob(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.persistence(views.transitions(spark, d), views.fragments(spark, d)), "logp")


@register("duplicate_edges", with_("fragments", extra="e AS (SELECT mol_id, unnest([frag_id // 2, frag_id // 3]) AS from_id, frag_id AS to_id, unnest([2, 3]) AS how FROM fragments WHERE frag_id > 0)") + "SELECT mol_id, from_id, to_id, how, row_number() OVER (PARTITION BY mol_id, from_id, to_id ORDER BY how) > 1 AS is_duplicate FROM e")
def duplicate_edges(spark: SparkSession, d: str) -> DataFrame:
    f = views.fragments(spark, d).where("frag_id > 0")
    both = f.select("mol_id", F.col("frag_id").alias("to_id"), F.explode(F.array(F.lit(2), F.lit(3))).alias("how")).withColumn("from_id", F.floor(F.col("to_id") / F.col("how")).cast("long"))
    return graph.mark_duplicates(both, F.col("how")).select("mol_id", "from_id", "to_id", "how", "is_duplicate")


REACH = "reach(mol_id, frag_id, depth) AS (SELECT DISTINCT mol_id, CAST(0 AS BIGINT), 0 FROM transitions UNION SELECT r.mol_id, t.to_id, r.depth + 1 FROM reach r JOIN transitions t ON t.mol_id = r.mol_id AND t.from_id = r.frag_id WHERE r.depth < 8), least AS (SELECT mol_id, frag_id, min(depth) AS depth FROM reach GROUP BY ALL)"


@register("reachable_min_depth", with_("fragments", "transitions", extra=REACH, recursive=True) + "SELECT * FROM least")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.min_depth(views.transitions(spark, d))


@register("graph_height", with_("fragments", "transitions", extra=REACH, recursive=True) + "SELECT mol_id, max(depth) + 1 AS height FROM least GROUP BY mol_id")
def graph_height(spark: SparkSession, d: str) -> DataFrame:
    return graph.height(graph.min_depth(views.transitions(spark, d)))


@register("detours_removed", with_("fragments", "transitions", extra=REACH, recursive=True) + "SELECT t.mol_id, from_id, to_id, row_number() OVER (PARTITION BY t.mol_id ORDER BY from_id, to_id) - 1 AS trans_id FROM transitions t JOIN least a ON a.mol_id = t.mol_id AND a.frag_id = from_id JOIN least b ON b.mol_id = t.mol_id AND b.frag_id = to_id WHERE a.depth < b.depth")
def detours(spark: SparkSession, d: str) -> DataFrame:
    t = views.transitions(spark, d)
    return graph.remove_detours(t, graph.min_depth(t)).select("mol_id", "from_id", "to_id", "trans_id")


@register("pruned_expansion", with_("fragments", "transitions", extra=TL + ", grow(mol_id, frag_id, logp, depth) AS (SELECT DISTINCT mol_id, CAST(0 AS BIGINT), 0.0::DOUBLE, 0 FROM transitions UNION ALL SELECT g.mol_id, t.to_id, g.logp + t.logp, g.depth + 1 FROM grow g JOIN tl t ON t.mol_id = g.mol_id AND t.from_id = g.frag_id WHERE g.depth < 3 AND g.logp + t.logp >= -4.0)", recursive=True) + "SELECT mol_id, frag_id, round(max(logp), 6) AS logp FROM grow GROUP BY ALL")
def pruned(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.likely_expansion(views.transitions(spark, d), -4.0, 3), "logp")


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return views.fragments(spark, d).where("theta > 0").select("mol_id", "frag_id")


ANN = "ann AS (SELECT mol_id, frag_id FROM fragments WHERE theta > 0), up(mol_id, frag_id) AS (SELECT DISTINCT mol_id, CAST(0 AS BIGINT) FROM transitions UNION SELECT t.mol_id, t.to_id FROM up JOIN transitions t ON t.mol_id = up.mol_id AND t.from_id = up.frag_id SEMI JOIN ann ON ann.mol_id = t.mol_id AND ann.frag_id = t.to_id)"


@register("direct_path_flags", with_("fragments", "transitions", extra=ANN, recursive=True) + "SELECT DISTINCT mol_id, frag_id FROM up")
def direct(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct_paths(views.transitions(spark, d), _annotated(spark, d))


@register("redundant_prune", with_("fragments", "transitions", extra=ANN + ", down(mol_id, frag_id) AS (SELECT mol_id, frag_id FROM ann ANTI JOIN up ON up.mol_id = ann.mol_id AND up.frag_id = ann.frag_id UNION SELECT t.mol_id, t.from_id FROM down JOIN transitions t ON t.mol_id = down.mol_id AND t.to_id = down.frag_id)", recursive=True) + "SELECT mol_id, frag_id FROM down UNION SELECT mol_id, frag_id FROM ann UNION SELECT DISTINCT mol_id, 0 FROM transitions")
def redundant(spark: SparkSession, d: str) -> DataFrame:
    return graph.needed(views.transitions(spark, d), _annotated(spark, d))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return views.fragments(spark, d).where("theta >= 2").select("mol_id", "frag_id")


ABOVE = "want AS (SELECT mol_id, frag_id FROM fragments WHERE theta >= 2), above(mol_id, target, frag_id, depth) AS (SELECT mol_id, frag_id, frag_id, 0 FROM want UNION SELECT t.mol_id, above.target, t.from_id, above.depth + 1 FROM above JOIN transitions t ON t.mol_id = above.mol_id AND t.to_id = above.frag_id WHERE above.depth < 6)"


@register("path_edges", with_("fragments", "transitions", extra=ABOVE, recursive=True) + "SELECT DISTINCT t.mol_id, t.from_id, t.to_id FROM above JOIN transitions t ON t.mol_id = above.mol_id AND t.to_id = above.frag_id WHERE above.depth < 6")
def path_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths_to(views.transitions(spark, d), _wanted(spark, d))


@register("path_ancestors", with_("fragments", "transitions", extra=ABOVE, recursive=True) + "SELECT mol_id, frag_id AS ancestor, count(DISTINCT target) AS n_targets FROM above WHERE depth > 0 GROUP BY ALL HAVING count(DISTINCT target) > 1")
def path_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return graph.common_ancestors(views.transitions(spark, d), _wanted(spark, d))


@register("edge_sample")
def edge_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.sample_edges(views.transitions(spark, d), 20)


@register("random_walk_sample")
def random_walk_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.random_walks(views.transitions(spark, d), 5)


@register("weighted_walk_sample")
def weighted_walk_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.random_walks(views.transitions(spark, d), 5, weighted=True)
