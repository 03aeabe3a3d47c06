"""Registered queries of root features, lists and text records, with SQL.

The SQL of root features starts from the atoms of five small molecules in their breadth-first order, written down by hand, and computes the layout of
each feature from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import MORE_SYMBOLS, SYMBOLS
from ..operators import root_features
from ..sources import sinks, spectra
from . import views
from .lineage import shared_folder
from .queries import SCORED, register, with_, QUERIES

#: Structure and root atom of the molecules; molecule p_size % 5 of a part is its ion and the next one its neutral loss.
MOLECULES = [("CC(=O)O", 1), ("CCN", 2), ("C#N", 0), ("C1CC1", 0), ("BrCCCl", 1)]
#: (molecule, place, symbol, distance, degree) and (molecule, place, place, bond class) of the same molecules.
ATOMS = "(0, 0, 'C', 0, 3), (0, 1, 'C', 1, 1), (0, 2, 'O', 1, 1), (0, 3, 'O', 1, 1), (1, 0, 'N', 0, 1), (1, 1, 'C', 1, 2), (1, 2, 'C', 2, 1), (2, 0, 'C', 0, 1), (2, 1, 'N', 1, 1), (3, 0, 'C', 0, 2), (3, 1, 'C', 1, 2), (3, 2, 'C', 1, 2), (4, 0, 'C', 0, 2), (4, 1, 'C', 1, 2), (4, 2, 'Br', 1, 1), (4, 3, 'Cl', 2, 1)"
BONDS = "(0, 0, 1, 1), (0, 0, 2, 5), (0, 0, 3, 5), (1, 0, 1, 1), (1, 1, 2, 1), (2, 0, 1, 3), (3, 0, 1, 1), (3, 0, 2, 1), (3, 1, 2, 1), (4, 0, 1, 1), (4, 0, 2, 1), (4, 1, 3, 1)"


def _breaks(spark: SparkSession, d: str) -> DataFrame:
    smiles, root = F.array(*[F.lit(s) for s, _ in MOLECULES]), F.array(*[F.lit(r) for _, r in MOLECULES])
    a, b = F.col("p_size") % 5, (F.col("p_size") + 1) % 5
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), smiles[a].alias("ion"), root[a].alias("ion_root"), smiles[b].alias("nl"), root[b].alias("nl_root"), (F.col("p_size") % 2 == 0).alias("ring_break"))


def _symbols(name: str, known: Iterable[str]) -> str:
    return f"{name}(s, k) AS (VALUES {', '.join(f"('{s}', {k})" for k, s in enumerate((*known, 'X')))})"


def _features_sql(parts: list[tuple[str, int]]) -> str:
    """parts: (SQL of (m, ring, k) set indexes, size) per feature; each feature stands for the ion and then for the neutral loss."""
    ctes = [
        f"atom(m, p, full_s, dist, deg) AS (VALUES {ATOMS})", f"bond(m, i, j, c) AS (VALUES {BONDS})", "side AS (SELECT m, i, j, c FROM bond UNION ALL SELECT m, j, i, c FROM bond)", _symbols("few", SYMBOLS), _symbols("more", MORE_SYMBOLS),
        "folded AS (SELECT atom.*, coalesce(few.k, 5) AS k, coalesce(more.k, 11) AS wide FROM atom LEFT JOIN few ON few.s = full_s LEFT JOIN more ON more.s = full_s)", "ring(r) AS (VALUES (0), (1))",
        "breaks AS (SELECT p_partkey AS id, p_size % 5 AS ion, (p_size + 1) % 5 AS nl, 1 - p_size % 2 AS r FROM part)",
    ]
    got, at = ["SELECT id, 0 AS k FROM breaks"], 1
    for n, (sql, size) in enumerate(parts):
        ctes.append(f"f{n} AS ({sql})")
        for which in ("ion", "nl"):
            got.append(f"SELECT id, {at} + f{n}.k FROM breaks JOIN f{n} ON f{n}.m = {which} AND f{n}.ring = r")
            at += size
    return f"WITH {', '.join(ctes)} SELECT id, list(k ORDER BY k) AS features, {at} AS feature_len, 'ok' AS status FROM ({' UNION ALL '.join(got)}) x(id, k) GROUP BY id"


PAIRS = "SELECT m, r AS ring, 1 + 4 * place + 2 * r + unnest(CASE WHEN n > 1 THEN [0, 1] ELSE [0] END) AS k FROM (SELECT a.m, a.k * 6 + b.k AS place, count(*) AS n FROM folded a JOIN side ON side.m = a.m AND side.i = a.p JOIN folded b ON b.m = a.m AND b.p = side.j WHERE a.p = 0 GROUP BY ALL) CROSS JOIN ring"
TRIPLES = """SELECT m, r AS ring, 1 + 4 * place + 2 * r + unnest(CASE WHEN n > 1 THEN [0, 1] ELSE [0] END) AS k FROM (SELECT a.m, (a.k * 6 + b.k) * 6 + c.k AS place, count(*) AS n
    FROM folded a JOIN side x ON x.m = a.m AND x.i = a.p JOIN folded b ON b.m = a.m AND b.p = x.j JOIN side y ON y.m = a.m AND y.i = b.p AND y.j <> a.p JOIN folded c ON c.m = a.m AND c.p = y.j WHERE a.p = 0 GROUP BY ALL) CROSS JOIN ring
    UNION ALL SELECT m, r, 0 FROM (SELECT DISTINCT m FROM atom) CROSS JOIN ring WHERE m NOT IN (SELECT m FROM atom WHERE dist = 2) AND m NOT IN (SELECT a.m FROM bond a JOIN atom x ON x.m = a.m AND x.p = a.i JOIN atom y ON y.m = a.m AND y.p = a.j WHERE x.dist = 1 AND y.dist = 1)"""


def _matrix(atoms: int, depth: int, bonds: bool = True, wide: bool = False) -> tuple[str, int]:
    there, width = f"p < {atoms} AND dist < {depth}", 12 if wide else 6
    n_bonds = 6 * atoms * (atoms - 1) // 2 if bonds else 0
    sql = [
        f"SELECT m, {n_bonds} + p * {width} + {'wide' if wide else 'k'} AS k FROM folded WHERE {there}", f"SELECT m, {n_bonds + atoms * width} + p * 5 + least(deg, 4) FROM folded WHERE {there}",
        f"SELECT bond.m, (i * {atoms} - i * (i + 1) // 2 + j - i - 1) * 6 + c FROM bond JOIN atom a ON a.m = bond.m AND a.p = i JOIN atom b ON b.m = bond.m AND b.p = j WHERE j < {atoms} AND a.dist < {depth} AND b.dist < {depth}",
    ][: 3 if bonds else 2]
    return f"SELECT m, r AS ring, k FROM ({' UNION ALL '.join(sql)}) x(m, k) CROSS JOIN ring", n_bonds + atoms * (width + 5)


def _generalized(depth: int) -> tuple[str, int]:
    seen = f"SELECT a.m, a.dist AS d, (c - 1) * 6 + b.k AS code, count(*) AS n FROM folded a JOIN side ON side.m = a.m AND side.i = a.p JOIN folded b ON b.m = a.m AND b.p = side.j WHERE a.dist < {depth} GROUP BY ALL"
    return f"SELECT m, r AS ring, unnest(CASE WHEN d > 0 THEN [126 + (d - 1) * 42 + code] WHEN n > 2 THEN [3 * code, 3 * code + 1, 3 * code + 2] WHEN n > 1 THEN [3 * code, 3 * code + 1] ELSE [3 * code] END) AS k FROM ({seen}) CROSS JOIN ring", 126 + (depth - 1) * 42


def _both(*names: str) -> list[str]:
    return [side + n for n in names for side in ("Ion", "NL")]


def _register(name: str, features: list[str], parts: list[tuple[str, int]]) -> None:
    register(name, _features_sql(parts))(lambda spark, d: root_features.root_features(_breaks(spark, d), features))


_register("root_paths", _both("RootPairs", "RootTriples"), [(PAIRS, 145), (TRIPLES, 865)])
_register("root_matrix", _both("RootMatrixFPN6", "RootMatrixFPN6D2", "RootMatrixFPN8", "RootMatrixFPN8D3", "RootMatrixFPN10", "RootMatrixFPN16"), [_matrix(6, 6), _matrix(6, 2), _matrix(8, 8), _matrix(8, 3), _matrix(10, 10), _matrix(16, 16)])
_register("root_matrix_simple", _both("RootMatrixSimpleFPN8D3", "RootMatrixSimpleFPN10", "RootMatrixSimpleFPN16", "RootMatrixSimpleFPN32"), [_matrix(8, 3, False), _matrix(10, 10, False), _matrix(16, 16, False), _matrix(32, 32, False)])
_register("root_matrix_more_symbols", _both("RootMatrixFPN10MoreSymbols", "RootMatrixFPN16MoreSymbols"), [_matrix(10, 10, wide=True), _matrix(16, 16, wide=True)])
_register("root_generalized", _both("RootGeneralizedMatrixFPN8", "RootGeneralizedMatrixFPN10"), [_generalized(8), _generalized(10)])


# Lists and text records ---------------------------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, what: str, lines: DataFrame) -> str:
    path = f"{shared_folder(spark)}/ionmill-{what}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _list_lines(spark: SparkSession, d: str, *more) -> DataFrame:
    rows = views.table(spark, d, "part")
    count = spark.createDataFrame([("2000",)], "value string")
    return count.unionByName(rows.select(F.concat_ws(" ", F.concat(F.lit("mol"), F.col("p_partkey").cast("string")), F.concat(F.lit("C"), F.repeat(F.lit("C"), F.col("p_size") % 7)), *more).alias("value")))


_LIST = "'mol' || p_partkey AS {id}, 'C' || repeat('C', (p_size % 7)::INT) AS structure"


@register("training_list", f"SELECT {_LIST.format(id='mol_id')}, p_size % 10 AS cv_group FROM part")
def training_list(spark: SparkSession, d: str) -> DataFrame:
    return spectra.training_list(spark, _written(spark, "list", _list_lines(spark, d, (F.col("p_size") % 10).cast("string"))))


@register("predict_list", f"SELECT {_LIST.format(id='cand_id')} FROM part")
def predict_list(spark: SparkSession, d: str) -> DataFrame:
    return spectra.predict_list(spark, _written(spark, "list", _list_lines(spark, d)))


@register("precomputed_list", f"SELECT {_LIST.format(id='cand_id')}, 'lib' || p_size % 3 || '.msp' AS spectrum_ref FROM part")
def precomputed_list(spark: SparkSession, d: str) -> DataFrame:
    return spectra.precomputed_list(spark, _written(spark, "list", _list_lines(spark, d, F.concat(F.lit("lib"), (F.col("p_size") % 3).cast("string"), F.lit(".msp")))))


@register("candidate_spectra", f"WITH l AS (SELECT {_LIST.format(id='cand_id')}, 'lib' || p_size % 3 AS lib, CAST(p_partkey AS VARCHAR) AS ref FROM part), " + views.SQL["peaks"] + " SELECT cand_id, structure, lib, spectrum_id, energy, mass, intensity FROM l JOIN peaks ON CAST(spectrum_id AS VARCHAR) = ref AND 'lib' || spectrum_id % 3 = lib AND source = 'predicted'")
def candidate_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that name a library and a record of it."""
    lines = _list_lines(spark, d, F.concat(F.lit("lib"), (F.col("p_size") % 3).cast("string"), F.lit(":"), F.col("p_partkey").cast("string")))
    listed = spectra.precomputed_list(spark, _written(spark, "list", lines))
    library = views.peaks(spark, d).where("source = 'predicted'").drop("source").withColumn("lib", F.concat(F.lit("lib"), (F.col("spectrum_id") % 3).cast("string")))
    return spectra.candidate_spectra(listed, library)


@register("fragment_text", with_("fragments") + "SELECT mol_id, frag_id, printf('%d %.5f %s', frag_id, mass, 'CO') AS value FROM fragments")
def fragment_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.fragment_text(views.fragments(spark, d).withColumn("ion_smiles", F.lit("CO")))


@register("score_report", SCORED + "SELECT spectrum_id, energy, spectrum_id || chr(9) || energy || chr(9) || printf('%.6f', dice) || chr(9) || printf('%.6f', recall) AS value FROM sc")
def score_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.report_text(QUERIES["score_all_wide"](spark, d), ["dice", "recall"])


SHOWN = "shown AS (SELECT spectrum_id, energy, mass, floor(intensity / max(intensity) OVER (PARTITION BY spectrum_id, energy) * 100 * 100 + 0.5) / 100.0 AS shown FROM peaks WHERE source = 'measured'), line AS (SELECT spectrum_id, energy, mass, printf('%.5f', mass) AS m, printf('%.2f', shown) AS i, m || ' ' || i AS line FROM shown WHERE shown > 0), body AS (SELECT spectrum_id, energy, string_agg(line, chr(10) ORDER BY mass, line) AS lines FROM line GROUP BY ALL)"


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return views.peaks(spark, d).where("source = 'measured'").drop("source")


@register("peak_text", with_("peaks", extra=SHOWN) + "SELECT spectrum_id, string_agg('energy' || energy || chr(10) || lines, chr(10) ORDER BY energy) AS value FROM body GROUP BY spectrum_id")
def peak_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.peak_text(_measured(spark, d))


@register("mgf_records", with_("peaks", extra=SHOWN) + "SELECT spectrum_id, energy, 'BEGIN IONS' || chr(10) || 'PEPMASS=500.000000' || chr(10) || 'CHARGE=1+' || chr(10) || 'TITLE=' || spectrum_id || ';Energy' || energy || ';+ve in-silico MS/MS by ionmill;' || chr(10) || lines || chr(10) || 'END IONS' AS value FROM body")
def mgf_records(spark: SparkSession, d: str) -> DataFrame:
    return sinks.mgf_records(_measured(spark, d), F.lit(500.0))


@register("msp_roundtrip", with_("peaks", extra=SHOWN) + "SELECT CAST(spectrum_id AS VARCHAR) AS spectrum_id, energy, CAST(m AS DOUBLE) AS mass, CAST(i AS DOUBLE) AS intensity FROM line")
def msp_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Measured peaks written as a library and read again."""
    return spectra.msp(spark, _written(spark, "msp", sinks.msp_records(_measured(spark, d)).select("value")))


@register("graph_text", with_("fragments", "transitions") + "SELECT mol_id, 0 AS part, frag_id AS place, printf('%d %.5f %s', frag_id, mass, 'C') AS value FROM fragments UNION ALL SELECT mol_id, 1, from_id * 1000000 + to_id, printf('%d %d %s', from_id, to_id, 'O') FROM transitions")
def graph_text(spark: SparkSession, d: str) -> DataFrame:
    f = views.fragments(spark, d).withColumn("ion_smiles", F.lit("C"))
    return sinks.graph_text(f, views.transitions(spark, d).withColumn("nl_smiles", F.lit("O")))


@register("peak_list_sections", with_("peaks", extra=SHOWN + ", level AS (SELECT *, dense_rank() OVER (PARTITION BY spectrum_id ORDER BY energy) - 1 AS place FROM line)") + "SELECT CAST(spectrum_id AS VARCHAR) AS spectrum_id, place AS energy, 'measured' AS source, CAST(m AS DOUBLE) AS mass, CAST(i AS DOUBLE) AS intensity FROM level")
def peak_list_sections(spark: SparkSession, d: str) -> DataFrame:
    """S1 over the text that K5 writes: sections are numbered in their order."""
    return spectra.peak_sections(sinks.peak_text(_measured(spark, d)).select(F.col("spectrum_id").cast("string").alias("spectrum_id"), "value"))
