"""The driver's contract: names, columns and SQL fit together on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ionmill.plans import queries as base

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the supplied tables")
SAMPLE = ["spectrum_normalize", "spectrum_postprocess", "spectrum_clean", "band_join_ppm", "band_semi_explained", "match_full_outer", "score_all_wide", "rank_topn", "redundant_prune", "beliefs_norm", "gradient_linear", "adam_step", "adadelta_step", "adamw_step", "adabelief_step", "root_paths", "root_matrix", "root_matrix_simple", "root_matrix_more_symbols", "root_generalized", "training_list", "predict_list", "precomputed_list", "candidate_spectra", "fragment_text", "score_report", "peak_text", "mgf_records", "msp_roundtrip", "graph_text", "peak_list_sections"]


def test_names():
    assert len(base.QUERIES) >= 50 and set(entry.oracle_sql()) <= set(entry.queries()) and set(base.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    df, want = entry.queries()[name](spark, DIR), con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(want.select(*cols).fetchall(), key=key)
