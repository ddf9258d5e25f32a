"""The driver's contract, and queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from graphband import queries as core
from graphband import queries_graph, queries_multilevel, queries_study

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(core.queries()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


KNOWN = core.queries() | queries_multilevel.queries() | queries_graph.queries() | queries_study.queries()
SQL = core.oracle_sql() | queries_multilevel.oracle_sql() | queries_graph.oracle_sql() | queries_study.oracle_sql()


@pytest.mark.parametrize("name", ["locality_before_after", "band_curve_100", "hem_mutual_round", "move_gain_cut", "independent_moves", "qubo_energy", "stage_durations", "usage_by_unit", "permutation_check", "lattice_m", "kpi_summary", "case_product", "config_validation", "telemetry_extract", "graph_components", "component_levels", "visit_matching_sorted", "boundary_colours", "admitted_moves"])
def test_against_sql(spark, con, name):
    got, want = KNOWN[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    as_rows = lambda f: sorted(map(str, f[cols].itertuples(index=False, name=None)))
    assert [x.replace("nan", "None") for x in as_rows(got.astype(object))] == [x.replace("nan", "None") for x in as_rows(want.astype(object))]


def test_refinement_lowers_the_cut(spark):
    row = core.refined_cut(spark, SF).first()
    assert row["after"] <= row["before"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
