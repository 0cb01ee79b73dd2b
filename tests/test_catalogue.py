"""Registered queries against their SQL in DuckDB, plain and divided."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, plain
from stintwise.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()
PLAIN = ["a1_mapped_rows", "a11_inventory_reconcile", "b2_recorder_fields", "b12_sequence_index", "c1_record_contract",
         "c19_region_coverage", "c22_text_scan_documents", "d3_concept_availability", "d6_computations", "f28_recomputed_values", "f6_attrition_funnel", "f18_pairing",
         "f24_comparability_status", "g14_percentile_interval", "g26_sufficiency", "h7_export_references", "i5_readiness"]
DIVIDED = ["b12_sequence_index", "c19_region_coverage", "c21_block_binding", "c21_block_rules", "c5_c7_temporal_flags", "d4_summary_by_lap", "d6_computations", "f17_order_index", "g8_dispersion_ratio",
           "g13_bootstrap_median", "g18_benjamini_hochberg", "h1_lifecycle_edges", "i3_claims_versus_inventory"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def compare(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = oracle.sql(ORACLE[name])
    names = rel.columns
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE) and len(catalogue.QUERIES) > 100
    assert set(catalogue.QUERIES) <= set(QUERIES) and set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", PLAIN)
def test_plain(spark, oracle, name):
    compare(spark, oracle, name)


@pytest.mark.parametrize("name", DIVIDED)
def test_divided(spark, oracle, name):
    spark.conf.set("stintwise.rowsPerTask", "100")
    try:
        compare(spark, oracle, name)
    finally:
        spark.conf.unset("stintwise.rowsPerTask")
