"""Registered queries against their SQL, on the smallest tables.

By default a selection over all groups runs; ``TREMOR_ALL=1`` runs every query (about fifteen
minutes), as ``tools/check.py`` does at any scale.
"""
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tremor.sources.projection import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

QUICK = ["A03_read_graph_edges", "A10_snapshot", "B07_normalize_dep_name", "B08_classify_file_roles", "B11_annotate_edges", "C02_propagate_ctor_types", "C09_facts_from_graph",
         "C12_page_text", "D01_dedupe_nodes", "D02_dedupe_edges", "D12_graph_fingerprint", "D13_communities", "E02_quality_reasons", "E17_explain_edges", "F01_parse_diffs",
         "G01_snapshot_diff", "G02_fact_diff", "H08_judge_hypotheses", "I02_distinct_calls", "J20_dataflow_facts", "J26_chain_quality", "K03_normalize_routes", "K13_match_routes",
         "K14_match_templates", "L01_active_rules", "L14_rule_standard", "L21_doc_changes", "M05_compare_expected", "S01_stream_file_changes"]
CHOSEN = sorted(QUERIES) if os.environ.get("TREMOR_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["E15_direct_neighbours", "E16_query_diagnostics"])
def test_neighbours_need_no_walk(spark, monkeypatch, name):
    """edges at the asked nodes are met directly, without paths."""
    from tremor.operators import impact

    monkeypatch.setattr(impact, "walk", lambda *_: pytest.fail("walked"))
    assert QUERIES[name](spark, SF).limit(1).count() == 1
