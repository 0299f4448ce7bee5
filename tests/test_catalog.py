"""Queries against their SQL on the smallest test data, and the driver's entry points."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = ["date_buckets", "entity_page", "entity_graph", "dashboard", "session_briefing", "reco_candidates", "neighbors_1hop", "sanitize", "search_or_fallback", "all_seeds", "strata_sample", "turn_dedupe", "ledger_decision", "pair_islands", "lookback", "fact_history", "hub_edges", "bfs_hops", "path_walk", "reco_top3", "workspaces_rich", "term_scores", "rrf_fusion", "subject_feed", "upsert_latest", "chunking"]


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in ("workspaces", "episodes", "turns", "entities", "entity_hints", "fact_hints", "embeddings", "memory_vectors"):
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return out


def cells(rows):
    plain = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(repr([plain(x) for x in row]) for row in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER)
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    rows = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    assert cells([[r[c] for c in columns] for r in got.collect()]) == cells([[r[c] for c in columns] for r in rows])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
