"""Registered queries against their oracles on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyproof.plans import registry

DATA = "/root/testdata/sf0.001"
FAST = ["table_atoms", "merge_atoms", "relation_edges", "conflict_arbitration", "greedy_packing", "correction_routing", "premise_options", "pin_assignment", "restatement_repair", "unrepaired_years", "value_conflicts", "chain_edges", "reachability", "pair_gate", "stage_history", "verdict_lookup", "response_contract", "splice_guard", "consensus_entries"]


def _rows(rows):
    def plain(v):
        return "~" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    assert _rows(tuple(r) for r in df.select(columns).collect()) == _rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_reachability_starts_from_every_source(spark):
    test_query_matches_oracle(spark, "reachability_every_source")
    seeds = registry.QUERIES["reachability_every_source"](spark, DATA).filter("depth = 0").count()
    assert seeds == registry.QUERIES["edge_union"](spark, DATA).filter("confidence = 0.9D").count()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
