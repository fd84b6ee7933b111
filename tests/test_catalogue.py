"""Registered queries against their DuckDB twins, over the smallest tables; the driver compares all of them over larger ones."""

import os

import duckdb
import pytest

from roadweave.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ("road_candidates", "road_edges", "road_edges_one_to_one", "road_symmetric", "road_route_costs", "road_route_members", "road_lattice", "road_claim_atoms", "road_lattice_figures", "match_dag_costs", "match_dag_long", "match_dag_summary", "match_points_one_to_one", "distance_thresholds", "network_endpoints")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, got.fetchall()))


def test_streets_have_junctions(spark):
    """Forks, merges, a block and a stub reach the registered queries: pairs of every relation and cardinality."""
    rows = QUERIES["road_symmetric"](spark, SF).collect()
    assert {r.relation for r in rows} == {"1:1", "split", "merge"} and {"1:1", "1:N_SPLIT", "N:1_MERGE", "N:M_COMPLEX"} & {r.cardinality for r in rows} >= {"1:N_SPLIT", "N:1_MERGE"}
    assert max(r.n_dest for r in QUERIES["road_dag"](spark, SF).collect()) > 1
