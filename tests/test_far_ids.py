"""Queries against their SQL over ids far beyond sf0.1: times pass the expiries, and commits of different documents meet."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from recallframe.operators import lifecycle

SF = "/root/testdata/sf0.001"
#: A multiple of 4 * 100,003, so that copies of a document share scope, topic and commit, and end in different digits.
SHIFT = 151 * 400_012


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Three copies of the documents and labels of sf0.001, the largest ids first."""
    d = tmp_path_factory.mktemp("far")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        rows = f"SELECT * FROM '{path}'"
        if name in ("documents", "labels"):
            rows = f"SELECT * REPLACE (doc_id + k * {SHIFT} AS doc_id) FROM '{path}', (SELECT unnest([0, 1, 2]) AS k) ORDER BY doc_id DESC"
        con.execute(f"COPY ({rows}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return str(d), con


def both(spark, far, name, sql):
    d, con = far
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")  # as over many rows, which one task doesn't sort by id before they are placed
    try:
        got = entry.queries()[name](spark, d).select(*columns).collect()
    finally:
        spark.conf.unset(merged)
    return sorted(map(str, map(tuple, got))), sorted(map(str, want.fetchall()))


def by_id(name):
    """The query's SQL, with approvals of one commit by id: its ORDER BY leaves them open, and DuckDB orders them anew in each run."""
    return entry.oracle_sql()[name].replace("ORDER BY commit_seq", "ORDER BY commit_seq, id")


def test_candidate_violations(spark, far):
    got, want = both(spark, far, "candidate_violations", entry.oracle_sql()["candidate_violations"])
    assert want and got == want


def test_card_versions(spark, far):
    got, want = both(spark, far, "card_versions", by_id("card_versions"))
    assert want and got == want


def test_versions_of_one_commit(spark):
    """Approvals of one commit are in the order of ids, whichever way the rows come in."""
    ids = [f"c{i:02}" for i in range(40)]
    for order in (ids, ids[::-1]):
        c = spark.createDataFrame([("t", "u", i, "k", "", "", "", "", 5) for i in order], "tenant_id string, user_id string, id string, kind string, category string, memory_key string, person string, relationship string, created_us long")
        r = spark.createDataFrame([("t", "u", i, "approve", 5, 1) for i in order], "tenant_id string, user_id string, candidate_id string, decision string, reviewed_us long, commit_seq long")
        got = lifecycle.card_versions(c, r, spark.createDataFrame([], "tenant_id string, user_id string, commit_seq long")).orderBy("version").collect()
        assert [x.id for x in got] == ids


def test_timeline_queries(spark, far):
    got, want = both(spark, far, "timeline_queries", by_id("timeline_queries"))
    assert want and got == want


def test_what_is_seen_after_one_commit(spark):
    """Of versions of one commit a query sees the last, whichever way they are read."""
    versions = [("t", "u", f"c{i:02}", "key", i + 1, 0, 1, None) for i in range(40)]
    q = spark.createDataFrame([("q", "t", "u", 2, 0)], "query_id string, tenant_id string, user_id string, seq long, at_us long")
    e = spark.createDataFrame([], "tenant_id string, user_id string, commit_seq long")
    for order in (versions, versions[::-1]):
        v = spark.createDataFrame(order, "tenant_id string, user_id string, id string, identity_key string, version int, erasure_epoch long, commit_seq long, expires_us long")
        assert [(r.id, r.version) for r in lifecycle.replay_queries(q, v, e).collect()] == [("c39", 40)]


def test_uniqueness_violations(spark, far):
    got, want = both(spark, far, "uniqueness_violations", by_id("uniqueness_violations"))
    assert {r.split("'")[1] for r in want} == {"one_active", "one_of_version", "one_of_candidate", "one_serving"} and got == want
