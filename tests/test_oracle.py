"""Every registered query against its SQL on the small tables."""

import re

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Training-data operators that SQL cannot express have tests of their own.
WITHOUT_SQL = {n for n in QUERIES if re.match(r"op\d+_|pipeline$", n)} - set(ORACLES)
# Nothing to report on ten nodes: these are compared on a hundred.
SPARSE = {
    "dead_node_impact", "index_conflicts", "load_extremes", "missing_indexes", "remove_candidates", "shrink_by_index", "shrink_by_load",
}


@pytest.fixture(scope="module")
def duck():
    return {path: oracle.connect(path) for path in (SF_DIR, LARGER)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_matches_sql(spark, duck, name):
    path = LARGER if name in SPARSE else SF_DIR
    ok, rows, _, note = oracle.check(spark, duck[path], name, QUERIES[name], ORACLES.get(name), path)
    assert ok is True, note or "no SQL"
    assert rows > 0, "nothing was compared"


def test_every_verdict_occurs(spark):
    got = {r.verdict for r in QUERIES["address_conflicts"](spark, SF_DIR).select("verdict").distinct().collect()}
    assert got == {"keep", "mark offline", "removable", "ambiguous"}


def test_one_query_with_code_generation(spark):
    """The other tests run without it, to compile less."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        for name in ("node_brief", "reconcile_reports", "membership_consistency"):
            want = sorted(map(str, QUERIES[name](spark, SF_DIR).collect()))
            spark.conf.set("spark.sql.codegen.wholeStage", "false")
            assert sorted(map(str, QUERIES[name](spark, SF_DIR).collect())) == want
            spark.conf.set("spark.sql.codegen.wholeStage", "true")
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
