"""Every query that has SQL gives the SQL's rows."""

import pytest
from compare import normal, oracle

from keyloom import dialect_queries, problems

SQL = dialect_queries.oracle_sql() | problems.oracle_sql()
QUERIES = dialect_queries.queries() | problems.queries()


@pytest.fixture(scope="module")
def con(small):
    return oracle(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, small, name):
    df = QUERIES[name](spark, small)
    rel = con.execute(SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(rel.fetchall(), columns)


REPORTS = {}


def report(name):
    REPORTS[name] = lambda f: f
    return lambda f: REPORTS.__setitem__(name, f)


@report("p2_filter")
def _(rows, con):
    (r,) = rows
    n, missing = con.execute(f"WITH {problems.ORPHANS} SELECT count(*), count(*) FILTER (orphan_kind = 'missing') FROM orphans").fetchone()
    assert r.n_postings == r.n_proven + r.n_verified == n
    assert r.n_proven + r.n_let_through == missing and r.n_let_through <= 0.05 * missing


@report("p3_error_rate")
def _(rows, con):
    (r,) = rows
    assert (r.n_keys, r.n_new) == con.execute(SQL["p3_asked"]).fetchone()
    assert r.n_new > 0 and r.wrong_rate == r.n_wrong / r.n_new <= r.rate_bound == 0.01


@report("p3_chain_layers")
def _(rows, con):
    keys = con.execute("SELECT count(*) FROM (SELECT DISTINCT keyspace_id, key_value FROM key_version WHERE keyspace_id IS NOT NULL AND key_value IS NOT NULL)").fetchone()[0]
    assert 0.98 * keys <= sum(r.n_keys for r in rows) <= keys
    assert all(0 < r.fill < 0.6 and r.n_keys <= r.capacity and r.compounded < 0.01 for r in rows)


@report("p3_stored_filters")
def _(rows, con):
    assert len(rows) == con.execute("SELECT count(*) FROM sstable").fetchone()[0]
    assert sum(r.filter_state == "none" for r in rows) == con.execute("SELECT count(*) FROM sstable WHERE bloom_filter IS NULL").fetchone()[0]
    assert {r.filter_state for r in rows} <= {"ok", "none", "cut", "damaged"} and all((r.n_set is None) == (r.filter_state != "ok") for r in rows)


@report("p6_replaced")
def _(rows, con):
    first, second = sorted(rows)
    assert first.n_replaced == first.n_recomputed == first.n_units > 0
    assert 0 < second.n_replaced <= second.n_recomputed <= second.n_units


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_reports(spark, con, small, name):
    REPORTS[name](QUERIES[name](spark, small).collect(), con)


def test_all_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
