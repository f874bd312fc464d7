"""Queries do the whole job: every part of the table is read, at every size."""

import pytest
from compare import oracle

from keyloom import dialect_queries

LARGER = "/root/testdata/sf0.01"
QUERIES, SQL = dialect_queries.queries(), dialect_queries.oracle_sql()


def test_postings_as_of_read_every_index_at_every_size(spark, small):
    shares = []
    for d in (small, LARGER):
        con = oracle(d)
        e = "(SELECT keyspace_id, unnest(entries, recursive := true) FROM posting_list) WHERE primary_key IS NOT NULL AND is_present"
        wanted = {r[0] for r in con.execute(f"SELECT DISTINCT keyspace_id FROM {e}").fetchall()}
        found = QUERIES["posting_as_of"](spark, d)
        assert {r[0] for r in found.select("keyspace_id").distinct().collect()} == wanted
        shares.append(found.count() / con.execute(f"SELECT count(DISTINCT (keyspace_id, index_value, primary_key)) FROM (SELECT keyspace_id, index_value, unnest(entries, recursive := true) FROM posting_list) WHERE primary_key IS NOT NULL AND is_present").fetchone()[0])
    assert shares[0] == pytest.approx(shares[1], rel=0.2)


@pytest.mark.parametrize(("name", "column", "nulls_first"), [("sort_nulls", "series", True), ("sort_nulls_desc", "fps", False)])
def test_sorts_give_all_documents_and_their_nulls(spark, small, name, column, nulls_first):
    con = oracle(small)
    rows = [tuple(r) for r in QUERIES[name](spark, small).collect()]
    # In order, which the comparison of sets of rows does not look at.
    assert rows == [tuple(r) for r in con.execute(SQL[name]).fetchall()]
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    n = con.execute(f"SELECT count(*) FROM documents WHERE {column} IS NULL").fetchone()[0]
    assert 0 < n < len(rows)
    assert all(v is None for _, v in (rows[:n] if nulls_first else rows[-n:]))


def test_whole_posting_lists_are_in_order(spark, small):
    rows = sorted(tuple(r) for r in QUERIES["posting_list_merge"](spark, small).collect())
    lists: dict[str, list] = {}
    for status, place, key in rows:
        lists.setdefault(status, []).append(key)
        assert place == len(lists[status])
    assert lists == {s: sorted(k) for s, k in oracle(small).execute("SELECT o_orderstatus, list(o_orderkey) FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ALL").fetchall()}


def test_the_snapshot_of_events_sees_the_same_share_at_every_size(spark, small):
    for d in (small, LARGER):
        con = oracle(d)
        last = con.execute("SELECT max(event_id) * 3 // 4 FROM events").fetchone()[0]
        n, seen = con.execute(f"SELECT count(*), count(*) FILTER (event_id <= {last}) FROM events").fetchone()
        assert seen / n == pytest.approx(0.75, rel=0.01)
        rows = {tuple(r) for r in QUERIES["snapshot_visibility"](spark, d).select("user_id", "event_type", "value").collect()}
        assert rows == {tuple(r) for r in con.execute(f"SELECT user_id, event_type, value FROM ({SQL['snapshot_visibility']})").fetchall()}


@pytest.mark.parametrize("name", ["merge_union", "merge_intersection"])
def test_set_operations_grow_with_the_table(spark, name):
    small, large = (QUERIES[name](spark, d).count() for d in (LARGER, "/root/testdata/sf0.1"))
    assert large > 5 * small > 0
