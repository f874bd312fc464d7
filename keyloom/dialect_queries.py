"""Queries of the SQL dialect over a data folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.engine import Engine, KeyValues, Session, versions
from keyloom.engine.transactions import Transaction
from keyloom.operators import merging, postings
from keyloom.sources.shared import shared_path
from keyloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "nation": "n_nationkey", "region": "r_regionkey", "lineitem": "l_orderkey"}


def session(spark: SparkSession, d: str, *tables: str) -> Session:
    """A new database with tables of the data folder. ``lineitem`` has no unique key and is for reading only."""
    engine = Engine(spark, shared_path(spark, "db"))
    s = engine.session()
    s.sql("CREATE DATABASE main;")
    for t in tables:
        engine.register_parquet("main", t, f"{d}/{t}.parquet", KEYS[t])
    s.use("main")
    return s


def _read(table: str, statement: str, *before: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = session(spark, d, table)
        for x in before:
            s.sql(x)
        return s.sql(statement).data

    return run


#: name -> (table, statement of the dialect, statements before it, SQL)
READS: dict[str, tuple[str, str, list[str], str]] = {
    "full_scan": ("nation", "SELECT * FROM nation;", [], "SELECT * FROM nation"),
    "project_columns": ("customer", "SELECT c_name, c_acctbal FROM customer;", [], "SELECT c_name, c_acctbal FROM customer"),
    "flagship": (
        "customer", 'SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100.0 + 50.0 AND c_mktsegment == "FURNITURE" ORDER BY c_acctbal DESC LIMIT 10;', [],
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 150 AND c_mktsegment = 'FURNITURE' ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    ),
    "pk_exact": ("orders", "SELECT * FROM orders WHERE o_orderkey == 42;", [], "SELECT * FROM orders WHERE o_orderkey IS NOT DISTINCT FROM 42"),
    "pk_range": ("orders", "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200;", [], "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    "pk_range_open": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000;", [], "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000"),
    "pk_range_merged": ("orders", "SELECT * FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 900 AND o_orderkey >= 200 AND o_orderkey < 5000;", [], "SELECT * FROM orders WHERE o_orderkey BETWEEN 200 AND 900"),
    "pk_range_empty": ("orders", "SELECT * FROM orders WHERE o_orderkey > 200 AND o_orderkey < 100;", [], "SELECT * FROM orders WHERE false"),
    "key_seek": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 500 LIMIT 25;", [], "SELECT o_orderkey FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 25"),
    "secondary_exact": ("customer", 'SELECT * FROM customer WHERE c_mktsegment == "FURNITURE";', ["CREATE INDEX ON customer (c_mktsegment);"], "SELECT * FROM customer WHERE c_mktsegment = 'FURNITURE'"),
    "secondary_exact_covering": ("customer", 'SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment == "FURNITURE";', ["CREATE INDEX ON customer (c_mktsegment);"], "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'FURNITURE'"),
    "secondary_range": ("customer", "SELECT * FROM customer WHERE c_acctbal > 9000.0 AND c_acctbal <= 9500.0;", ["CREATE INDEX ON customer (c_acctbal);"], "SELECT * FROM customer WHERE c_acctbal > 9000 AND c_acctbal <= 9500"),
    "index_seek": ("customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000.0;", ["CREATE INDEX ON customer (c_acctbal);"], "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000"),
    "compound_or_and": (
        "customer", 'SELECT * FROM customer WHERE (c_custkey == 1 OR c_mktsegment == "FURNITURE") AND (c_custkey == 2 OR c_nationkey == 3);', ["CREATE INDEX ON customer (c_mktsegment);"],
        "SELECT * FROM customer WHERE (c_custkey = 1 OR c_mktsegment = 'FURNITURE') AND (c_custkey = 2 OR c_nationkey = 3)",
    ),
    "filter_arith": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice * (1.0 - l_discount) > 50000.0;", [], "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice * (1::double - l_discount) > 50000::double"),
    "const_fold": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (1.0 + 3.0) * 25000.0;", [], "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000"),
    "unary_minus": ("customer", "SELECT c_custkey, c_acctbal FROM customer WHERE -c_acctbal > 500.0 OR -(c_custkey + 1) == -8;", [], "SELECT c_custkey, c_acctbal FROM customer WHERE -c_acctbal > 500 OR c_custkey = 7"),
    "int_div": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderkey / 7 == 100 OR -o_orderkey / 7 == -20;", [], "SELECT o_orderkey FROM orders WHERE o_orderkey // 7 = 100 OR -o_orderkey // 7 = -20"),
    "int_add_sub": ("part", "SELECT p_partkey FROM part WHERE p_size + 2 - p_size * 3 < 0 - 90;", [], "SELECT p_partkey FROM part WHERE p_size + 2 - p_size * 3 < -90"),
    "cmp_lt": ("customer", "SELECT c_custkey FROM customer WHERE c_acctbal < 100.0;", [], "SELECT c_custkey FROM customer WHERE c_acctbal < 100"),
    "cmp_le": ("part", "SELECT p_partkey FROM part WHERE p_size <= 10;", [], "SELECT p_partkey FROM part WHERE p_size <= 10"),
    "cmp_gt": ("part", "SELECT p_partkey FROM part WHERE p_size > 40;", [], "SELECT p_partkey FROM part WHERE p_size > 40"),
    "cmp_ge": ("supplier", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0.0;", [], "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0"),
    "cmp_eq": ("part", "SELECT p_partkey FROM part WHERE p_size == 7;", [], "SELECT p_partkey FROM part WHERE p_size = 7"),
    "cmp_ne": ("events", 'SELECT event_id FROM events WHERE event_type != "click";', [], "SELECT event_id FROM events WHERE event_type <> 'click'"),
    "cmp_string": ("part", 'SELECT p_partkey, p_brand FROM part WHERE p_brand >= "Brand#3" AND p_brand < "Brand#5";', [], "SELECT p_partkey, p_brand FROM part WHERE p_brand >= 'Brand#3' AND p_brand < 'Brand#5'"),
    "cmp_columns": ("documents", "SELECT doc_id FROM documents WHERE n_chars > duration_ms / 100;", [], "SELECT doc_id FROM documents WHERE n_chars > duration_ms // 100"),
    "null_eq": ("documents", "SELECT doc_id, lang, series FROM documents WHERE lang == series;", [], "SELECT doc_id, lang, series FROM documents WHERE lang IS NOT DISTINCT FROM series"),
    "null_ne": ("documents", 'SELECT doc_id, lang FROM documents WHERE lang != "en";', [], "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'"),
    "null_cmp": ("documents", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1500;", [], "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1500"),
    "null_and_or": ("documents", 'SELECT doc_id FROM documents WHERE (episode > 10 OR lang == "es") AND n_chars < 2500 OR episode + 1 == 3;', [], "SELECT doc_id FROM documents WHERE ((episode > 10 OR lang IS NOT DISTINCT FROM 'es') AND n_chars < 2500) OR (episode + 1) IS NOT DISTINCT FROM 3"),
    "sort_asc": ("customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal;", [], "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey"),
    "sort_desc": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC;", [], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"),
    "sort_nulls": ("documents", "SELECT doc_id, series FROM documents ORDER BY series;", [], "SELECT doc_id, series FROM documents ORDER BY series ASC NULLS FIRST, doc_id"),
    "sort_nulls_desc": ("documents", "SELECT doc_id, fps FROM documents ORDER BY fps DESC;", [], "SELECT doc_id, fps FROM documents ORDER BY fps DESC NULLS LAST, doc_id"),
    "reverse_pk": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC;", [], "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC"),
    "topn": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 20;", [], "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 20"),
    "topn_desc": ("orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC LIMIT 20;", [], "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"),
    "limit_pk": ("supplier", "SELECT * FROM supplier LIMIT 7;", [], "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 7"),
    "limit_where": ("supplier", "SELECT s_suppkey FROM supplier LIMIT 5 WHERE s_acctbal > 0.0;", [], "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 5"),
    "limit_zero": ("supplier", "SELECT * FROM supplier LIMIT 0;", [], "SELECT * FROM supplier WHERE false"),
    "update_expr": (
        "part", "SELECT p_partkey, p_size, p_retailprice FROM part;", ["UPDATE part SET p_retailprice = p_retailprice * 1.5, SET p_size = p_size + 1 WHERE p_size > 25;"],
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN p_retailprice * 1.5::double ELSE p_retailprice END AS p_retailprice FROM part",
    ),
    "update_to_null": ("documents", "SELECT doc_id, duration_ms FROM documents;", ["UPDATE documents SET duration_ms = n_chars * 10;"], "SELECT doc_id, coalesce(n_chars * 10, duration_ms) AS duration_ms FROM documents"),
    "upsert_merge": (
        "supplier", "SELECT * FROM supplier;", ["INSERT INTO supplier (s_suppkey, s_acctbal) VALUES (3, -1.5);", 'INSERT INTO supplier (s_suppkey, s_name) VALUES (1000000, "new");'],
        "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey = 3 THEN -1.5::double ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT 1000000, 'new', NULL, NULL",
    ),
    "delete_where": ("events", "SELECT event_id, event_type FROM events;", ['DELETE FROM events WHERE event_type == "error" OR user_id < 20;'], "SELECT event_id, event_type FROM events WHERE NOT (event_type = 'error' OR user_id < 20)"),
    "delete_limit": ("orders", "SELECT o_orderkey FROM orders;", ["DELETE FROM orders LIMIT 10 WHERE o_totalprice > 1000.0;"], "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 10)"),
    "delete_insert": (
        "supplier", "SELECT * FROM supplier;", ["DELETE FROM supplier WHERE s_suppkey == 2;", 'INSERT INTO supplier (s_suppkey, s_name) VALUES (2, "again");'],
        "SELECT s_suppkey, CASE WHEN s_suppkey = 2 THEN 'again' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 2 THEN NULL ELSE s_nationkey END AS s_nationkey, CASE WHEN s_suppkey = 2 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier",
    ),
    "index_after_update": (
        "customer", 'SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment == "FURNITURE";', ["CREATE INDEX ON customer (c_mktsegment);", 'UPDATE customer SET c_mktsegment = "FURNITURE" WHERE c_custkey < 50;', 'UPDATE customer SET c_mktsegment = "OTHER" WHERE c_custkey < 20;'],
        "SELECT c_custkey, 'FURNITURE' AS c_mktsegment FROM customer WHERE (c_mktsegment = 'FURNITURE' AND c_custkey >= 20) OR c_custkey BETWEEN 20 AND 49",
    ),
    "show_tables": ("orders", "SHOW TABLES;", [], "SELECT 'orders' AS \"Table\""),
    "show_databases": ("orders", "SHOW DATABASES;", [], "SELECT 'main' AS \"Database\""),
    "describe": (
        "supplier", "DESCRIBE supplier;", ["CREATE INDEX ON supplier (s_nationkey);"],
        "SELECT * FROM (VALUES ('s_suppkey', 'I64', true, false), ('s_name', 'VARCHAR', false, false), ('s_nationkey', 'I32', false, true), ('s_acctbal', 'F64', false, false)) v(Field, Type, \"Primary\", Indexed)",
    ),
    "show_index": ("supplier", "SHOW INDEX FROM supplier;", ["CREATE INDEX ON supplier (s_nationkey);"], "SELECT * FROM (VALUES ('s_suppkey', 'Primary'), ('s_nationkey', 'Secondary')) v(Field, Type)"),
}

#: name -> (index, statement after EXPLAIN, lines)
PLANS: dict[str, tuple[str | None, str, list[str]]] = {
    "explain_full": (None, "SELECT * FROM customer WHERE c_acctbal > 10.0;", ["Filter (Query)", "Full Scan"]),
    "explain_point": (None, "SELECT c_custkey FROM customer WHERE c_custkey == 1 AND c_acctbal == 1.0;", ["Projection (c_custkey)", "Filter (Query)", "Exact primary (1)"]),
    "explain_range": (None, "SELECT c_custkey FROM customer WHERE c_custkey >= 1 AND c_custkey < 2 + 3 ORDER BY c_custkey DESC;", ["Reverse", "Filter (Query)", "Range c_custkey [1, 5)"]),
    "explain_union": ("c_nationkey", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey == 1 OR c_nationkey == 7 LIMIT 3;", ["Limit (3)", "Filter (Query)", "Union", " Exact secondary c_nationkey (7)", " Exact primary (1)"]),
    "explain_intersection": (
        "c_nationkey", "SELECT * FROM customer WHERE (c_custkey == 1 OR c_nationkey == 7) AND (c_custkey == 2 OR c_nationkey == 8) ORDER BY c_name LIMIT 5;",
        ["Top N Sort (c_name ASC LIMIT 5)", "Filter (Query)", "Intersection", " Union", "  Exact secondary c_nationkey (8)", "  Exact primary (2)", " Union", "  Exact secondary c_nationkey (7)", "  Exact primary (1)"],
    ),
    "explain_sort": (None, "SELECT * FROM customer ORDER BY c_name DESC;", ["Full Sort (c_name DESC)", "Full Scan"]),
}


def _segment_and_nation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two selections that both grow with the table."""
    s = session(spark, d, "customer")
    return s.sql('SELECT * FROM customer WHERE c_mktsegment == "FURNITURE";').data, s.sql("SELECT * FROM customer WHERE c_nationkey == 3;").data


def merge_union(spark: SparkSession, d: str) -> DataFrame:
    return merging.merge_union(*_segment_and_nation(spark, d), "c_custkey")


def merge_intersection(spark: SparkSession, d: str) -> DataFrame:
    return merging.merge_intersection(*_segment_and_nation(spark, d), "c_custkey")


def topn_distinct_key(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return merging.top_distinct(orders, "o_orderdate", "o_orderkey", 20)


def _events_log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a log: one key per user, versions in order of their ids, an error deletes; a view sets no value."""
    e = read_table(spark, d, "events")
    value = F.when(F.col("event_type") != "view", F.col("value"))
    return e.select("user_id", F.col("event_id").alias("_txn"), F.lit(0).cast("long").alias("_seq"), (F.col("event_type") == "error").alias("_deleted"), "event_type", value.alias("value"))


def row_reassembly(spark: SparkSession, d: str) -> DataFrame:
    return versions.merged(_events_log(spark, d), "user_id", ["user_id", "event_type", "value"])


def snapshot_visibility(spark: SparkSession, d: str) -> DataFrame:
    """The events as of a reader that the data gives, so the share that is seen is the same at every size."""
    log = _events_log(spark, d)
    last, hidden = _reader(log.select(F.col("_txn").alias("txn_id")))
    return versions.merged(log.where(Transaction(last, frozenset(hidden)).sees(F.col("_txn"))), "user_id", ["user_id", "event_type", "value"])


def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    """A transaction goes on seeing what was there when it started, and its own writes."""
    s = session(spark, d, "supplier")
    other = s.engine.session("main")
    s.sql("START_TRANSACTION;")
    s.sql("UPDATE supplier SET s_acctbal = 1.0 WHERE s_suppkey == 1;")
    other.sql("UPDATE supplier SET s_acctbal = 2.0 WHERE s_suppkey <= 3;")
    return s.sql("SELECT s_suppkey, s_acctbal FROM supplier;").data


def rollback_hidden(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d, "supplier")
    for x in ("START_TRANSACTION;", "DELETE FROM supplier;", "ROLLBACK;", "START_TRANSACTION;", "DELETE FROM supplier WHERE s_suppkey == 4;", "COMMIT;"):
        s.sql(x)
    return s.sql("SELECT s_suppkey, s_name FROM supplier;").data


def compacted_read(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d, "supplier")
    s.sql("DELETE FROM supplier WHERE s_acctbal < 0.0;")
    s.sql("UPDATE supplier SET s_nationkey = 0 WHERE s_suppkey < 10;")
    s.engine.compact("main", "supplier")
    return s.sql("SELECT * FROM supplier;").data


def created_table(spark: SparkSession, d: str) -> DataFrame:
    """A table made by CREATE TABLE, its rows set, updated and deleted by statements alone."""
    s = session(spark, d)
    s.sql("CREATE TABLE t (id I64 PRIMARY KEY, name VARCHAR, money F64, small U8, big U64, real F32, flag BOOLEAN);")
    for x in (
        'INSERT INTO t (id, name, money, small, big, real, flag) VALUES (1, "one", 1.5, 255, 18446744073709551615, 0.25, TRUE);', 'INSERT INTO t (id, name) VALUES (2, "two");',
        "INSERT INTO t (id, flag) VALUES (-3, FALSE);", "INSERT INTO t (id) VALUES (4);", "UPDATE t SET money = id * 2.5, SET small = small - 1 WHERE id < 4;", "DELETE FROM t WHERE id == 4;",
    ):
        s.sql(x)
    return s.sql("SELECT * FROM t;").data


def background_index(spark: SparkSession, d: str) -> DataFrame:
    """An index that is built in the background, with a write before it is ready and one after."""
    s = session(spark, d, "customer")
    s.sql("CREATE INDEX ON customer (c_nationkey) ASYNC;")
    s.sql("UPDATE customer SET c_nationkey = 3 WHERE c_custkey <= 40;")
    s.engine.wait()
    s.sql("UPDATE customer SET c_nationkey = 4 WHERE c_custkey <= 20;")
    return s.sql("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey == 3;").data


def recovered(spark: SparkSession, d: str) -> DataFrame:
    """What another engine finds after the first one stopped within a transaction, and what it adds."""
    s = session(spark, d, "supplier")
    s.sql("UPDATE supplier SET s_acctbal = 0.0 WHERE s_nationkey == 1;")
    s.sql("START_TRANSACTION;")
    s.sql("DELETE FROM supplier;")
    again = Engine(spark, s.engine.catalog.root).session("main")
    again.sql("UPDATE supplier SET s_acctbal = 7.0 WHERE s_suppkey == 1;")
    return again.sql("SELECT s_suppkey, s_acctbal FROM supplier;").data


def last_id_wins(spark: SparkSession, d: str) -> DataFrame:
    """Two transactions write the same rows: the later one counts, though the earlier one commits last."""
    s = session(spark, d, "supplier")
    other = s.engine.session("main")
    s.sql("START_TRANSACTION;")
    other.sql("START_TRANSACTION;")
    other.sql("UPDATE supplier SET s_acctbal = 2.0 WHERE s_suppkey <= 3;")
    s.sql("UPDATE supplier SET s_acctbal = 1.0 WHERE s_suppkey <= 5;")
    other.sql("COMMIT;")
    s.sql("COMMIT;")
    return s.sql("SELECT s_suppkey, s_acctbal FROM supplier;").data


def use_rolls_back(spark: SparkSession, d: str) -> DataFrame:
    """Changing the database, or closing the session, ends an open transaction without effect."""
    s = session(spark, d, "supplier")
    s.sql("START_TRANSACTION;")
    s.sql("DELETE FROM supplier WHERE s_suppkey < 5;")
    s.use("main")
    s.sql("START_TRANSACTION;")
    s.sql("DELETE FROM supplier WHERE s_suppkey > 5;")
    s.close()
    return s.engine.session("main").sql("SELECT s_suppkey FROM supplier;").data


def auto_commit_off(spark: SparkSession, d: str) -> DataFrame:
    """Without auto-commit the first write opens a transaction that ROLLBACK undoes and COMMIT keeps."""
    s = session(spark, d, "supplier")
    s.set_auto_commit(False)
    s.sql("DELETE FROM supplier WHERE s_suppkey < 5;")
    s.sql("ROLLBACK;")
    s.sql("UPDATE supplier SET s_nationkey = 77 WHERE s_suppkey == 6;")
    s.sql("COMMIT;")
    return s.engine.session("main").sql("SELECT s_suppkey, s_nationkey FROM supplier;").data


def table_merge(spark: SparkSession, d: str) -> DataFrame:
    """A table whose balances add up: a write to them is an amount that is added."""
    s = session(spark, d, "supplier")
    s.engine.set_merge("main", "supplier", {"s_acctbal": "sum"})
    for x in ("UPDATE supplier SET s_acctbal = 10.0 WHERE s_suppkey <= 5;", "UPDATE supplier SET s_acctbal = -1.0 WHERE s_suppkey <= 2;"):
        s.sql(x)
    s.engine.compact("main", "supplier")
    s.sql("UPDATE supplier SET s_acctbal = 100.0, SET s_nationkey = 5 WHERE s_suppkey == 1;")
    return s.sql("SELECT * FROM supplier;").data.select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


def merged_log(spark: SparkSession, d: str) -> DataFrame:
    """Writes merged into one, over a base that stays, with a write after it."""
    s = session(spark, d, "supplier")
    for x in ("UPDATE supplier SET s_acctbal = 1.0 WHERE s_suppkey <= 6;", "DELETE FROM supplier WHERE s_suppkey == 2 OR s_suppkey == 3;", 'INSERT INTO supplier (s_suppkey, s_name) VALUES (3, "again");'):
        s.sql(x)
    s.engine.merge_log("main", "supplier")
    s.sql("UPDATE supplier SET s_nationkey = 99 WHERE s_suppkey >= 3 AND s_suppkey <= 4;")
    return s.sql("SELECT * FROM supplier;").data


def key_value_batch(spark: SparkSession, d: str) -> DataFrame:
    """Many changes as one write: columns set, keys added and deleted, one deleted and set anew."""
    s = session(spark, d, "supplier")
    store = KeyValues(s, "supplier")
    store.write_batch([(1, {"s_acctbal": 5.0}), (2, None), (1, {"s_nationkey": 9}), (5000000, {"s_name": "new"}), (3, None), (3, {"s_name": "third"})])
    store.set(4, s_name="fourth")
    store.delete(5)
    return store.scan_all()


def key_value_scan(spark: SparkSession, d: str) -> DataFrame:
    """Whether single keys are found, and how many rows follow a key, with it and without."""
    store = KeyValues(session(spark, d, "orders"), "orders")
    there = lambda k: int(store.get(k) is not None)
    return spark.createDataFrame([(there(7), there(-7), store.scan_from(100).count(), store.scan_from(100, inclusive=False).count())], "n_there int, n_not_there int, n_from long, n_after long")


def posting_list(spark: SparkSession, d: str) -> DataFrame:
    """Size and ends of each value's posting list, from its shards."""
    shards = merging.posting_shards(read_table(spark, d, "orders"), "o_orderkey", "o_orderstatus")
    return shards.groupBy("index_value").agg(F.sum(F.size("primary_keys")).cast("long").alias("n_keys"), F.min(F.get("primary_keys", F.lit(0))).alias("first_key"), F.max(F.element_at("primary_keys", -1)).alias("last_key"))


def posting_list_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each value's whole posting list, from its shards: one row per key with its place in its value's sorted list.

    Shards split a value's keys by hash, so no single array or window holds a frequent value's list: keys are sorted in ranges,
    and a key's place is its place in its range after the value's keys of earlier ranges.
    """
    shards = merging.posting_shards(read_table(spark, d, "orders"), "o_orderkey", "o_orderstatus")
    return merging.listed(shards)


def _reader(txns: DataFrame) -> tuple[int, list[int]]:
    """A reader at three quarters of the history, and the transactions open when it starts: every second of the last twenty before it."""
    last = (txns.agg(F.max("txn_id")).first()[0] or 0) * 3 // 4
    before = [r[0] for r in txns.where(F.col("txn_id") < last).distinct().orderBy(F.desc("txn_id")).limit(20).collect()]
    return last, before[::2]


def posting_as_of(spark: SparkSession, d: str) -> DataFrame:
    """All indexes as of a transaction that the data gives, so the share that is read is the same at every size."""
    lists = read_table(spark, d, "posting_list")
    return postings.postings_as_of(lists, *_reader(postings.usable_entries(lists).where(F.col("txn_id") > postings.OLDEST).select("txn_id")))


def merge_hook(spark: SparkSession, d: str) -> DataFrame:
    """Versions combined by a function of the caller: here the number of events and the longest type since a user's last error."""
    merges = {"value": F.count, "event_type": F.max}
    return versions.merged_by(_events_log(spark, d), "user_id", merges).select("user_id", F.col("value").alias("n_values"), F.col("event_type").alias("last_type"), F.col("_txn").alias("last_event"))


def read_uncommitted(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d, "supplier")
    s.sql("START_TRANSACTION;")
    s.sql("UPDATE supplier SET s_nationkey = 99 WHERE s_suppkey <= 5;")
    return s.engine.session("main", "read_uncommitted").sql("SELECT s_suppkey, s_nationkey FROM supplier;").data


NAMED = [
    merge_union, merge_intersection, topn_distinct_key, row_reassembly, snapshot_visibility, snapshot_read, rollback_hidden, compacted_read, merged_log, posting_list, posting_list_merge, posting_as_of, merge_hook, read_uncommitted,
    created_table, background_index, recovered, last_id_wins, use_rolls_back, auto_commit_off, table_merge, key_value_batch, key_value_scan,
]


def queries() -> dict[str, Query]:
    plans = {}
    for name, (index, statement, _) in PLANS.items():
        plans[name] = _read("customer", "EXPLAIN " + statement, *([f"CREATE INDEX ON customer ({index});"] if index else []))
    return {name: _read(t, s, *before) for name, (t, s, before, _) in READS.items()} | plans | {f.__name__: f for f in NAMED}


def _merged_sql(where: str) -> str:
    return f"""WITH log AS (SELECT * FROM events WHERE {where}),
        dead AS (SELECT user_id, max(event_id) AS e FROM log WHERE event_type = 'error' GROUP BY user_id),
        live AS (SELECT l.* FROM log l LEFT JOIN dead d ON l.user_id = d.user_id WHERE event_type <> 'error' AND (d.e IS NULL OR event_id > d.e))
        SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (WHERE event_type <> 'view' AND value IS NOT NULL) AS value FROM live GROUP BY user_id"""


def oracle_sql() -> dict[str, str]:
    lines = {n: "SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in p[2]) + ") v(Step)" for n, p in PLANS.items()}
    return {n: x[3] for n, x in READS.items()} | lines | {
        "merge_union": "SELECT * FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_nationkey = 3",
        "merge_intersection": "SELECT * FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_nationkey = 3",
        "topn_distinct_key": "SELECT o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) = 1 ORDER BY o_orderdate LIMIT 20",
        "row_reassembly": _merged_sql("true"),
        "snapshot_visibility": _merged_sql("""event_id <= (SELECT max(event_id) * 3 // 4 FROM events) AND event_id NOT IN (SELECT event_id FROM
            (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS n FROM (SELECT DISTINCT event_id FROM events WHERE event_id < (SELECT max(event_id) * 3 // 4 FROM events))) WHERE n < 20 AND n % 2 = 1)"""),
        "snapshot_read": "SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN 1::double ELSE s_acctbal END AS s_acctbal FROM supplier",
        "rollback_hidden": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <> 4",
        "compacted_read": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey < 10 THEN 0 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier WHERE s_acctbal >= 0",
        "merged_log": """SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'again' ELSE s_name END AS s_name, CASE WHEN s_suppkey IN (3, 4) THEN 99 ELSE s_nationkey END AS s_nationkey,
            CASE WHEN s_suppkey = 3 THEN NULL WHEN s_suppkey <= 6 THEN 1::double ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey <> 2""",
        "key_value_batch": """SELECT s_suppkey, CASE s_suppkey WHEN 3 THEN 'third' WHEN 4 THEN 'fourth' ELSE s_name END AS s_name, CASE s_suppkey WHEN 1 THEN 9 WHEN 3 THEN NULL ELSE s_nationkey END AS s_nationkey,
            CASE s_suppkey WHEN 1 THEN 5::double WHEN 3 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey NOT IN (2, 5) UNION ALL SELECT 5000000, 'new', NULL, NULL""",
        "key_value_scan": "SELECT count(*) FILTER (o_orderkey = 7)::int AS n_there, count(*) FILTER (o_orderkey = -7)::int AS n_not_there, count(*) FILTER (o_orderkey >= 100) AS n_from, count(*) FILTER (o_orderkey > 100) AS n_after FROM orders",
        "created_table": """SELECT * FROM (VALUES (1::bigint, 'one', 2.5::double, 254::smallint, 18446744073709551615::decimal(20,0), 0.25::float, true), (2, 'two', 5, NULL, NULL, NULL, NULL), (-3, NULL, -7.5, NULL, NULL, NULL, false))
            v(id, name, money, small, big, real, flag)""",
        "background_index": "SELECT c_custkey, 3 AS c_nationkey FROM customer WHERE (c_nationkey = 3 AND c_custkey > 40) OR c_custkey BETWEEN 21 AND 40",
        "recovered": "SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN 7::double WHEN s_nationkey = 1 THEN 0::double ELSE s_acctbal END AS s_acctbal FROM supplier",
        "last_id_wins": "SELECT s_suppkey, CASE WHEN s_suppkey <= 3 THEN 2::double WHEN s_suppkey <= 5 THEN 1::double ELSE s_acctbal END AS s_acctbal FROM supplier",
        "use_rolls_back": "SELECT s_suppkey FROM supplier",
        "auto_commit_off": "SELECT s_suppkey, CASE WHEN s_suppkey = 6 THEN 77 ELSE s_nationkey END AS s_nationkey FROM supplier",
        "table_merge": """SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN 5 ELSE s_nationkey END AS s_nationkey,
            round(s_acctbal + CASE WHEN s_suppkey <= 5 THEN 10 ELSE 0 END - CASE WHEN s_suppkey <= 2 THEN 1 ELSE 0 END + CASE WHEN s_suppkey = 1 THEN 100 ELSE 0 END, 2) AS s_acctbal FROM supplier""",
        "posting_as_of": """WITH e AS (SELECT keyspace_id, index_value, unnest(entries, recursive := true) FROM posting_list),
            used AS (SELECT * FROM e WHERE primary_key IS NOT NULL AND is_present IS NOT NULL),
            reader AS (SELECT max(txn_id) * 3 // 4 AS last FROM used),
            before AS (SELECT txn_id, row_number() OVER (ORDER BY txn_id DESC) AS n FROM (SELECT DISTINCT txn_id FROM used, reader WHERE txn_id < last)),
            seen AS (SELECT * FROM used, reader WHERE txn_id IS NULL OR (txn_id <= last AND txn_id NOT IN (SELECT txn_id FROM before WHERE n < 20 AND n % 2 = 1)))
            SELECT keyspace_id, index_value, primary_key FROM seen GROUP BY keyspace_id, index_value, primary_key
            HAVING max(coalesce(txn_id, -1)) FILTER (WHERE is_present) >= coalesce(max(coalesce(txn_id, -1)) FILTER (WHERE NOT is_present), -1)""",
        "merge_hook": """WITH dead AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'error' GROUP BY user_id)
            SELECT v.user_id, count(CASE WHEN event_type <> 'view' THEN value END) AS n_values, max(event_type) AS last_type, max(event_id) AS last_event
            FROM events v LEFT JOIN dead d ON v.user_id = d.user_id WHERE event_type <> 'error' AND (d.e IS NULL OR event_id > d.e) GROUP BY v.user_id""",
        "read_uncommitted": "SELECT s_suppkey, CASE WHEN s_suppkey <= 5 THEN 99 ELSE s_nationkey END AS s_nationkey FROM supplier",
        "posting_list_merge": "SELECT o_orderstatus AS index_value, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS place, o_orderkey AS primary_key FROM orders WHERE o_orderstatus IS NOT NULL",
        "posting_list": "SELECT o_orderstatus AS index_value, count(*) AS n_keys, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY o_orderstatus",
    }
