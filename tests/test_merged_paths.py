"""Paths through indexes: the rows are those of a full scan, each once, and less is read."""

import pytest

from keyloom import dialect_queries
from keyloom.engine import indexes

WHERES = {
    "c_custkey == 1 OR c_mktsegment == \"FURNITURE\"": True,
    "c_mktsegment == \"FURNITURE\" OR c_mktsegment == \"BUILDING\" OR c_acctbal > 9000.0": True,
    "(c_custkey == 1 OR c_mktsegment == \"FURNITURE\") AND (c_custkey == 2 OR c_acctbal > 0.0)": True,
    "c_acctbal > 5000.0 AND c_custkey < 60": False,
    "c_acctbal > 5000.0 AND c_acctbal <= 9000.0 AND c_name != \"x\"": True,
    "(c_custkey < 10 OR c_custkey > 90) OR c_mktsegment == \"FURNITURE\"": True,
    "c_custkey == 1 OR c_custkey == 2": False,
    "c_mktsegment == \"FURNITURE\" OR c_nationkey == 3": False,
}
WRITES = [
    'UPDATE customer SET c_mktsegment = "FURNITURE" WHERE c_custkey == 5;', "DELETE FROM customer WHERE c_custkey == 7;", 'INSERT INTO customer (c_custkey, c_mktsegment) VALUES (1000000, "FURNITURE");',
    'UPDATE customer SET c_mktsegment = "NONE", SET c_acctbal = -1.0 WHERE c_mktsegment == "FURNITURE" AND c_custkey < 40;',
]


@pytest.fixture(scope="module")
def sessions(spark, small):
    plain, led = dialect_queries.session(spark, small, "customer"), dialect_queries.session(spark, small, "customer")
    for c in ("c_mktsegment", "c_acctbal"):
        led.sql(f"CREATE INDEX ON customer ({c});")
    return plain, led


def rows(s, where):
    return sorted(map(tuple, s.sql(f"SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE {where};").all()))


@pytest.fixture
def used(monkeypatch):
    seen, real = [], indexes.read_through
    monkeypatch.setattr(indexes, "read_through", lambda *a: seen.append(real(*a)) or seen[-1])
    return seen


@pytest.mark.parametrize(("where", "led"), WHERES.items())
def test_paths_lead_through_indexes(sessions, used, where, led):
    plain, with_index = sessions
    assert rows(with_index, where) == rows(plain, where)
    assert (used[0] is not None) == led


def test_writes_are_seen_through_indexes_before_and_after_compaction(spark, small):
    plain, led = dialect_queries.session(spark, small, "customer"), dialect_queries.session(spark, small, "customer")
    for c in ("c_mktsegment", "c_acctbal"):
        led.sql(f"CREATE INDEX ON customer ({c});")
    for x in WRITES:
        assert plain.sql(x).count == led.sql(x).count
    for _ in range(2):
        for where in list(WHERES)[:4]:
            assert rows(led, where) == rows(plain, where)
        led.engine.compact("main", "customer")


def scanned_rows(df):
    """Rows that the scans of an executed plan gave, as the engine counts them."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan

    def walk(p):
        if p.nodeName().startswith("Scan") or p.nodeName().startswith("FileScan") or "Scan parquet" in p.nodeName():
            yield p.metrics().apply("numOutputRows").value()
        children = p.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return sum(walk(plan))


def test_an_index_reads_less_than_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    spark.range(20_000).selectExpr("id AS k", "(id * 7919) % 20000 AS v", "repeat('x', 20) AS pad").write.option("parquet.block.size", 20_000).option("parquet.page.size", 2000).parquet(path)
    from keyloom.engine import Engine

    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    try:
        s = Engine(spark, f"file://{tmp_path}/db").session()
        s.sql("CREATE DATABASE d;")
        s.engine.register_parquet("d", "t", path, "k")
        s.use("d")
        before = s.sql("SELECT * FROM t WHERE v == 77;").data
        assert before.collect() and scanned_rows(before) > 10_000
        s.sql("CREATE INDEX ON t (v);")
        for where, n in (("v == 77", 1), ("v >= 100 AND v < 130", 30), ("v == 1 OR v == 19000", 2)):
            df = s.sql(f"SELECT * FROM t WHERE {where};").data
            assert len(df.collect()) == n and scanned_rows(df) < 10_000
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
