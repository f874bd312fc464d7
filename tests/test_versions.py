from keyloom.engine.transactions import Transaction
from keyloom.engine.versions import merged, merged_by
from pyspark.sql import functions as F

LOG = "id long, _txn long, _seq long, _deleted boolean, brand string, kind string"


def current(spark, rows):
    return sorted(map(tuple, merged(spark.createDataFrame(rows, LOG), "id", ["id", "brand", "kind"]).collect()))


def test_rows_from_partial_records(spark):
    # Every subset of two versions that each set one, both or none of the columns.
    sets = [(None, None), ("b", None), (None, "k"), ("b", "k")]
    rows, want = [], []
    for i, (old, new) in enumerate((a, b) for a in sets for b in sets):
        rows += [(i, 5, 0, False, *(x and x + "2" for x in new)), (i, 3, 0, False, *(x and x + "1" for x in old))]
        want.append((i, *((n and n + "2") or (o and o + "1") for o, n in zip(old, new, strict=True))))
    assert current(spark, rows) == want


def test_deletes_and_order_within_a_transaction(spark):
    rows = [(1, 1, 1, False, "a", "b"), (1, 1, 2, True, None, None), (1, 1, 3, False, None, "c"), (2, 5, 1, False, "x", None), (2, 5, 2, True, None, None), (3, 1, 1, None, "n", None)]
    assert current(spark, rows) == [(1, None, "c"), (3, "n", None)]
    assert current(spark, []) == []


def test_snapshot_of_a_version_log(spark):
    df = spark.range(60).selectExpr("id % 7 AS k", "id AS t")
    for last, hidden in ((0, set()), (31, set()), (31, {4, 30, 31, 50}), (99, {1})):
        seen = {r.t for r in df.where(Transaction(last, frozenset(hidden)).sees(F.col("t"))).collect()}
        assert seen == {t for t in range(60) if t <= last and t not in hidden}
    # Ids up to the base's are no longer in a log, so they need not be hidden.
    text = str(Transaction(50, frozenset({3, 40})).sees(F.col("t"), after=20))
    assert "40" in text and "3" not in text.replace("<= 50", "")


def test_merge_by_a_function(spark):
    rows = [("a", t, 0, t, False) for t in (1, 2, 5)] + [("b", 3, 1, 7, False), ("b", 3, 2, 0, True), ("b", 3, 3, 2, False), ("c", 1, 1, 5, False), ("c", 2, 1, 0, True)]
    log = spark.createDataFrame(rows, "k string, _txn long, _seq long, v long, _deleted boolean")
    got = {r.k: (r.v, r._txn) for r in merged_by(log, "k", {"v": F.sum}).collect()}
    assert got == {"a": (8, 5), "b": (2, 3)}
