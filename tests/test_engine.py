import pytest

from keyloom import errors as X
from keyloom.engine import Engine
from keyloom.engine.cli import result_text, run_line


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.session().sql("CREATE DATABASE d;")
    e.session("d").sql("CREATE TABLE t (id I64 PRIMARY KEY, nombre VARCHAR, dinero F64, nivel I32);")
    return e


@pytest.fixture
def db(engine):
    return engine.session("d")


def rows(s, text="SELECT * FROM t;"):
    return sorted(map(tuple, s.sql(text).all()), key=repr)


def test_insert_merges_over_an_existing_row(db):
    db.sql('INSERT INTO t (id, nombre, dinero) VALUES (1, "a", 1.0);')
    db.sql("INSERT INTO t (id, dinero) VALUES (1, 2.0);")
    db.sql("INSERT INTO t (id, dinero) VALUES (1, NULL);")
    assert rows(db) == [(1, "a", 2.0, None)]


def test_nothing_survives_a_delete(db):
    db.sql('INSERT INTO t (id, nombre, dinero) VALUES (1, "a", 1.0);')
    assert db.sql("DELETE FROM t WHERE id == 1;").count == 1
    assert rows(db) == []
    db.sql('INSERT INTO t (id, nombre) VALUES (1, "b");')
    assert rows(db) == [(1, "b", None, None)]


def test_update(db):
    db.sql("INSERT INTO t (id, dinero, nivel) VALUES (1, 5.0, 2147483647);")
    db.sql("INSERT INTO t (id) VALUES (2);")
    assert db.sql("UPDATE t SET dinero = dinero + 1.0;").count == 2
    assert rows(db, "SELECT id, dinero FROM t;") == [(1, 6.0), (2, None)]
    assert db.sql("SELECT id FROM t WHERE nivel + 1 == 2147483648;").all()[0][0] == 1
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        db.sql("UPDATE t SET nivel = nivel + 1 WHERE id == 1;")
    assert rows(db, "SELECT nivel FROM t WHERE id == 1;") == [(2147483647,)]


def test_snapshots(engine, db):
    other = engine.session("d")
    db.sql("START_TRANSACTION;")
    db.sql("INSERT INTO t (id) VALUES (1);")
    other.sql("START_TRANSACTION;")
    assert rows(other, "SELECT id FROM t;") == [] and rows(db, "SELECT id FROM t;") == [(1,)]
    db.sql("COMMIT;")
    assert rows(other, "SELECT id FROM t;") == []
    assert rows(engine.session("d"), "SELECT id FROM t;") == [(1,)]
    other.sql("INSERT INTO t (id) VALUES (2);")
    other.sql("ROLLBACK;")
    assert rows(engine.session("d"), "SELECT id FROM t;") == [(1,)]


def test_recovery(spark, engine, db):
    db.sql("INSERT INTO t (id) VALUES (1);")
    db.sql("START_TRANSACTION;")
    db.sql("INSERT INTO t (id) VALUES (2);")
    last = db.txn.id
    again = Engine(spark, engine.catalog.root)
    assert rows(again.session("d"), "SELECT id FROM t;") == [(1,)]
    s = again.session("d")
    assert s.sql("START_TRANSACTION;").count > last
    s.sql("INSERT INTO t (id) VALUES (3);")
    s.sql("COMMIT;")
    assert rows(s, "SELECT id FROM t;") == [(1,), (3,)]


def test_indexes_stay_right(engine, db):
    db.sql('INSERT INTO t (id, nombre) VALUES (1, "a");')
    db.sql('INSERT INTO t (id, nombre) VALUES (2, "a");')
    assert db.sql("CREATE INDEX ON t (nombre);").count == 2
    db.sql('UPDATE t SET nombre = "b" WHERE id == 1;')
    assert rows(db, 'SELECT id FROM t WHERE nombre == "a";') == [(2,)]
    assert rows(db, 'SELECT id FROM t WHERE nombre == "b";') == [(1,)]
    db.sql("DELETE FROM t WHERE id == 2;")
    assert rows(db, 'SELECT id, nombre FROM t WHERE nombre == "a";') == []
    engine.compact("d", "t")
    assert rows(db, 'SELECT id, nombre FROM t WHERE nombre >= "a" AND nombre < "c";') == [(1, "b")]
    with pytest.raises(X.IndexAlreadyExists):
        db.sql("CREATE INDEX ON t (nombre);")
    with pytest.raises(X.IndexAlreadyExists):
        db.sql("CREATE INDEX ON t (id);")


def test_background_index(engine, db):
    db.sql("INSERT INTO t (id, dinero) VALUES (1, 1.5);")
    db.sql("CREATE INDEX ON t (dinero) ASYNC;")
    engine.wait()
    db.sql("INSERT INTO t (id, dinero) VALUES (2, 2.5);")
    assert rows(db, "SELECT id FROM t WHERE dinero > 1.0;") == [(1,), (2,)]
    assert [tuple(r) for r in db.sql("SHOW INDEX FROM t;").all()] == [("id", "Primary"), ("dinero", "Secondary")]


def test_sort_with_nulls_and_ties(db):
    for i, d in ((4, "2.0"), (1, "2.0"), (3, "NULL"), (2, "1.0"), (5, "2.0")):
        db.sql(f"INSERT INTO t (id, dinero) VALUES ({i}, {d});")
    ids = lambda q: [r[0] for r in db.sql(q).all()]
    assert ids("SELECT id FROM t ORDER BY dinero;") == [3, 2, 1, 4, 5]
    assert ids("SELECT id FROM t ORDER BY dinero LIMIT 4;") == [3, 2, 1, 4]
    assert ids("SELECT id FROM t ORDER BY dinero DESC LIMIT 2;") == [1, 4]
    assert ids("SELECT id FROM t LIMIT 2;") == [1, 2]
    assert db.sql("SELECT id FROM t ORDER BY id;").next_n(2) == db.sql("SELECT id FROM t ORDER BY id;").all()[:2]
    assert db.sql("DELETE FROM t LIMIT 2 WHERE dinero == 2.0;").count == 2
    assert sorted(ids("SELECT id FROM t;")) == [2, 3, 5]


def test_null_truth(db):
    db.sql("INSERT INTO t (id, dinero) VALUES (1, NULL);")
    db.sql("INSERT INTO t (id, dinero, nivel) VALUES (2, 1.0, 1);")
    ids = lambda w: [r[0] for r in rows(db, f"SELECT id FROM t WHERE {w};")]
    assert ids("dinero == nivel") == [1, 2]
    assert ids("dinero != 1.0") == [1]
    assert ids("dinero < 5.0") == [2]
    assert ids("dinero < 5.0 OR id == 1") == [1, 2]
    assert ids("dinero < 5.0 AND id > 0") == [2]


def test_division(db):
    db.sql("INSERT INTO t (id, dinero) VALUES (7, 7.0);")
    assert rows(db, "SELECT id FROM t WHERE id / 2 == 3 AND -id / 2 == -3 AND dinero / 2 == 3.5;") == [(7,)]
    for w in ("id / 0 == 1", "dinero / 0.0 > 1.0"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            db.sql(f"SELECT id FROM t WHERE {w};").all()


def test_unsigned(engine, db):
    db.sql("CREATE TABLE u (k U64 PRIMARY KEY, b U8);")
    db.sql("INSERT INTO u (k, b) VALUES (9223372036854775808, 255);")
    assert rows(db, "SELECT b FROM u WHERE k > 9;") == [(255,)]
    with pytest.raises(Exception, match="out of the range of U8"):
        db.sql("UPDATE u SET b = b + 1;")
    assert rows(db, "SELECT b FROM u;") == [(255,)]


@pytest.mark.parametrize("text, code", [
    ("SELECT * FROM nadie;", 8), ("SELECT x FROM t;", 7), ("SELECT * FROM t WHERE x == 1;", 13), ("SELECT * FROM t WHERE id = 1;", 3), ("SELECT * FROM t WHERE 1 == 1;", 4),
    ("INSERT INTO t (id, dinero) VALUES (1, 2);", 14), ("UPDATE t SET dinero = 2;", 4), ("UPDATE t SET id = 2;", 4), ("CREATE TABLE t (a I64 PRIMARY KEY);", 9), ("CREATE DATABASE d;", 16), ("COMMIT;", 6),
])
def test_error_codes(db, text, code):
    with pytest.raises(X.KeyloomError) as x:
        db.sql(text)
    assert x.value.code == code


def test_context(engine, db):
    with pytest.raises(X.InvalidContext):
        engine.session().sql("SELECT * FROM t;")
    with pytest.raises(X.DatabaseNotFound):
        engine.session("nadie")
    db.sql("START_TRANSACTION;")
    with pytest.raises(X.InvalidContext):
        db.sql("START_TRANSACTION;")
    with pytest.raises(X.InvalidContext):
        db.sql("INSERT INTO t (id) VALUES (1);") and engine.compact("d", "t")
    db.close()
    assert rows(engine.session("d"), "SELECT id FROM t;") == []


def test_prompt(engine):
    s = engine.session()
    assert run_line(s, "use d").startswith("Database changed")
    run_line(s, 'INSERT INTO t (id, nombre, dinero) VALUES (1, "Él", 2.0);')
    out = run_line(s, "SELECT nombre, id, dinero, nivel FROM t;")
    assert "| Él" in out and "2.00" in out and "N/A" in out and "1 rows in set" in out
    assert "Error 8" in run_line(s, "SELECT * FROM x;")
    assert result_text(s.sql("SELECT dinero, id FROM t;"), "id").splitlines()[1].startswith("| id")
    assert run_line(s, "exit") is None


def test_registered_table_keeps_its_base(spark, engine, tmp_path):
    path = f"file://{tmp_path}/base.parquet"
    spark.createDataFrame([(1, "a", [1.0]), (2, "b", None), (3, None, [])], "k long, v string, e array<float>").write.parquet(path)
    engine.register_parquet("d", "r", path, "k")
    s = engine.session("d")
    s.sql('UPDATE r SET v = "z" WHERE k == 1;')
    s.sql("DELETE FROM r WHERE k == 3;")
    assert sorted((r[0], r[1], r[2]) for r in s.sql("SELECT * FROM r;").all()) == [(1, "z", [1.0]), (2, "b", None)]
    engine.compact("d", "r")
    assert sorted((r[0], r[1], r[2]) for r in s.sql("SELECT * FROM r;").all()) == [(1, "z", [1.0]), (2, "b", None)]
    with pytest.raises(X.InvalidType):
        s.sql("INSERT INTO r (k, e) VALUES (4, 1);")


def test_added_columns(spark, engine, tmp_path):
    path = f"file://{tmp_path}/base2.parquet"
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(path)
    engine.register_parquet("d", "r", path, "k")
    s = engine.session("d")
    s.sql('UPDATE r SET v = "z" WHERE k == 1;')
    engine.add_columns("d", "r", {"w": "I32"})
    s.sql("UPDATE r SET w = 5 WHERE k == 2;")
    assert rows(s, "SELECT * FROM r;") == [(1, "z", None), (2, "b", 5)]
    with pytest.raises(X.ColumnNameAlreadyDefined):
        engine.add_columns("d", "r", {"v": "I32"})


def test_compaction_by_itself_and_read_uncommitted(spark, tmp_path):
    from keyloom.engine import Options

    e = Engine(spark, f"file://{tmp_path}/db", Options(compact_after=2))
    e.session().sql("CREATE DATABASE d;")
    s = e.session("d")
    s.sql("CREATE TABLE t (id I64 PRIMARY KEY, a I64);")
    for i in range(3):
        s.sql(f"INSERT INTO t (id, a) VALUES ({i}, {i});")
    assert e.catalog.table("d", "t").log_number == 1
    s.sql("START_TRANSACTION;")
    s.sql("DELETE FROM t WHERE id == 0;")
    assert rows(e.session("d", "read_uncommitted"), "SELECT id FROM t;") == [(1,), (2,)]
    assert rows(e.session("d"), "SELECT id FROM t;") == [(0,), (1,), (2,)]
    s.sql("ROLLBACK;")
    assert rows(e.session("d", "read_uncommitted"), "SELECT id FROM t;") == [(0,), (1,), (2,)]


def test_a_reader_leaves_the_writer_alone_and_sees_its_commits(spark, engine, db):
    for i in range(3):
        db.sql(f"INSERT INTO t (id) VALUES ({i});")
    db.sql("START_TRANSACTION;")
    db.sql("INSERT INTO t (id) VALUES (9);")
    reader = Engine(spark, engine.catalog.root).session("d")
    files = set(engine.catalog.files.names(engine.transactions("d").folder))
    assert len(rows(reader)) == 3 and set(engine.catalog.files.names(engine.transactions("d").folder)) == files
    db.sql("COMMIT;")
    assert len(rows(reader)) == len(rows(db)) == 4
    # A new writer ends what the old one left open, and the old one is told.
    db.sql("START_TRANSACTION;")
    db.sql("INSERT INTO t (id) VALUES (10);")
    reader.sql("INSERT INTO t (id) VALUES (11);")
    with pytest.raises(X.InvalidContext):
        db.sql("COMMIT;")
    assert sorted(r[0] for r in rows(reader, "SELECT id FROM t;")) == [0, 1, 2, 9, 11]


def test_compaction_keeps_what_was_handed_out_and_drops_what_is_older(engine, db):
    kept = lambda: sorted(engine.catalog.files.names(engine.catalog.table("d", "t").folder))
    db.sql("CREATE INDEX ON t (nivel);")
    db.sql("INSERT INTO t (id, nivel) VALUES (1, 1);")
    db.sql("START_TRANSACTION;")
    db.sql("DELETE FROM t;")
    db.sql("ROLLBACK;")
    early = db.sql("SELECT * FROM t;").data
    engine.compact("d", "t")
    assert len(early.collect()) == 1
    for i in (2, 3):
        db.sql(f"INSERT INTO t (id, nivel) VALUES ({i}, 1);")
        early = db.sql("SELECT * FROM t WHERE nivel == 1;").data
        engine.compact("d", "t")
        assert len(early.collect()) == i
    assert kept() == ["base-2", "base-3", "index-3-2", "index-3-3", "log-2"]
    assert engine.transactions("d").rolled_back == set() and len(engine.catalog.files.names(engine.transactions("d").folder)) <= 4
    last = engine.transactions("d").last
    assert db.sql("START_TRANSACTION;").count == last + 1


def test_tiers(spark, tmp_path):
    from keyloom.engine import Options

    path = f"file://{tmp_path}/base.parquet"
    spark.range(100).selectExpr("id AS k", "id * 1.0D AS v").write.parquet(path)
    shown = {}
    for strategy in ("tiered", "leveled"):
        e = Engine(spark, f"file://{tmp_path}/{strategy}", Options(compact_after=3, strategy=strategy))
        e.session().sql("CREATE DATABASE d;")
        e.register_parquet("d", "r", path, "k")
        s = e.session("d")
        s.sql("CREATE INDEX ON r (v);")
        for i in range(7):
            s.sql(f"UPDATE r SET v = -1.0 WHERE k == {i % 4};" if i % 3 else f"DELETE FROM r WHERE k == {50 + i};")
        t = e.catalog.table("d", "r")
        assert (t.base == path) == (strategy == "tiered") and t.log_number >= 2
        shown[strategy] = rows(s, "SELECT * FROM r WHERE v < 60.0;")
    assert shown["tiered"] == shown["leveled"] and len(shown["tiered"]) == 60 - 3 + 2 - 2
    with pytest.raises(X.InvalidOption):
        Options(strategy="none")


def test_options_file_rows_one_by_one_and_prompt(spark, engine, db, tmp_path):
    from keyloom.engine import Options
    from keyloom.engine.cli import prompt

    (tmp_path / "options").write_text("# all of them\ncompact_after = 5\nstrategy = leveled # each time\n\nisolation = read_uncommitted\n")
    o = Options.read(spark, f"file://{tmp_path}/options")
    assert o == Options(5, "leveled", "read_uncommitted") and Options().compact_after == 64
    for bad in ("compact_after = x", "nothing = 1"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(X.InvalidOption):
            Options.read(spark, f"file://{tmp_path}/bad")
    for i in (1, 2):
        db.sql(f"INSERT INTO t (id) VALUES ({i});")
    r = db.sql("SELECT id FROM t ORDER BY id;")
    assert [r.next(), r.next(), r.next()] == [(1,), (2,), None]
    s = engine.session("d")
    lines = ["autocommit off", "DELETE FROM t WHERE id == 1;", "", "autocommit maybe", "ROLLBACK;", "SELECT id FROM t;"]
    said = list(prompt(s, lines))
    assert said[1].startswith("1 rows") and said[2] == "autocommit on, or autocommit off" and "2 rows in set" in said[4] and s.database is None
    assert list(prompt(engine.session("d"), ["exit", "SELECT * FROM t;"])) == []


def test_key_values(engine, db):
    from keyloom.engine import KeyValues

    store = KeyValues(db, "t")
    assert store.write_batch([(2, {"nombre": "b"}), (1, {"nombre": "a", "dinero": 1.0}), (2, {"nivel": 7}), (3, None)]) == 3
    assert tuple(store.get(2)) == (2, "b", None, 7) and store.get(3) is None
    db.sql("START_TRANSACTION;")
    store.delete(1)
    store.write_batch([(2, None), (2, {"dinero": 2.0})])
    assert [tuple(r) for r in store.scan_all().collect()] == [(2, None, 2.0, None)]
    assert store.write_batch([]) == 0
    db.sql("ROLLBACK;")
    assert [r.id for r in store.scan_from(1, inclusive=False).collect()] == [2] and len(rows(db)) == 2
    for bad, error in (([(None, {})], X.PrimaryColumnNotIncluded), ([(1, {"x": 1})], X.UnknownColumn), ([(1, {"id": 1})], X.UnknownColumn)):
        with pytest.raises(error):
            store.write_batch(bad)
    with pytest.raises(X.TableNotFound):
        KeyValues(db, "none")


def test_table_merge_functions(engine, db):
    engine.set_merge("d", "t", {"dinero": "sum", "nivel": "max"})
    for x in ("INSERT INTO t (id, dinero, nivel) VALUES (1, 1.5, 3);", "INSERT INTO t (id, dinero, nivel) VALUES (1, 2.0, 2);", 'INSERT INTO t (id, nombre) VALUES (2, "b");'):
        db.sql(x)
    assert rows(db) == [(1, None, 3.5, 3), (2, "b", None, None)]
    engine.compact("d", "t")
    db.sql("INSERT INTO t (id, dinero) VALUES (1, 1.0);")
    assert rows(db, "SELECT id, dinero, nivel FROM t;") == [(1, 4.5, 3), (2, None, None)]
    db.sql("DELETE FROM t WHERE id == 1;")
    db.sql("INSERT INTO t (id, nivel) VALUES (1, 1);")
    assert rows(db, "SELECT id, dinero, nivel FROM t WHERE id == 1;") == [(1, None, 1)]
    for bad in ({"id": "sum"}, {"dinero": "median"}):
        with pytest.raises(X.InvalidOption):
            engine.set_merge("d", "t", bad)
