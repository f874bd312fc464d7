"""Queries of problems 1 to 6 over a data folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import incremental, membership, postings, references, replay, wide
from keyloom.sources.shared import shared_path
from keyloom.sources.tables import read_table as t
from keyloom.streaming.changes import StreamedFeed


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return postings.present_postings(t(spark, d, "posting_list"))


def p1_value_sizes(spark: SparkSession, d: str) -> DataFrame:
    return postings.value_sizes(t(spark, d, "posting_list"))


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t(spark, d, "posting_list"), t(spark, d, "key_version"), t(spark, d, "schema_column")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_p2(spark, d)).select("keyspace_id", "index_value", "primary_key", "orphan_kind")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(*_p2(spark, d))


def p2_filter(spark: SparkSession, d: str) -> DataFrame:
    return references.filter_report(*_p2(spark, d))


def _p3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t(spark, d, "key_version"), t(spark, d, "key_probe")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return membership.seen_before(*_p3(spark, d), tables=t(spark, d, "sstable"))


def p3_resumed(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, by a chain that took in the older half of the SSTables in one run and, opened again, the others in another."""
    versions, probes = _p3(spark, d)
    tables, path = t(spark, d, "sstable"), shared_path(spark, "p3")
    half = tables.agg(F.percentile_approx("created_at", 0.5)).first()[0]
    membership.SeenKeys(spark, path).take(versions, tables.where(F.col("created_at") <= half))
    chain = membership.SeenKeys(spark, path)
    chain.take(versions)
    return membership.seen_before(versions, probes, chain, tables)


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return membership.error_report(*_p3(spark, d), tables=t(spark, d, "sstable"))


def p3_asked(spark: SparkSession, d: str) -> DataFrame:
    """Of p3_error_rate what does not depend on hash functions."""
    return p3_error_rate(spark, d).select("n_keys", "n_new")


def p3_chain_layers(spark: SparkSession, d: str) -> DataFrame:
    return membership.chain_of(t(spark, d, "key_version")).report()


def p3_stored_filters(spark: SparkSession, d: str) -> DataFrame:
    return membership.stored_filter_state(t(spark, d, "sstable"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.filled_cells(t(spark, d, "data_record"), t(spark, d, "schema_column"))


def _p4_wide(keyspace_id: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: wide.wide_table(t(spark, d, "data_record"), t(spark, d, "schema_column"), keyspace_id)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return replay.current_cells(t(spark, d, "wal_entry"), t(spark, d, "txn_log"))


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return replay.current_rows(t(spark, d, "wal_entry"), t(spark, d, "txn_log"))


#: Micro-batches of p5_streamed.
SLICES = 5


def p5_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The cells of p5_found with the feed taken in as a stream, in slices of its order of arrival.

    Each slice is a file and a micro-batch, which sees of the transaction log what was logged when its
    last change arrived; commits of most transactions come later. The last batch sees the whole log.
    """
    feed, log = t(spark, d, "wal_entry"), t(spark, d, "txn_log")
    at = [F.col("arrived_at").cast("double"), F.lit(0.0)]
    cuts = feed.agg(F.percentile_approx(at[0], [i / SLICES for i in range(1, SLICES)])).first()[0] or []
    state, place, checkpoint = StreamedFeed(spark, shared_path(spark, "p5"), merge_every=2), shared_path(spark, "p5-in"), shared_path(spark, "p5-checkpoint")
    place_in = F.coalesce(*at)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = (F.lit(True) if low is None else place_in > low) & (F.lit(True) if high is None else place_in <= high)
        feed.where(inside).write.mode("append").parquet(place)
        logged = log if high is None else log.where(F.col("logged_at").cast("double") <= high)
        stream = spark.readStream.schema(feed.schema).parquet(place)
        state.write(stream, checkpoint, lambda logged=logged: logged).awaitTermination()
    return state.read(log)


def _p6_runs(spark: SparkSession, d: str) -> tuple[incremental.IncrementalPending, list[incremental.Run]]:
    """Two runs over a state of their own: one before the last flush of each keyspace completed, one after."""
    table = incremental.IncrementalPending(spark, shared_path(spark, "p6"))
    versions, manifest, runs = t(spark, d, "key_version"), t(spark, d, "manifest_operation"), t(spark, d, "processing_run")
    return table, [table.run(versions, m, runs) for m in (incremental.without_last_flush(manifest), manifest)]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The table after a run that had only the last flush of each keyspace to bring in."""
    return _p6_runs(spark, d)[0].read()


def p6_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Of both runs: the partitions there are, those computed and those replaced."""
    rows = [(i, r.units, r.recomputed, r.replaced) for i, r in enumerate(_p6_runs(spark, d)[1], 1)]
    return spark.createDataFrame(rows, "run int, n_units long, n_recomputed long, n_replaced long")


def p6_flushes(spark: SparkSession, d: str) -> DataFrame:
    """The completed flushes and whether a run covers them: what the units' fingerprints are made of."""
    return incremental.flush_state(t(spark, d, "manifest_operation"), t(spark, d, "processing_run"))


TABLES = {1: "personas", 2: "cuentas", 3: "pagos", 4: "articulos", 5: "accesos", 6: "tareas"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_value_sizes, p2_found, p2_report, p2_filter, p3_found, p3_resumed, p3_error_rate, p3_asked, p3_chain_layers, p3_stored_filters, p4_found, p5_found, p5_rows, p5_streamed, p6_found, p6_replaced, p6_flushes]
    return {f.__name__: f for f in named} | {f"p4_{name}": _p4_wide(k) for k, name in TABLES.items()}


NEWEST_POSTINGS = """
newest AS (
  SELECT keyspace_id, index_value, primary_key, max(txn_id) AS txn_id, arg_max(is_present, txn_id) AS is_present
  FROM (SELECT keyspace_id, index_value, unnest(entries, recursive := true) FROM posting_list WHERE keyspace_id >= 101)
  WHERE primary_key IS NOT NULL AND is_present IS NOT NULL
  GROUP BY keyspace_id, index_value, primary_key),
present AS (SELECT keyspace_id, index_value, primary_key, txn_id FROM newest WHERE is_present)"""

ORPHANS = f"""{NEWEST_POSTINGS},
known AS (SELECT DISTINCT secondary_index_keyspace_id AS index_id, keyspace_id AS table_id, table_name FROM schema_column WHERE secondary_index_keyspace_id IS NOT NULL),
state AS (SELECT keyspace_id, key_value, arg_max(is_tombstone, txn_id) AS dead, min(txn_id) AS first FROM key_version GROUP BY keyspace_id, key_value),
orphans AS (
  SELECT p.keyspace_id, index_value, primary_key, table_name, p.txn_id,
    CASE WHEN s.key_value IS NULL THEN 'missing' WHEN s.dead THEN 'deleted' WHEN s.first > p.txn_id THEN 'late' END AS orphan_kind
  FROM present p JOIN known k ON p.keyspace_id = k.index_id LEFT JOIN state s ON s.keyspace_id = k.table_id AND s.key_value = p.primary_key)"""

def _is_value(v: str, kind: str) -> str:
    bare = f"trim({v}, E' \\t\\r\\n')"
    ranges = {"I8": ("-128", "127"), "I16": ("-32768", "32767"), "I32": ("-2147483648", "2147483647"), "I64": ("-9223372036854775808", "9223372036854775807"), "U8": ("0", "255"), "U16": ("0", "65535"), "U32": ("0", "4294967295"), "U64": ("0", "18446744073709551615")}
    whens = ["WHEN 'VARCHAR' THEN true"]
    for k, (lo, hi) in ranges.items():
        whens.append(f"WHEN '{k}' THEN regexp_full_match({bare}, '[+-]?[0-9]+') AND try_cast({bare} AS hugeint) BETWEEN {lo}::hugeint AND {hi}::hugeint")
    for k in ("F32", "F64"):
        whens.append(f"WHEN '{k}' THEN regexp_full_match({bare}, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?')")
    whens.append(f"WHEN 'BOOLEAN' THEN lower({bare}) IN ('true', 'false')")
    whens.append(f"WHEN 'DATE' THEN regexp_full_match({bare}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({bare} AS date) IS NOT NULL")
    return f"CASE {kind} {' '.join(whens)} ELSE false END"


CELLS = f"""
pk AS (SELECT DISTINCT keyspace_id, column_type AS key_type FROM schema_column WHERE is_primary),
usable AS (
  SELECT d.keyspace_id, CASE WHEN key_type = 'VARCHAR' THEN primary_column_value ELSE try_cast(trim(primary_column_value, E' \\t\\r\\n') AS hugeint)::varchar END AS entity,
    d.column_id, d.txn_id, d.record_id, d.column_value
  FROM data_record d JOIN schema_column s ON d.keyspace_id = s.keyspace_id AND d.column_id = s.column_id JOIN pk ON pk.keyspace_id = d.keyspace_id
  WHERE column_value IS NOT NULL AND primary_column_value IS NOT NULL AND {_is_value('column_value', 'column_type')} AND {_is_value('primary_column_value', 'key_type')}),
cells AS (
  SELECT keyspace_id, entity, column_id, record_id, column_value FROM usable
  QUALIFY row_number() OVER (PARTITION BY keyspace_id, entity, column_id ORDER BY txn_id DESC NULLS LAST, record_id DESC) = 1)"""

SQL_TYPES = {"I16": "smallint", "I32": "integer", "I64": "bigint", "U8": "smallint", "U64": "decimal(20,0)", "F32": "float", "F64": "double", "BOOLEAN": "boolean", "VARCHAR": "varchar", "DATE": "date"}
COLUMNS = {
    1: "id I64, nombre VARCHAR, dinero F64, fecha DATE, activo BOOLEAN, ciudad VARCHAR, nivel I32, edad U8, apodo VARCHAR",
    2: "codigo VARCHAR, titular VARCHAR, saldo F64, estado VARCHAR, abierta DATE, limite U64, bloqueada BOOLEAN",
    3: "id I64, importe F64, moneda VARCHAR, fecha DATE, cuotas I16, credito I64, concepto VARCHAR, confirmado BOOLEAN",
    4: "sku VARCHAR, categoria VARCHAR, precio F32, stock I32, peso F64, descripcion VARCHAR, alta DATE",
    5: "id I64, dispositivo VARCHAR, duracion I64, exito BOOLEAN, intentos U8, nota VARCHAR",
    6: "ref VARCHAR, etiqueta VARCHAR, prioridad I16, hecha BOOLEAN, horas F32, vence DATE",
}


def _wide_sql(keyspace_id: int) -> str:
    cols = [c.split() for c in COLUMNS[keyspace_id].split(", ")]
    out = [f"entity::{SQL_TYPES[cols[0][1]]} AS {cols[0][0]}"]
    for i, (name, kind) in enumerate(cols[1:], 1):
        value = f"max(column_value) FILTER (WHERE column_id = {i})"
        out.append(f"{value} AS {name}" if kind == "VARCHAR" else f"trim({value}, E' \\t\\r\\n')::{SQL_TYPES[kind]} AS {name}")
    return f"WITH {CELLS} SELECT {', '.join(out)} FROM cells WHERE keyspace_id = {keyspace_id} GROUP BY entity"


FEED = """
changes AS (
  SELECT DISTINCT keyspace_id, key_value, txn_id, seq, entry_value
  FROM wal_entry WHERE txn_id IN (SELECT txn_id FROM txn_log WHERE log_record = 'commit')),
deletes AS (
  SELECT keyspace_id, key_value, max({'t': txn_id, 's': seq}) AS w FROM changes WHERE entry_value IS NULL OR entry_value = '' GROUP BY keyspace_id, key_value),
sets AS (
  SELECT keyspace_id, key_value, txn_id, seq, unnest(json_keys(entry_value)) AS name, entry_value
  FROM changes WHERE entry_value <> '' AND json_valid(entry_value) AND json_type(entry_value) = 'OBJECT'),
cells AS (
  SELECT s.keyspace_id, s.key_value, name::int AS column_id, max({'t': txn_id, 's': seq}) AS w
  FROM sets s LEFT JOIN deletes d ON s.keyspace_id = d.keyspace_id AND s.key_value = d.key_value
  WHERE json_type(entry_value, '$."' || name || '"') <> 'NULL' AND (d.w IS NULL OR {'t': txn_id, 's': seq} > d.w)
  GROUP BY s.keyspace_id, s.key_value, name::int)"""


SEEN = """WITH first AS (SELECT keyspace_id, key_value, min(probe_id) AS first_id FROM key_probe WHERE key_value IS NOT NULL GROUP BY ALL)
    SELECT probe_id FROM key_probe p JOIN first f ON p.keyspace_id = f.keyspace_id AND p.key_value = f.key_value
    WHERE probe_id > first_id OR EXISTS (SELECT 1 FROM key_version v WHERE v.keyspace_id = p.keyspace_id AND v.key_value = p.key_value)"""

FLUSHES = """
done AS (SELECT keyspace_id, completed_operation_id AS id, min(written_at) AS at FROM manifest_operation WHERE operation_content = 'Completed' GROUP BY ALL),
flushes AS (SELECT DISTINCT m.keyspace_id, m.manifest_operation_id AS id, m.sstable_id, d.at FROM manifest_operation m JOIN done d ON m.keyspace_id = d.keyspace_id AND m.manifest_operation_id = d.id WHERE operation_content = 'MemtableFlush'),
state AS (SELECT f.*, EXISTS (SELECT 1 FROM processing_run r WHERE r.keyspace_id = f.keyspace_id AND run_state = 'succeeded' AND f.id BETWEEN first_operation_id AND last_operation_id AND started_at >= f.at) AS covered FROM flushes f)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {NEWEST_POSTINGS} SELECT keyspace_id, index_value, primary_key FROM present",
        "p1_value_sizes": f"""WITH {NEWEST_POSTINGS},
            sizes AS (SELECT keyspace_id, index_value, sum(coalesce(len(entries), 0))::bigint AS n_entries, count(*) AS n_fragments FROM posting_list GROUP BY keyspace_id, index_value)
            SELECT p.keyspace_id, p.index_value, count(*) AS n_keys, any_value(n_entries) AS n_entries, any_value(n_fragments) AS n_fragments
            FROM present p JOIN sizes s ON p.keyspace_id = s.keyspace_id AND p.index_value IS NOT DISTINCT FROM s.index_value GROUP BY p.keyspace_id, p.index_value""",
        "p2_found": f"WITH {ORPHANS} SELECT keyspace_id, index_value, primary_key, orphan_kind FROM orphans WHERE orphan_kind IS NOT NULL",
        "p2_report": f"""WITH {ORPHANS},
            times AS (SELECT keyspace_id, index_value, e.primary_key, e.txn_id, min(written_at) AS written_at
              FROM (SELECT keyspace_id, index_value, written_at, unnest(entries) AS e FROM posting_list) WHERE e.is_present GROUP BY ALL)
            SELECT table_name, date_trunc('week', written_at)::date AS week, orphan_kind, count(*) AS n_orphans
            FROM orphans o JOIN times t ON o.keyspace_id = t.keyspace_id AND o.index_value IS NOT DISTINCT FROM t.index_value AND o.primary_key = t.primary_key AND o.txn_id = t.txn_id
            WHERE orphan_kind IS NOT NULL GROUP BY ALL""",
        "p3_found": SEEN,
        "p3_resumed": SEEN,
        "p3_asked": """SELECT count(*) AS n_keys, count(*) FILTER (NOT EXISTS (SELECT 1 FROM key_version v WHERE v.keyspace_id = p.keyspace_id AND v.key_value = p.key_value)) AS n_new
            FROM (SELECT DISTINCT keyspace_id, key_value FROM key_probe WHERE keyspace_id IS NOT NULL AND key_value IS NOT NULL) p""",
        "p4_found": f"WITH {CELLS} SELECT keyspace_id, entity AS primary_column_value, column_id, record_id FROM cells",
        "p5_found": f"WITH {FEED} SELECT keyspace_id, key_value, column_id, w.t AS txn_id, w.s AS seq FROM cells",
        "p5_streamed": f"WITH {FEED} SELECT keyspace_id, key_value, column_id, w.t AS txn_id, w.s AS seq FROM cells",
        "p5_rows": f"WITH {FEED} SELECT keyspace_id, key_value, count(*) AS n_cells, max(w.t) AS last_txn FROM cells GROUP BY keyspace_id, key_value",
        "p6_found": f"""WITH {FLUSHES}
            SELECT v.keyspace_id, key_value, txn_id FROM key_version v JOIN state s ON v.keyspace_id = s.keyspace_id AND v.sstable_id = s.sstable_id
            GROUP BY v.keyspace_id, key_value, txn_id HAVING NOT bool_or(covered)""",
        "p6_flushes": f"WITH {FLUSHES} SELECT keyspace_id, id AS operation_id, sstable_id, covered FROM state",
    } | {f"p4_{name}": _wide_sql(k) for k, name in TABLES.items()}
