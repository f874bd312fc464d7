"""Tables as a base and a log of changes; the current rows are a merge of versions.

A log row sets some columns of a key (null = not set by this write) or deletes the key. Each write is
a folder of its own, named by its number, so a write is read, counted or left out by file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.engine.catalog import TableInfo
from keyloom.engine.transactions import Transaction
from keyloom.functions.typed import SPARK_TYPES

TXN, SEQ, DELETED = "_txn", "_seq", "_deleted"


def log_schema(table: TableInfo) -> str:
    return ", ".join([f"{TXN} long", f"{DELETED} boolean", *[f"`{c}` {SPARK_TYPES[t]}" for c, t in table.types.items() if t in SPARK_TYPES], f"{SEQ} long"])


def read_log(spark: SparkSession, table: TableInfo) -> DataFrame:
    return spark.read.schema(log_schema(table)).parquet(table.log)


def read_base(spark: SparkSession, table: TableInfo, path: str | None = None) -> DataFrame:
    """The base, or a copy of it, with the table's columns; one that was added later is null."""
    base = spark.read.parquet(path or table.base)
    have = set(base.columns)
    return base.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(SPARK_TYPES[t]).alias(c) for c, t in table.types.items()])


def merged(log: DataFrame, primary: str, columns: list[str]) -> DataFrame:
    """The current rows of a log: per key and column the last value that was set, later than the key's last delete.

    log has TXN, SEQ and DELETED beside the columns; versions are ordered by (TXN, SEQ). A key whose
    last change is its deletion gives no row; a key with versions but no values gives a row of nulls.
    """
    version = F.struct(TXN, SEQ)
    live = ~F.coalesce(F.col(DELETED), F.lit(False))
    others = [c for c in columns if c != primary]
    # A value may only count if it is later than the last delete, which is known at the end of the
    # group. So deletes and last values are aggregated side by side and compared afterwards.
    aggs = [F.max(F.when(~live, version)).alias("_d"), F.max(F.when(live, version)).alias("_v")]
    aggs += [F.max(F.when(live & F.col(f"`{c}`").isNotNull(), F.struct(TXN, SEQ, F.col(f"`{c}`").alias("x")))).alias(f"_c{i}") for i, c in enumerate(others)]
    one = log.groupBy(F.col(f"`{primary}`").alias("_k")).agg(*aggs)
    after = lambda s: F.col("_d").isNull() | (F.struct(s[TXN], s[SEQ]) > F.col("_d"))
    one = one.where(F.col("_v").isNotNull() & after(F.col("_v")))
    out = {c: F.when(after(F.col(f"_c{i}")), F.col(f"_c{i}.x")) for i, c in enumerate(others)}
    return one.select(*[F.col("_k").alias(c) if c == primary else out[c].alias(c) for c in columns])


def merged_by(log: DataFrame, primary: str, merges: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """As ``merged``, but each column's values after the key's last delete are combined by an aggregate of its own, such as ``F.sum``.

    The last delete of a key has to be known first, so the log is aggregated twice; both aggregates
    combine before the shuffle.
    """
    version = F.struct(TXN, SEQ)
    dead = F.coalesce(F.col(DELETED), F.lit(False))
    last = log.where(dead).groupBy(F.col(f"`{primary}`").alias("_k")).agg(F.max(version).alias("_d"))
    live = log.where(~dead)
    live = live.join(last, live[f"`{primary}`"].eqNullSafe(F.col("_k")), "left").where(F.col("_d").isNull() | (version > F.col("_d")))
    return live.groupBy(F.col(f"`{primary}`").alias(primary)).agg(*[f(F.col(f"`{c}`")).alias(c) for c, f in merges.items()], F.max(TXN).alias(TXN))


#: Functions that a table may combine a column's values by.
MERGES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def current(log: DataFrame, table: TableInfo) -> DataFrame:
    """``merged``, with the columns that have a merge function of their own combined by it; such a column is null where no value was ever set."""
    columns = list(table.types)
    rows = merged(log, table.primary, [c for c in columns if c not in table.merges])
    if not table.merges:
        return rows
    key = F.col(f"`{table.primary}`")
    own = merged_by(log, table.primary, {c: MERGES[f] for c, f in table.merges.items()})
    types = {c: SPARK_TYPES[table.types[c]] for c in table.merges}
    own = own.select(key.alias("_k"), *[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])
    return rows.join(own, key.eqNullSafe(F.col("_k")), "left").select(*[F.col(f"`{c}`") for c in columns])


def snapshot(spark: SparkSession, table: TableInfo, txn: Transaction | None, part: DataFrame | None = None) -> DataFrame:
    """The rows of a table that a transaction sees; None sees everything, committed or not.

    A table that was never written is its base alone. Otherwise only keys with changes are merged:
    the base keeps its other rows as they are, so a small log costs no aggregate over a large base.
    part: those rows of the base that can be in the result; changed keys are merged all the same.
    """
    columns = list(table.types)
    base = read_base(spark, table) if table.base else None
    unchanged = base if part is None else part
    if not table.logged:
        return unchanged if base is not None else spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in table.schema()]))
    log = read_log(spark, table)
    if txn is not None:
        log = log.where(txn.sees(F.col(TXN), table.base_txn))
    if base is None:
        return current(log, table)
    for c, t in table.types.items():
        if t not in SPARK_TYPES:
            log = log.withColumn(c, F.lit(None).cast(base.schema[c].dataType))
    keys = log.select(F.col(f"`{table.primary}`")).distinct()
    old = base.join(keys, table.primary, "left_semi").select(F.lit(table.base_txn).cast("long").alias(TXN), F.lit(-1).cast("long").alias(SEQ), F.lit(False).alias(DELETED), *[F.col(f"`{c}`") for c in columns])
    changed = current(old.unionByName(log), table)
    return unchanged.join(keys, table.primary, "left_anti").select(*columns).unionByName(changed)


def reduced_log(spark: SparkSession, table: TableInfo, txn: Transaction) -> DataFrame:
    """The log as few rows: of each key its last delete, if any, and the values set after it, as one row each of the transaction itself.

    Over any base it gives the rows that the whole log gives, for readers that see ``txn`` and later ones.
    """
    log = read_log(spark, table).where(txn.sees(F.col(TXN), table.base_txn))
    kinds = {c: SPARK_TYPES[t] for c, t in table.types.items() if t in SPARK_TYPES}
    key = F.col(f"`{table.primary}`")
    dead = log.where(F.coalesce(F.col(DELETED), F.lit(False))).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    now = F.lit(txn.id).cast("long").alias(TXN)
    deletes = dead.select(now, F.lit(True).alias(DELETED), *[(key if c == table.primary else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    values = merged(log, table.primary, list(kinds)).select(now, F.lit(False).alias(DELETED), *[F.col(f"`{c}`") for c in kinds])
    return deletes.withColumn("_first", F.lit(1)).unionByName(values.withColumn("_first", F.lit(2)))


def append(rows: DataFrame, table: TableInfo, txn: Transaction, seq: int, deleted: bool | None) -> int:
    """Writes log rows and gives their number; rows holds the key and the columns that are set, and, where ``deleted`` is None, says itself what is deleted."""
    spark = rows.sparkSession
    given = set(rows.columns)
    columns = [(F.col(f"`{c}`") if c in given else F.lit(None)).cast(SPARK_TYPES[t]).alias(c) for c, t in table.types.items() if t in SPARK_TYPES]
    path = f"{table.log}/{SEQ}={seq}"
    rows.select(F.lit(txn.id).cast("long").alias(TXN), (F.col(DELETED) if deleted is None else F.lit(deleted)).alias(DELETED), *columns).write.parquet(path)
    return spark.read.parquet(path).count()


def compacted(spark: SparkSession, table: TableInfo, txn: Transaction, path: str) -> None:
    """Writes the rows that ``txn`` sees as a new base, sorted by key so that row groups can be skipped."""
    snapshot(spark, table, txn).sort(table.primary).write.parquet(path)
