"""SELECT, UPDATE and DELETE as DataFrames over a table's snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.engine import indexes, versions
from keyloom.engine.catalog import TableInfo
from keyloom.engine.transactions import Transaction
from keyloom.plans import access_path as P
from keyloom.plans import ast as A
from keyloom.plans.expressions import casted, column


def matching(spark: SparkSession, table: TableInfo, txn: Transaction | None, where: A.Expr | None) -> DataFrame:
    """Rows that a predicate selects.

    Spark takes predicates on the primary key to the files by itself. Where a path leads through an
    index, the rows that were not changed come from the index.
    """
    rows = versions.snapshot(spark, table, txn, indexes.read_through(spark, table, P.path_of(where, table)))
    return rows if where is None else rows.where(column(where, table.types))


def select(spark: SparkSession, table: TableInfo, txn: Transaction | None, s: A.Select) -> DataFrame:
    """Rows in the order of the sort column, nulls first ascending and last descending, ties by key; without a sort, by key where a limit needs an order."""
    rows = matching(spark, table, txn, s.where)
    key = F.col(f"`{table.primary}`")
    if s.sort:
        by = F.col(f"`{s.sort.column}`")
        rows = rows.orderBy(by.desc() if s.sort.descending else by.asc(), key.desc() if s.sort.descending and s.sort.column == table.primary else key.asc())
    elif s.limit is not None:
        rows = rows.orderBy(key)
    if s.limit is not None:
        rows = rows.limit(s.limit)
    return rows.select(*[F.col(f"`{c}`") for c in (s.columns or table.types)])


def update(spark: SparkSession, table: TableInfo, txn: Transaction, s: A.Update) -> DataFrame:
    """Key and new values of the matching rows; a null value leaves its column as it is."""
    rows = matching(spark, table, txn, s.where)
    return rows.select(F.col(f"`{table.primary}`"), *[casted(e, table.types, table.types[c]).alias(c) for c, e in s.sets])


def delete(spark: SparkSession, table: TableInfo, txn: Transaction, s: A.Delete) -> DataFrame:
    """Keys of the matching rows, the first ones by key if there is a limit."""
    rows = matching(spark, table, txn, s.where).select(F.col(f"`{table.primary}`"))
    return rows.orderBy(table.primary).limit(s.limit) if s.limit is not None else rows
