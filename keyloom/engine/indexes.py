"""Secondary indexes: copies of a table's base, sorted by another column.

A copy is read in the base's place where a predicate bounds its column, and the file format skips
the parts of it that lie outside; it has all columns, so nothing is looked up in the base. Rows that
the log has changed are merged from the log wherever unchanged rows are read, so a write does not
touch an index and never makes one stale; compaction makes the copies anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.engine import versions
from keyloom.engine.catalog import TableInfo
from keyloom.plans import access_path as P


def build(spark: SparkSession, table: TableInfo, column: str) -> None:
    """Writes the copy of the base in order of the column. Rows without a value are left out, as no bound holds for them."""
    if table.base:
        rows = versions.read_base(spark, table).where(F.col(f"`{column}`").isNotNull())
        rows.sort(f"`{column}`").write.mode("overwrite").parquet(table.index_path(column))


def _inside(path: P.Point | P.Range) -> Column:
    value = F.col(f"`{path.column}`")
    if isinstance(path, P.Point):
        return value == F.lit(path.value)
    out = F.lit(True)
    if path.low is not None:
        out = out & (value >= F.lit(path.low) if path.low_in else value > F.lit(path.low))
    if path.high is not None:
        out = out & (value <= F.lit(path.high) if path.high_in else value < F.lit(path.high))
    return out


def sources(table: TableInfo, path: P.Path) -> list[tuple[str, Column]] | None:
    """What a path reads: Parquet folders, each with the bounds of its column, which together cover the path's rows; None for the whole base.

    A union reads what both sides read. Of an intersection the side that reads fewer sources is
    read, points before ranges and the base before a copy, as either covers the rows; the other's bounds are pushed into the
    same scans with the rest of the predicate.
    """
    if isinstance(path, P.Merge):
        left, right = sources(table, path.left), sources(table, path.right)
        if path.kind == "Union":
            return None if left is None or right is None else left + right
        sides = [(len(s), _ranges(p), any(at != table.base for at, _ in s), s) for p, s in ((path.left, left), (path.right, right)) if s is not None]
        return min(sides, key=lambda x: x[:3])[3] if sides else None
    if isinstance(path, (P.Point, P.Range)):
        if path.column == table.primary:
            return [(table.base, _inside(path))]
        if table.indexes.get(path.column) == "active":
            return [(table.index_path(path.column), _inside(path))]
    return None


def _ranges(path: P.Path) -> int:
    return _ranges(path.left) + _ranges(path.right) if isinstance(path, P.Merge) else isinstance(path, P.Range)


def read_through(spark: SparkSession, table: TableInfo, path: P.Path) -> DataFrame | None:
    """Rows of the base that a path leads to through an index, each once; None if it leads through none."""
    parts = sources(table, path) if table.base else None
    if parts is None or all(at == table.base for at, _ in parts):
        return None
    out, before = None, F.lit(False)
    for at, inside in parts:
        # A row that an earlier part has is left out by that part's bounds, without comparing rows.
        rows = versions.read_base(spark, table, at).where(inside & ~before)
        out = rows if out is None else out.unionByName(rows)
        before = before | F.coalesce(inside, F.lit(False))
    return out
