"""Processing only what is new: which key versions no successful run has had, kept up to date by changed partitions alone.

An SSTable never changes once it is written. So a partition is a unit of history, a keyspace and an
aligned range of operation ids, and what happened to a unit shows in its flushes, without a look at
their versions. A run reads the versions of flushes that are new or newly covered, and of the units
whose transactions overlap theirs, since only these can hold the same versions; no other is read.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.files import Files

#: Versions that a unit holds, about; and units that a keyspace has at least, as far as it has operations.
UNIT_ROWS, LEAST_UNITS = 4_000_000, 24
#: SSTables up to which their ids go to the scan as a list.
PUSHED = 1000
VERSION = ["keyspace_id", "key_value", "txn_id"]
Unit = tuple[int, int]
Span = tuple[int, int]


def completed_flushes(manifest: DataFrame) -> DataFrame:
    """keyspace_id, operation_id, sstable_id, completed_at (of the earliest Completed record) of the completed flushes. Repeated records count once."""
    flush = manifest.where("operation_content = 'MemtableFlush' AND sstable_id IS NOT NULL").select("keyspace_id", F.col("manifest_operation_id").alias("operation_id"), "sstable_id").distinct()
    done = manifest.where("operation_content = 'Completed'").groupBy("keyspace_id", F.col("completed_operation_id").alias("operation_id")).agg(F.min("written_at").alias("completed_at"))
    return flush.join(done, ["keyspace_id", "operation_id"])


def run_cover(runs: DataFrame) -> DataFrame:
    """The succeeded runs as aligned blocks of operation ids: keyspace_id, level, block, last_start.

    A range [a, b] is the union of at most two blocks of 2**level ids per level, so covering costs
    a logarithm of the range and not its length, and of all runs that use a block only the latest
    start matters. Ranges that are empty or have a null end cover nothing.
    """
    r = runs.where("run_state = 'succeeded' AND started_at IS NOT NULL AND first_operation_id <= last_operation_id AND last_operation_id >= 0")
    r = r.select("keyspace_id", "started_at", F.greatest(F.col("first_operation_id"), F.lit(0)).alias("a"), F.least(F.col("last_operation_id"), F.lit((1 << 61) - 1)).alias("b"))
    levels = "sequence(0, 61)"
    # At level j the part of the range still open is [lo, hi) in blocks of 2**j.
    parts = f"""filter(flatten(transform(transform({levels}, j -> named_struct('level', j, 'lo', shiftright(a + shiftleft(1L, j) - 1, j), 'hi', shiftright(b + 1, j))),
        x -> array(named_struct('level', x.level, 'block', if(x.lo < x.hi AND x.lo % 2 = 1, x.lo, null)),
                   named_struct('level', x.level, 'block', if(x.lo < x.hi AND x.hi % 2 = 1, x.hi - 1, null))))), y -> y.block IS NOT NULL)"""
    return r.select("keyspace_id", "started_at", F.inline(F.expr(parts))).groupBy("keyspace_id", "level", "block").agg(F.max("started_at").alias("last_start"))


def flush_state(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """The completed flushes with ``covered``: a succeeded run has the flush in its range and started at or after its completion.

    Each flush asks for its own block on every level in use, in one join with at most one row per
    block. On a low level a block has few operations; on a high one it has many, and that join key is
    broadcast while the cover is small and split by Spark where it is skewed.
    """
    flushes = completed_flushes(manifest)
    cover = run_cover(runs)
    # A level is one of 62 numbers; no block has level -1, which keeps flushes where there is no run.
    used = F.broadcast(cover.select("level").union(manifest.sparkSession.range(1).select(F.lit(-1))).distinct())
    asked = flushes.withColumn("level", F.explode(F.expr("sequence(-1, 61)"))).join(used, "level", "left_semi").withColumn("block", F.expr("if(operation_id < 0, null, shiftright(operation_id, level))"))
    met = asked.join(cover, ["keyspace_id", "level", "block"], "left")
    hit = F.max(F.coalesce(F.col("last_start") >= F.col("completed_at"), F.lit(False)))
    return met.groupBy("keyspace_id", "operation_id", "sstable_id").agg(hit.alias("covered"))


def without_last_flush(manifest: DataFrame) -> DataFrame:
    """The manifest as it was before the last completed flush of each keyspace completed."""
    last = completed_flushes(manifest).groupBy("keyspace_id").agg(F.max("operation_id").alias("_last"))
    rows = manifest.join(last, "keyspace_id", "left")
    return rows.where(F.coalesce((F.col("operation_content") != "Completed") | (F.col("completed_operation_id") != F.col("_last")), F.lit(True))).drop("_last")


UNIT = ["keyspace_id", "unit"]
FLUSH_SCHEMA = "keyspace_id long, operation_id long, sstable_id long, covered boolean"


def _sums(*columns: str) -> list[Column]:
    """Count and two additive hashes of a group's rows, as texts: equal exactly if the rows are the same, whatever their order."""
    h = lambda seed: F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(20,0)"))
    return [F.count(F.lit(1)).cast("string"), h(1).cast("string"), h(2).cast("string")]


def with_unit(flushes: DataFrame, bits: int) -> DataFrame:
    return flushes.withColumn("unit", F.shiftright("operation_id", bits))


def prints(rows: DataFrame, *columns: str) -> dict[Unit, list[str]]:
    """Fingerprint of each unit's rows."""
    return {(r[0], r[1]): list(r[2:]) for r in rows.groupBy(*UNIT).agg(*_sums(*columns)).collect()}


def versions_of(versions: DataFrame, flushes: DataFrame) -> DataFrame:
    """The versions in the SSTables of these flushes. The ids of a few are given to the scan, which then skips what holds none of them."""
    versions = versions.select(*VERSION, "sstable_id")
    few = flushes.limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        ids = sorted({r["sstable_id"] for r in few})
        versions = versions.where(F.col("sstable_id").isin(*ids) if ids else F.lit(False))
        flushes = versions.sparkSession.createDataFrame(few, flushes.schema)
    return versions.join(flushes, ["keyspace_id", "sstable_id"])


def pending(states: DataFrame) -> DataFrame:
    """Versions none of whose completed flushes is covered, in the unit of their first flush. A version may come several times."""
    one = states.groupBy(*VERSION).agg(F.max("covered").alias("_c"), F.min("unit").alias("unit"))
    return one.where(~F.col("_c")).select(*VERSION, "unit")


def overlapping(ranges: dict[Unit, Span], asked: dict[Unit, Span]) -> set[Unit]:
    """Units with a transaction range that meets one of the asked ranges of the same keyspace."""
    found = set()
    for k in {k for k, _ in asked}:
        spans = sorted(s for (x, _), s in asked.items() if x == k)
        lows, highs = [s[0] for s in spans], list(accumulate((s[1] for s in spans), max))
        for u, (low, high) in ((u, s) for u, s in ranges.items() if u[0] == k):
            # Of the asked ranges that begin by the unit's end, the one that reaches furthest.
            i = bisect_right(lows, high) - 1
            if i >= 0 and highs[i] >= low:
                found.add(u)
    return found


@dataclass(frozen=True)
class Run:
    """Units there are, those that a run computed again, and those that were different and were replaced."""

    units: int
    recomputed: int
    replaced: int


class IncrementalPending:
    """The pending versions of a feed, kept as a table in ``path`` of which each run replaces the changed partitions only.

    ``data`` holds the rows, partitioned by keyspace and unit. Each generation ``meta-<n>`` holds the
    flushes as of a run and, of every unit, count and additive hashes of its flushes and of its
    rows, and the range of its transactions; the file ``current`` names the generation in force.

    A run compares the flushes' fingerprints, reads what may have changed (see the module), and
    replaces the units whose rows came out different, by dynamic partition overwrite. The generation
    is published last, as one file: a run that fails before has changed nothing that the next one
    relies on, and the next one replaces the same units again, so nothing is skipped or repeated.
    Each unit has a marker row, so that one without pending rows is emptied rather than left.

    The driver holds ten numbers per unit, that is per UNIT_ROWS versions. Versions with a null
    transaction count as of transaction -1 when ranges are compared.
    """

    MARK, NOTHING = "_mark", ["0", None, None]

    def __init__(self, spark: SparkSession, path: str, unit_rows: int = UNIT_ROWS, least_units: int = LEAST_UNITS) -> None:
        self.spark, self.path, self.files = spark, path, Files(spark)
        self.unit_rows, self.least_units = unit_rows, least_units

    def _current(self) -> dict:
        self.files.recover(f"{self.path}/current")
        return json.loads(self.files.read(f"{self.path}/current")) if self.files.exists(f"{self.path}/current") else {"generation": 0, "units": []}

    def _kept(self, df: DataFrame, generation: int, name: str) -> DataFrame:
        path = f"{self.path}/meta-{generation}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def layout(self, versions: DataFrame, flushes: DataFrame) -> int:
        """Width of units in operations, as a power of two. Chosen by the first run from the sizes it finds."""
        per = flushes.groupBy("keyspace_id").agg((F.max("operation_id") - F.min("operation_id") + 1).alias("span"), F.count(F.lit(1)).alias("n"))
        span, n = per.agg(F.coalesce(F.max("span"), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return int(math.log2(max(1, min(span // self.least_units, self.unit_rows * n // max(1, versions.count())))))

    def _units(self, units: Iterable[Unit]) -> DataFrame:
        return self.spark.createDataFrame(sorted(units), "keyspace_id long, unit long")

    def run(self, versions: DataFrame, manifest: DataFrame, runs: DataFrame) -> Run:
        """Brings the table up to date."""
        was = self._current()
        old, new = was["generation"], was["generation"] + 1
        known = {(k, u): rest for k, u, *rest in was["units"]}  # unit -> fingerprint of flushes, fingerprint of rows, range
        flushes = self._kept(flush_state(manifest, runs), new, "flushes")
        bits = was["bits"] if old else self.layout(versions, flushes)
        flushes = with_unit(flushes, bits)
        digests = prints(flushes, "operation_id", "sstable_id", "covered")
        differ = {u for u in digests.keys() | known.keys() if digests.get(u) != (known[u][0] if u in known else None)}
        if old and not differ:
            self.files.delete(f"{self.path}/meta-{new}")
            return Run(len(digests), 0, 0)
        touched = flushes.select(*UNIT, "sstable_id")
        if old:
            before = with_unit(self.spark.read.schema(FLUSH_SCHEMA).parquet(f"{self.path}/meta-{old}/flushes"), bits)
            both = flushes.withColumn("_n", F.lit(1)).union(before.withColumn("_n", F.lit(-1))).join(self._units(differ), UNIT, "left_semi")
            touched = both.groupBy(*UNIT, "operation_id", "sstable_id", "covered").agg(F.sum("_n").alias("_n")).where("_n != 0").select(*UNIT, "sstable_id").distinct()
            touched = self._kept(touched, new, "touched")
        txn = F.coalesce("txn_id", F.lit(-1))
        met = {(r[0], r[1]): (r[2], r[3]) for r in versions_of(versions, touched).groupBy(*UNIT).agg(F.min(txn), F.max(txn)).collect()}
        ranges = {u: tuple(x[2]) for u, x in known.items() if x[2]}
        ranges |= {u: (min(a, ranges[u][0]), max(b, ranges[u][1])) if u in ranges else (a, b) for u, (a, b) in met.items()}
        again = overlapping(ranges, met) | differ
        if old:
            near = overlapping(ranges, {u: ranges[u] for u in again if u in ranges}) | again
            states = versions_of(versions, flushes.join(self._units(near), UNIT, "left_semi").select(*UNIT, "sstable_id", "covered"))
            rows = self._kept(pending(states).join(self._units(again), UNIT, "left_semi"), new, "rows")
            found = prints(rows, *VERSION)
            replaced = {u for u in again if found.get(u, self.NOTHING) != (known[u][1] if u in known else self.NOTHING)}
            if replaced:
                self._replace(rows.join(self._units(replaced), UNIT, "left_semi"), replaced)
        else:
            replaced = again
            self._replace(pending(versions_of(versions, flushes.select(*UNIT, "sstable_id", "covered"))), again)
            found = prints(self._data().where(~F.col(self.MARK)), *VERSION)
        units = [[*u, x, found.get(u, self.NOTHING) if u in again else known[u][1], ranges.get(u)] for u, x in sorted(digests.items())]
        self.files.write(f"{self.path}/current", json.dumps({"generation": new, "bits": bits, "units": units}))
        for name in (f"meta-{new}/rows", f"meta-{new}/touched", f"meta-{old - 1}"):
            self.files.delete(f"{self.path}/{name}")
        return Run(len(digests), len(again), len(replaced))

    def _replace(self, rows: DataFrame, units: set[Unit]) -> None:
        """Replaces these units. A large unit is written by several tasks, small ones share tasks."""
        marks = self._units(units).select("keyspace_id", F.lit(None).cast("string").alias("key_value"), F.lit(None).cast("long").alias("txn_id"), "unit", F.lit(True).alias(self.MARK))
        out = rows.withColumn(self.MARK, F.lit(False)).unionByName(marks).hint("rebalance", *UNIT)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*UNIT).parquet(f"{self.path}/data")

    def _data(self) -> DataFrame:
        return self.spark.read.schema(f"key_value string, txn_id long, {self.MARK} boolean, keyspace_id long, unit long").parquet(f"{self.path}/data")

    def read(self) -> DataFrame:
        if not self.files.exists(f"{self.path}/data"):
            return self.spark.createDataFrame([], "keyspace_id long, key_value string, txn_id long")
        return self._data().where(~F.col(self.MARK)).select(*VERSION)
