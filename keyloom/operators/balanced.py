"""Per-key work without a few overloaded tasks: fragment-replicate by estimated load.

A light aggregate estimates the load of each key. Keys above a share of a task's fair load are
split into shards in proportion to it; all other keys fall into virtual buckets. Shards and
buckets are bin-packed onto tasks, largest first, and rows are sent straight to their task. The
side that has to meet the rows of a key is replicated to the tasks of that key's shards only. Rows of
sub-keys that alone would fill a good part of a task are told apart, to be combined before they move.

What reaches the driver is bounded by the number of tasks, not by the data: fewer than
``tasks * PIECES`` keys can hold more than ``1 / (tasks * PIECES)`` of the load each, and there
are ``tasks * BUCKETS`` buckets.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces into which a task's fair load is divided: a key above one piece is split.
PIECES = 4
#: Virtual buckets per task for the keys below one piece.
BUCKETS = 8
#: One row in so many is looked at to find hot sub-keys. It steers where rows go, never the result.
SAMPLE = 8

#: Rows that a task should have at most, where the number of tasks is not given.
TASK_ROWS = 4_000_000

TASK, HOT = "_task", "_hot"


def tasks_for(spark: SparkSession, rows: int | float) -> int:
    """The session's number of shuffle partitions, or more where the rows are known to need more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


@dataclass
class ShardPlan:
    """Where the rows of each key go.

    heavy: key -> tasks of its shards, of which the hash of the sub-key chooses one; hot: keys and
    sub-keys with many rows of their own; buckets: task of each virtual bucket of the other keys.
    """

    tasks: int
    keys: list[str]
    subs: list[str]
    key_schema: T.StructType
    buckets: list[int]
    heavy: list[tuple] = field(default_factory=list)
    hot: list[tuple] = field(default_factory=list)

    def _frame(self, spark: SparkSession, rows: list[tuple], names: list[str], extra: T.StructField) -> DataFrame:
        fields = [T.StructField("_p_" + n, self.key_schema[n].dataType) for n in names]
        return spark.createDataFrame(rows, T.StructType([*fields, extra]))

    def _lookup(self, df: DataFrame, rows: list[tuple], names: list[str], extra: T.StructField) -> DataFrame:
        """``df`` with the plan's column; the plan has fewer rows than tasks * PIECES, so it is broadcast."""
        if not rows:
            return df.withColumn(extra.name, F.lit(None).cast(extra.dataType))
        plan = self._frame(df.sparkSession, rows, names, extra)
        on = [df[n].eqNullSafe(plan["_p_" + n]) for n in names]
        return df.join(F.broadcast(plan), on, "left").drop(*["_p_" + n for n in names])

    def _bucket_task(self) -> Column:
        ids = F.from_json(F.lit(json.dumps(self.buckets)), "array<int>")
        return F.get(ids, F.pmod(F.xxhash64(*self.keys), F.lit(len(self.buckets))).cast("int"))

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with the TASK of each row's key and sub-key, still where it was."""
        df = self._lookup(df, self.heavy, self.keys, T.StructField("_tasks", T.ArrayType(T.IntegerType())))
        shard = F.pmod(F.xxhash64(*self.subs), F.size("_tasks").cast("long")).cast("int")
        task = F.when(F.col("_tasks").isNull(), self._bucket_task()).otherwise(F.get("_tasks", shard))
        return df.withColumn(TASK, task).drop("_tasks")

    def route(self, df: DataFrame) -> DataFrame:
        """``df`` in ``tasks`` partitions, each row in that of its TASK."""
        return self.assign(df).repartitionById(self.tasks, F.col(TASK))

    def mark_hot(self, df: DataFrame) -> DataFrame:
        """``df`` with HOT: whether its sub-key is one with many rows. Aggregate these where they are; a routed sub-key goes to one task."""
        df = self._lookup(df, self.hot, [*self.keys, *self.subs], T.StructField("_found", T.BooleanType()))
        return df.withColumn(HOT, F.col("_found").isNotNull()).drop("_found")

    def replicate(self, df: DataFrame) -> DataFrame:
        """The matching side: each row goes to the tasks of its key's shards, and to no other task."""
        df = self._lookup(df, self.heavy, self.keys, T.StructField("_tasks", T.ArrayType(T.IntegerType())))
        tasks = F.when(F.col("_tasks").isNull(), F.array(self._bucket_task())).otherwise(F.array_distinct("_tasks"))
        df = df.withColumn(TASK, F.explode(tasks)).drop("_tasks")
        return df.repartitionById(self.tasks, F.col(TASK))


def pack(loads: list[tuple[float, int]], tasks: int) -> list[int]:
    """Task of each item; items are (load, number). Largest first onto the least loaded task."""
    heap = [(0.0, t) for t in range(tasks)]
    at = [0] * len(loads)
    for load, i in sorted(loads, key=lambda x: (-x[0], x[1])):
        sum_, t = heapq.heappop(heap)
        at[i] = t
        heapq.heappush(heap, (sum_ + load, t))
    return at


def plan_shards(loads: DataFrame, keys: list[str], subs: list[str], load: str, tasks: int | None = None, sub_sample: DataFrame | None = None) -> ShardPlan:
    """A plan from the estimated load of each key.

    loads: one row per key with its load; sub_sample: a sample of rows with keys and subs, one row
    for each unit of load times SAMPLE, in which sub-keys that are hot by themselves are sought.
    tasks: by default as many as the load needs. Null keys are a key like any other. Without rows the
    plan has empty buckets only.
    """
    loads = loads.select(*keys, F.coalesce(F.col(load).cast("double"), F.lit(0.0)).alias("_load")).persist()
    try:
        total = loads.agg(F.sum("_load")).first()[0] or 0.0
        tasks = tasks or tasks_for(loads.sparkSession, total)
        n_buckets = tasks * BUCKETS
        piece = max(1.0, total / (tasks * PIECES))
        big = [tuple(r) for r in loads.where(F.col("_load") > piece).collect()]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")
        light = dict(map(tuple, loads.where(F.col("_load") <= piece).groupBy(bucket.alias("b")).agg(F.sum("_load")).collect()))
        schema = loads.schema
    finally:
        loads.unpersist()
    items: list[tuple[float, int]] = [(light.get(b, 0.0), b) for b in range(n_buckets)]
    spans = []
    for *key, weight in sorted(big, key=lambda r: (-r[-1], str(r))):
        shards = min(tasks, math.ceil(weight / piece))
        spans.append((key, len(items), shards))
        items += [(weight / shards, len(items) + i) for i in range(shards)]
    at = pack(items, tasks)
    hot: list[tuple] = []
    key_schema = T.StructType([schema[k] for k in keys])
    if sub_sample is not None and big and subs:
        names = [*keys, *subs]
        seen = sub_sample.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * SAMPLE > piece)
        rows = seen.collect()
        hot = [(*r[:-1], True) for r in map(tuple, rows)]
        key_schema = T.StructType([*key_schema, *[seen.schema[s] for s in subs]])
    return ShardPlan(tasks, keys, subs, key_schema, at[:n_buckets], [(*k, at[i : i + n]) for k, i, n in spans], hot)


def heavy_keys(df: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame | None:
    """Keys with more than a piece of a task's fair share of the rows, by a sample; None if there are none. Fewer than tasks * PIECES can be found."""
    sampled = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(SAMPLE)) == 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        total = sampled.agg(F.sum("_n")).first()[0] or 0
        tasks = tasks or tasks_for(df.sparkSession, total * SAMPLE)
        rows = sampled.where(F.col("_n") > max(1000 / SAMPLE, total / (tasks * PIECES))).select(*keys).collect()
    finally:
        sampled.unpersist()
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema) if rows else None


def looked_up(df: DataFrame, right: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Left join with ``right``, which has at most one row per key, such that no task gets all rows of a heavy key.

    The right rows of heavy keys, fewer than tasks * PIECES, go to where the left rows are; all
    others meet by a shuffle, or as Spark sees fit. ``df`` is read three times, so it should be a
    written table. Its keys must not be null.
    """
    heavy = heavy_keys(df, keys, tasks)
    if heavy is None:
        return df.join(right, keys, "left")
    heavy = F.broadcast(heavy)
    light = df.join(heavy, keys, "left_anti").join(right, keys, "left")
    return light.unionByName(df.join(heavy, keys, "left_semi").join(F.broadcast(right.join(heavy, keys, "left_semi")), keys, "left"))
