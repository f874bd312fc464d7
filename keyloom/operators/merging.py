"""Set operations on rows of one keyed table, and what else of the dialect goes beyond a single call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.balanced import looked_up
from keyloom.sources.shared import checkpointed


def merge_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of either side, one per key. Both sides are scans of one table, so rows of a key are equal. Null keys are one key."""
    return a.unionByName(b).dropDuplicates([key])


def merge_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key is in ``b`` too. A null key is in neither."""
    return a.join(b.select(key), key, "left_semi")


def top_distinct(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The first n different values of a column with the row of the smallest key for each.

    One row per value is kept by an aggregate that combines before the shuffle, so a frequent value
    is no burden; then n rows are taken from the top.
    """
    rest = [c for c in df.columns if c not in (by, key)]
    one = df.groupBy(by).agg(F.min_by(F.struct(key, *rest), key).alias("_r"))
    return one.select(by, *[F.col(f"_r.{c}").alias(c) for c in (key, *rest)]).orderBy(by).limit(n).select(*df.columns)


def posting_shards(rows: DataFrame, key: str, column: str, keys_per_shard: int = 4096) -> DataFrame:
    """index_value, shard, primary_keys: the keys of each value as sorted arrays of about ``keys_per_shard`` keys.

    A frequent value has many shards, so no array grows with the table. Null values have no postings.
    """
    have = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("index_value"), F.col(key).alias("primary_key"))
    sizes = have.groupBy("index_value").agg(F.ceil(F.count(F.lit(1)) / keys_per_shard).alias("_shards"))
    spread = looked_up(have, sizes, ["index_value"]).withColumn("shard", F.pmod(F.xxhash64("primary_key"), F.col("_shards")).cast("int"))
    return spread.groupBy("index_value", "shard").agg(F.sort_array(F.collect_list("primary_key")).alias("primary_keys"))


def listed(shards: DataFrame) -> DataFrame:
    """index_value, place, primary_key: the keys of each value in order, places from 1.

    Rows are sorted into ranges of (value, key). The counts by value and range tell how many keys of the value
    lie in earlier ranges; a window over the range alone tells the rest, so a frequent value is spread over ranges.
    """
    rows = shards.select("index_value", F.explode("primary_keys").alias("primary_key"))
    ranged = checkpointed(rows.repartitionByRange("index_value", "primary_key").withColumn("_range", F.spark_partition_id()), "listed")
    before = Window.partitionBy("index_value").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("index_value", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("index_value", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("index_value", "_range").orderBy("primary_key"))
    placed = ranged.withColumn("_within", within).join(offsets, ["index_value", "_range"])
    return placed.select("index_value", (F.col("_before") + F.col("_within")).alias("place"), "primary_key")
