"""Orphan references: present postings whose row is missing, deleted or younger than the posting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.balanced import looked_up
from keyloom.operators.postings import merge_postings
from keyloom.sources.shared import checkpointed

#: A block of the filter: 512 words of 64 bits, 4 KiB.
WORDS = 512
#: Bits per parent key that are aimed at, and hash functions.
BITS_PER_KEY, HASHES = 12, 4
#: A filter up to this size is broadcast; a larger one is split by block, and keys are sent to their blocks.
FILTER_BYTES = 32 << 20


def bloom_blocks(n_keys: int) -> int:
    """Blocks of a filter for so many distinct keys, however many they are."""
    return max(1, math.ceil(n_keys * BITS_PER_KEY / (WORDS * 64)))


def filter_bytes(n_blocks: int) -> int:
    return n_blocks * WORDS * 8


def _positions(keys: list[str]) -> tuple:
    """Block hash, and positions within the block, of a key."""
    low, step = F.xxhash64(*keys, F.lit(17)), F.xxhash64(*keys, F.lit(91))
    spots = [F.pmod(F.shiftright(low, 3 + 11 * i).bitwiseXOR(F.shiftright(step, 5 + 7 * i)), F.lit(WORDS * 64)).cast("int") for i in range(HASHES)]
    return F.xxhash64(*keys), F.array(*spots)


def bloom_filter(parents: DataFrame, keys: list[str], n_blocks: int) -> DataFrame:
    """A blocked Bloom filter of the key columns: one row per block, (block, words array<bigint>).

    Built by bitwise OR, so partial filters combine before the shuffle and repeated keys cost
    nothing. n_blocks rows of 4 KiB.
    """
    spark = parents.sparkSession
    block, spots = _positions(keys)
    bits = parents.select(F.pmod(block, F.lit(n_blocks)).cast("int").alias("block"), F.explode(spots).alias("_p"))
    bits = bits.select("block", F.shiftright("_p", 6).alias("word"), F.expr("shiftleft(1L, _p & 63)").alias("bits"))
    empty = spark.range(n_blocks * WORDS).select((F.col("id") / WORDS).cast("int").alias("block"), F.pmod("id", F.lit(WORDS)).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bits.union(empty).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def with_might_contain(df: DataFrame, bloom: DataFrame, keys: list[str], n_blocks: int, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """``df`` with maybe_parent: false proves that the filter's parents lack the key.

    The filter is broadcast as long as its n_blocks * 4 KiB stay within most_bytes. A larger one is
    met by a shuffle on the block, where a heavy block is met in place; ``df`` should be a written
    table then.
    """
    block, spots = _positions(keys)
    df = df.withColumn("_block", F.pmod(block, F.lit(n_blocks)).cast("int")).withColumn("_spots", spots)
    hit = F.forall("_spots", lambda p: F.getbit(F.get("_words", F.shiftright(p, 6)), p.bitwiseAND(63)) == 1)
    bloom = bloom.select(F.col("block").alias("_block"), F.col("words").alias("_words"))
    met = df.join(F.broadcast(bloom), "_block", "left") if filter_bytes(n_blocks) <= most_bytes else looked_up(df, bloom, ["_block"])
    return met.withColumn("maybe_parent", F.coalesce(hit, F.lit(False))).drop("_block", "_spots", "_words")


def known_indexes(schema: DataFrame) -> DataFrame:
    """index keyspace -> table keyspace and name; a catalogue of a few rows."""
    rows = schema.where(F.col("secondary_index_keyspace_id").isNotNull())
    return rows.groupBy(F.col("secondary_index_keyspace_id").alias("index_id")).agg(F.min("keyspace_id").alias("table_id"), F.min("table_name").alias("table_name"))


def screened(fragments: DataFrame, versions: DataFrame, schema: DataFrame, with_time: bool, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """Present postings of known indexes with table_id, table_name and maybe_parent. The postings are merged once and written, as they are used several times."""
    index = known_indexes(schema)
    posts = merge_postings(fragments, with_time=with_time)
    posts = checkpointed(posts.join(index, posts["keyspace_id"] == index["index_id"]).drop("index_id", "_task"), "p2-postings")
    parents = versions.select(F.col("keyspace_id").alias("table_id"), F.col("key_value").alias("primary_key")).where("table_id IS NOT NULL AND primary_key IS NOT NULL")
    n_blocks = bloom_blocks(math.ceil(1.05 * parents.agg(F.approx_count_distinct(F.xxhash64("table_id", "primary_key"), 0.02)).first()[0]))
    bloom = bloom_filter(parents, ["table_id", "primary_key"], n_blocks)
    return with_might_contain(posts, bloom, ["table_id", "primary_key"], n_blocks, most_bytes)


def orphan_references(fragments: DataFrame, versions: DataFrame, schema: DataFrame, with_time: bool = False, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """Present postings without a row they could refer to, with orphan_kind.

    missing: the table has no version of the key. deleted: its newest version is a tombstone (also
    where a live version shares that txn_id). late: its newest version is live, but all versions are
    younger than the posting's newest entry. Keys compare exactly. Only indexes known to the schema
    count; empty inputs give no rows, and an empty version table makes every posting missing.

    Postings that the Bloom filter rejects are missing for certain and take no part in the join; the
    others are joined exactly with one aggregated row per parent key, so that a key with many
    versions is reduced before the shuffle, and one with many postings is met where they are.
    """
    posts = screened(fragments, versions, schema, with_time, most_bytes)
    keep = ["keyspace_id", "index_value", "primary_key", "table_name", *(["written_at"] if with_time else [])]
    sure = posts.where(~F.col("maybe_parent")).select(*keep, F.lit("missing").alias("orphan_kind"))
    dead = F.coalesce(F.col("is_tombstone"), F.lit(False))
    state = versions.groupBy(F.col("keyspace_id").alias("table_id"), F.col("key_value").alias("primary_key")).agg(
        F.max(F.when(~dead, F.col("txn_id"))).alias("_live"), F.max(F.when(dead, F.col("txn_id"))).alias("_dead"), F.min("txn_id").alias("_first"), F.lit(True).alias("_there")
    )
    met = looked_up(posts.where("maybe_parent"), state, ["table_id", "primary_key"])
    kind = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("_dead").isNotNull() & (F.col("_live").isNull() | (F.col("_dead") >= F.col("_live"))), "deleted")
        .when(F.col("_first") > F.col("txn_id"), "late")
    )
    return sure.unionByName(met.withColumn("orphan_kind", kind).where("orphan_kind IS NOT NULL").select(*keep, "orphan_kind"))


def orphan_report(fragments: DataFrame, versions: DataFrame, schema: DataFrame) -> DataFrame:
    """Orphans counted per table, week (its Monday) of the posting's written_at, and kind. An unknown time gives a null week."""
    rows = orphan_references(fragments, versions, schema, with_time=True)
    week = F.date_trunc("week", "written_at").cast("date").alias("week")
    return rows.groupBy("table_name", week, "orphan_kind").agg(F.count(F.lit(1)).alias("n_orphans"))


def filter_report(fragments: DataFrame, versions: DataFrame, schema: DataFrame) -> DataFrame:
    """One row: postings, those proven orphans by the filter, those left to the exact join, and how many of these the filter let through wrongly."""
    posts = screened(fragments, versions, schema, False)
    keys = versions.select(F.col("keyspace_id").alias("table_id"), F.col("key_value").alias("primary_key")).distinct().withColumn("_there", F.lit(True))
    met = looked_up(posts, keys, ["table_id", "primary_key"])
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return met.agg(F.count(F.lit(1)).alias("n_postings"), n(~F.col("maybe_parent")).alias("n_proven"), n(F.col("maybe_parent")).alias("n_verified"), n(F.col("maybe_parent") & F.col("_there").isNull()).alias("n_let_through"))
