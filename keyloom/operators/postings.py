"""Posting lists: merging fragments into the primary keys now present under each index value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.balanced import HOT, SAMPLE, TASK, ShardPlan, plan_shards

VALUE = ["keyspace_id", "index_value"]
PAIR = [*VALUE, "primary_key"]
#: Older than any transaction: stands for a missing transaction id.
OLDEST = -(1 << 63)


def usable_entries(fragments: DataFrame, *more: str) -> DataFrame:
    """One row per entry with a primary key and a presence flag. A missing txn_id counts as the oldest."""
    e = F.col("_e")
    rows = fragments.select(*VALUE, "fragment_id", *more, F.explode("entries").alias("_e"))
    rows = rows.select(*VALUE, "fragment_id", *more, e["primary_key"].alias("primary_key"), F.coalesce(e["txn_id"], F.lit(OLDEST)).alias("txn_id"), e["is_present"].alias("is_present"))
    return rows.where("primary_key IS NOT NULL AND is_present IS NOT NULL")


def shard_plan(fragments: DataFrame, tasks: int | None = None) -> ShardPlan:
    """Load of an index value: the entries of its fragments. Hot primary keys are sought in a sample of fragments."""
    loads = fragments.groupBy(*VALUE).agg(F.sum(F.when(F.col("entries").isNotNull(), F.size("entries")).otherwise(0)).alias("_n"))
    sampled = fragments.where(F.pmod(F.xxhash64("fragment_id"), F.lit(SAMPLE)) == 0)
    return plan_shards(loads, VALUE, ["primary_key"], "_n", tasks, usable_entries(sampled).select(*PAIR))


def merge_postings(fragments: DataFrame, plan: ShardPlan | None = None, with_time: bool = False) -> DataFrame:
    """The newest usable entry of each pair of index value and primary key, where it is present.

    Columns: keyspace_id, index_value, primary_key, txn_id of the newest entry, and with
    ``with_time`` the written_at of the first fragment that carried it; also the task that merged it.

    Fragments may be late or written twice: only transaction ids decide, so order and repeats do not
    matter. Where a present and an absent entry share a txn_id, the pair is present. Null and empty
    lists have no entries; a null index value is a value. Rows of any keyspace are merged.

    Every task gets a fair share of entries (see ``balanced``). The entries of a primary key that is
    frequent by itself are merged where they are read, and only one row per reading task moves.
    """
    plan = plan or shard_plan(fragments)
    rows = usable_entries(fragments, *["written_at"] * with_time)
    newest = F.when(F.col("is_present"), F.col("txn_id"))
    aggs = [F.max(newest).alias("_here"), F.max(F.when(~F.col("is_present"), F.col("txn_id"))).alias("_gone")]
    if with_time:
        first = F.struct(F.col("txn_id"), (-F.unix_micros("written_at")).alias("early"), F.col("written_at"))
        aggs.append(F.max(F.when(F.col("is_present"), first)).alias("_first"))
    if plan.hot:
        rows = plan.mark_hot(rows)
        cold = plan.route(rows.where(~F.col(HOT))).groupBy(TASK, *PAIR).agg(*aggs)
        # The usual aggregate: it combines in the reading tasks, so each sends a hot pair as one row.
        local = cold.unionByName(plan.assign(rows.where(F.col(HOT))).groupBy(TASK, *PAIR).agg(*aggs))
    else:
        local = plan.route(rows).groupBy(TASK, *PAIR).agg(*aggs)
    present = local.where(F.col("_here").isNotNull() & (F.col("_gone").isNull() | (F.col("_here") >= F.col("_gone"))))
    return present.select(TASK, *PAIR, F.col("_here").alias("txn_id"), *([F.col("_first.written_at").alias("written_at")] if with_time else []))


def postings_as_of(fragments: DataFrame, last_txn: int, hidden: list[int] | None = None) -> DataFrame:
    """keyspace_id, index_value, primary_key present for a reader that sees transactions up to ``last_txn`` but for the hidden ones.

    Entries of other transactions are left out before the merge; entries without a transaction are the oldest and are seen.
    """
    seen = lambda e: F.coalesce(e["txn_id"] <= last_txn, F.lit(True)) & (~F.coalesce(e["txn_id"].isin(*hidden), F.lit(False)) if hidden else F.lit(True))
    return merge_postings(fragments.withColumn("entries", F.filter("entries", seen))).select(*PAIR)


def present_postings(fragments: DataFrame, first_index: int = 101) -> DataFrame:
    """Pairs now present in the index keyspaces (those from ``first_index`` on), known to the schema or not."""
    return merge_postings(fragments.where(F.col("keyspace_id") >= first_index)).select(*PAIR)


def value_sizes(fragments: DataFrame, first_index: int = 101) -> DataFrame:
    """keyspace_id, index_value, n_keys (primary keys present), n_entries (entries written, usable or not), n_fragments.

    The matching side, one header per index value, is replicated to the tasks that merge the value's
    shards; each task counts its shard beside the header, and the counts of a value's few shards are
    added. Values without any present key are left out.
    """
    fragments = fragments.where(F.col("keyspace_id") >= first_index)
    plan = shard_plan(fragments)
    count = F.when(F.col("entries").isNotNull(), F.size("entries")).otherwise(0).cast("long")
    header = plan.replicate(fragments.groupBy(*VALUE).agg(F.sum(count).alias("n_entries"), F.count(F.lit(1)).alias("n_fragments")))
    shard = merge_postings(fragments, plan).groupBy(TASK, *VALUE).agg(F.count(F.lit(1)).alias("_n"))
    h = header.select(F.col(TASK).alias("_t"), *[F.col(c).alias("_h_" + c) for c in VALUE], "n_entries", "n_fragments")
    on = [shard[TASK] == h["_t"], *[shard[c].eqNullSafe(h["_h_" + c]) for c in VALUE]]
    met = shard.join(h, on, "inner").select(*[shard[c] for c in VALUE], "_n", "n_entries", "n_fragments")
    return met.groupBy(*VALUE).agg(F.sum("_n").alias("n_keys"), F.max("n_entries").alias("n_entries"), F.max("n_fragments").alias("n_fragments"))
