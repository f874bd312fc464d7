"""Ordered replay of a change feed: inserts, updates and deletes in any order of arrival give the current rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.balanced import tasks_for
from keyloom.sources.shared import ship_package

KEY, VERSION = ["keyspace_id", "key_value"], ["txn_id", "seq"]
#: Stands in the column id of a change that deletes its key.
DELETE = -1
#: A key is hot if it has more than a fair task's share of changes divided by this.
HOT_PARTS = 4
CELLS = "keyspace_id long, key_value long, column_id int, txn_id long, seq long"


def committed(log: DataFrame) -> DataFrame:
    """txn_id of the transactions with a commit record."""
    return log.where(F.col("log_record") == "commit").where("txn_id IS NOT NULL").select("txn_id").distinct()


def parsed_changes(feed: DataFrame) -> DataFrame:
    """One row per column that a change sets, or one row with column_id DELETE.

    A null or empty entry deletes. Any other entry must be one whole JSON object: torn entries are
    left out, JSON nulls set nothing, and so do names that are no column number. Changes without a
    key, transaction or sequence are left out.
    """
    v = F.col("entry_value")
    # As the only element of an array, so that nothing may follow the object.
    whole = F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})
    shaped = v.rlike(r"(?s)^\s*\{.*\}\s*\z")
    names = F.map_keys(F.map_filter(F.get(whole, F.lit(0)), lambda k, x: x.isNotNull()))
    gone = v.isNull() | (v == "")
    columns = F.when(gone, F.array(F.lit(DELETE))).when(shaped & (F.size(whole) == 1), F.transform(names, lambda n: n.try_cast("int")))
    rows = feed.where("keyspace_id IS NOT NULL AND key_value IS NOT NULL AND txn_id IS NOT NULL AND seq IS NOT NULL").select(*KEY, *VERSION, F.explode(columns).alias("column_id"))
    return rows.where((F.col("column_id") >= 0) | (F.col("column_id") == DELETE))


def _settle(rows: pd.DataFrame, keep_deletes: bool) -> pd.DataFrame:
    """State of each key after its changes, given in order: the last change of each column after the last delete, and that delete."""
    rows = rows.reset_index(drop=True)
    place = pd.Series(rows.index, index=rows.index)
    is_delete = rows["column_id"] == DELETE
    last = place.where(is_delete).groupby([rows[k] for k in KEY], sort=False).transform("max").fillna(-1)
    rows = rows[(place > last) | (is_delete & (place == last))]
    rows = rows.drop_duplicates([*KEY, "column_id"], keep="last")
    return rows if keep_deletes else rows[rows["column_id"] != DELETE]


def _replayer(keep_deletes: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key and version. The state of the last key of a batch is carried into the next one."""
        carry: pd.DataFrame | None = None
        for b in batches:
            if not len(b):
                continue
            rows = _settle(b if carry is None else pd.concat([carry, b], ignore_index=True), keep_deletes=True)
            end = b.iloc[-1]
            is_open = (rows[KEY[0]] == end[KEY[0]]) & (rows[KEY[1]] == end[KEY[1]])
            carry, done = rows[is_open], rows[~is_open]
            if not keep_deletes:
                done = done[done["column_id"] != DELETE]
            if len(done):
                yield done[["keyspace_id", "key_value", "column_id", "txn_id", "seq"]]
        if carry is not None:
            carry = _settle(carry, keep_deletes)
            if len(carry):
                yield carry[["keyspace_id", "key_value", "column_id", "txn_id", "seq"]]

    return run


def _ordered(changes: DataFrame, tasks: int) -> DataFrame:
    return changes.repartition(tasks, *KEY).sortWithinPartitions(*KEY, *VERSION, "column_id")


def hot_keys(rows: DataFrame, tasks: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(keyspace_id, key_value, parts) of the keys whose rows exceed a part of a task's fair share; and the number of tasks, which is what the rows need unless it is given.

    Fewer than tasks * HOT_PARTS keys can exceed it, so the list may be collected and broadcast.
    """
    loads = rows.where("keyspace_id IS NOT NULL AND key_value IS NOT NULL").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        total = loads.agg(F.sum("_n")).first()[0] or 0
        tasks = tasks or tasks_for(rows.sparkSession, total)
        share = max(1000.0, total / (tasks * HOT_PARTS))
        return [(r[0], r[1], min(tasks, int(r[2] / share) + 1)) for r in loads.where(F.col("_n") > share).collect()], tasks
    finally:
        loads.unpersist()


def replay(changes: DataFrame, tasks: int | None = None, hot: list[tuple[int, int, int]] | None = None, keep_deletes: bool = False) -> DataFrame:
    """The filled cells of the current rows: keyspace_id, key_value, column_id, txn_id, seq of the change that wrote each.

    changes: keyspace_id, key_value, txn_id, seq, column_id (DELETE deletes the key). Rows are
    partitioned by key, sorted by (txn_id, seq) and run through a state machine that keeps the last
    change of each column since the last delete; a change met again changes nothing. Memory holds one
    batch and the state of one key.

    The changes of a hot key are first cut into several parts and each part is replayed to its
    state, which is again a few changes; the parts' states then replay like the changes of any other
    key. So no task gets all changes of a hot key. hot: these keys, if they are known already, with the number of tasks; which
    they are decides where work is done and not the result. Of a deleting and a setting change with the same
    version the setting one counts. keep_deletes: the last delete of each key stays as a row of
    column DELETE, so that the result can be replayed together with further changes, older or newer.
    """
    spark = changes.sparkSession
    ship_package(spark)
    columns = [*KEY, *VERSION, "column_id"]
    changes = changes.select(*columns)
    if hot is None:
        hot, tasks = hot_keys(changes, tasks)
    if hot:
        plan = F.broadcast(spark.createDataFrame(hot, "_hk long, _hv long, _parts int"))
        is_hot = (changes["keyspace_id"] == F.col("_hk")) & (changes["key_value"] == F.col("_hv"))
        # Semi and anti joins go below the parsing of entries, so no entry is parsed for both sides.
        cut = changes.join(plan, is_hot, "left_semi").join(plan, is_hot).withColumn("_part", F.pmod(F.xxhash64(*VERSION), F.col("_parts").cast("long")))
        states = cut.select(*columns, "_part").repartition(tasks, *KEY, "_part").sortWithinPartitions("_part", *KEY, *VERSION, "column_id")
        states = states.mapInPandas(_part_replayer, CELLS + ", _part long").select(*columns)
        changes = changes.join(plan, is_hot, "left_anti").unionByName(states)
    return _ordered(changes, tasks).mapInPandas(_replayer(keep_deletes), CELLS)


def _part_replayer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As _replayer, for rows sorted by part and key: the parts of a batch are settled one by one."""
    carry: pd.DataFrame | None = None
    for b in batches:
        if not len(b):
            continue
        rows = b if carry is None else pd.concat([carry, b], ignore_index=True)
        settled = pd.concat([_settle(x, True) for _, x in rows.groupby("_part", sort=False)], ignore_index=True)
        end = b.iloc[-1]
        is_open = (settled["_part"] == end["_part"]) & (settled[KEY[0]] == end[KEY[0]]) & (settled[KEY[1]] == end[KEY[1]])
        carry, done = settled[is_open], settled[~is_open]
        if len(done):
            yield done[["keyspace_id", "key_value", "column_id", "txn_id", "seq", "_part"]]
    if carry is not None and len(carry):
        yield carry[["keyspace_id", "key_value", "column_id", "txn_id", "seq", "_part"]]


def current_cells(feed: DataFrame, log: DataFrame, tasks: int | None = None) -> DataFrame:
    """Current cells after all changes of committed transactions; a transaction without a commit record counts for nothing."""
    kept = feed.join(committed(log), "txn_id", "left_semi")
    hot, tasks = hot_keys(feed, tasks)
    return replay(parsed_changes(kept), tasks, hot)


def current_rows(feed: DataFrame, log: DataFrame, tasks: int | None = None) -> DataFrame:
    """keyspace_id, key_value, n_cells, last_txn of each key with a filled cell."""
    return current_cells(feed, log, tasks).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_cells"), F.max("txn_id").alias("last_txn"))
