"""A change feed as a stream: each micro-batch is replayed to its state, and states are merged as they pile up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators.replay import KEY, VERSION, committed, parsed_changes, replay
from keyloom.sources.files import Files

#: After so many batches their states are merged into one.
MERGE_EVERY = 8


class StreamedFeed:
    """The state of a feed whose changes, and whose transactions' commits, arrive in any order, kept in ``path``.

    A micro-batch takes the changes that came with it and those that waited for a commit. Changes of
    transactions known as committed by now are replayed to a state, which is the last change of each
    column and the last delete of each key; it is written to ``state/<batch>``. The others wait in
    ``waiting/<batch>``; a commit may come any number of batches later, or never. Every MERGE_EVERY
    batches the states so far are replayed into one, ``merged/<batch>``, and the older ones dropped, so
    what is kept grows with the current rows and with what waits, not with history.

    Which change counts depends on versions, not on arrival, and replaying states gives the state
    of all their changes; so batches may hold changes late by any time. All folders are named by the
    batch and written whole; a batch that is run again after a failure finds what it found before, and
    replaces its own, so nothing is repeated.
    """

    COLUMNS = [*KEY, *VERSION, "column_id"]
    SCHEMA = "keyspace_id long, key_value long, txn_id long, seq long, column_id int"

    def __init__(self, spark: SparkSession, path: str, merge_every: int = MERGE_EVERY) -> None:
        self.spark, self.path, self.files, self.merge_every = spark, path, Files(spark), merge_every

    def _batches(self, kind: str) -> list[int]:
        """Batches whose folder of a kind is complete."""
        return sorted(int(n) for n in self.files.names(f"{self.path}/{kind}") if n.isdigit() and self.files.exists(f"{self.path}/{kind}/{n}/_SUCCESS"))

    def _read(self, kind: str, batches: list[int]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{kind}/{b}" for b in batches]) if batches else self.spark.createDataFrame([], self.SCHEMA)

    def _put(self, df: DataFrame, kind: str, batch: int) -> None:
        df.select(*self.COLUMNS).write.mode("overwrite").parquet(f"{self.path}/{kind}/{batch}")

    def _states(self, upto: int, merged_before: int) -> DataFrame:
        """The states of the batches up to one: the last merged one before a batch, and those after it."""
        last = max((b for b in self._batches("merged") if b < merged_before), default=-1)
        states = self._read("state", [b for b in self._batches("state") if last < b <= upto])
        return states if last < 0 else states.union(self._read("merged", [last]))

    def _drop(self, kind: str, upto: int) -> None:
        for b in self._batches(kind):
            if b <= upto:
                self.files.delete(f"{self.path}/{kind}/{b}")

    def take(self, batch: DataFrame, number: int, log: DataFrame) -> None:
        """Takes in one micro-batch of the feed, given the transaction log as it is by now."""
        waited = self._read("waiting", [b for b in self._batches("waiting") if b < number][-1:])
        changes = parsed_changes(batch).select(*self.COLUMNS).union(waited).persist()
        try:
            known = committed(log)
            self._put(replay(changes.join(known, "txn_id", "left_semi"), keep_deletes=True), "state", number)
            self._put(changes.join(known, "txn_id", "left_anti").distinct(), "waiting", number)
        finally:
            changes.unpersist()
        if number % self.merge_every == self.merge_every - 1:
            self._put(replay(self._states(number, number), keep_deletes=True), "merged", number)
            # What this batch would need again if it failed after this point: the merged state before it.
            older = [b for b in self._batches("merged") if b < number]
            self._drop("state", older[-1] if older else -1)
            self._drop("merged", older[-2] if len(older) > 1 else -1)
        self._drop("waiting", number - 2)

    def write(self, feed: DataFrame, checkpoint: str, log: Callable[[], DataFrame]) -> StreamingQuery:
        """Starts taking in a streaming DataFrame with the columns of the feed; ends when the available input is done. log: reads the transaction log as of now."""
        return feed.writeStream.foreachBatch(lambda batch, number: self.take(batch, number, log())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, log: DataFrame | None = None) -> DataFrame:
        """The current cells after all batches so far; with a log, also those of changes whose commit came after their batch."""
        last = max(self._batches("waiting"), default=-1)
        rows = self._states(last, last + 1)
        if log is not None:
            rows = rows.union(self._read("waiting", [last] if last >= 0 else []).join(committed(log), "txn_id", "left_semi").select(*self.COLUMNS))
        return replay(rows.select(*self.COLUMNS))
