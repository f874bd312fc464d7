"""Has this key been seen before? Scalable Bloom chains, kept from run to run, with an exact check of what they let through."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.operators.balanced import tasks_for
from keyloom.operators.references import FILTER_BYTES, bloom_blocks, bloom_filter, filter_bytes, with_might_contain
from keyloom.sources.files import Files
from keyloom.sources.shared import checkpointed, shared_path, ship_package

#: Bound on the share of new keys that a chain calls seen, however long its history grows.
ERROR_BOUND = 0.01
#: Each layer may err half as often as the one before, so all layers together stay under the bound.
TIGHTEN = 0.5
#: Keys of the first layer; each further layer holds twice as many.
FIRST_CAPACITY, GROWTH = 1024, 2
#: Layers are made for this part of the error they may have, as small filters err a little more than the formula says.
MARGIN = 0.8
#: SSTables up to which their ids go to the scan as a list.
PUSHED = 1000


class BloomChain:
    """Layers of Bloom filters: a full layer stays as it is and a larger, stricter one is opened.

    Keys are pairs of unsigned 64-bit hashes. Layer i holds capacity * GROWTH**i keys at an error of
    bound * (1 - TIGHTEN) * TIGHTEN**i; the sum of all errors, ``promised``, never reaches the bound.
    """

    def __init__(self, bound: float = ERROR_BOUND, capacity: int = FIRST_CAPACITY) -> None:
        self.bound, self.capacity = bound, capacity
        self.layers: list[dict] = []

    def _open(self) -> dict:
        i = len(self.layers)
        error, room = self.bound * (1 - TIGHTEN) * TIGHTEN**i, self.capacity * GROWTH**i
        made_for = MARGIN * error
        bits = max(64, math.ceil(-room * math.log(made_for) / math.log(2) ** 2))
        self.layers.append({"error": error, "room": room, "bits": bits, "hashes": max(1, math.ceil(-math.log2(made_for))), "n": 0, "words": np.zeros((bits + 63) // 64, np.uint64)})
        return self.layers[-1]

    @staticmethod
    def _spots(layer: dict, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        step = b | np.uint64(1)
        for i in range(layer["hashes"]):
            mixed = a + np.uint64(i) * step
            mixed ^= mixed >> np.uint64(29)
            yield mixed % np.uint64(layer["bits"])

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.zeros(len(a), bool)
        for layer in self.layers:
            hit = np.ones(len(a), bool)
            for p in self._spots(layer, a, b):
                hit &= (layer["words"][p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            found |= hit
        return found

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds keys that contains() denied; the caller leaves out repeats."""
        while len(a):
            layer = self.layers[-1] if self.layers and self.layers[-1]["n"] < self.layers[-1]["room"] else self._open()
            n = min(len(a), layer["room"] - layer["n"])
            for p in self._spots(layer, a[:n], b[:n]):
                np.bitwise_or.at(layer["words"], p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
            layer["n"] += n
            a, b = a[n:], b[n:]

    def see(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key seems to have come before, in the chain or earlier in this batch; then adds the new ones."""
        seen = self.contains(a, b)
        pairs = np.stack([a, b], axis=1)
        first = np.zeros(len(a), bool)
        first[np.unique(pairs, axis=0, return_index=True)[1]] = True
        new = ~seen & first
        self.add(a[new], b[new])
        return seen | ~first

    @property
    def promised(self) -> float:
        """Compounded bound on false positives of the layers opened so far."""
        return 1.0 - math.prod(1.0 - x["error"] for x in self.layers)


    @classmethod
    def of(cls, layers: list[dict], bound: float, capacity: int = FIRST_CAPACITY) -> BloomChain:
        """A chain of layers that were kept."""
        chain = cls(bound, capacity)
        chain.layers = [{**x, "words": np.frombuffer(x["words"], np.uint64).copy()} for x in sorted(layers, key=lambda x: x["layer"])]
        return chain


LAYER = "shard int, layer int, n long, room long, bits long, hashes int, error double, ones long, words binary"
FACTS = ["n", "room", "bits", "hashes", "error"]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _hashes() -> list:
    return [F.xxhash64("keyspace_id", "key_value").alias("h1"), F.xxhash64("key_value", "keyspace_id", F.lit(7)).alias("h2")]


def _known(df: DataFrame) -> DataFrame:
    return df.where("keyspace_id IS NOT NULL AND key_value IS NOT NULL")


def _each_shard(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[tuple[int, BloomChain, pa.RecordBatch | None]]:
    """Rows sorted by shard, the layers first: the shard's chain with each piece of its other rows, and with None at the shard's end."""
    shard, chain, layers = None, None, []
    for b in batches:
        numbers = b.column("shard").to_numpy()
        cuts = np.concatenate([[0], np.nonzero(np.diff(numbers))[0] + 1, [len(numbers)]])
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if at == end:
                continue
            if numbers[at] != shard:
                if shard is not None:
                    yield shard, chain or BloomChain.of(layers, bound), None
                shard, chain, layers = int(numbers[at]), None, []
            part = b.slice(at, end - at)
            kept = part.filter(pa.compute.is_valid(part.column("layer")))
            layers += kept.select(["layer", *FACTS, "words"]).to_pylist()
            rest = part.filter(pa.compute.is_null(part.column("layer")))
            if rest.num_rows:
                chain = chain or BloomChain.of(layers, bound)
                yield shard, chain, rest
    if shard is not None:
        yield shard, chain or BloomChain.of(layers, bound), None


class SeenKeys:
    """The keys of all history as Bloom chains, one per shard of the key's hash, kept in ``path``.

    Each run adds a folder ``run-<n>`` with the layers that filled up in it, which never change
    again, the layers still open after it, and the SSTables it took in; the file ``current`` names
    the last run that ended. A run reads only SSTables that were not taken in yet. A task holds the
    chain of one shard, and never the keys.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None, bound: float = ERROR_BOUND) -> None:
        self.spark, self.path, self.files = spark, path, Files(spark)
        self.files.recover(f"{path}/current")
        kept = json.loads(self.files.read(f"{path}/current")) if self.files.exists(f"{path}/current") else {}
        self.runs: int = kept.get("runs", 0)
        self.shards: int | None = kept.get("shards", shards)
        self.bound: float = kept.get("bound", bound)

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def layers(self) -> DataFrame:
        """The layers of all chains: those that are full, of each run, and those open after the last."""
        full = [f"run-{i}/layers/is_full=true" for i in range(1, self.runs + 1)]
        names = [*full, f"run-{self.runs}/layers/is_full=false"] if self.runs else []
        return self._read([n for n in names if self.files.exists(f"{self.path}/{n}")], LAYER)

    def taken(self) -> DataFrame:
        """sstable_id of the SSTables taken in."""
        return self._read([f"run-{i}/taken" for i in range(1, self.runs + 1)], "sstable_id long")

    def _with_layers(self, rows: DataFrame) -> DataFrame:
        """Rows with h1 and h2, and the layers, in the partition of their shard and in its order."""
        self.shards = self.shards or tasks_for(self.spark, 0)
        rows = rows.withColumn("shard", F.pmod("h1", F.lit(self.shards)).cast("int"))
        both = self.layers().drop("ones").unionByName(rows, allowMissingColumns=True)
        return both.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("shard", F.col("layer").asc_nulls_last())

    def take(self, versions: DataFrame, tables: DataFrame | None = None) -> int:
        """Takes in the keys of SSTables that were not taken in before; gives their number.

        tables: the SSTables there are, by sstable_id; without it they are looked up in ``versions``.
        Where none is new, ``versions`` is not read. Repeated keys are reduced before they move.
        Rows with a null keyspace or key count for nothing.
        """
        ship_package(self.spark)
        to = f"{self.path}/run-{self.runs + 1}"
        listed = (versions if tables is None else tables).select("sstable_id").distinct()
        done = self.taken().select(F.col("sstable_id").alias("_s"))
        listed.join(done, F.col("sstable_id").eqNullSafe(F.col("_s")), "left_anti").write.mode("overwrite").parquet(f"{to}/taken")
        new = self._read([f"run-{self.runs + 1}/taken"], "sstable_id long")
        few = new.limit(PUSHED + 1).collect()
        if not few:
            self.files.delete(to)
            return 0
        # Of the first run, which sets the number of shards for all others, the row count is in the files' footers.
        self.shards = self.shards or tasks_for(self.spark, versions.count())
        rows = _known(versions).select("keyspace_id", "key_value", "sstable_id")
        if len(few) <= PUSHED and None not in (ids := [r[0] for r in few]):
            rows = rows.where(F.col("sstable_id").isin(*ids))
        else:
            new = new.select(F.col("sstable_id").alias("_s"))
            rows = rows.join(new, F.col("sstable_id").eqNullSafe(F.col("_s")), "left_semi")
        keys = rows.select(*_hashes()).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).select("h1", "h2")
        bound = self.bound
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in (LAYER + ", is_full boolean").split(", "))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            full = 0
            seen = None
            for shard, chain, rows in _each_shard(batches, bound):
                if shard != seen:
                    seen, full = shard, sum(x["n"] == x["room"] for x in chain.layers)
                if rows is not None:
                    chain.see(_unsigned(rows.column("h1")), _unsigned(rows.column("h2")))
                    continue
                out = [{"shard": shard, "layer": i, **{k: x[k] for k in FACTS}, "ones": int(np.bitwise_count(x["words"]).sum()), "words": x["words"].tobytes(), "is_full": x["n"] == x["room"]} for i, x in enumerate(chain.layers) if i >= full]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

        # The first piece of a shard finds its chain as it was kept, so what was full then is known and not written again.
        self._with_layers(keys).mapInArrow(run, LAYER + ", is_full boolean").write.mode("overwrite").partitionBy("is_full").parquet(f"{to}/layers")
        self.runs += 1
        self.files.write(f"{self.path}/current", json.dumps({"runs": self.runs, "shards": self.shards, "bound": self.bound}))
        return len(few) if len(few) <= PUSHED else new.count()

    def ask(self, keys: DataFrame) -> DataFrame:
        """keyspace_id, key_value, probe_id with maybe_seen: false is certain; true is wrong for at most ``bound`` of the new keys."""
        ship_package(self.spark)
        bound = self.bound

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, chain, rows in _each_shard(batches, bound):
                if rows is not None:
                    seen = chain.contains(_unsigned(rows.column("h1")), _unsigned(rows.column("h2")))
                    yield pa.RecordBatch.from_arrays([rows.column("keyspace_id"), rows.column("key_value"), rows.column("probe_id"), pa.array(seen)], ["keyspace_id", "key_value", "probe_id", "maybe_seen"])

        rows = keys.select("keyspace_id", "key_value", "probe_id", *_hashes())
        return self._with_layers(rows).mapInArrow(run, "keyspace_id long, key_value string, probe_id long, maybe_seen boolean")

    def report(self) -> DataFrame:
        """The layers of each shard's chain: shard, layer, n_keys, capacity, n_bits, n_hashes, fill, error, compounded (bound on the errors of all layers up to it)."""
        so_far = F.sum(F.log1p(-F.col("error"))).over(Window.partitionBy("shard").orderBy("layer"))
        return self.layers().select("shard", "layer", F.col("n").alias("n_keys"), F.col("room").alias("capacity"), F.col("bits").alias("n_bits"), F.col("hashes").alias("n_hashes"), (F.col("ones") / F.col("bits")).alias("fill"), "error", (-F.expm1(so_far)).alias("compounded"))


def first_probes(probes: DataFrame) -> DataFrame:
    """The earliest probe of each key: only this one can be new."""
    return _known(probes).groupBy("keyspace_id", "key_value").agg(F.min("probe_id").alias("probe_id"))


def _skipped_tables(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """sstable_id of SSTables whose stored filter is whole and denies all the keys: no key's byte in it is set.

    Of the keys only their places in a filter matter, at most STORED per keyspace.
    """
    places = keys.groupBy("keyspace_id").agg(F.collect_set(F.pmod(F.crc32(F.col("key_value").cast("binary")), F.lit(STORED)).cast("int")).alias("_asked"))
    ok = tables.join(stored_filter_state(tables).where("filter_state = 'ok'").select("sstable_id"), "sstable_id", "left_semi")
    body = F.hex(F.substring("bloom_filter", HEAD + 1, STORED))
    is_set = lambda p: F.substring(body, 2 * p + 2, F.lit(1)).isin(*"13579BDF")
    met = ok.select("sstable_id", "keyspace_id", "bloom_filter").join(places, "keyspace_id", "left")
    return met.where(F.col("_asked").isNull() | ~F.exists("_asked", is_set)).select("sstable_id").distinct()


def verified(answers: DataFrame, versions: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """The answers with ``seen``: what the chain is sure of stays, what it is not is looked up exactly among the earlier keys.

    Earlier keys that no doubtful probe asks for are left out where they are read: whole SSTables
    whose stored filter denies all of these, if ``tables`` is given, and then single keys by a Bloom
    filter of these, as long as it may be broadcast. So only about as many keys move as are asked for.
    """
    answers = checkpointed(answers, "p3-answers")
    doubt = answers.where("maybe_seen")
    rows = _known(versions).select("keyspace_id", "key_value", "sstable_id")
    if tables is not None:
        rows = rows.join(_skipped_tables(tables, doubt), "sstable_id", "left_anti")
    keys = ["keyspace_id", "key_value"]
    n_blocks = bloom_blocks(doubt.count())
    if filter_bytes(n_blocks) <= FILTER_BYTES:
        rows = with_might_contain(rows.select(*keys), bloom_filter(doubt, keys, n_blocks), keys, n_blocks).where("maybe_parent")
    there = rows.select(*keys).distinct().withColumn("_there", F.lit(True))
    met = doubt.join(there, keys, "left").withColumn("seen", F.col("_there").isNotNull()).drop("_there")
    return answers.where(~F.col("maybe_seen")).withColumn("seen", F.lit(False)).unionByName(met)


def chain_of(versions: DataFrame, shards: int | None = None, bound: float = ERROR_BOUND) -> SeenKeys:
    """A chain of its own over these versions, kept in the shared folder."""
    spark = versions.sparkSession
    chain = SeenKeys(spark, shared_path(spark, "p3"), shards, bound)
    chain.take(versions)
    return chain


def seen_before(versions: DataFrame, probes: DataFrame, chain: SeenKeys | None = None, tables: DataFrame | None = None) -> DataFrame:
    """probe_id of every probe whose key occurred before: in ``versions``, or in a probe with a smaller id.

    Exact. Null keys and null keyspaces are never seen. chain: one that has taken in the versions.
    Of each key only the first probe can be new, so all probes are seen but the first ones of new
    keys; those are taken out by their unique id, and no task ever receives all probes of a frequent key.
    """
    chain = chain or chain_of(versions)
    new = verified(chain.ask(first_probes(probes)), versions, tables).where(~F.col("seen")).select("probe_id")
    return _known(probes).select("probe_id").join(new, "probe_id", "left_anti")


def error_report(versions: DataFrame, probes: DataFrame, chain: SeenKeys | None = None, tables: DataFrame | None = None) -> DataFrame:
    """One row: distinct keys asked, new ones, those wrongly called seen, the measured rate and the bound.

    The rate is null where no key was new.
    """
    chain = chain or chain_of(versions)
    rows = verified(chain.ask(first_probes(probes)), versions, tables)
    wrong = F.coalesce(F.sum((F.col("maybe_seen") & ~F.col("seen")).cast("long")), F.lit(0))
    new = F.coalesce(F.sum((~F.col("seen")).cast("long")), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("n_keys"), new.alias("n_new"), wrong.alias("n_wrong"), (wrong / F.nullif(new, F.lit(0))).alias("wrong_rate")).withColumn("rate_bound", F.lit(chain.bound))


#: Layout of a stored filter: checksum, length of the bitmap, bitmap; a key sets bit 0 of one byte of it.
HEAD, STORED = 8, 512


def stored_filter_state(tables: DataFrame) -> DataFrame:
    """keyspace_id, sstable_id, filter_state (ok, none, cut, damaged) and n_set bytes of each stored filter; n_set is null unless ok."""
    f = F.col("bloom_filter")
    word = lambda at: F.conv(F.concat(*[F.substring(F.hex(f), 2 * (at + i) + 1, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    body = F.substring(f, HEAD + 1, STORED)
    state = F.when(f.isNull(), "none").when(F.octet_length(f) < HEAD + STORED, "cut").when((F.octet_length(f) > HEAD + STORED) | (word(4) != STORED) | (F.crc32(body) != word(0)), "damaged").otherwise("ok")
    spaced = F.regexp_replace(F.hex(body), "(..)", "$1 ")
    ones = F.length(F.regexp_replace(spaced, "[0-9A-F][02468ACE] ", "")) / 3
    return tables.select("keyspace_id", "sstable_id", state.alias("filter_state"), F.when(state == "ok", ones.cast("long")).alias("n_set"))
