"""Documents into containers of a fixed number of tokens: minimum bin slack."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.sources.shared import ship_package, spread

CAPACITY = 2048
#: File of a public tokenizer's ranks; a name is looked up where the tokenizers are installed, a path is used as it is.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Documents that are packed together. A task holds their ids and sizes, never their texts; each
#: shard leaves a container or two less full, so larger shards waste less and smaller ones spread further.
SHARD_DOCUMENTS = 20_000
PACKED = "container_id long, doc_id long, piece int, first_token long, n_tokens int"


def encoder(tokenizer: str):
    import public_tokenizers
    import tiktoken

    path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every document with a text; null and empty texts are left out, and texts without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or encoder(tokenizer)
            n = [len(enc.encode_ordinary(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    ship_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    return spread(rows).mapInArrow(run, "doc_id long, n_tokens long")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available sizes (size -> number available) with the largest sum within the capacity.

    Subset sums as the bits of an integer: bit s is set if s can be reached. A size available often
    is taken in powers of two, so that every number of it can be composed. Larger sizes come first,
    and the search ends when the capacity is reached exactly.
    """
    mask = (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for size in sorted(counts, reverse=True):
        left, many = min(counts[size], capacity // size), 1
        while left > 0:
            take = min(many, left)
            steps.append((size, take, reach))
            reach |= (reach << size * take) & mask
            left -= take
            many *= 2
        if reach >> capacity & 1:
            break
    best = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[size] = chosen.get(size, 0) + take
            best -= size * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Containers for items of given sizes as (sizes in a container, how many such containers).

    Each container starts with the largest item left, which fits in fewer combinations the longer it
    waits, and gets the fullest combination with it. Each time that combination is taken out, as often as the items allow: the next search
    would find it again. It uses up at least one size, or all but less than one more, so there are
    no more searches than about twice the number of different sizes, however many items there are.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    out = []
    while left:
        first = max(left)
        others = {s: n - (s == first) for s, n in left.items() if s <= capacity - first and n > (s == first)}
        chosen = fullest(others, capacity - first)
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[s] // k for s, k in chosen.items())
        out.append((chosen, times))
        for s, k in chosen.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def pack_shard(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(container, doc_id, piece, first_token, n_tokens) of a shard's pieces, containers numbered from 0.

    A document beyond the capacity is split into full pieces, each a container of its own, and a rest
    that is packed like any other item.
    """
    full = (sizes - 1) // capacity
    rest = sizes - full * capacity
    order = np.lexsort((ids, rest))
    by_size = rest[order]
    place = {int(s): i for s, i in zip(*np.unique(by_size, return_index=True), strict=True)}
    number = {int(s): int(n) for s, n in zip(*np.unique(by_size, return_counts=True), strict=True)}
    bin_of = np.zeros(len(ids), np.int64)
    n_bins = 0
    for chosen, times in minimum_bin_slack(number, capacity):
        for s, k in chosen.items():
            at = place[s]
            bin_of[order[at : at + k * times]] = n_bins + np.repeat(np.arange(times), k)
            place[s] = at + k * times
        n_bins += times
    split = np.repeat(np.arange(len(ids)), full)
    piece = np.arange(len(split)) - np.repeat(np.cumsum(full) - full, full)
    return (
        np.concatenate([bin_of, n_bins + np.arange(len(split))]),
        np.concatenate([ids, ids[split]]),
        np.concatenate([full, piece]),
        np.concatenate([full * capacity, piece * capacity]),
        np.concatenate([rest, np.full(len(split), capacity)]),
    )


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """container_id, doc_id, piece, first_token, n_tokens: the tokens of a document that lie in a container.

    Documents are counted in tokens where they are read; only ids and counts are shuffled, spread by
    hash over shards of about ``shard_documents``, and each shard is packed by itself. No document is
    split unless it alone exceeds the capacity. Null and empty texts are no items; a doc_id that is
    given twice is packed twice. The result is the same in every run.
    """
    shards = max(1, math.ceil(documents.count() / shard_documents))
    # A set number of partitions, as the rows are few bytes and much work: merging small partitions would put all on one task.
    tasks = min(shards, 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = token_counts(documents, tokenizer).where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        c, i, p, f, n = pack_shard(pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy(), capacity)
        return pd.DataFrame({"container_id": (int(key[0]) << 32) + c, "doc_id": i, "piece": p.astype(np.int32), "first_token": f, "n_tokens": n.astype(np.int32)})

    return items.repartition(tasks, "shard").groupBy("shard").applyInPandas(run, PACKED)


def fill_report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the least number that the tokens need, pieces, tokens, and the share of space filled (null without containers)."""
    per = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    one = per.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"))
    space = F.col("n_containers") * capacity
    return one.select("n_containers", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), "n_pieces", "n_tokens", F.when(space > 0, F.col("n_tokens") / space).alias("filled"))
