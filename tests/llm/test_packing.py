import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import packing as P


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(12, 30))
@settings(max_examples=150, deadline=None)
def test_fullest_is_fullest(counts, capacity):
    chosen = P.fullest(counts, capacity)
    assert all(0 < k <= counts[s] for s, k in chosen.items())
    best = max(t for t in (sum(s * k for s, k in zip(counts, ks, strict=True)) for ks in itertools.product(*[range(n + 1) for n in counts.values()])) if t <= capacity)
    assert sum(s * k for s, k in chosen.items()) == best


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=80, deadline=None)
def test_every_item_is_packed_once(sizes):
    out = P.minimum_bin_slack(dict(Counter(sizes)), 50)
    packed = Counter()
    for chosen, times in out:
        assert times > 0 and sum(s * k for s, k in chosen.items()) <= 50
        for s, k in chosen.items():
            packed[s] += k * times
    assert packed == Counter(sizes)


def test_shard():
    rng = np.random.default_rng(0)
    sizes = np.concatenate([rng.integers(1, 3000, 3000), [2048, 4096, 4097, 10_000]])
    ids = rng.permutation(len(sizes))
    c, i, piece, first, n = P.pack_shard(ids, sizes, 2048)
    load = np.bincount(c, n)
    assert load.max() <= 2048 and load.min() > 0
    assert load.sum() / 2048 / len(load) > 0.985
    whole = {int(a): int(b) for a, b in zip(ids, sizes, strict=True)}
    by = {}
    for d, p, f, k in zip(i, piece, first, n, strict=True):
        by.setdefault(int(d), []).append((int(p), int(f), int(k)))
    for d, parts in by.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        assert [f for _, f, _ in parts] == list(np.cumsum([0, *[k for _, _, k in parts]])[:-1])
        assert sum(k for _, _, k in parts) == whole[d] and (whole[d] > 2048 or len(parts) == 1)
    assert len(by) == len(sizes)
    assert all(len(x) == 0 for x in P.pack_shard(np.zeros(0, np.int64), np.zeros(0, np.int64), 2048))


def test_tokens_round_trip():
    enc = P.encoder(P.TOKENIZER)
    text = "¿Viste cómo la ley anula la demandante?\r\n<|endoftext|> 🙂"
    assert enc.decode(enc.encode_ordinary(text)) == text


@pytest.fixture
def documents(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "word " * 9000), (5, "a"), (None, "lost"), (6, " ")] + [(i, "some text " * (i % 90 + 1)) for i in range(10, 400)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("n_tokens", F.lit(1))


def test_packed(spark, documents):
    got = P.packed(documents, shard_documents=100)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(r) for r in P.packed(documents.repartition(7), shard_documents=100).collect())
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(documents).collect()}
    assert 1 not in counts and 2 not in counts and None not in counts
    total = Counter()
    load = Counter()
    for c, d, _, _, n in rows:
        total[d] += n
        load[c] += n
    assert total == counts and max(load.values()) <= P.CAPACITY
    r = P.fill_report(got).first()
    assert r.n_containers == len(load) and r.n_tokens == sum(counts.values()) and r.least_containers <= r.n_containers
    empty = P.packed(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and P.fill_report(empty).first().filled is None


def test_filled_on_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = P.fill_report(P.packed(docs)).first()
    assert r.n_containers <= r.least_containers * 1.005 + 1
