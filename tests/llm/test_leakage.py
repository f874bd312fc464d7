import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import leakage as L
from keyloom.llm.folding import letters
from keyloom.llm.subtitles import speech

PASSAGE = "In the misty valley of Otvalos, 1201 tilers once stored barrels of resin from Galbru beneath the stone granary from Otvalmon. Which of the 1242 lamplighters left grey wool from Ñeta behind the northern causeway when Quinpreno was abandoned, and who kept the sealed chest?"
OTHER = "The chronicle of Osotria records that 1054 charcoal burners traded barrels of resin from Brutado for horn combs from Noos during the treeless winter of that year."
W = PASSAGE.split()


def as_file(text, width=5):
    w = text.split()
    return "\n\n".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n" + " ".join(w[i * width : (i + 1) * width]) for i in range(-(-len(w) // width)))


def found(text, items=((1, PASSAGE), (2, OTHER))):
    return sorted(i for _, i in L._search(L.Passages(list(items)), [9], [text]))


def test_quotations_and_their_length():
    assert found(as_file("Good night. " + PASSAGE + " Wait, wait.")) == [1]
    assert found(as_file("Come on. " + " ".join(W[4:16]) + " Sit down, Ciro.")) == [1]
    assert found(as_file("Come on. " + " ".join(W[4:15]) + " Sit down, Ciro.")) == []
    assert found(as_file(" ".join(W[:12]))) == [1] and found(as_file(" ".join(W[-12:]))) == [1]
    assert found(as_file(PASSAGE + " Anyway. " + OTHER)) == [1, 2]
    assert found("") == [] and found(as_file("Good night.")) == []


def test_retelling_is_none():
    rnd = random.Random(1)
    for _ in range(20):
        told = [w if i % 7 else rnd.choice(["ya", "Fania", "so", "old", "that"]) for i, w in enumerate(W)]
        assert found(as_file(" ".join(told))) == []


@pytest.mark.parametrize("damage", [
    lambda t: t.upper(), lambda t: t.replace("e", "c", 3).replace("t", "f", 2).replace("h", "li", 1), lambda t: t.replace("m", "rn").replace("w", "vv"), lambda t: t.replace("o", "0").replace("l", "I"),
    lambda t: t.replace(" ", "", 5).replace("stone", "st one"), lambda t: t.encode().decode("latin-1"), lambda t: t.replace("Ñ", "�").replace("valley", "vall�y"), lambda t: t.replace("Ñ", "N").replace(",", ""),
    lambda t: t.replace("granary", "granry").replace("valley", "vxlley"),
    lambda t: t.replace("barrels", "<b>barrels</b> [phone rings]").replace("Which", "- Which"),
])
def test_damage(damage):
    assert found(as_file("Good night. " + damage(PASSAGE))) == [1]


def test_another_number_is_another_passage():
    assert found(as_file(" ".join(W[4:10] + W[10:16]).replace("1201", "1301"))) == []
    assert found(as_file(" ".join(W[4:16]).replace("1201", "l2O1"))) == [1]


def test_interruptions_by_adverts_and_names():
    a, b = as_file(" ".join(W[:8])), as_file("VESKO: " + " ".join(W[8:20]))
    ad = "\n\n7\n00:01:00,000 --> 00:01:02,000\nWatch the match live on vip.example\n\n"
    assert found(a + ad + b) == [1]


def test_windows_share_a_fingerprint():
    rng = np.random.default_rng(2)
    for _ in range(200):
        span = rng.integers(97, 123, L.K + L.WINDOW - 1, dtype=np.uint8)
        a, b = (np.concatenate([rng.integers(97, 123, rng.integers(0, 40), dtype=np.uint8), span, rng.integers(97, 123, rng.integers(0, 40), dtype=np.uint8)]) for _ in "ab")
        h, g = L.kgram_hashes(a), L.kgram_hashes(b)
        assert set(h[L.winnow(h)].tolist()) & set(g[L.winnow(g)].tolist())


def test_winnowing_is_what_it_says():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 30, 300).astype(np.uint32)
    want = {j for i in range(len(h) - L.WINDOW + 1) for j in range(i, i + L.WINDOW) if h[j] == h[i : i + L.WINDOW].min()}
    assert set(L.winnow(h).tolist()) == want
    assert L.winnow(h[:3]).tolist() == [0, 1, 2] and len(L.kgram_hashes(np.zeros(5, np.uint8))) == 0


def exact(text, passage):
    """Whether twelve successive words of the passage follow each other in the speech, undamaged."""
    doc, words = letters(speech(text)), [w for w in map(letters, passage.split()) if w]
    return any(b"".join(words[i : i + 12]) in doc for i in range(len(words) - 11))


def test_finds_all_that_an_exact_search_finds(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/eval_passage.parquet")
    got = {tuple(r) for r in L.leaked_passages(docs, items).collect()}
    want = {(d.doc_id, i.item_id) for d in docs.collect() if d.text for i in items.collect() if exact(d.text, i.passage)}
    assert want and want <= got and len(got) <= len(want) + 3


def test_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, as_file(PASSAGE)), (2, None), (3, ""), (4, as_file(OTHER) * 30), (1, as_file(PASSAGE)), (5, "x" * 3_000_000)], "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("passage", F.lit("x"))
    items = spark.createDataFrame([(1, PASSAGE, "s"), (2, OTHER, "s"), (3, None, "s"), (4, "too short", "s"), (5, "", None)], "item_id long, passage string, suite string").withColumn("text", F.lit(1))
    want = [(1, 1), (1, 1), (4, 2)]
    assert sorted(map(tuple, L.leaked_passages(docs, items).collect())) == want
    monkeypatch.setattr(L, "BLOCK_BYTES", 10)
    assert sorted(map(tuple, L.leaked_passages(docs, items).collect())) == want
    assert {r.item_id: r.n_documents for r in L.leaked_items(docs, items).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert L.leaked_passages(docs, items.where("false")).count() == 0 and L.leaked_passages(docs.where("false"), items).count() == 0
