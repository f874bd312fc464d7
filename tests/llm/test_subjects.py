import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import subjects as S

NOUNS = {
    "law": ["judge", "court", "clause", "verdict", "statute", "jury", "appeal", "witness"], "sport": ["referee", "goal", "court", "relay", "sprint", "coach", "league", "penalty"],
    "food": ["broth", "garlic", "oven", "batter", "crust", "glaze", "onion", "dough"],
}
FILLER = ["Good night.", "Are you serious?", "I will, Lil.", "Come on, sit down.", "Wait, wait!", "That was years ago."]
FRAMES = ["Look at the {} and then at the {}.", "Nobody explains the {} like the {}.", "Without the {} there is no {}.", "First the {} and only then the {}."]


def document(rnd, shares, n=24):
    said = []
    for s, share in shares.items():
        said += [rnd.choice(FRAMES).format(*rnd.sample(NOUNS[s], 2)) for _ in range(round(share * n))]
    said += [rnd.choice(FILLER) for _ in range(n - len(said))]
    rnd.shuffle(said)
    lines = [f"{i + 1}\n00:{i // 12:02d}:{i % 12 * 5:02d},000 --> 00:{i // 12:02d}:{i % 12 * 5 + 3:02d},000\n{x}\n" for i, x in enumerate(said)]
    ad = f"{n + 1}\n00:30:00,000 --> 00:30:02,000\nWatch the {rnd.choice(NOUNS['sport'])} live on {rnd.choice(['a', 'b'])}site.example\n"
    return "\n".join([*lines, ad])


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(7)
    docs, labels, truth = [], [], set()
    for i in range(1, 601):
        mains = rnd.sample(list(NOUNS), rnd.choice([0, 1, 1, 1, 2]))
        shares = {s: rnd.uniform(0.33, 0.45) if s in mains else rnd.choice([0, 0, 0.06, 0.12]) for s in NOUNS}
        docs.append((i, document(rnd, shares), rnd.choice(["en", "EN", "eng", None]), rnd.choice(["x", "y"]), None))
        truth |= {(i, s) for s in mains}
        if i % 3 == 0:
            for s in mains or ["none"]:
                labels.append((i, s if rnd.random() < 0.9 else rnd.choice([*NOUNS, "none"]), "a"))
            labels += labels[-1:] if rnd.random() < 0.2 else []
    docs += [(1000, None, "en", None, None), (1001, "", None, None, None), (1002, "1\n00:00:01,000 --> 00:00:02,000\n(sighs)\n", "en", "x", "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, series string").withColumn("labels", F.lit("x")).withColumn("p", F.lit(1))
    y = spark.createDataFrame([*labels, (None, "law", "a"), (3, None, "a")], "doc_id long, subject string, annotator string")
    s = spark.createDataFrame([(i, x, x) for i, x in enumerate(NOUNS)], "subject_id int, subject string, description string")
    return d, y, s, truth


def test_held_out_accuracy(case):
    d, y, s, truth = case
    got = {(r.doc_id, r.subject) for r in S.document_subjects(d, y, s).collect() if r.doc_id % 3}
    want = {x for x in truth if x[0] % 3}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_reports(case):
    d, y, s, truth = case
    n = {r.subject: r.n_documents for r in S.composition(d, y, s).collect()}
    assert set(n) == set(NOUNS) and abs(sum(n.values()) - len(truth)) < 30
    f = {r.labelling_function: r for r in S.function_report(d, y, s).collect()}
    for name in ("lexicon", "terms", "section"):
        assert f[name].apart > 0.4 and f[name].for_if_has > 5 * f[name].for_if_not
    assert f["lexicon"].n_changed + f["terms"].n_changed > 0
    # Here addresses and sources are drawn at random: they say nothing, and are silent.
    for name in ("address", "source"):
        assert f[name].apart < 0.001 and f[name].n_changed == 0
    assert max(abs(r.deviations) for r in S.association_report(d, y, s).collect()) < S.DEVIATIONS


def test_addresses_and_sources_that_say_something_vote(spark, case):
    d, y, s, truth = case
    law = spark.createDataFrame([(i,) for i, x in truth if x == "law"], "doc_id long").withColumn("is_law", F.lit(True))
    told = d.join(law, "doc_id", "left").withColumn("source", F.when(F.col("is_law"), "court").otherwise("x"))
    told = told.withColumn("text", F.when(F.col("is_law"), F.regexp_replace("text", "[ab]site", "lawyers")).otherwise(F.col("text"))).drop("is_law")
    f = {r.labelling_function: r for r in S.function_report(told, y, s).collect()}
    for name in ("address", "source"):
        assert f[name].apart > 0.15 and f[name].for_if_has > 3 * f[name].for_if_not
    assert f["address"].n_changed + f["source"].n_changed > 0


def test_empty_inputs(spark, case):
    d, y, s, _ = case
    assert S.document_subjects(d.where("doc_id < 20"), y.where("false"), s).count() == 0
    assert S.document_subjects(d.where("false"), y, s).count() == 0
    assert S.document_subjects(d.where("doc_id < 20"), y, s.where("false")).count() == 0


def test_latent_model_learns_who_can_be_trusted():
    rng = np.random.default_rng(0)
    z = rng.random(20_000) < 0.3
    good, levels = [0.95, 0.9, 0.85, 0.5, 0.5], np.array(list(S.FUNCTIONS.values()))
    votes = np.stack([np.where(rng.random(len(z)) < g, z, ~z) * (k - 1) for g, k in zip(good, levels, strict=True)], axis=1)
    code, n = np.unique((votes * S.PLACES).sum(1), return_counts=True)
    m = S.LatentModel(dict(zip(code.tolist(), n.tolist(), strict=True)))
    assert abs(m.prior - 0.3) < 0.05
    for g, c in zip(good, m.chances, strict=True):
        assert abs(c[1, -1] - g) < 0.06 and abs(c[0, -1] - (1 - g)) < 0.06
    assert S.LatentModel({}).posterior == {}
    without = S.LatentModel(dict(zip(code.tolist(), n.tolist(), strict=True)), ["lexicon", "terms", "section", "source"])
    assert len(without.chances) == 4 and abs(without.chances[0][1, -1] - 0.95) < 0.06


def test_halves_of_the_vocabulary_are_disjoint_and_votes_exact():
    law, sport = b"judge court clause verdict statute jury", b"referee goal relay sprint coach league"
    labelled = [(law + b"\x02" + law, {"law"}, "en"), (sport + b"\x02" + sport, {"sport"}, "en"), (b"sit down\x02good night", {"none"}, "en")] * 40
    m = S.WordModel(labelled, ["law", "sport"])
    assert len(m.half) == m.rare + 1 and set(m.half[: m.rare]) == {0, 1}
    doc, (a, b, c) = m.votes([S.sentences(x) for x in (law + b"\x02sit down", b"", sport)])
    assert doc.tolist() == [0, 0, 2] and a.shape == b.shape == c.shape == (3, 2)
    top = len(S.WORD_CUTS)
    assert a[0].tolist() == b[0].tolist() == [top, 0] and a[2].tolist() == [0, top]
    assert c.tolist() == [[0, 0], [len(S.SECTION_CUTS), 0], [0, 0]]
    # A word counts for its half alone.
    word = next(w for w, i in m.vocabulary.items() if m.half[i] == 0 and w in law.split())
    _, (a, b, _) = m.votes([[[word]]])
    assert a[0, 0] > b[0, 0] == top // 2


def test_sentences_and_sections():
    text = "1\n00:00:01,000 --> 00:00:02,000\nOne thing. And\n\n2\n00:00:03,000 --> 00:00:04,000\nanother!\n- Third\n\n3\n00:00:40,000 --> 00:00:41,000\nhere? Yes."
    said = S.sentences(S.spoken(text))
    assert [b" ".join(w for w in x if w != b"\x03") for x in said] == [b"one tlllng", b"and anotller", b"tlllrd llere", b"yes"]
    assert b"\x03" in said[2] and b"\x03" not in said[1]
    assert S.language("EN") == S.language("eng") == "en" and S.language(None) == "" and S.language("pt-BR") == "pt"
