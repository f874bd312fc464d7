"""Subjects of documents: labelling functions, a latent model that learns how far each can be trusted, posteriors.

Hand-labelled documents teach what words, addresses, sources and series go with which subject.
Labelling functions then vote on every pair of sentence and subject, each by evidence of its own:

* lexicon and terms by the sentence's words, each by one half of the vocabulary, so that no word speaks in both;
* section by the other sentences of its section;
* address by the sites in the document's adverts, and source by its source and series, where labelled documents
  show that these go with a subject more, or less, than chance would have it.

A latent-class model is fitted to how often each pattern of votes occurs, over all documents, and
gives each pattern a posterior; a document has the subjects of a quarter of its sentences.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import folding
from keyloom.llm.subtitles import adverts, cues
from keyloom.sources.shared import checkpointed, ship_package, spread

#: Share of a document's sentences that makes a subject.
SHARE = 0.25
#: Labelled documents that the word model is fitted on at most, chosen by hash.
FIT_DOCUMENTS = 4000
#: A pause of so many seconds between cues begins a section.
SECTION_PAUSE = 9.0
#: Rounds of fitting the word model, and the weight, in sentences, of a document's labels in it.
ROUNDS, LABEL_WEIGHT = 12, 6.0
#: Share of a labelled document's sentences that are expected to have no subject; and of a document labelled with none.
PLAIN, PLAIN_NONE = 0.4, 0.92
#: Words rarer than this in the fitted documents are not used.
LEAST_WORD = 3
#: Levels of a vote by words: log ratios of a subject to the likeliest other, or to none.
WORD_CUTS = (-4.0, -2.0, -0.5, 0.5, 2.0, 4.0)
#: Levels of a vote by section: share of its other sentences whose words are strong for the subject.
SECTION_CUTS = (1e-9, 0.2, 0.5)
#: An address or source votes on a subject if it goes with it so many standard deviations more or less often than usual, over at least so many labelled documents.
DEVIATIONS, SUPPORT = 3.5, 8
#: The labelling functions and the number of levels of their votes, from against to for.
FUNCTIONS = {"lexicon": len(WORD_CUTS) + 1, "terms": len(WORD_CUTS) + 1, "section": len(SECTION_CUTS) + 1, "address": 3, "source": 3}
#: Weight of each function's level in a pattern's code, and the number of codes.
PLACES = [math.prod(list(FUNCTIONS.values())[:i]) for i in range(len(FUNCTIONS))]
CODES = math.prod(FUNCTIONS.values())

#: Three-letter language codes and their two-letter ones.
LANGUAGES = {"eng": "en", "spa": "es", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "ita": "it", "por": "pt", "dut": "nl", "nld": "nl"}

_END = re.compile(r"[.!?…]+[\"'”»“)]*(?=\s|$)|\n[ \t]*[-–—](?=\s)")


def _seconds(clock: str) -> float:
    out = 0.0
    for part in clock.replace(",", ".").split(":"):
        out = out * 60 + float(part or 0)
    return out


def spoken(text: str) -> bytes:
    """The spoken words, folded, with BREAK between sentences and SECTION where a section begins."""
    starts, texts = cues(text)
    parts, before = [], None
    for clock, said in zip(starts, texts, strict=True):
        if not said or said.isspace():
            continue
        at = _seconds(clock) if clock else 0.0
        if before is not None and not -1 < at - before < SECTION_PAUSE:
            parts.append("\x03")
        before = at
        parts.append(said)
    return folding.words(_END.sub("\x02", "\n".join(parts).replace("\x02", " ")))


def sentences(folded: bytes) -> list[list[bytes]]:
    out = []
    for s in folded.split(b"\x02"):
        words = s.split()
        if words and words != [b"\x03"]:
            out.append(words)
    return out


def language(tag: str | None) -> str:
    tag = (tag or "").strip().lower()
    return LANGUAGES.get(tag, re.split(r"[-_]", tag)[0])


class WordModel:
    """Words by language and by what a sentence is about: topic 0 is no subject, topic i the i-th subject.

    Fitted on labelled documents only: sentences start from their document's labels, and a few rounds
    of expectation and maximisation find which of the sentences are about them. Languages are told by
    their words, learnt from the tagged documents, as tags may be missing or wrong; each language has
    its own topics, so that a language that is frequent with one subject does not stand for it.
    """

    def __init__(self, labelled: list[tuple[bytes, set[str], str]], subjects: list[str]) -> None:
        self.subjects = subjects
        docs = [sentences(f) for f, _, _ in labelled]
        seen = Counter(w for d in docs for s in d for w in set(s))
        self.vocabulary = {w: i for i, (w, n) in enumerate(sorted(seen.items())) if n >= LEAST_WORD and w != b"\x03"}
        self.vocabulary = {w: i for i, w in enumerate(self.vocabulary)}
        self.rare = len(self.vocabulary)
        #: Which half of the vocabulary a word is in: the lexicon's or the terms'.
        self.half = np.array([zlib.crc32(w) & 1 for w in self.vocabulary] + [0], np.int8)
        tags = [language(t) for _, _, t in labelled]
        usual = Counter(t for t in tags if len(t) == 2)
        self.languages = [t for t, n in sorted(usual.items()) if n >= max(2, 0.01 * len(labelled))] or [""]
        sent, word, doc = self._flat(docs)
        size = (self.rare + 1, len(self.languages))
        heard = np.zeros(size)
        for j, t in enumerate(self.languages):
            mine = np.array([x == t for x in tags], bool) if docs else np.zeros(0, bool)
            heard[:, j] = np.bincount(word, mine[doc[sent]] if len(sent) else None, self.rare + 1)
        self.by_language = self._log(heard, 0.1)
        spoken_in = self.tell_languages(sent, word, doc, len(docs))
        topics = len(subjects) + 1
        self.by_topic = np.zeros((len(self.languages), self.rare + 1, topics), np.float32)
        for j in range(len(self.languages)):
            self.by_topic[j] = self._fit(sent, word, doc, np.nonzero(spoken_in == j)[0], labelled, topics)

    def _flat(self, docs: list[list[list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentence and word number of each word, and document of each sentence."""
        get = self.vocabulary.get
        word: list[int] = []
        length: list[int] = []
        doc: list[int] = []
        for k, d in enumerate(docs):
            for s in d:
                ids = [get(w, self.rare) for w in s]
                word += ids
                length.append(len(ids))
                doc.append(k)
        return np.repeat(np.arange(len(length)), length), np.array(word, np.int64), np.array(doc, np.int64)

    def _log(self, counts: np.ndarray, smooth: float) -> np.ndarray:
        out = np.log((counts + smooth) / (counts + smooth).sum(0))
        out[self.rare] = 0
        return out

    def tell_languages(self, sent: np.ndarray, word: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        score = np.stack([np.bincount(doc[sent], self.by_language[word, j], n_docs) if len(sent) else np.zeros(n_docs) for j in range(len(self.languages))])
        return score.argmax(0)

    def _fit(self, sent: np.ndarray, word: np.ndarray, doc: np.ndarray, mine: np.ndarray, labelled: list, topics: int) -> np.ndarray:
        if not len(mine):
            return np.zeros((self.rare + 1, topics), np.float32)
        keep = np.isin(doc, mine)
        number = np.cumsum(keep) - 1
        of_word = keep[sent]
        s, w, d = number[sent[of_word]], word[of_word], np.searchsorted(mine, doc[keep])
        told = np.full((len(mine), topics), 0.01)
        for k, i in enumerate(mine):
            labels = [self.subjects.index(x) + 1 for x in labelled[i][1] if x in self.subjects]
            told[k, 0] += PLAIN if labels else PLAIN_NONE
            for y in labels:
                told[k, y] += (1 - PLAIN) / len(labels)
        told /= told.sum(1, keepdims=True)
        overall = np.bincount(w, minlength=self.rare + 1) / max(1, len(w))
        mix, about = told, told[d]
        logs = np.zeros((self.rare + 1, topics))
        for _ in range(ROUNDS):
            counts = np.stack([np.bincount(w, about[s, y], self.rare + 1) for y in range(topics)], axis=1)
            logs = self._log(counts + 20 * overall[:, None], 1e-3)
            score = np.log(mix[d]) + np.stack([np.bincount(s, logs[w, y], len(d)) for y in range(topics)], axis=1)
            about = np.exp(score - score.max(1, keepdims=True))
            about /= about.sum(1, keepdims=True)
            mix = told * LABEL_WEIGHT
            np.add.at(mix, d, about)
            mix = mix / mix.sum(1, keepdims=True)
        return logs.astype(np.float32)

    def votes(self, docs: list[list[list[bytes]]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Document of each sentence; and the levels of lexicon, terms and section for each sentence and subject."""
        n, topics = len(docs), len(self.subjects) + 1
        sent, word, doc = self._flat(docs)
        if not len(sent):
            return doc, [np.zeros((0, topics - 1), np.int64)] * 3
        spoken_in = self.tell_languages(sent, word, doc, n)
        rows = self.by_topic[spoken_in[doc[sent]], word]
        levels = []
        for half in (0, 1):
            mine = self.half[word] == half
            score = np.stack([np.bincount(sent[mine], rows[mine, y], len(doc)) for y in range(topics)], axis=1)
            top = np.partition(score, topics - 2, axis=1)
            best, second = top[:, -1:], top[:, -2:-1]
            levels.append(np.digitize(np.where(score == best, score - second, score - best)[:, 1:], WORD_CUTS))
        begins = np.fromiter((b"\x03" in s for d in docs for s in d), bool, len(doc))
        first = np.concatenate([[True], np.diff(doc) != 0])
        section = np.cumsum(first | np.concatenate([[False], begins[:-1]])) - 1
        strong = np.maximum(*levels) == len(WORD_CUTS)
        size = np.bincount(section)
        led = np.stack([np.bincount(section, strong[:, y], len(size)) for y in range(topics - 1)], axis=1)
        others = (led[section] - strong) / np.maximum(1, size[section] - 1)[:, None]
        return doc, [*levels, np.digitize(others, SECTION_CUTS)]


def sites(text: str) -> set[str]:
    """Addresses in the adverts of a text."""
    return {m.lower() for a in adverts(text) for m in re.findall(r"([\w-]+)\.\w{2,7}\b", a)}


class Associations:
    """What an address, a source or a series says of a document, from the labelled documents that have it.

    deviations: of each name and subject, how many standard deviations more often than usual they
    go together; only those beyond DEVIATIONS vote, so that names which say nothing stay silent.
    """

    def __init__(self, labelled: list[tuple[list[str], set[str]]], subjects: list[str]) -> None:
        total, by = Counter(), defaultdict(Counter)
        n_of: Counter = Counter()
        for names, labels in labelled:
            total.update(labels)
            for x in names:
                n_of[x] += 1
                by[x].update(labels)
        usual = np.array([(total[s] + 1) / (len(labelled) + len(subjects)) for s in subjects])
        self.deviations = {x: (np.array([by[x][s] for s in subjects]) - n * usual) / np.sqrt(n * usual * (1 - usual)) for x, n in n_of.items() if n >= SUPPORT}
        votes = {x: np.where(z > DEVIATIONS, 2, np.where(z < -DEVIATIONS, 0, 1)) for x, z in self.deviations.items()}
        self.votes = {x: v for x, v in votes.items() if (v != 1).any()}

    def vote(self, names: list[str], n_subjects: int) -> np.ndarray:
        """For where any of the names speaks for a subject, else against where any speaks against it."""
        said = [self.votes[x] for x in names if x in self.votes]
        if not said:
            return np.ones(n_subjects, np.int64)
        said = np.stack(said)
        return np.where((said == 2).any(0), 2, np.where((said == 0).any(0), 0, 1))


def _origin(source: str | None, series: str | None) -> list[str]:
    return [k + v for k, v in (("source ", source), ("series ", series)) if v]


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[WordModel, Associations, Associations]:
    """The word model and the associations of addresses and of sources, from at most FIT_DOCUMENTS labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)
    rows = documents.select("doc_id", "text", "lang", "source", "series").where("text IS NOT NULL AND text != ''").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([spoken(x) for x in texts], pa.binary()), pa.array([sorted(sites(x)) for x in texts], pa.list_(pa.string())), b.column("lang"), b.column("source"), b.column("series"), b.column("labels")],
                ["doc_id", "spoken", "sites", "lang", "source", "series", "labels"],
            )

    got = rows.select("doc_id", "text", "lang", "source", "series", "labels").mapInArrow(run, "doc_id long, spoken binary, sites array<string>, lang string, source string, series string, labels array<string>").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.spoken)))
    words = WordModel([(bytes(r.spoken), set(r.labels), r.lang) for r in got], subjects)
    return words, Associations([(list(r.sites), set(r.labels)) for r in got], subjects), Associations([(_origin(r.source, r.series), set(r.labels)) for r in got], subjects)


def votes(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """doc_id, subject (its number), n_sentences, codes and counts: which patterns of votes the document's sentences have for the subject, and how many each.

    A code is the sum of the functions' levels times PLACES. Texts without a spoken sentence are left out.
    """
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, subjects))
    n = len(subjects)
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.int32()), ("n_sentences", pa.int32()), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, addresses, origins = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column("text").to_pylist()
                doc, levels = words.votes([sentences(spoken(x)) for x in texts])
                if not len(doc):
                    continue
                said = np.stack([addresses.vote(sorted(sites(x)), n) if addresses.votes else np.ones(n, np.int64) for x in texts])
                from_ = np.stack([origins.vote(_origin(*x), n) if origins.votes else np.ones(n, np.int64) for x in zip(b.column("source").to_pylist(), b.column("series").to_pylist(), strict=True)])
                code = sum(v * p for v, p in zip([*levels, said[doc], from_[doc]], PLACES, strict=True))
                keys, counts = np.unique(((doc[:, None] * n + np.arange(n)) * CODES + code).ravel(), return_counts=True)
                pair = keys // CODES
                starts = np.nonzero(np.diff(pair, prepend=-1))[0]
                offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
                pair = pair[starts]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % CODES, counts)]
                ids = b.column("doc_id").take(pa.array(pair // n))
                yield pa.RecordBatch.from_arrays([ids, pa.array((pair % n).astype(np.int32)), pa.array(np.bincount(doc, minlength=b.num_rows)[pair // n].astype(np.int32)), *lists], schema=schema)

    rows = documents.select("doc_id", "text", "source", "series").where("text IS NOT NULL AND text != ''")
    return spread(rows).mapInArrow(run, "doc_id long, subject int, n_sentences int, codes array<int>, counts array<int>")


class LatentModel:
    """How far each labelling function can be trusted, learnt without true labels from how often patterns of votes occur.

    Two classes, about the subject or not; given the class the functions vote independently, each with
    its own chances of every level. ``posterior`` gives P(about | pattern). names: the functions that
    are used, the others being left out. It starts from the number of functions that are fully for.
    """

    def __init__(self, patterns: dict[int, int], names: list[str] | None = None, rounds: int = 60) -> None:
        self.names = names or list(FUNCTIONS)
        used = [j for j, f in enumerate(FUNCTIONS) if f in self.names]
        levels = [list(FUNCTIONS.values())[j] for j in used]
        codes = np.array(sorted(patterns), np.int64)
        weight = np.array([patterns[int(c)] for c in codes], float)
        cast = np.stack([codes // PLACES[j] % k for j, k in zip(used, levels, strict=True)], axis=1)
        has = np.clip((cast == np.array(levels) - 1).sum(1) / 2, 0.02, 0.98)
        self.prior, self.chances = 0.5, [np.full((2, k), 1 / k) for k in levels]
        for _ in range(rounds if len(codes) else 0):
            for k, w in enumerate((weight * (1 - has), weight * has)):
                for j, c in enumerate(self.chances):
                    seen = np.bincount(cast[:, j], w, c.shape[1]) + 0.1
                    c[k] = seen / seen.sum()
            self.prior = min(0.999, max(0.001, (weight * has).sum() / weight.sum()))
            odds = np.log(self.prior) - np.log(1 - self.prior) + sum(np.log(c[1, cast[:, j]]) - np.log(c[0, cast[:, j]]) for j, c in enumerate(self.chances))
            has = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        self.posterior = dict(zip(codes.tolist(), has.tolist(), strict=True))


def _subjects(subject_list: DataFrame) -> list[str]:
    """The subjects in order of their ids: a list of a few names."""
    return [r[0] for r in subject_list.where("subject IS NOT NULL").groupBy("subject").agg(F.min("subject_id").alias("i")).orderBy("i", "subject").collect()]


def _modelled(documents: DataFrame, labels: DataFrame, subject_list: DataFrame) -> tuple[list[str], DataFrame | None, dict[int, int]]:
    """The subjects, the votes on all documents, and how often each pattern occurs in them."""
    subjects = _subjects(subject_list)
    if not subjects:
        return subjects, None, {}
    cast = checkpointed(votes(documents, labels, subjects), "votes")
    # At most CODES patterns, counted over all documents.
    each = cast.select(F.inline(F.arrays_zip(F.col("codes").alias("p"), F.col("counts").alias("n"))))
    return subjects, cast, {r.p: r.n for r in each.groupBy("p").agg(F.sum("n").alias("n")).collect()}


def _sum_by(model: LatentModel, value: Callable[[float], float]) -> Column:
    """Of a row of votes: the sum over its sentences of a value of their posteriors."""
    table = [value(model.posterior.get(c, 0.0)) for c in range(CODES)]
    each = F.from_json(F.lit(json.dumps(table)), "array<double>")
    return F.aggregate(F.zip_with("codes", "counts", lambda c, n: F.get(each, c) * n), F.lit(0.0), lambda a, x: a + x)


def _share(model: LatentModel) -> Column:
    """Share of the sentences whose posterior is at least one half."""
    return _sum_by(model, lambda x: float(x >= 0.5)) / F.col("n_sentences")


def document_subjects(documents: DataFrame, labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """doc_id, subject, share, posterior: the subjects that at least SHARE of the document's sentences are about, by their posteriors; and the mean posterior of these sentences.

    Null and empty texts, and those without a spoken sentence, get none. Without any labels no word
    speaks for a subject, and no document gets one. All documents are voted on in one pass without a
    shuffle; the votes, some hundred bytes a document, are kept in the shared folder between the two uses.
    """
    subjects, cast, patterns = _modelled(documents, labels, subject_list)
    model = LatentModel(patterns)
    if not any(x >= 0.5 for x in model.posterior.values()):
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, share double, posterior double")
    names = F.array(*[F.lit(s) for s in subjects])
    rows = cast.withColumn("share", _share(model)).where(F.col("share") >= SHARE)
    sure = _sum_by(model, lambda x: x * (x >= 0.5)) / (F.col("share") * F.col("n_sentences"))
    return rows.select("doc_id", F.get(names, F.col("subject")).alias("subject"), "share", sure.alias("posterior"))


def composition(documents: DataFrame, labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """subject, n_documents of every subject of the list."""
    n = document_subjects(documents, labels, subject_list).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return subject_list.select("subject").distinct().join(n, "subject", "left").select("subject", F.coalesce("n", F.lit(0)).alias("n_documents"))


def function_report(documents: DataFrame, labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """What each labelling function contributes.

    for_if_has, for_if_not: its chance of the vote that is most for a subject, given that the
    sentence is about it or not. apart: how far its chances of all votes differ between the two, from
    0 (it says nothing) to 1. n_changed: decisions on documents that are others without it.
    """
    _, cast, patterns = _modelled(documents, labels, subject_list)
    spark, schema = documents.sparkSession, "labelling_function string, for_if_has double, for_if_not double, apart double, n_changed long"
    if not patterns:
        return spark.createDataFrame([], schema)
    whole = LatentModel(patterns)
    has = _share(whole) >= SHARE
    changed = [F.sum(((_share(LatentModel(patterns, [g for g in FUNCTIONS if g != f])) >= SHARE) != has).cast("long")) for f in FUNCTIONS]
    counts = cast.agg(*changed).first()
    rows = [(f, float(c[1, -1]), float(c[0, -1]), float(np.abs(c[1] - c[0]).sum() / 2), n) for f, c, n in zip(FUNCTIONS, whole.chances, counts, strict=True)]
    return spark.createDataFrame(rows, schema)


def association_report(documents: DataFrame, labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """labelling_function, name, subject, deviations of every address, source and series with enough labelled documents: what the functions address and source rest on, whether they vote or not."""
    subjects = _subjects(subject_list)
    schema = "labelling_function string, name string, subject string, deviations double"
    _, addresses, origins = fit(documents, labels, subjects)
    rows = [(f, x, s, float(d)) for f, a in (("address", addresses), ("source", origins)) for x, z in sorted(a.deviations.items()) for s, d in zip(subjects, z, strict=True)]
    return documents.sparkSession.createDataFrame(rows, schema)
