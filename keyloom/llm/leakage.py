"""Evaluation passages in a corpus: winnowed fingerprints of letters, hits extended word by word.

Speech is reduced to its letters: no case, accents, punctuation or spaces, and letters that scanners
confuse are one. So damage to spaces, encodings and most single letters leaves fingerprints alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.folding import WILD, letters
from keyloom.llm.subtitles import speech
from keyloom.sources.shared import ship_package, spread

#: Letters of a k-gram and k-grams of a window: a span of K + WINDOW - 1 letters in common always has a common fingerprint.
K, WINDOW = 12, 6
#: Successive words of a passage that make a leak.
LEAST_WORDS = 12
#: Test texts of one pass: so much is held by each task. A larger test set is searched in blocks of this size, each over all documents.
BLOCK_BYTES = 16 << 20
#: Characters of documents that are fingerprinted as one stream, to keep the arrays small; a longer document is a stream of its own.
STREAM_CHARS = 1 << 20


def kgram_hashes(s: np.ndarray) -> np.ndarray:
    """A hash of the K letters from each place of a byte array; one too short has none."""
    if len(s) < K:
        return np.zeros(0, np.uint32)
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    h1 = s.astype(np.uint64)
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h = h8[:-4] * power(4) + h4[8:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def _slide(a: np.ndarray, op) -> np.ndarray:
    """op over each WINDOW successive values (WINDOW = 6)."""
    two = op(a[:-1], a[1:])
    four = op(two[:-2], two[2:])
    return op(four[:-2], two[4:])


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of each window (all of equal ones); fewer hashes than a window are all kept."""
    if len(h) < WINDOW:
        return np.arange(len(h))
    low = _slide(h, np.minimum)
    pad = np.zeros(WINDOW - 1, h.dtype)
    high = _slide(np.concatenate([pad, low, pad]), np.maximum)
    return np.nonzero(high == h)[0]


class Passages:
    """Fingerprints and words of the test items of one block."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.letters, self.starts, self.words = [], [], [], []
        hashes, owner, place = [], [], []
        for item, text in items:
            words = [w for w in (letters(x) for x in (text or "").split()) if w]
            if len(words) < LEAST_WORDS:
                continue
            starts = np.cumsum([0, *map(len, words)]).tolist()
            whole = b"".join(words)
            h = kgram_hashes(np.frombuffer(whole, np.uint8))
            at = winnow(h)
            hashes.append(h[at])
            place.append(at)
            owner.append(np.full(len(at), len(self.ids)))
            self.ids.append(item)
            self.letters.append(whole)
            self.starts.append(starts[:-1])
            self.words.append(words)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        hashes, owner, place = cat(hashes, np.uint32), cat(owner, np.int64), cat(place, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self.hashes & np.uint32((1 << 20) - 1)] = True

    def hits(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the stream, number of the fingerprint) of the common fingerprints."""
        h = kgram_hashes(stream)
        at = winnow(h)
        at = at[self.quick[h[at] & np.uint32((1 << 20) - 1)]]
        left, right = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        n = right - left
        which = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else left, n) + np.arange(n.sum())
        return np.repeat(at, n), which

    def run(self, doc: bytes, d: int, item: int, p: int) -> tuple[int, int, int, int]:
        """The run of successive words around a hit: number of words, first word, and its span in the document."""
        starts, words = self.starts[item], self.words[item]
        w = bisect_right(starts, p + K - 1) - 1
        if starts[w] < p:
            w = max(0, bisect_right(starts, p) - 1)
        at = d + starts[w] - p
        if at < 0:
            return 0, w, d, d
        first, left = w, at
        while first > 0 and (n := _before(doc, left, words[first - 1])) is not None:
            first, left = first - 1, left - n
        last, right = w, at
        while last < len(words) and (n := _after(doc, right, words[last])) is not None:
            last, right = last + 1, right + n
        return last - first, first, left, right

    def leaked(self, doc: bytes, hits: list[tuple[int, int, int]]) -> list[int]:
        """Items of which LEAST_WORDS successive words are in the document, given its hits (item, place in document, place in item)."""
        out, item_done, spans = [], None, []
        for item, d, p in sorted(hits):
            if item != item_done:
                item_done, spans, found = item, [], False
            if found or any(a <= d < b and abs((d - p) - diagonal) < 4 for a, b, diagonal in spans):
                continue
            n, _, left, right = self.run(doc, d, item, p)
            spans.append((left, right, d - p))
            if n >= LEAST_WORDS:
                out.append(self.ids[item])
                found = True
        return out


def _near(a: bytes, b: bytes, most: int) -> bool:
    """Whether two short strings differ by at most ``most`` (1 or 2) insertions, deletions or changes; WILD equals any letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    i = 0
    while i < len(a) and (a[i] == b[i] or a[i] == WILD or b[i] == WILD):
        i += 1
    a, b = a[i:], b[i:]
    while a and (a[-1] == b[-1] or a[-1] == WILD or b[-1] == WILD):
        a, b = a[:-1], b[:-1]
    if len(b) <= most:
        return True
    if most == 1 or not a:
        return False
    return _near(a[1:], b[1:], 1) or _near(a, b[1:], 1) or _near(a[1:], b, 1)


def _allowed(word: bytes, seen: bytes) -> int:
    """Letters of a word that may be wrong. A number with another digit is another number."""
    if any(d in word for d in b"23456789"):
        return 0
    if WILD in seen:
        return 1 if len(word) < 5 else 2
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


def _after(doc: bytes, at: int, word: bytes) -> int | None:
    """Letters that the word takes from ``at`` on, undamaged or damaged; None if it is not there."""
    n = len(word)
    if doc.startswith(word, at):
        return n
    if at >= len(doc):
        return None
    for m in (n, n - 1, n + 1):
        seen = doc[at : at + m]
        if m > 0 and len(seen) == m and (most := _allowed(word, seen)) and _near(seen, word, most):
            return m
    return None


def _before(doc: bytes, end: int, word: bytes) -> int | None:
    """The same for letters that end before ``end``."""
    n = len(word)
    if end >= n and doc[end - n : end] == word:
        return n
    for m in (n, n - 1, n + 1):
        seen = doc[end - m : end] if end >= m else b""
        if m > 0 and len(seen) == m and (most := _allowed(word, seen)) and _near(seen, word, most):
            return m
    return None


def _search(passages: Passages, ids: list, texts: list) -> Iterator[tuple[int, int]]:
    """(document, item) pairs of a batch of documents, fingerprinted as one stream with gaps of zeros between."""
    streams = [letters(speech(x)) if x else b"" for x in texts]
    gap = b"\0" * K
    stream = np.frombuffer(gap.join(streams), np.uint8)
    begins = np.cumsum([0, *[len(s) + K for s in streams]])[:-1]
    at, which = passages.hits(stream)
    if not len(at):
        return
    doc = np.searchsorted(begins, at, "right") - 1
    edges = np.nonzero(np.diff(doc))[0] + 1
    for part in np.split(np.arange(len(at)), edges):
        i = doc[part[0]]
        hits = list(zip(passages.owner[which[part]].tolist(), (at[part] - begins[i]).tolist(), passages.place[which[part]].tolist(), strict=True))
        for item in passages.leaked(streams[i], hits):
            yield ids[i], item


def _streams(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= STREAM_CHARS or i == len(texts) - 1:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most BLOCK_BYTES of text; one block at a time is on the driver."""
    block, size = [], 0
    rows = items.select("item_id", "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").orderBy("item_id", "passage")
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: documents whose speech has at least LEAST_WORDS successive words of the item's passage.

    One pass over the documents for each block of items (one block up to 16 MiB of test text), without a
    shuffle: each task holds the block's fingerprints and looks up the winnowed fingerprints of its
    documents; hits are extended word by word on both sides, where a word of four letters or more may
    have one letter wrong, missing or too many (two from nine letters on), but no number a digit. Whole texts are searched.
    Null and empty texts, and items of fewer words, give no rows; documents given twice give their rows twice.
    """
    schema = "doc_id long, item_id long"
    spark = documents.sparkSession
    ship_package(spark)
    texts = spread(documents.select("doc_id", "text").where("text IS NOT NULL AND text != ''"))
    out = None
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = Passages(shared.value)
            for b in batches:
                pairs = [x for part in _streams(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in _search(passages, *part)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["doc_id", "item_id"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, n_documents of every test item, 0 for those that did not leak."""
    n = leaked_passages(documents, items).distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"))
