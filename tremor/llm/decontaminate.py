"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The index holds the test items; every passage of every training text is a query. A term's weight in an item is its
BM25 impact divided by the item's score for its own text, so that a score is the share of the item that the passage
covers and one threshold serves all items. Posting lists are cut into blocks that know their largest impact. Common terms
that stay below the threshold together in every item cannot lift any item above it alone, so a passage is searched
only if its other terms can lift some item there; that bound is taken over many passages at once. The passages left
run block-max WAND in threshold mode: a pivot is the first item at which the list maxima add up to the threshold,
and it is scored only if the maxima of the blocks there do so too. All items above the threshold are returned, and
each is verified: the five-word shingles of its question, and those of its answer, must be in the text.

The items are read in blocks of bounded size, one pass over the texts for each, so that an index is never larger
than a task can hold.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import slices, unused
from tremor.plans.loops import CutTable

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach, and share of its shingles that the text must hold.
THRESHOLD, OVERLAP = 0.6, 0.8
SHINGLE = 5
#: Words from one passage to the next, and characters of items in one index.
STRIDE, INDEX_CHARS = 32, 8 << 20
BLOCK_POSTINGS = 8
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer.

    The answer is what follows the last line break or, in an item of one line, its last sentence; an item that has
    neither, or whose question would be shorter than a shingle, is a question only.
    """
    body = (text or "").strip()
    head, _, tail = body.rpartition("\n")
    if not head:
        parts = re.split(r"(?<=[.?!])\s+", body)
        head, tail = " ".join(parts[:-1]), parts[-1]
    question, answer = words_of(head), words_of(tail)
    return (question, answer) if len(question) >= SHINGLE else (question + answer, [])


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; fewer words make one shorter shingle, none make none."""
    if not words:
        return set()
    return {tuple(words[k:k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}


class Index:
    """Impact-ordered-by-item posting lists of a bounded set of items."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(key, q, a) for key, text in items for q, a in [split_item(text)] if q or a]
        self.keys = [key for key, _, _ in kept]
        self.parts = [(q, a) for _, q, a in kept]
        counts = [Counter(q + a) for q, a in self.parts]
        length = [sum(c.values()) for c in counts]
        mean = sum(length) / max(len(length), 1)
        df = Counter(t for c in counts for t in c)
        self.longest = max(length, default=0)
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, c in enumerate(counts):
            impact = {t: log(1 + (len(kept) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length[item] / mean))
                      for t, f in c.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                lists[self.terms[t]].append((item, x / own))
        self.items = [[i for i, _ in p] for p in lists]
        self.impacts = [[x for _, x in p] for p in lists]
        self.block_max = [[max(x[k:k + BLOCK_POSTINGS]) for k in range(0, len(x), BLOCK_POSTINGS)] for x in self.impacts]
        self.upper = np.array([max(x) for x in self.impacts] or [0.0])
        self.bins = -(-self.longest // STRIDE) + 1  # of STRIDE words, in a passage
        self._flat_items = np.array([i for x in self.items for i in x], np.int64)
        self._flat_impacts = np.array([v for x in self.impacts for v in x])
        self._begin = np.r_[0, np.cumsum([len(x) for x in self.items])].astype(np.int64)
        self._common = np.zeros(len(self.terms) + 1, bool)
        self._common_share = np.zeros(len(self.keys))

    def set_threshold(self, threshold: float) -> Index:
        """Choose the common terms: most frequent first, as long as they make up half the threshold in no item."""
        self._common[:] = False
        self._common_share[:] = 0
        for t in sorted(range(len(self.terms)), key=lambda t: -len(self.items[t])):
            new = self._common_share[self.items[t]] + self.impacts[t]
            if (new < threshold / 2).all():
                self._common_share[self.items[t]] = new
                self._common[t] = True
        return self

    def above(self, terms: Iterable[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) with score >= threshold for a passage's distinct terms."""
        end = len(self.keys)
        cursors = [[self.items[t][0], 0, t] for t in terms]  # (current item, position in its list, term)
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (item, _, t) in enumerate(cursors):
                bound += self.upper[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # maxima of the blocks that hold the pivot item, and the last item for which they stay the same
            bound, until = 0.0, end
            for item, at, t in cursors[:pivot + 1]:
                own = self.items[t]
                while at < len(own) and own[min(len(own), (at // BLOCK_POSTINGS + 1) * BLOCK_POSTINGS) - 1] < target:
                    at = (at // BLOCK_POSTINGS + 1) * BLOCK_POSTINGS
                if at < len(own):
                    bound += self.block_max[t][at // BLOCK_POSTINGS]
                    until = min(until, own[min(len(own), (at // BLOCK_POSTINGS + 1) * BLOCK_POSTINGS) - 1])
            if bound >= threshold:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    self._advance(c, target)
                    if c[0] == target:
                        score += self.impacts[c[2]][c[1]]
                if score >= threshold:
                    found.append((target, score))
                follow = target + 1
            else:
                follow = max(target + 1, min(until + 1, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
            for c in cursors[:pivot + 1]:
                self._advance(c, follow)
            cursors = [c for c in cursors if c[0] < end]
        return found

    def _advance(self, cursor: list, target: int) -> None:
        """Move to the first posting at or after ``target``, whole blocks at a time."""
        item, at, t = cursor
        own = self.items[t]
        while at < len(own) and own[min(len(own), (at // BLOCK_POSTINGS + 1) * BLOCK_POSTINGS) - 1] < target:
            at = (at // BLOCK_POSTINGS + 1) * BLOCK_POSTINGS
        while at < len(own) and own[at] < target:
            at += 1
        cursor[0], cursor[1] = (own[at], at) if at < len(own) else (len(self.keys), at)

    def search(self, texts: list[list[str]], threshold: float) -> list[dict[int, float]]:
        """Of each text's words: best score by item over its passages, for items that reach ``threshold`` in one.

        A passage begins every ``STRIDE`` words and is at least ``STRIDE`` words longer than the longest item, so any
        run of words as long as an item lies whole in one passage.
        """
        found: list[dict[int, float]] = [{} for _ in texts]
        lengths = np.array([len(w) for w in texts], np.int64)
        bins = -(-lengths // STRIDE) + self.bins  # empty ones at the end keep texts apart
        base = np.cumsum(bins) - bins
        term = np.array([t for w in texts for t in map(self.terms.get, w, repeat(-1))], np.int64)
        if not self.keys or not len(term):
            return found
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        at = np.flatnonzero((term >= 0) & ~self._common[term])
        span = base[owner[at]] + (at - first[owner[at]]) // STRIDE
        key = np.unique(span * len(self.terms) + term[at])  # a term once in a bin
        span, t = key // len(self.terms), key % len(self.terms)
        n = self._begin[t + 1] - self._begin[t]
        posting = np.repeat(self._begin[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, impact = self._flat_items[posting], self._flat_impacts[posting]
        begins = np.repeat(span, n)[:, None] - np.arange(self.bins)  # every passage that holds the bin
        cell, code = np.unique((begins * len(self.keys) + item[:, None]).ravel(), return_inverse=True)
        bound = np.bincount(code.ravel(), np.repeat(impact, self.bins), len(cell))
        passages = np.unique(cell[bound >= threshold - self._common_share[cell % len(self.keys)] - 1e-9] // len(self.keys))
        for p in passages.tolist():
            k = int(np.searchsorted(base, p, "right")) - 1
            # a passage that begins before the text holds no more of it than its first one
            a = first[k] + max(0, p - base[k]) * STRIDE
            own = np.unique(term[a:min(a + self.bins * STRIDE, first[k] + lengths[k])])
            for i, score in self.above(own[own >= 0].tolist(), threshold):
                found[k][i] = max(found[k].get(i, 0.0), score)
        return found

    def verified(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[tuple[int, float, float, float]]]:
        """Of each text: (item id, score, share of the question's shingles it holds, share of the answer's), both at least ``overlap``."""
        split = [words_of(t) for t in texts]
        return [self._verify(w, f, overlap) if f else [] for w, f in zip(split, self.search(split, threshold))]

    def _verify(self, words: list[str], found: dict[int, float], overlap: float) -> list[tuple[int, float, float, float]]:
        have, out = {}, []
        for item, score in sorted(found.items()):
            shares = []
            for part in self.parts[item]:
                own = shingles(part)
                n = min(len(part), SHINGLE)
                if own and n not in have:
                    have[n] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}
                shares.append(len(own & have[n]) / len(own) if own else 1.0)
            if min(shares) >= overlap:
                out.append((self.keys[item], score, *shares))
        return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, row_hash, item_id, score, question_overlap, answer_overlap) per verified pair.

    Null or empty texts and items match nothing; items with equal texts are each reported; ``row_hash`` is the hash
    of the text, so rows that share a ``doc_id`` stay apart. Rows equal in both give equal pairs, once for each row.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, row_hash bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"),
                        F.col("text").cast("string").alias("text"))
    listed = CutTable(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))).df
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // INDEX_CHARS) or 1
    out = None
    for k in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toLocalIterator()
        shared = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows]).set_threshold(threshold))

        def work(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                keys, hashes, body = (b.column(k).to_pylist() for k in range(3))
                found = [(keys[j], hashes[j], *hit) for i, j in slices(body, 1 << 18)
                         for j, hits in enumerate(index.verified(body[i:j], threshold, overlap), i) for hit in hits]
                yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema=wanted)

        names = [c.split()[0] for c in schema.split(", ")]
        wanted = pa.schema([(n, pa.int64()) for n in names[:3]] + [(n, pa.float64()) for n in names[3:]])
        part = texts.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns."""
    own, key, digest = (unused(docs, c) for c in ("_own_hash", "_hit_id", "_hit_hash"))
    hit = contaminated(docs, items, **options).select(F.col("doc_id").alias(key), F.col("row_hash").alias(digest)).distinct()
    hit = CutTable(hit).df  # few rows: Spark may broadcast them by their size
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest))
    return marked.join(hit, same, "left_anti").drop(own)
