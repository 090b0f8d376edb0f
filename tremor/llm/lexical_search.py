"""Ranked lexical search as maximum inner products: vectors in buckets by length, bounds first, exact scores last.

A document is the vector of its terms' impacts ``(10^9 tf) div (1000 tf + 12 m)``, an item the vector of its terms' weights
times their counts; the score is their inner product in whole numbers. Document vectors are held over the terms of a
block of items only. They are dealt by ranges of their length and sorted by it, and a bucket is the next ``BUCKET`` of
them. For an item with the threshold t (its k-th best score so far):

* a bucket whose longest vector times the item's length is below t is left out (Cauchy-Schwarz);
* inside a bucket the item's heaviest coordinates are its focus: as few as make the rest of the item, times the longest vector,
  fall below t. A document without any of them is out; for the others the product over the focus plus
  the length of the item's rest times that of the document's rest bounds the score;
* documents whose bound reaches t are scored in whole numbers.

The longest vectors are searched first, and their k-th scores are the thresholds that the rest starts with. Thresholds
only ever come from scores of real documents, so no result can be lost.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.common import slices
from tremor.plans.loops import CutTable

BUCKET = 2048
#: Distinct (item, term) pairs of one block of items: what is broadcast and held by the driver at once. A single item may exceed it.
BLOCK_TERMS = 1 << 18
#: Share of the longest vectors that are searched first.
FIRST_SHARE = 0.01
_PIECE = 1 << 20
#: Bounds are doubles: a bound counts as reaching a threshold that is above it by no more than this share.
_SLACK = 1 + 1e-9
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FOUND = "item int, doc_id bigint, score bigint"


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in order: maximal runs of ASCII letters, digits and all other characters above; lists of bounded size."""
    raw = (text or "").encode("utf-8", "replace").translate(_KEEP)
    at = 0
    while len(raw) - at > _PIECE:
        end = raw.rfind(b" ", at + 1, at + _PIECE)
        end = raw.find(b" ", at + _PIECE) if end < 0 else end
        if end < 0:
            break
        yield raw[at:end].split()
        at = end
    yield raw[at:].split()


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of each document with a term: all its terms counted, those of the vocabulary listed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices(texts, _PIECE):
                rows, sizes, ends, terms, counts = [], [], [0], [], []
                for k in range(i, j):
                    n, tf = 0, Counter()
                    for words in term_lists(texts[k]):
                        n += len(words)
                        tf.update(map(number, words))
                    tf.pop(None, None)
                    if n:
                        rows.append(k)
                        sizes.append(n)
                        terms.extend(tf.keys())
                        counts.extend(tf.values())
                        ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, counts)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, n bigint, term array<int>, tf array<int>")


def _document_counts(vectors: DataFrame, terms: int) -> np.ndarray:
    """Number of documents by term."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(seen[held])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for row in vectors.select("term").mapInArrow(work, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


class _Search:
    """Running results of all items of a block over buckets of document vectors."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray, terms: int, k: int):
        self.terms, self.k, self.floor = terms, k, floor.copy()
        self.items, self.rest, self.best = [], [], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for term, weight in items:
            order = np.argsort(-weight, kind="stable")
            term, weight = term[order], weight[order]
            self.items.append((term, weight))
            # length of what is left of the item after its first 0, 1, ... coordinates
            squares = weight.astype(float) ** 2
            self.rest.append(np.sqrt(np.concatenate([np.cumsum(squares[::-1])[::-1], [0.0]])))
        self.lengths = np.array([r[0] for r in self.rest])

    def bucket(self, doc_id: np.ndarray, no_id: np.ndarray, length: np.ndarray, ends: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        reach = float(length.max(initial=0.0))
        alive = np.flatnonzero(self.lengths * reach * _SLACK >= np.maximum(self.floor, 1))
        if not len(alive):
            return
        owner = np.repeat(np.arange(len(doc_id)), np.diff(ends))
        order = np.argsort(term, kind="stable")
        rows, values = owner[order], impact[order].astype(float)
        heads = np.searchsorted(term[order], np.arange(self.terms + 1))
        dense = np.zeros(self.terms, np.int64)
        for q in alive.tolist():
            own, weight = self.items[q]
            rest, floor = self.rest[q], max(int(self.floor[q]), 1)
            focus = int(np.searchsorted(-rest * reach * _SLACK, -float(floor), "right"))
            product, held = np.zeros(len(doc_id)), np.zeros(len(doc_id))
            for t, w in zip(own[:focus].tolist(), weight[:focus].tolist()):
                a, b = heads[t], heads[t + 1]
                if a < b:
                    product[rows[a:b]] += w * values[a:b]
                    held[rows[a:b]] += values[a:b] ** 2
            # what reaches the threshold has a focus coordinate, unless the focus is the whole item
            bound = product + rest[min(focus, len(own))] * np.sqrt(np.maximum(length ** 2 - held, 0.0))
            left = np.flatnonzero((bound * _SLACK >= floor) & (held > 0))
            if not len(left):
                continue
            dense[own] = weight
            sizes = ends[left + 1] - ends[left]
            cells = np.repeat(ends[left] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            score = np.add.reduceat(dense[term[cells]] * impact[cells], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            dense[own] = 0
            good = score >= floor
            self._add(q, score[good], doc_id[left[good]], no_id[left[good]])

    def _add(self, q: int, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray) -> None:
        score, doc_id, no_id = (np.concatenate(pair) for pair in zip(self.best[q], (score, doc_id, no_id)))
        order = np.lexsort((doc_id, no_id, -score))[:self.k]
        self.best[q] = score[order], doc_id[order], no_id[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], score[order[-1]])

    def found(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        score, doc_id, no_id = (np.concatenate([b[k] for b in self.best]) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, mask=no_id), pa.array(score)], names=["item", "doc_id", "score"])


def _searched(vectors: DataFrame, items: list, floor: np.ndarray, terms: int, k: int, bucket: int) -> DataFrame:
    """Best ``k`` per item and task among ``vectors`` (doc_id, length, term, impact), longest first."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, floor))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(*shared.value, terms, k)
        for batch in batches:
            for at in range(0, batch.num_rows, bucket):
                part = batch.slice(at, bucket)
                keys, lists = part.column(0), part.column(2)
                ends = np.asarray(lists.offsets).astype(np.int64)
                search.bucket(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False), part.column(1).to_numpy(),
                              ends - ends[0], lists.flatten().to_numpy(), part.column(3).flatten().to_numpy())
        yield search.found()

    longest = F.col("length").desc()
    dealt = vectors.repartitionByRange(longest, "doc_id").sortWithinPartitions(longest, "doc_id")
    return dealt.select("doc_id", "length", "term", "impact").mapInArrow(work, FOUND)


def _block(docs: DataFrame, items: list[Counter], k: int, bucket: int) -> DataFrame | None:
    """(item, doc_id, score): candidates that hold the best ``k`` of each of ``items``; none without a document."""
    vocabulary = {t: n for n, t in enumerate(dict.fromkeys(t for item in items for t in item))}
    vectors = CutTable(_vectors(docs, vocabulary)).df
    total = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    if not total["documents"] or not vocabulary:
        return None
    df = _document_counts(vectors, len(vocabulary)).tolist()
    weight = [math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * n + 1))) for n in df]
    rows = [(np.array([vocabulary[t] for t in item], np.int64), np.array([weight[vocabulary[t]] * c for t, c in item.items()], np.int64)) for item in items]
    m = 75 + F.expr(f"(25L * n * {total['documents']}L) div {total['terms']}L")
    impact = F.transform("tf", lambda tf: F.expr("0L") + F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(12).cast("long") * F.col("m")))
    scored = vectors.where(F.size("term") > 0).withColumn("m", m).withColumn("impact", impact)
    scored = scored.withColumn("length", F.sqrt(F.aggregate("impact", F.lit(0.0), lambda a, v: a + v.cast("double") * v)))
    edge = scored.agg(F.percentile_approx("length", 1 - FIRST_SHARE, 1000).alias("edge")).first()["edge"]
    if edge is None:
        return None
    best = CutTable(_searched(scored.where(F.col("length") >= edge), rows, np.zeros(len(items), np.int64), len(vocabulary), k, bucket)).df
    floor = np.zeros(len(items), np.int64)
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
    for row in ranked.where(F.col("r") == k).toLocalIterator():
        floor[row["item"]] = row["score"]
    return best.unionAll(_searched(scored.where(F.col("length") < edge), rows, floor, len(vocabulary), k, bucket))


def _item_blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Items as (item_id, counts of terms), in blocks of about ``size`` distinct terms; only one block is held."""
    block, held = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        terms = Counter()
        for words in term_lists(row["text"]):
            terms.update(words)
        if held and held + len(terms) > size:
            yield block
            block, held = [], 0
        block.append((row["item_id"], terms))
        held += len(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, *, bucket: int = BUCKET, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each row of ``items``.

    Equal scores go by ascending ``doc_id``, null last. Null and empty texts have no terms: such documents are not
    counted, such items find nothing. Equal rows of ``docs`` are documents of their own; equal rows of ``items`` are each
    ranked. Without documents or items the result is empty. Other columns are not read. Very long texts are taken apart
    piece by piece.
    """
    spark: SparkSession = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for block in _item_blocks(items, block_terms):
        found = _block(docs, [terms for _, terms in block], k, bucket)
        if found is not None:
            names = spark.createDataFrame([(n, key) for n, (key, _) in enumerate(block)], f"item int, item_id {kind}")
            ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            out = out.unionAll(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY doc_id, t),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t),
impacts AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS v FROM tf JOIN sizes USING (doc_id), total),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * v)::BIGINT AS score FROM asked JOIN weights USING (t) JOIN impacts USING (t) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
