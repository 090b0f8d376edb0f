"""Language identification with a string kernel.

A text is the set of its byte n-grams of several lengths (blended spectrum), addressed by a hash into ``2**bits``
cells; the kernel of two texts is the number of cells both have over the geometric mean of their own numbers
(presence kernel). Landmark texts give a Nystroem map: with K_LL the kernel of the landmarks, the features of x are
K_LL^(-1/2) k(x, L), and one-versus-rest kernel ridge regression on them is a small linear system. As the kernel is
an inner product, k(x, L) times the weights equals one product of x's presence vector with a (cells x languages)
matrix, so whole batches of texts are scored by one gathered matrix product.

Only landmarks and kernel values of a bounded sample of labelled rows reach the driver; every whole text is scored.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import unused

UNKNOWN = "und"
#: Text is read in pieces of this many bytes, so that the work space stays bounded; n-grams run across the pieces.
PIECE = 1 << 20


@dataclass(frozen=True)
class Spectrum:
    """The n-gram lengths of the kernel and the number of cells they are hashed into."""

    lengths: tuple[int, ...] = (1, 2, 3, 4)  # of at most 4 bytes
    bits: int = 18

    def cells(self, text: str) -> np.ndarray:
        """Sorted cells of the n-grams that the text contains."""
        raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        seen = np.zeros(1 << self.bits, bool)
        overlap = max(self.lengths) - 1
        for at in range(0, max(len(raw), 1), PIECE):
            part = raw[max(0, at - overlap):at + PIECE].astype(np.uint32)
            gram = np.zeros(len(part), np.uint32)
            for n in range(1, max(self.lengths) + 1):
                if len(part) < n:
                    break
                gram = (gram[:len(part) - n + 1] << np.uint32(8)) | part[n - 1:]
                if n in self.lengths:
                    mixed = (gram + np.uint32(n)) * np.uint32(2654435761)
                    seen[mixed >> np.uint32(32 - self.bits)] = True
        return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    spectrum: Spectrum
    languages: tuple[str, ...]
    weights: np.ndarray  # (cells, languages): the landmarks' presence times their dual weights

    def scores(self, cells: list[np.ndarray]) -> np.ndarray:
        """Ridge outputs of a batch of texts that have a cell each."""
        size = np.array([len(c) for c in cells])
        starts = np.cumsum(size) - size
        return np.add.reduceat(self.weights[np.concatenate(cells)], starts, axis=0) / np.sqrt(size)[:, None]


def _has_letter(text: str) -> Column:
    return F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")


def _kernel(cells: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Presence kernel of one text with the landmarks, given as rows of bits by cell."""
    both = np.zeros(len(sizes))
    for k in range(0, len(cells), 4096):
        both += np.unpackbits(landmarks[cells[k:k + 4096]], axis=1, count=len(sizes)).sum(axis=0, dtype=np.int64)
    return both / np.sqrt(max(len(cells), 1) * sizes)


def train(docs: DataFrame, learn: Column, *, spectrum: Spectrum | None = None, landmarks: int = 256, sample: int = 2048,
          ridge: float = 1e-3) -> Model | None:
    """Fit on rows where ``learn`` holds and the language is known and the text has a letter.

    ``landmarks`` and ``sample`` bound the texts used, shared evenly among the languages; rows are picked by a hash of
    their text, so equal texts count once and reruns agree. None if no row can be learned from.
    """
    spectrum = spectrum or Spectrum()
    rows = docs.where(learn & F.col("lang").isNotNull() & _has_letter("text")).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if not counts:
        return None
    names = tuple(sorted(counts))
    each, marks = max(1, sample // len(names)), max(1, landmarks // len(names))
    key = F.pmod(F.xxhash64("text"), F.lit(1 << 40))

    def picked(per: int) -> DataFrame:
        # a share that holds about 2 * per rows of each language; the first per of them in hash order are used
        share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(min(1.0, 2.0 * per / counts[n]))))])
        return rows.where(key < (F.element_at(share, F.col("lang")) * F.lit(float(1 << 40))))

    def ranked(frame: DataFrame, per: int, fn, schema: str) -> list:
        found = frame.withColumn("key", key).mapInArrow(fn, schema).toLocalIterator()
        by: dict[str, dict] = {n: {} for n in names}
        for r in found:
            by[r["lang"]][r["key"]] = r["v"]
        return [(n, v) for n in names for _, v in sorted(by[n].items())[:per]]

    def cells_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [spectrum.cells(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cells, pa.list_(pa.int32()))], names=["lang", "key", "v"])

    marked = ranked(picked(marks), marks, cells_of, "lang string, key bigint, v array<int>")
    bits = np.zeros((1 << spectrum.bits, (len(marked) + 7) // 8), np.uint8)
    for k, (_, cells) in enumerate(marked):
        bits[np.asarray(cells, np.int64), k // 8] |= np.uint8(128 >> k % 8)
    sizes = np.array([len(cells) for _, cells in marked], np.float64)
    packed = docs.sparkSession.sparkContext.broadcast(bits)

    def kernel_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [_kernel(spectrum.cells(t), packed.value, sizes) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(k, pa.list_(pa.float64()))], names=["lang", "key", "v"])

    fitted = ranked(picked(each), each, kernel_of, "lang string, key bigint, v array<double>")
    packed.unpersist()
    k_nl = np.array([v for _, v in fitted])
    k_ll = np.array([_kernel(np.asarray(cells, np.int64), bits, sizes) for _, cells in marked])
    value, vector = np.linalg.eigh(k_ll)
    kept = value > 1e-8 * value.max()
    half = vector[:, kept] / np.sqrt(value[kept])  # K_LL^(-1/2) on its range
    phi = k_nl @ half
    target = np.array([[float(lang == n) for n in names] for lang, _ in fitted])
    weight = np.array([1.0 / sum(lang == x for x, _ in fitted) for lang, _ in fitted])[:, None]  # languages count alike
    beta = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]), phi.T @ (target * weight))
    dual = half @ beta / np.sqrt(sizes)[:, None]
    weights = np.zeros((1 << spectrum.bits, len(names)), np.float32)
    for (_, cells), w in zip(marked, dual):
        weights[np.asarray(cells, np.int64)] += w.astype(np.float32)
    return Model(spectrum, names, weights)


def predict(docs: DataFrame, model: Model | None, *keep: str, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred`` and ``score`` (or the names in ``out``).

    The score is the winner's share of the positive ridge outputs. Null texts, texts without a letter, and all texts
    if there is no model give ``und`` with score 0. The text alone decides; ties go to the first language by name.
    """
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) if keep else ""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    work = docs.select(*keep, F.when(_has_letter("text"), F.col("text").cast("string")).alias(unused(docs, "_text")))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            label, value = [UNKNOWN] * len(texts), [0.0] * len(texts)
            rows = [k for k, t in enumerate(texts) if t] if m else []
            for a in range(0, len(rows), 64):
                some = rows[a:a + 64]
                ridge = m.scores([m.spectrum.cells(texts[k]) for k in some]).astype(np.float64)
                up = np.maximum(ridge, 0) + 1e-12
                share, best = up / up.sum(axis=1, keepdims=True), up.argmax(axis=1)
                for r, k in enumerate(some):
                    label[k], value[k] = m.languages[best[r]], float(share[r, best[r]])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(label, pa.string()), pa.array(value, pa.float64())],
                                             names=[*b.schema.names[:-1], *out])

    return work.mapInArrow(score, f"{schema}`{out[0]}` string, `{out[1]}` double")
