"""Maximal periodic runs of words by block convolution at dyadic scales.

A run is a stretch of words with smallest period q and at least ``max(24, 3 q)`` words that no neighbouring word extends.
At scale B (8, 16, 32, ...) the words are cut into blocks of B. A run of period q in [B, 2B) (below 16 for B = 8)
holds a whole block and the block's copy q words later, so every run is seen from some block: the sum of squared
differences between a block and each place of the window after it is zero there. The sums come from one convolution
a block, done for many blocks at once by a number-theoretic transform modulo a prime; word codes are kept so small that
the sums stay below the prime, hence they are the exact integers. Each zero gives a distance, and the pair
(block, distance) is extended both ways as far as words so far apart are equal. Extension compares prefix hashes by doubling
steps; every run found is then compared word by word, so that nothing rests on the hashes.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import slices

#: Least words of a run, and least words as a multiple of its period.
LEAST, TIMES = 24, 3
#: Blocks of the first scale: LEAST words hold one and its copy at any distance below twice its length.
FIRST = 8
#: 15 * 2^27 + 1 and a generator of its units: roots of unity for transforms of up to 134 million cells.
PRIME, ROOT = 2013265921, 31
#: Values transformed at once, and characters of texts looked at together.
_CELLS, _SLICE_CHARS = 1 << 19, 1 << 20
_P = np.uint64(PRIME)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, PRIME))
        out[have:2 * have] = out[:min(have, n - have)] * step % _P
        have *= 2
    return out


_TWIDDLES: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}


def _twiddles(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Factors of each step of the transform of length n and of its inverse, longest step first."""
    if n not in _TWIDDLES:
        root = pow(ROOT, (PRIME - 1) // n, PRIME)
        there, back = _powers(root, n // 2), _powers(pow(root, PRIME - 2, PRIME), n // 2)
        steps = [1 << k for k in range(n.bit_length() - 1)]
        _TWIDDLES[n] = [there[::k].reshape(-1, 1) for k in steps], [back[::k].reshape(-1, 1) for k in steps]
    return _TWIDDLES[n]


def transform(cells: np.ndarray) -> np.ndarray:
    """Number-theoretic transform down the columns of (n, columns), values in bit-reversed order."""
    n, columns = cells.shape
    half = n // 2
    for factors in _twiddles(n)[0]:
        view = cells.reshape(-1, 2, half, columns)
        low, high = view[:, 0], view[:, 1]
        out = np.empty_like(view)
        np.remainder(low + high, _P, out=out[:, 0])
        np.remainder((low + _P - high) * factors, _P, out=out[:, 1])
        cells, half = out.reshape(n, columns), half // 2
    return cells


def inverse(cells: np.ndarray) -> np.ndarray:
    """From ``transform``'s order back to the values."""
    n, columns = cells.shape
    half = 1
    for factors in reversed(_twiddles(n)[1]):
        view = cells.reshape(-1, 2, half, columns)
        low, high = view[:, 0], view[:, 1] * factors % _P
        out = np.empty_like(view)
        np.remainder(low + high, _P, out=out[:, 0])
        np.remainder(low + _P - high, _P, out=out[:, 1])
        cells, half = out.reshape(n, columns), half * 2
    return cells * np.uint64(pow(n, PRIME - 2, PRIME)) % _P


class _Hashes:
    """Prefix hashes of the words to two bases: equal stretches always have equal hashes."""

    def __init__(self, ids: np.ndarray):
        values = (ids % PRIME).astype(np.uint64)
        self.n, self.sums, self.powers = len(ids), [], []
        for base in (1_000_003, 48_271):
            powers = _powers(base, len(ids) + 1)
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(values * powers[:-1] % _P, out=sums[1:])
            self.sums.append(sums % _P)
            self.powers.append(powers)

    def same(self, a: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Are the ``n`` words from ``a`` on those from ``a + d`` on?"""
        equal = np.ones(len(a), bool)
        for sums, powers in zip(self.sums, self.powers):
            one, two = (sums[a + n] + _P - sums[a]) % _P, (sums[a + d + n] + _P - sums[a + d]) % _P
            equal &= one * powers[d] % _P == two
        return equal

    def extend(self, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last word of the stretch of period ``d`` around the equal words ``at`` and ``at + d``."""
        right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            grown = np.flatnonzero(at + d + right + step <= self.n)
            grown = grown[self.same((at + right)[grown], d[grown], np.int64(step))]
            right[grown] += step
            grown = np.flatnonzero(at - left - step >= 0)
            grown = grown[self.same((at - left - step)[grown], d[grown], np.int64(step))]
            left[grown] += step
            step >>= 1
        return at - left, at + d + right


def _zeros(ids: np.ndarray, starts: np.ndarray, block: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance) of every place of a block's window without a mismatch of codes."""
    spread = 2 * block - least
    n = 1 << (spread + block - 2).bit_length()
    bits = (PRIME.bit_length() - 1 - block.bit_length()) // 2
    codes = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    padded = np.concatenate([codes, np.zeros(3 * block, np.int64)])
    squares = np.concatenate([[0], np.cumsum(padded * padded)])
    inside, window, places = np.arange(block).reshape(-1, 1), np.arange(spread + block - 1).reshape(-1, 1), np.arange(spread).reshape(-1, 1) + least
    for k in range(0, len(starts), max(1, _CELLS // n)):
        own = starts[k:k + max(1, _CELLS // n)]
        a, w = np.zeros((n, len(own)), np.uint64), np.zeros((n, len(own)), np.uint64)
        a[-inside[:, 0]] = padded[own + inside]
        w[:len(window)] = padded[own + least + window]
        products = inverse(transform(a) * transform(w) % _P)[:spread].astype(np.int64)
        differences = squares[own + block] - squares[own] + squares[own + places + block] - squares[own + places] - 2 * products
        at, column = np.nonzero(differences == 0)
        yield own[column], at + least


def _true_stretch(ids: np.ndarray, start: int, stop: int, d: int, at: int) -> tuple[int, int]:
    """The stretch of period d around ``at``, by words; the hashes' answer is taken if it stands the comparison."""
    if np.array_equal(ids[start:stop - d], ids[start + d:stop]):
        return start, stop
    while start <= at and not np.array_equal(ids[start:at], ids[start + d:at + d]):
        start += 1
    stop = at
    while stop + d < len(ids) and ids[stop] == ids[stop + d]:
        stop += 1
    return start, stop + d


def stretch_runs(ids: np.ndarray, first: np.ndarray, stop: np.ndarray) -> dict[tuple[int, int], int]:
    """{(start, stop): period} of all runs in ``ids``; texts take the words ``first`` to ``stop`` and share no separator."""
    found: dict[tuple[int, int], int] = {}
    hashes, block = None, FIRST
    longest = int((stop - first).max(initial=0))
    while longest >= max(LEAST, TIMES * block):
        least = 1 if block == FIRST else block
        starts = np.arange(0, len(ids) - block + 1, block)
        text = np.searchsorted(first, starts, "right") - 1
        starts = starts[starts + block + least <= stop[text]]
        known = sorted((a, b, q) for (a, b), q in found.items() if b - a >= block + least)
        for at, d in _zeros(ids, starts, block, least):
            keep = at + d + block <= stop[np.searchsorted(first, at, "right") - 1]
            if keep.any() and known:
                order = np.argsort(at, kind="stable")
                at, d, keep = at[order], d[order], keep[order]
                for a, b, q in known:  # seen at a smaller scale
                    i, j = np.searchsorted(at, (a, b))
                    keep[i:j] &= (at[i:j] + d[i:j] + block > b) | (d[i:j] % q != 0)
            at, d = at[keep], d[keep]
            # codes of unlike words may be equal
            hashes = hashes or (_Hashes(ids) if len(at) else None)
            if hashes:
                real = ids[at] == ids[at + d]
                at, d = at[real], d[real]
                a, b = hashes.extend(at, d)
                long = b - a >= np.maximum(LEAST, TIMES * d)
                for s, e, q, seed in np.unique(np.stack([a, b, d, at])[:, long], axis=1).T.tolist():
                    if found.get((s, e), q + 1) > q:
                        s, e = _true_stretch(ids, s, e, q, seed)
                        if e - s >= max(LEAST, TIMES * q):
                            found[s, e] = min(q, found.get((s, e), q))
        block *= 2
    return found


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words as (start, length, period), by start, then period."""
    code: defaultdict = defaultdict()
    code.default_factory = code.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    # a separator after each text equals no other word
    first = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(int((sizes + 1).sum()), np.int64)
    for at, words in zip(first.tolist(), texts):
        ids[at:at + len(words)] = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    ids[first + sizes] = len(code) + np.arange(len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(texts):
        for (a, b), q in stretch_runs(ids, first, first + sizes).items():
            k = int(np.searchsorted(first, a, "right")) - 1
            out[k].append((a - int(first[k]), b - a, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of every run's part after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def collapse_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, then ``runs`` (start, length, period; by start, then period) and the text without repeats.

    Words are the maximal pieces without the six ASCII white-space characters; ``collapsed_text`` is the kept ones joined
    by one space. A null text has no words: no runs and an empty text. Each row gives one row, equal ones too; an empty
    table gives none. Whole texts are looked at, whatever their length, each in one task.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            rows, found = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices(found, _SLICE_CHARS):
                words = [(t or "").encode("utf-8", "replace").split() for t in found[i:j]]
                runs = runs_of(words)
                texts = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)]
                named = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
                yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), pa.array(named, kind), pa.array(texts, pa.string())], names=["row", "runs", "collapsed_text"])

    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    schema = rows.select("row", F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed_text")).schema
    return rows.mapInArrow(work, schema).select("row.*", "runs", "collapsed_text")


def strongest(runs: str):
    """The run of ``runs`` with the greatest length / period, then smallest start and period; null if there is none."""
    def order(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        after = (left < right) | ((left == right) & (F.struct(a["start"], a["period"]) > F.struct(b["start"], b["period"])))
        return F.when(after, 1).when((left == right) & (a["start"] == b["start"]) & (a["period"] == b["period"]), 0).otherwise(-1)

    return F.get(F.array_sort(F.col(runs), order), F.lit(0))
