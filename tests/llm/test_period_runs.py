"""Periodic runs by convolution against a scan of every period."""
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremor.llm import period_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words):
    code = {}
    ids, best = np.array([code.setdefault(w, len(code)) for w in words], np.int64), {}
    for q in range(1, len(ids) // 3 + 1):
        same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(same))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a + q >= max(24, 3 * q):
                best.setdefault((a, b + q), q)
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def slow_row(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(key).encode()) if key is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return (key, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


@pytest.mark.parametrize("n", [2, 8, 64, 4096])
def test_transform_is_exact(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 200, (n, 3)).astype(np.uint64) for _ in range(2))
    got = period_runs.inverse(period_runs.transform(a) * period_runs.transform(b) % np.uint64(period_runs.PRIME))
    for k in range(3):
        full = np.convolve(a[:, k].astype(object), b[:, k].astype(object))
        want = [int(full[i]) + (int(full[i + n]) if i + n < len(full) else 0) for i in range(n)]
        assert got[:, k].tolist() == want


def shapes():
    rng = np.random.default_rng(1)
    fib = ["a", "b"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    yield from ("a" * n for n in (0, 1, 23, 24, 25, 100, 5000))
    yield from (fib[-1], ("a" * 100 + "b") * 12, ("a" * 300 + "b") * 4 + "a" * 200, "ab" * 12, "ab" * 11 + "a", ("abcabcx" * 40 + "y") * 5, "abc" * 30 + "abd" * 30)
    yield from ("".join(chr(65 + c) for c in rng.integers(0, k, n)) for k in (1, 2, 3, 30) for n in (50, 700))
    for q in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100, 255, 256, 257):
        unit = "".join(chr(200 + c) for c in rng.integers(0, 500, q))
        for words in (3 * q - 1, 3 * q, 3 * q + 1, 24, 5 * q):
            yield "xyz" * int(rng.integers(0, 9)) + (unit * 6)[:words] + "z"


def test_runs_of_hard_shapes_together_and_alone():
    texts = [list(s) for s in shapes()]
    want = [slow_runs(t) for t in texts]
    assert period_runs.runs_of(texts) == want
    assert [period_runs.runs_of([t])[0] for t in texts] == want
    assert period_runs.runs_of([]) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=12), st.integers(1, 12)), max_size=12), min_size=1, max_size=4))
def test_runs_of_any_repeats(texts):
    words = [list("".join(unit * k for unit, k in parts)) for parts in texts]
    assert period_runs.runs_of(words) == [slow_runs(w) for w in words]


def test_long_repeats_end():
    n = 400_000
    assert period_runs.runs_of([["w"] * n]) == [[(0, n, 1)]]
    rng = np.random.default_rng(2)
    unit = [int(x) for x in rng.integers(0, 1 << 40, n // 5)]
    assert period_runs.runs_of([[-1, -2, *unit, *unit, *unit, *unit[:50]]]) == [[(2, 3 * len(unit) + 50, len(unit))]]


def test_hashes_that_agree_by_chance_are_told_apart(monkeypatch):
    monkeypatch.setattr(period_runs._Hashes, "same", lambda self, a, d, n: np.ones(len(a), bool))
    words = list("xy" + "abc" * 20 + "zzt")
    assert period_runs.runs_of([words]) == [slow_runs(words)]


def test_query_on_the_whole_table(spark):
    from tremor.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    short = {k: t for k, t in docs if len(t or "") < 12_000}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_period_runs"](spark, "/root/testdata/sf0.01").collect()}
    assert sorted(got) == sorted(k for k, _ in docs) and len(short) > 900
    assert {k: got[k] for k in short} == {k: slow_row(k, t) for k, t in short.items()}


def test_edge_rows(spark, edge, empty):
    from tremor.llm.queries import with_repeats

    wide = edge.withColumn("runs", F.lit(1)).withColumn("collapsed_text_of", F.lit(1))
    got = period_runs.collapse_runs(wide, "doc_id", "row", "component_id").collect()
    assert len(got) == edge.count() and all(r["collapsed_text"] is not None for r in got)
    long = [r for r in got if r["doc_id"] == 6][0]
    assert [tuple(r) for r in long["runs"]] == [(0, 30_000, 977)] and len(long["collapsed_text"].split()) == 977
    assert period_runs.collapse_runs(empty, "doc_id").collect() == []
    assert with_repeats(edge).count() == edge.count()
