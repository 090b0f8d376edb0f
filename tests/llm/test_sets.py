"""Mixing, nearest neighbours and the pipeline against plain Python."""
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import mixing, projection_forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, limit=3):
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if rate * weight[n] > limit * sizes[n]]
        if not over:
            return out | {n: rate * weight[n] for n in open_}
        for n in over:
            out[n] = float(limit * sizes[n])
            left -= out[n]
            open_.discard(n)
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.floats(0, 1.2))
def test_subset_sum_is_the_best(lengths, part):
    ordered = sorted(lengths)
    counts = [lengths[x] for x in ordered]
    budget = int(part * sum(a * b for a, b in zip(ordered, counts)))
    sums = {0}
    for a, b in zip(ordered, counts):
        sums = {s + a * k for s in sums for k in range(b + 1)}
    taken = mixing.subset_sum(ordered, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    assert sum(a * t for a, t in zip(ordered, taken)) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("window", [50, 1 << 16])
def test_fit_stays_within_counts_and_close(window):
    rng = np.random.default_rng(2)
    lengths = sorted({int(x) for x in rng.lognormal(5, 2, 400)} - {0})
    counts = [int(c) for c in rng.integers(1, 2000, len(lengths))]
    total = sum(a * b for a, b in zip(lengths, counts))
    for budget in (0, 1, total // 3, total - 1, total, total + 5):
        taken = mixing.fit(lengths, counts, budget, window)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert 0 <= min(budget, total) - sum(a * t for a, t in zip(lengths, taken)) <= 1


def test_mix(edge, small, empty):
    for docs in (edge, small):
        sizes = Counter()
        for r in docs.collect():
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        want = slow_targets(sizes)
        got = mixing.mix(docs, ["doc_id", "source", "text"]).collect()
        assert len(got) == docs.count()
        taken = Counter()
        for r in got:
            assert r["size"] == len(WORD.findall(r["row"]["text"] or "")) and 0 <= r["copies"] <= 3
            assert abs(r["target"] - want[r["row"]["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["row"]["source"]]
            taken[r["row"]["source"]] += r["size"] * r["copies"]
        if docs is small:
            assert all(abs(taken[s] - want[s]) <= max(1, 0.02 * want[s]) for s in want)  # ten documents a source
            assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, ["doc_id", "source", "text"]).collect()))
        mixed = mixing.apply_mix(docs)
        assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty, ["doc_id"]).collect() == []


def slow_nearest(vectors, query, k):
    own = vectors[query]
    d = sorted((float(np.sqrt(((np.array(v, float) - own) ** 2).sum())), key) for key, v in vectors.items() if key != query)
    return [(key, x) for x, key in d[:k]]


def test_search_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    got = {}
    for r in projection_forest.search(table, F.col("vec_id") % 50 == 0, leaf_rows=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        want = slow_nearest(vectors, q, 10)
        hits += len({k for k, _ in want} & {k for k, _ in found.values()})
        assert all(abs(np.sqrt(((vectors[k] - vectors[q]) ** 2).sum()) - s) < 1e-12 for k, s in found.values())
    assert len(got) == 10 and hits >= 0.9 * 100


def test_search_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []),
            (100, [0.5, 0.5]), (None, [1.0, 1.0]), (3, [0.0, 1.0]), (11, [1.0, 2.0, 3.0])] + [(k, [2.0, 2.0]) for k in range(200, 230)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in projection_forest.search(table, F.col("vec_id") % 100 == 0).collect())
    plain = {k: np.array(v, float) for k, v in rows if k is not None and v and len(v) == 2 and None not in v and np.isfinite(v).all() and any(v)}
    want = [(q, n, key, d) for q in (0, 100, 200) for n, (key, d) in enumerate(slow_nearest(plain, q, 10), 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert projection_forest.search(table.where("false"), F.lit(True)).collect() == []


def best_sum(lengths, target):
    """Greatest sum of documents not above the target, each taken floor(target / size) times or once more."""
    whole = int(target // sum(lengths)) * sum(lengths)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= target - whole}
    return whole + max(sums)


def test_pipeline_stages_take_effect(spark, small, tmp_path):
    docs, seen = small, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == small.columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    language, unique, clean = text(seen["language"]), text(seen["near_duplicates"]), text(seen["decontaminated"])
    assert language == {k: t for k, t in text(small).items() if re.search(r"[^\W\d_]", t or "")}
    from test_near_copies import slow_keepers

    assert sorted(unique) == slow_keepers(sorted(language.items()))
    from tremor.llm.decontaminate import shingles, words_of

    items = [shingles(words_of(r["text"])) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    dirty = {k for k, t in unique.items() if any(len(i & shingles(words_of(t))) >= 0.8 * len(i) for i in items)}
    assert dirty and set(clean) == set(unique) - dirty
    sizes, taken, lengths = Counter(), Counter(), {}
    for r in seen["decontaminated"].collect():
        n = len(WORD.findall(r["text"]))
        sizes[r["source"]] += n
        lengths.setdefault(r["source"], []).append(n)
    for r in seen["mixed"].collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    # few documents may have no sum near the target: then it is the best one that is not above it
    assert all(abs(taken[s] - t) <= max(1, 0.02 * t) or taken[s] == best_sum(lengths[s], t) for s, t in slow_targets(sizes).items())
    mixed = sorted(r["doc_id"] for r in seen["mixed"].collect())
    assert [r["doc_id"] for r in sorted(seen["tokens"].collect(), key=lambda r: r["start"])] == mixed


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_pipeline_stages_bear_edge_rows(spark, edge, empty, stage):
    assert stage(spark, edge, "/root/testdata/sf0.001").count() > 0
    assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
