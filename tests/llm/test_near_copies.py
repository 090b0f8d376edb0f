"""Near-copy stage of the pipeline against all pairs, by 5-word Jaccard similarity."""
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import near_copies


def word_sets(texts):
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lower]
    return [frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


def slow_keepers(docs):
    """Smallest doc_id of each component of pairs with Jaccard >= 0.8, -1 for null."""
    own, parent = word_sets([t for _, t in docs]), list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if own[a] == own[b] or (own[a] and own[b] and len(own[a] & own[b]) * 9 >= 4 * (len(own[a]) + len(own[b]))):
                parent[root(a)] = root(b)
    low = {}
    for k, (key, _) in enumerate(docs):
        if key is not None:
            low[root(k)] = min(low.get(root(k), key), key)
    return sorted(low.get(r, -1) for r in {root(k) for k in range(len(docs))})


def kept(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.select("doc_id").collect())


def test_stage_keeps_one_of_each_group(spark, edge, small, empty):
    for docs in (edge, small, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0")):
        assert kept(spark, docs) == slow_keepers([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert kept(spark, empty) == []


def test_pairs_at_the_limit_and_chains(spark):
    rng = np.random.default_rng(5)
    docs, key = [], 0
    for n in (5, 6, 9, 10, 13, 45, 46, 90, 400):
        for share in (0.02, 0.05, 0.1, 0.11, 0.12, 0.2):
            words = [f"w{x}" for x in rng.integers(0, 10**9, n)]
            for _ in range(5):  # each one cut or grown at the end of the one before: a chain
                docs.append((key, " ".join(words)))
                key += 1
                m = max(1, int(len(words) * share))
                words = words[m:] if rng.random() < 0.5 and len(words) > m + 5 else words + [f"v{x}" for x in rng.integers(0, 10**9, m)]
    assert kept(spark, spark.createDataFrame(docs, "doc_id bigint, text string")) == slow_keepers(docs)


def test_large_group_of_near_copies_is_not_paired(spark):
    base = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join([*base[:150], f"x{k}", *base[150:]])) for k in range(300)] + [(1000, "some other text of a few words")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert kept(spark, frame) == [0, 1000]
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("low")
    nodes = near_copies._sets(frame, False).groupBy("node").agg(low, F.first("n").alias("n"), F.first("part").alias("part"))
    assert near_copies.links(frame, nodes).count() < 300 * 10


def test_recall_in_a_large_group_of_loose_copies(spark):
    """700 texts of one pattern, most pairs just below or above 0.8: links and groups against all pairs."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(260)]
    docs = []
    for k in range(700):
        words = list(base)
        for at in rng.choice(260, int(rng.integers(1, 7)), replace=False):
            words[at] = f"x{k}-{at}"
        docs.append((k, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    own = word_sets([t for _, t in docs])
    pairs = [(a, b) for a in range(700) for b in range(a) if len(own[a] & own[b]) * 9 >= 4 * (len(own[a]) + len(own[b]))]
    keys = [set(near_copies.band_keys(near_copies.shingles(t)[1]).tolist()) for _, t in docs]
    assert sum(bool(keys[a] & keys[b]) for a, b in pairs) >= 0.99 * len(pairs)
    want, got = slow_keepers(docs), kept(spark, frame)
    assert len(want) <= len(got) and 700 - len(got) >= 0.99 * (700 - len(want))


def test_later_stages_after_the_jaccard_stage(spark, small, tmp_path):
    docs, seen = small, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    pairs = lambda name: sorted((r["doc_id"], r["text"]) for r in seen[name].collect())
    unique = [k for k, _ in pairs("near_duplicates")]
    assert unique == slow_keepers(pairs("language"))
    from tremor.llm.decontaminate import shingles, words_of

    items = [shingles(words_of(r["text"])) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    dirty = {k for k, t in pairs("near_duplicates") if any(len(i & shingles(words_of(t))) >= 0.8 * len(i) for i in items)}
    assert dirty and {k for k, _ in pairs("decontaminated")} == set(unique) - dirty


def test_fingerprints_come_first_and_copies_of_one_text_meet_it(spark, monkeypatch):
    """All fingerprints are searched by op10's links; then each copy is held against the text it was made from, not against a node of each bucket."""
    base = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join([*base[:k % 60], f"x{k}", *base[k % 60 + 1:]])) for k in range(400)] + [(1000, " ".join(base)), (1001, "some other text of a few words")]
    asked, pairs, linked, similar = [], [], near_copies.simhash.linked, near_copies._similar
    monkeypatch.setattr(near_copies.simhash, "linked", lambda fps, *a: asked.append(fps.count()) or linked(fps, *a))
    monkeypatch.setattr(near_copies, "_similar", lambda p, sets: pairs.append(p.count()) or similar(p, sets))
    assert kept(spark, spark.createDataFrame(docs, "doc_id bigint, text string")) == slow_keepers(docs) == [0, 1001]
    assert len(asked) == 1 and asked[0] > 300 and sum(pairs) < 10 * 400


def test_every_link_of_a_group_of_fingerprints_is_met(spark):
    """Groups of equal fingerprints alone, without bands: a first node that is like none of them, chains, and a large group of loose copies."""
    docs = [(k, " ".join([*[f"w{a}" for a in range(60)][:at], f"x{k}", *[f"w{a}" for a in range(60)][at:]])) for k, at in ((1, 30), (2, 20), (3, 10))]
    docs = [(0, " ".join(f"z{a}" for a in range(61))), *docs]
    rng = np.random.default_rng(3)
    for k in range(100, 220):
        words = [f"v{a}" for a in range(120)]
        for at in rng.choice(120, 3, replace=False):
            words[at] = f"y{k}-{at}"
        docs.append((k, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    nodes = near_copies._sets(frame, False).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("low"), F.first("n").alias("n"))
    nodes = near_copies.CutTable(nodes.withColumns({"fp": (F.col("low.doc_id") >= 100).cast("bigint"), "part": F.array().cast("array<bigint>")})).df
    comp = near_copies.components(near_copies.links(frame, nodes))
    groups = nodes.join(comp.withColumnRenamed("node_id", "node"), "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("low.doc_id").alias("d"))
    assert sorted(r["d"] for r in groups.collect()) == slow_keepers(docs)
