"""Ranked search with bounds against a plain sum over all documents."""
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counts = [(key, Counter(terms(t))) for key, t in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    n_docs, total, df = len(counts), sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for key, c, n in counts:
            m = 75 + 25 * n * n_docs // total
            score = sum(weight[t] * k_ * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k_ in asked.items() if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(item, r, None if no_id else key, -s) for r, (s, no_id, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, k=20, **options):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, k, **options).collect()), key=str)


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_terms_are_the_maximal_matches():
    rng = np.random.default_rng(0)
    for text in ["", None, "A_b-C9 é!É", "中文。x", "a\x00b\x7fc\x80d", "x" * 30] + ["".join(rng.choice(list("aZ9 _.é中\x1f\x85\n`{@["), 40)) for _ in range(200)]:
        assert [w.decode() for part in lexical_search.term_lists(text) for w in part] == terms(text)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "ab é " * 500 + "w" * 900 + " tail" * 50
    monkeypatch.setattr(lexical_search, "_PIECE", 64)
    assert [w.decode() for part in lexical_search.term_lists(text) for w in part] == terms(text)


@pytest.mark.parametrize("bucket", [2048, 16])
def test_whole_table(spark, bucket):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(docs, items, bucket=bucket) == plain(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"), 20)


def test_blocks_of_items_and_few_results(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(docs, items, 3, bucket=7, block_terms=100) == plain(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"), 3)


def test_ties_copies_and_common_words(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 60)))) for k in range(400)] + [(k, "same text of all copies w1 w2") for k in range(400, 700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    items = [(1, "w1 w2 w2 w3"), (2, "same copies"), (3, "unknown words"), (4, "w1"), (5, " ".join(words)), (5, "w7 w7 w7"), (6, None)]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(docs, asked, bucket=32) == plain(rows, items, 20)


def test_edge_rows(spark, edge, empty):
    items = [(1, "the cat sat"), (2, ""), (None, "word1 word2"), (3, "chat another x")]
    asked = spark.createDataFrame([(*i, 7) for i in items], "item_id bigint, text string, doc_id int")
    assert found(edge.withColumn("item", F.lit(1)).withColumn("term", F.lit(1)), asked) == plain(pairs(edge, "doc_id", "text"), items, 20)
    assert found(empty, asked) == [] and found(edge, asked.where("false")) == [] and found(edge, asked.where("text = ''")) == []
    assert found(edge.where("text IS NULL"), asked) == []
