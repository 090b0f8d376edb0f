"""Token counts by overlapping chunks against the library on whole texts."""
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremor.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def plain(text):
    return len(TOK.encode(text or "", add_special_tokens=False).ids)


def counted(docs, **options):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PATH, "doc_id", **options).collect())


def wanted(docs):
    return sorted((k is not None, k or 0, len((t or "").encode()), plain(t)) for k, t in docs)


def test_whole_table_in_small_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert counted(docs, chunk=1000, overlap=100) == wanted(source)
    assert counted(docs) == wanted(source)


def test_texts_without_a_place_to_splice(spark):
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("abcdefgh"), 5000))
    texts = [word, word + " " + word, "a" * 4001, " " * 3000, "\n \t" * 900, "x y " * 50 + "q" * 2500 + " z" * 400 + word, "日本" * 2000, "日本語。テスト " * 400,
             "'" * 2000, "it's we'll " * 300, "<|endoftext|>" * 200, "a<|endoftext|>b " * 200, "é" * 1500, "一̀a1" * 800, "\x1c\x85 " * 700, "1234567890" * 300]
    texts += ["".join(rng.choice(list("ab 1.'\né中<|>"), 3000)) for _ in range(20)] + ["", None]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for chunk, overlap in ((300, 40), (700, 200), (5000, 256)):
        assert counted(docs, chunk=chunk, overlap=overlap) == wanted(rows)


def test_edge_rows(edge, empty):
    wide = edge.withColumn("n_tokens_of", F.lit(1)).withColumn("first", F.lit(2))
    assert counted(wide, chunk=400, overlap=64) == wanted([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert counted(empty) == []
    assert token_counts.count_tokens(edge, PATH, "doc_id", "row", "key").columns == ["doc_id", "row", "key", "n_bytes", "n_tokens"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "'s", "'", " ", "  ", "\n", "1", "23", ".", "!?", "é", "ß", "中", "́", " ", "\x85", "🙂", "<|endoftext|>", "<|", "|>", "İ", "’"]), min_size=60, max_size=400))
def test_stable_boundaries_hold_in_any_context(parts):
    text = "".join(parts)
    marks = [(a, b) for a, b in TOK.encode(text, add_special_tokens=False).offsets]
    starts = {a for a, _ in marks}
    special = [k + d for k in range(len(text)) if text.startswith("<|endoftext|>", k) for d in range(1, 13)]
    places = [p for p in range(1, len(text)) if token_counts.is_stable(text[p - 1], text[p]) and p not in special]
    assert set(places) <= starts
    for p in places[:: max(1, len(places) // 8)]:
        assert plain(text[:p]) + plain(text[p:]) == len(marks)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_are_encoded_whole(spark, small, name):
    path = public_tokenizers.path(name)
    assert token_counts.can_splice(PATH) and not token_counts.can_splice(path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(small, path, "doc_id", chunk=200, overlap=50).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = {k: len(model.encode(t)) for k, t in texts.items()}
    else:
        tok = Tokenizer.from_file(path)
        want = {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert got == want


def test_query_is_the_library_on_whole_texts(spark):
    from tremor.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n = plain(r["text"])
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len((r["text"] or "").encode()), n, n > 1024)
