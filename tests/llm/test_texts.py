"""Operators on texts against plain Python, and on the rows that must not break them."""
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremor.llm import decontaminate, gear_chunks, licenses, rule_ensemble, simhash, string_kernel, token_planes, winnow

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(TOKENIZER)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- language ---------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.col("doc_id") % 4 == 0)
    got = string_kernel.predict(docs, string_kernel.train(docs, ~F.col("held"), sample=512, landmarks=64), "lang", "held").where("held").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_rows(edge, empty):
    model = string_kernel.train(edge, F.lit(True))
    got = string_kernel.predict(edge, model, "doc_id", "text", "row").collect()
    assert len(got) == edge.count()
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in got)
    assert string_kernel.train(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in string_kernel.predict(edge, None, "doc_id").collect()} == {"und"}
    assert rows(string_kernel.predict(empty, model, "doc_id")) == []


def test_presence_counts_distinct_ngrams():
    spec = string_kernel.Spectrum(lengths=(1, 2), bits=18)
    assert len(spec.cells("abab")) == 4 and set(spec.cells("ab")) <= set(spec.cells("zab"))


def test_presence_runs_across_pieces(monkeypatch):
    whole = string_kernel.Spectrum().cells("abcdefgh" * 40)
    monkeypatch.setattr(string_kernel, "PIECE", 7)
    assert (string_kernel.Spectrum().cells("abcdefgh" * 40) == whole).all()


# --- near duplicates --------------------------------------------------------------------------

def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(docs, keepers=False):
    """(doc_id, fingerprint, smallest doc_id of the component) per row by comparing all pairs, -1 for null; or one id for each component."""
    fps = [slow_fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                parent[root(a)] = root(b)
    low = {}
    for k, (key, _) in enumerate(docs):
        if key is not None:
            low[root(k)] = min(low.get(root(k), key), key)
    if keepers:
        return sorted(low.get(r, -1) for r in {root(k) for k in range(len(docs))})
    return sorted(((key if key is not None else -1, f"{fps[k]:016x}", low.get(root(k), -1)) for k, (key, _) in enumerate(docs)))


def found_groups(df):
    return sorted((-1 if a is None else a, b, -1 if c is None else c) for a, b, c in rows(df))


def test_simhash_groups_match_all_pairs(edge, small, empty):
    for docs in (edge, small):
        assert found_groups(simhash.near_duplicates(docs)) == slow_groups(rows(docs.select("doc_id", "text")))
    assert rows(simhash.near_duplicates(empty)) == []


def test_simhash_keeps_one_row_of_each_group(edge, small):
    for docs in (edge, small):
        want = slow_groups(rows(docs.select("doc_id", "text")), keepers=True)
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(-1 if r[0] is None else r[0] for r in rows(kept)) == want


@pytest.mark.parametrize("parts", [2, 3, 5])
def test_links_are_complete_for_any_split(spark, parts):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 3), dtype=np.uint64), axis=1) for c in centre]))
    bits = simhash._group_bits(fps, parts)
    thresholds = {2: [1, 2], 3: [1, 1, 0], 5: [0] * 5}[parts]
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint"), [simhash.Part(b, t) for b, t in zip(bits, thresholds)], block=16)
    joined = {int(x): int(x) for x in fps.view(np.int64)}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in rows(found):
        joined[root(a)] = root(b)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    signed = fps.view(np.int64)
    assert all(root(int(signed[a])) == root(int(signed[b])) for a, b in near)
    pairs = {}
    for a, b in near:
        pairs.setdefault(int(signed[a]), set()).add(int(signed[b]))
    seen, groups = set(), 0
    for x in pairs:
        if x not in seen:
            groups, stack = groups + 1, [x]
            while stack:
                y = stack.pop()
                if y not in seen:
                    seen.add(y)
                    stack += pairs[y]
    assert len({root(int(x)) for x in signed}) == groups


def test_plan_covers_the_distance():
    sample = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for total in (10, 10**5, 10**10):
        chosen = simhash.plan(sample, total)
        assert sum(p.threshold + 1 for p in chosen) == 5
        assert len({b for p in chosen for b in p.bits}) == sum(len(p.bits) for p in chosen)
    assert sum(p.threshold + 1 for p in simhash.plan(np.zeros(1, np.uint64), 1)) == 5


# --- test items -------------------------------------------------------------------------------

ITEMS = [(1, "What colour is the clear sky at noon in summer?\nIt is a deep and even blue all over."), (2, None), (3, ""), (4, "short one"),
         (5, "One two three four five six seven eight nine ten eleven twelve.")]


def test_decontaminate(spark, edge, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    filler = "some other words that stand around the passage here " * 9
    docs = spark.createDataFrame([
        (1, filler + ITEMS[0][1].upper() + " " + filler, 0), (2, filler, 0), (3, filler + ITEMS[0][1].split("\n")[0], 0), (4, ITEMS[4][1], 0), (5, None, 0),
        (6, filler + "a short one here", 0), (1, filler, 0), (7, ITEMS[4][1], 0), (7, ITEMS[4][1], 0)], "doc_id bigint, text string, item_id int")
    got = rows(decontaminate.contaminated(docs, items).select("doc_id", "item_id"))
    assert sorted(got) == [(1, 1), (4, 5), (6, 4), (7, 5), (7, 5)]
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r[0] for r in rows(kept)) == [1, 2, 3, 5]
    assert rows(decontaminate.contaminated(edge, items)) == [] and rows(decontaminate.contaminated(empty, items)) == []
    assert decontaminate.remove_contaminated(docs, items.where("false")).count() == docs.count()


def test_wand_returns_all_above_the_threshold(spark):
    items = rows(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text"))
    texts = [decontaminate.words_of(r[0]) for r in rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(150))]
    index = decontaminate.Index(items).set_threshold(0.3)
    got, span = index.search(texts, 0.3), index.bins * decontaminate.STRIDE
    for words, found in zip(texts, got):
        want = {}
        for s in range(0, max(1, len(words)), decontaminate.STRIDE):
            score = {}
            for t in {index.terms[w] for w in words[s:s + span] if w in index.terms}:
                for i, x in zip(index.items[t], index.impacts[t]):
                    score[i] = score.get(i, 0) + x
            for i, x in score.items():
                if x >= 0.3:
                    want[i] = max(want.get(i, 0), x)
        assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want)


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole = sorted(rows(decontaminate.contaminated(docs, items).select("doc_id", "item_id")))
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 3000)
    assert sorted(rows(decontaminate.contaminated(docs, items).select("doc_id", "item_id"))) == whole != []


# --- lines and substrings ---------------------------------------------------------------------

def slow_lines(docs, window=3):
    seen, out = {}, {}
    for key, text in sorted(docs):
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x]
        gone = set()
        for s in range(len(at) - window + 1):
            run = tuple(lines[k] for k in at[s:s + window])
            if run in seen:
                gone |= set(at[s:s + window])
            else:
                seen[run] = key
        out[key] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_winnow(spark, edge, empty):
    docs = [(1, "a\nb\n\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\na\na\na\na"), (4, "c\nd"), (5, "p\na\nb\nc\nd\nq"), (6, "b\nc\nd"), (7, ""), (8, "\n\n\n")]
    got = winnow.drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == slow_lines(docs)
    out = winnow.drop_repeated_lines(edge.drop("lines"))
    assert out.columns == [*edge.drop("lines").columns, "n_lines", "removed_lines"]
    assert sorted(map(str, rows(out.select(edge.drop("lines").columns)))) == sorted(map(str, rows(edge.drop("lines"))))
    assert rows(winnow.drop_repeated_lines(empty)) == []
    twice = spark.createDataFrame([(None, "a\nb\nc"), (9, "a\nb\nc"), (9, "a\nb\nc")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in winnow.drop_repeated_lines(twice).collect()) == ["", "a\nb\nc", "a\nb\nc"]


def slow_spans(docs):
    seen, out = {}, []
    for key, text in sorted(docs):
        raw, mine = text.encode(), []
        for a, b in zip(*(x.tolist() for x in gear_chunks.chunk_spans(np.frombuffer(raw, np.uint8)))):
            if raw[a:b] in seen:
                mine.append((a, b, seen[raw[a:b]]))
            else:
                seen[raw[a:b]] = key
        for a, b, first in mine:
            if out and out[-1][0] == key and a <= out[-1][2]:
                out[-1] = (key, out[-1][1], max(out[-1][2], b), min(out[-1][3], first))
            else:
                out.append((key, a, b, first))
    size = {key: len(text.encode()) for key, text in docs}
    return [r for r in out if r[2] - r[1] >= gear_chunks.LEAST_RANGE or (r[1] == 0 and r[2] == size[r[0]] and r[2] < gear_chunks.LEAST + 1)]


def test_chunks_find_repeats_and_resist_shifts(spark, small, edge, empty):
    docs = rows(small.select("doc_id", "text"))
    assert sorted(rows(gear_chunks.repeated_spans(small).select("doc_id", "start", "end", "first_doc_id"))) == sorted(slow_spans(docs))
    rng = np.random.default_rng(1)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    passage = say(60)
    two = [(1, say(200) + " " + passage + " " + say(50)), (2, "é" + say(33) + " " + passage + " " + say(90))]
    frame = spark.createDataFrame(two, "doc_id bigint, text string")
    spans = gear_chunks.repeated_spans(frame)
    (key, start, end, first), = rows(spans.select("doc_id", "start", "end", "first_doc_id"))
    assert (key, first) == (2, 1) and two[1][1].encode()[start:end].decode() in passage and end - start > len(passage) // 2
    kept = {r["doc_id"]: r["text"] for r in gear_chunks.without_repeats(frame, spans).collect()}
    assert kept[1] == two[0][1] and len(kept[2].encode()) == len(two[1][1].encode()) - (end - start)
    assert rows(gear_chunks.repeated_spans(empty)) == []
    found = rows(gear_chunks.repeated_spans(edge.where("length(text) < 100")).select("doc_id", "first_doc_id"))
    assert found == [(2, 1)]
    assert gear_chunks.without_repeats(edge, gear_chunks.repeated_spans(edge)).columns == edge.columns


def test_cuts_fall_between_characters_and_bound_gaps():
    raw = np.frombuffer(("é漢😀" * 4000).encode(), np.uint8)
    at = gear_chunks.cuts(raw)
    assert at[0] == 0 and at[-1] == len(raw) and (np.diff(at) <= gear_chunks.LONGEST_GAP + 3).all()
    b"".join(bytes(raw[a:b]) for a, b in zip(at, at[1:])).decode()
    assert all(bytes(raw[a:b]).decode() for a, b in zip(at, at[1:]))


# --- licences ---------------------------------------------------------------------------------

def test_licences(spark, edge, empty):
    known = licenses.SENTENCES
    bsd = ". ".join(known[k] for k in ("bsd-terms", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"))
    docs = spark.createDataFrame([(1, bsd), (2, "Hi.\nReleased under the MIT License.\nLicensed under  CC BY-NC 4.0."), (3, "bsd and mit"), (4, None), (5, ""),
                                  (6, known["mit-grant"]), (7, known["mit-grant"] + "! Some words. " + known["mit-as-is"])], "doc_id bigint, text string")
    got = sorted(rows(licenses.scan(docs).select("doc_id", "match_no", "license", "n_sentences")))
    assert got == [(1, 1, "BSD-3-Clause", 5), (2, 1, "MIT", 1), (2, 2, "CC-BY-NC-4.0", 1), (7, 1, "MIT", 2)]
    assert rows(licenses.scan(edge)) == [] and rows(licenses.scan(empty)) == []


def test_licence_tables_agree():
    assert all(any(h in s for h in licenses.HINTS) or "cc" in s or "public domain" in s for s in licenses.SENTENCES.values())
    assert all(licenses.normal(s) == s for s in licenses.SENTENCES.values())
    assert {k for _, _, ids in licenses.RULES for k in ids} == set(licenses.SENTENCES)


# --- tokens -----------------------------------------------------------------------------------

@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_tokens_round_trip(spark, edge, small, planes):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    for docs in (edge, small):
        source = sorted(rows(docs.select("doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0))
        got = sorted(rows(token_planes.encode_and_read(docs, TOKENIZER, planes=planes, block_ids=1000)), key=lambda r: r[1])
        assert [r[0] for r in got] == [r[0] for r in source]
        at, want = 0, {}
        for key, text in source:
            ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
            want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        for key, start, n, crc in got:
            assert start == at and (n, crc) in want[key]
            at += n


def test_tokens_of_nothing(spark, empty):
    assert rows(token_planes.encode_and_read(empty, TOKENIZER)) == []


@pytest.mark.parametrize("text", ["", "A b\u0085c", "x <|endoftext|> y<|ENDOFTEXT|>z", "ΟΔΟΣ, ΟΔΟΣ", "é ́e J̌, J̌", "don't I'LL 's, 't.", "abc1, x2.", "日本語、テスト。", "a\x0bb\x1cc", " İstanbul ", "ﬁ, ß ẞ.",
                                  "EVİ.", "ERDALİ.", "İ!", "the end İ, next", "e\u0301. E\u0301, \u0301. x\u0307!", "é<|ENDOFTEXT|>x", "<|endoftext|>. <|x.", "слово. Слово, ǅ. ꟸ. 𝒳."])
def test_words_of_their_own_have_the_same_ids(text):
    from tokenizers import Tokenizer

    assert np.frombuffer(token_planes.text_ids(TOKENIZER, text), "<u4").tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


@settings(max_examples=int(os.environ.get("TREMOR_EXAMPLES", 1500)), deadline=None)
@given(st.lists(st.sampled_from([*"aBé ßİıſΣσςÅﬁЖж中1٣,.!?:;()#$%&*'’-_ \n\t\r\x0b\x1c\x85\u0301\u0307\u0345\u00a0\u2028\u212a\u1e9e\u0149🙂", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "word", "Word."]), max_size=40))
def test_any_words_have_the_ids_of_the_whole_text(parts):
    text = "".join(parts)
    assert np.frombuffer(token_planes.text_ids(TOKENIZER, text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "  Don't split  THIS, İ. \n\n or that "
    assert token_planes.by_words(TOKENIZER) and not token_planes.by_words(path)
    assert np.frombuffer(token_planes.text_ids(path, text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(token_planes, "_SLICE_CHARS", 50)
    line = "Don't stop. L'été «où» 12½ ×3 it's 're <|endoftext|> 日本語 Ωmega naïve’s end!!\n"
    for text in (line * 40, line.replace(" ", "_") * 40, "x" * 120, ""):
        assert np.frombuffer(token_planes.text_ids(TOKENIZER, text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_full_memories_are_emptied(monkeypatch):
    monkeypatch.setattr(token_planes, "WORD_MEMORY", 20)
    words, texts = token_planes._Words(TOKENIZER), [" ".join(f"Wörd{chr(97 + k % 26)}{'x' * (k % 7)}. tail" for k in range(j, j + 30)) for j in range(0, 90, 10)]
    for k in range(0, 9, 3):
        got = words.ids(texts[k:k + 3])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts[k:k + 3]]
        assert len(words.whole) < 150


@pytest.mark.parametrize("width", [1, 8])
@pytest.mark.parametrize("n", [1, 7, 8, 1003])
def test_planes_round_trip(width, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_planes.from_planes(token_planes.to_planes(ids, width), n, width) == ids).all()


# --- quality ----------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.col("doc_id") % 5 == 0
    got = rule_ensemble.score(docs, labels, ~held, "doc_id").join(labels, "doc_id").where(held & F.col("quality").isNotNull()).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


def test_quality_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    assert rule_ensemble.score(edge, labels, F.lit(True), "doc_id", "row").count() == edge.count()
    assert {r["score"] for r in rule_ensemble.score(edge, labels.where("false"), F.lit(True), "doc_id").collect()} == {0.5}
    assert {r["predicted"] for r in rule_ensemble.score(edge, labels.where("quality = 1"), F.lit(True), "doc_id").collect()} == {1}
    assert rows(rule_ensemble.score(empty, labels, F.lit(True), "doc_id")) == []
