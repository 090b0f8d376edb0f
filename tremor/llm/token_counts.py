"""Token counts of whole texts, huge ones by overlapping chunks.

A text of at most ``CHUNK`` characters is encoded as it is. A longer one is cut by Spark into chunks that overlap by
``OVERLAP`` characters, so that its chunks are encoded by many tasks. Two neighbours are spliced where both have a token
boundary at the same character of their overlap and the boundary is proven stable: the byte-level pattern ends a
word there whatever stands before or after (a letter before something that is no letter, a digit before no digit, a mark
before white space or a digit, or before a letter if the mark is no apostrophe), and it lies at least ``MARGIN`` characters from
both ends, so that a special string around it would be whole in both chunks. The pattern looks at most three
characters ahead and never back, so from a common stable boundary on both chunks give the tokens of the whole text.
Where the overlap holds no such place it is widened to the whole of both chunks: they are encoded again as one.
"""
from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tremor.llm.common import slices
from tremor.plans.loops import CutTable

CHUNK = 1 << 14
OVERLAP = 256
#: More than the longest special string and the characters the pattern looks ahead.
MARGIN = 16
#: Chunks are cut from pieces of so many chunks, so that cutting never walks over a huge text for each chunk.
PIECE = 64
SALTS = 16
_SLICE_CHARS = 1 << 20
SIDES = "key string, first int, last int, n bigint, head map<bigint,bigint>, tail map<bigint,bigint>"


@functools.cache
def _encoder(path: str):
    """Function from a list of texts to their (token count, offsets or none)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts, offsets=False: [(len(ids), None) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def encode(texts: list[str], offsets: bool = False) -> list[tuple]:
        if offsets:
            return [(len(e), e.offsets) for e in tok.encode_batch(texts, add_special_tokens=False)]
        return [(len(e), None) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    return encode


def can_splice(path: str) -> bool:
    """Is the file of the kind the stable boundaries are proven for? Texts of others are always encoded whole."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = all(not t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip", "normalized"))
    return (plain and all(len(t["content"]) <= MARGIN - 3 for t in spec["added_tokens"]) and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and model.get("type") == "BPE" and not model.get("dropout"))


@functools.lru_cache(1 << 16)
def _kind(char: str) -> str:
    """L letter, N number, S white space, P other mark; U where versions of Unicode disagree or none applies."""
    now, then = unicodedata.category(char), unicodedata.ucd_3_2_0.category(char)
    if char in " \t\n\r\v\f":
        return "S"
    if now != then:
        return "U"
    return {"L": "L", "N": "N", "Z": "S", "P": "P", "S": "P", "M": "P"}.get(now[0], "U")


def is_stable(before: str, after: str) -> bool:
    """Does the pattern end a word between the two characters, whatever stands around them?"""
    a, b = _kind(before), _kind(after)
    if "U" in (a, b) or a == "S":
        return False
    if a in "LN":
        return a != b
    return b in "SN" or (b == "L" and before != "'")


def sides(text: str, n: int, offsets: list[tuple[int, int]], start: int, overlap: int) -> tuple[dict, dict]:
    """Stable boundaries at both ends of a chunk that begins at character ``start`` of its text.

    ``{character: tokens before it}`` for those in the first ``overlap`` characters, ``{character: tokens from it on}``
    for those in the last.
    """
    head, tail = {}, {}
    for k, (at, _) in enumerate(offsets):
        if at > overlap - MARGIN:
            break
        if at >= MARGIN and offsets[k - 1][1] == at and is_stable(text[at - 1], text[at]):
            head[start + at] = k
    low = len(text) - overlap + MARGIN
    for k in range(n - 1, 0, -1):
        at = offsets[k][0]
        if at < low:
            break
        if at <= len(text) - MARGIN and offsets[k - 1][1] == at and is_stable(text[at - 1], text[at]):
            tail[start + at] = n - k
    return head, tail


def _counted(texts: DataFrame, path: str) -> DataFrame:
    """(row, text) to (row, n_tokens), each text encoded whole."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            found = batch.column(1).to_pylist()
            for i, j in slices(found, _SLICE_CHARS):
                counts = [n for n, _ in encode([t or "" for t in found[i:j]])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64())], names=["row", "n_tokens"])

    return texts.select("row", "text").mapInArrow(work, texts.select("row").schema.add("n_tokens", LongType()))


def _encoded(spans: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, first, last, part) to ``SIDES``: a span runs over the chunks ``first`` to ``last`` and the next overlap."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fields = _encoder(path), [pa.field("n", pa.int64()), *[pa.field(c, pa.map_(pa.int64(), pa.int64())) for c in ("head", "tail")]]
        for batch in batches:
            firsts, found = batch.column("first").to_pylist(), batch.column("part").to_pylist()
            for i, j in slices(found, _SLICE_CHARS):
                rows = []
                for first, text, (n, offsets) in zip(firsts[i:j], found[i:j], encode(found[i:j], True)):
                    head, tail = sides(text, n, offsets, first * chunk, overlap)
                    rows.append((n, list(head.items()), list(tail.items())))
                same = [batch.column(c).slice(i, j - i) for c in ("key", "first", "last")]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, f.type) for c, f in zip(zip(*rows), fields)]], names=["key", "first", "last", "n", "head", "tail"])

    return spans.select("key", "first", "last", "part").mapInArrow(work, SIDES)


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, first, last, part): the overlapping chunks of (key, text), dealt over all tasks."""
    def cuts(text: str, size: int, base: Column) -> Column:
        # a last piece that the overlap of the one before covers is left out
        last = F.greatest(F.ceil((F.length(text) - overlap) / size).cast("int") - 1, F.lit(0))
        return F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
            (base + k).alias("first"), F.substring(F.col(text), k * size + 1, F.lit(size + overlap)).alias("part"))))

    pieces = texts.select("key", cuts("text", PIECE * chunk, F.lit(0)).alias("p")).select("key", (F.col("p.first") * PIECE).alias("base"), F.col("p.part").alias("text"))
    parts = pieces.select("key", cuts("text", chunk, F.col("base")).alias("p")).select("key", "p.first", F.col("p.first").alias("last"), "p.part")
    return parts.repartition("key", "first")


def _seams(encoded: DataFrame) -> DataFrame:
    """(key, seam, cost): tokens that both neighbours of a seam count too many; null where they share no stable boundary."""
    none = F.lit(None).cast("map<bigint,bigint>")
    ends = encoded.select("key", F.col("first").alias("seam"), "head", none.alias("tail")).where("seam > 0").unionAll(
        encoded.select("key", (F.col("last") + 1).alias("seam"), none.alias("head"), "tail"))
    both = ends.groupBy("key", "seam").agg(F.first("head", ignorenulls=True).alias("head"), F.first("tail", ignorenulls=True).alias("tail"))
    common = F.array_min(F.array_intersect(F.map_keys("head"), F.map_keys("tail")))
    return both.where(F.col("head").isNotNull() & F.col("tail").isNotNull()).withColumn("at", common).select(
        "key", "seam", (F.element_at("head", F.col("at")) + F.element_at("tail", F.col("at"))).alias("cost"))


def _widened(encoded: DataFrame, failed: DataFrame, texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``encoded`` with the spans on both sides of each failed seam replaced by one span over them all."""
    order = Window.partitionBy("key").orderBy("first")
    marked = encoded.join(failed.select("key", F.col("seam").alias("first"), F.lit(0).alias("begins")), ["key", "first"], "left")
    island = F.sum(F.coalesce("begins", F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranges = marked.withColumn("island", island).groupBy("key", "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("spans"))
    joined = ranges.where("spans > 1")
    size = (F.col("last") - F.col("first") + 1) * chunk + overlap
    spans = joined.join(texts, "key").select("key", "first", "last", F.substring("text", F.col("first") * chunk + 1, size).alias("part"))
    kept = encoded.join(ranges.where("spans = 1").select("key", "first"), ["key", "first"], "left_semi")
    return kept.select(*encoded.columns).unionAll(_encoded(spans.repartition("key", "first"), path, chunk, overlap))


def spliced(texts: DataFrame, path: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, text), keys distinct, to (key, n_tokens), by chunks and their seams."""
    if not 2 * MARGIN < overlap < chunk:
        raise ValueError("the overlap has to be more than two margins and less than a chunk")
    encoded = CutTable(_encoded(_chunks(texts, chunk, overlap), path, chunk, overlap)).df
    seams = CutTable(_seams(encoded)).df
    failed = seams.where("cost IS NULL")
    if not failed.isEmpty():
        encoded = CutTable(_widened(encoded, failed, texts, path, chunk, overlap)).df
        seams = _seams(encoded)
    counts = encoded.select("key", "n").unionAll(seams.select("key", -F.col("cost")))
    return counts.groupBy("key").agg(F.sum("n").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, *keep: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` of each row, n_bytes (UTF-8) and n_tokens of its ``text``, as the library counts them.

    A null text counts as empty: no byte, no token. Every row of ``docs`` gives one row, equal ones too; an empty table
    gives none. Special strings inside a text are special tokens, as by the library's default. ``path`` is a
    ``.json`` file of tokenizers or a ``.model`` of sentencepiece; where the stable boundaries are not proven for
    it (``can_splice``), texts of any length are encoded whole. Equal long texts are encoded once.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).select(F.struct("row", "n_bytes").alias("row"), "text")
    out = [F.col("row.row.*"), F.col("row.n_bytes").alias("n_bytes"), F.col("n_tokens")]
    if not can_splice(path):
        return _counted(rows, path).select(*out)
    short = _counted(rows.where(F.length("text") <= chunk), path)
    long = rows.where(F.length("text") > chunk).withColumn("key", F.md5("text"))
    counts = spliced(long.select("key", "text").dropDuplicates(["key"]), path, chunk=chunk, overlap=overlap)
    # copies of one text may be a third of all rows
    salted = long.select("row", "key", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    counts = counts.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return short.unionByName(salted.join(counts, ["key", "salt"]).select("row", "n_tokens")).select(*out)
