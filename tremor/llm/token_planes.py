"""Token ids stored as compressed byte or bit planes.

Documents are put in ascending ``doc_id`` order by range partitions. Each partition encodes its texts, cuts its
stream of ids into blocks of a fixed number of ids, transposes each block into planes (plane k holds byte or bit
k of every id) and compresses each plane with zstandard; a plane of zeros takes no bytes. The chunk index stands
beside the payload: partition, block, first id, number of ids, and the pieces of documents a block holds. Blocks are
rows of a Parquet table, so that any store Spark writes to can hold them, Spark's commit protocol guards against lost
executors, and a reader opens only the blocks it needs.
"""
from __future__ import annotations

import functools
import gc
import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.common import slices
from tremor.session import shared_folder

END_ID = 2
BLOCK_IDS = 1 << 16
#: Pieces of text kept with their ids per Python worker.
WORD_MEMORY = 600_000
_SLICE_CHARS = 1 << 20

BLOCKS = ("part int, block int, first long, n int, width int, planes array<binary>, "
          "piece_doc array<bigint>, piece_start array<bigint>, piece_first array<int>, piece_n array<int>")
PIECES = "part int, doc_start bigint, doc_id bigint, at bigint, n int, crc bigint"


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The pattern that splits texts where words are encoded on their own; a file with another one has its texts encoded whole.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def by_words(path: str) -> bool:
    """Does the file drop white space and never join characters across it, so that words may be encoded one by one?"""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = all(not t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip", "normalized"))
    return (plain and steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [p["type"] for p in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": _SPLIT}
            and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
            and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>" and not spec["model"]["dropout"]
            and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec["added_tokens"]))


_WHITE, _LETTER, _DIGIT, _MARK, _ODD, _STAND_IN = range(6)
#: What an odd word is replaced by while its slice is cut; itself no character of an even word.
_PLACE = "\x01"
_EVEN_WORD = re.compile("[!-~\xa1-\u023f]*")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte of lower-cased even text, and of the characters whose first byte is 0xC2."""
    each, after = np.full(256, _ODD, np.uint8), np.full(256, _ODD, np.uint8)
    each[list(b" \t\n\r")] = _WHITE
    each[ord(_PLACE)] = _STAND_IN
    kinds = {"L": _LETTER, "N": _DIGIT}
    for c in range(0x21, 0x7F):
        each[c] = kinds.get(unicodedata.category(chr(c))[0], _MARK)
    for c in range(0xA1, 0xC0):
        after[c] = kinds.get(unicodedata.category(chr(c))[0], _MARK)
    each[0x80:0xC0] = each[0xC2:0xC9] = _LETTER  # U+00C0 to U+023F are letters but for two signs
    return each, after


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level tokenizers: itself if printable, else the next from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}}


_CLASS, _CLASS_C2 = _classes()
_BYTE_LETTERS = _byte_letters()


def _cut(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(classes, starts) of the bytes of lower-cased text with two line ends after it: where does a piece of the pattern begin?"""
    raw = np.frombuffer(text, np.uint8)
    kind = _CLASS[raw]
    two = np.flatnonzero(raw == 0xC2)
    kind[two] = kind[two + 1] = _CLASS_C2[raw[two + 1]]
    signs = np.flatnonzero(raw == 0xC3)
    signs = signs[(raw[signs + 1] == 0x97) | (raw[signs + 1] == 0xB7)]
    kind[signs] = kind[signs + 1] = _MARK
    starts = np.empty(len(raw), bool)
    starts[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    digits = np.flatnonzero(kind == _DIGIT)
    starts[digits[(raw[digits] < 0x80) | (raw[digits] >= 0xC0)]] = True
    # 's 't 'm 'd 're 've 'll are pieces where the apostrophe begins one
    marks = np.flatnonzero(raw == ord("'"))
    if len(marks):
        marks = marks[starts[marks]]
        one, other = raw[marks + 1], raw[marks + 2]
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (other == ord("e")) | (one == ord("l")) & (other == ord("l"))
        for found, size in ((marks[short], 2), (marks[long], 3)):
            starts[found + 1] = False
            starts[found + size] = True
    starts &= kind != _WHITE
    return kind, starts


class _Pieces(dict):
    """Number of each piece of text seen by one Python worker; ids of piece k are ``pool[ends[k]:ends[k + 1]]``."""

    def __init__(self, path: str):
        self.encode, self.tokenize = _tokenizer(path).encode, _tokenizer(path).model.tokenize
        self.pool, self.ends = array("I", [0]), array("q", [1])

    def __missing__(self, key: bytes) -> int:
        if key[0] == ord(_PLACE):
            ids = self.encode(key[1:].decode(), add_special_tokens=False).ids
        else:
            piece = key.decode() if key.isascii() else key.decode("latin-1").translate(_BYTE_LETTERS)
            ids = [t.id for t in self.tokenize(piece)]
        self.pool.extend(ids)
        self.ends.append(len(self.pool))
        self[key] = number = len(self)
        return number


class _Words:
    """Ids of texts, with each distinct piece of text encoded once and kept by one Python worker.

    The lower-cased texts of a slice are cut into the pieces of the tokenizer's pattern as bytes, all at once. Only
    even words are cut: those of printable ASCII, Latin-1 and Latin Extended-A/B, which Unicode composition leaves as
    they are. A word with any other character, or with the signs of a special token, is encoded whole by the library.
    The memory is emptied when full.
    """

    def __init__(self, path: str):
        self.path = path
        self.whole = _Pieces(path)

    def ids(self, texts: list[str]) -> list[bytes]:
        if not by_words(self.path):
            return [array("I", e.ids).tobytes() for e in _tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.whole) > WORD_MEMORY:
            self.whole = _Pieces(self.path)
        lows, odd = [t.lower().encode() for t in texts], []
        joined = b"\n".join(lows) + b"\n\n"
        kind, starts = _cut(joined)
        if _PLACE.encode() in joined or b"<|" in joined or (kind == _ODD).any():
            lows = [_without_odd(t, odd).lower().encode() for t in texts]
            joined = b"\n".join(lows) + b"\n\n"
            kind, starts = _cut(joined)
        at = np.flatnonzero(starts[1:] & (kind[:-1] != _WHITE)) + 1
        found = np.insert(np.frombuffer(joined, np.uint8), at, ord(" ")).tobytes().split()
        if odd:
            words = iter(odd)
            found = [next(words) if x == _PLACE.encode() else x for x in found]
        numbers = np.fromiter(map(self.whole.__getitem__, found), np.int64, len(found))
        pool, ends = np.frombuffer(self.whole.pool, "<u4"), np.frombuffer(self.whole.ends, np.int64)
        each = ends[numbers + 1] - ends[numbers]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(ends[numbers] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
        del pool, ends
        sizes = np.cumsum([0] + [len(x) + 1 for x in lows])
        before = np.concatenate([[0], np.cumsum(starts)])[sizes]
        cuts = (4 * upto[before]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _without_odd(text: str, odd: list[bytes]) -> str:
    """The words of a text, with a stand-in for each word that is not even; those are added to ``odd``."""
    words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    for k, word in enumerate(words):
        if "<|" in word or not _EVEN_WORD.fullmatch(word.lower()):
            odd.append((_PLACE + word).encode())
            words[k] = _PLACE
    return " ".join(words)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of bounded size, cut at spaces."""
    at = 0
    while len(text) - at > _SLICE_CHARS and (cut := text.find(" ", at + _SLICE_CHARS)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


_WORKER: dict[str, _Words] = {}


def texts_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without special tokens around it."""
    if path not in _WORKER:
        _WORKER[path] = _Words(path)
    # a slice makes very many small objects and no cycles
    gc.disable()
    try:
        if by_words(path) and any(len(t or "") > _SLICE_CHARS for t in texts):
            return [b"".join(_WORKER[path].ids([part])[0] for part in _parts(t or "")) for t in texts]
        return _WORKER[path].ids([t or "" for t in texts])
    finally:
        gc.enable()


def text_ids(path: str, text: str | None) -> bytes:
    return texts_ids(path, [text])[0]


def to_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """Planes of one block: 4 byte planes (``width`` 8) or 32 bit planes (``width`` 1), compressed."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if width == 1:
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, bitorder="little")
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(plane.tobytes()) if plane.any() else b"" for plane in raw.T]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    size = n if width == 8 else (n + 7) // 8
    raw = np.zeros((len(planes), size), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            raw[k] = np.frombuffer(unpack.decompress(plane, max_output_size=size), np.uint8)
    if width == 1:
        bits = np.unpackbits(raw, axis=1, count=n, bitorder="little")
        raw = np.packbits(bits, axis=0, bitorder="little")
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


class _BlockWriter:
    """Cuts the id stream of one partition into blocks; holds one open block."""

    def __init__(self, part: int, block_ids: int, width: int):
        self.part, self.block_ids, self.width = part, block_ids, width
        self.first = self.block = self.held = 0
        self.open: list[bytes] = []
        self.pieces: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        start, at, n = self.first + self.held, 0, len(ids) // 4
        while at < n:
            take = min(n - at, self.block_ids - self.held)
            self.open.append(ids[4 * at:4 * (at + take)])
            self.pieces.append((doc_id, start, at, take))
            self.held += take
            at += take
            if self.held == self.block_ids:
                yield self.close()

    def close(self) -> tuple:
        ids = np.frombuffer(b"".join(self.open), "<u4")
        docs, starts, firsts, counts = zip(*self.pieces)
        row = (self.part, self.block, self.first, self.held, self.width, to_planes(ids, self.width),
               list(docs), list(starts), list(firsts), list(counts))
        self.first += self.held
        self.block += 1
        self.held, self.open, self.pieces = 0, [], []
        return row


_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()),
                pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
_BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK_TYPES)], names=_BLOCK_NAMES)


def write_tokens(docs: DataFrame, tokenizer: str, out: str, *, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
                 planes: str = "byte") -> None:
    """Encode every text and write the block table to ``out``.

    Null texts count as empty, so each document has at least the end id. Rows with equal ``doc_id`` follow one
    another in order of their texts; rows with a null ``doc_id`` come first. Columns other than ``doc_id`` and
    ``text`` are not read. An empty table writes no block.
    """
    if planes not in ("byte", "bit"):
        raise ValueError("planes must be 'byte' or 'bit'")
    width, end = (8 if planes == "byte" else 1), array("I", [end_id]).tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _BlockWriter(TaskContext.get().partitionId(), block_ids, width)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts, _SLICE_CHARS):
                for key, ids in zip(keys[i:j], texts_ids(tokenizer, texts[i:j])):
                    for row in writer.add(key, ids + end):
                        yield _batch([row])
        if writer.held:
            yield _batch([writer.close()])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(out)


def _bases(blocks: DataFrame) -> DataFrame:
    """First global position of each partition's stream: one row per partition, so the window is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.groupBy("part").agg(F.sum("n").alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))


def _pieces(blocks: DataFrame) -> DataFrame:
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n"], row["width"]).tobytes()
                counts = np.array(row["piece_n"], np.int64)
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(crcs), pa.int32()), pa.array(row["piece_start"], pa.int64()),
                    pa.array(row["piece_doc"], pa.int64()), pa.array(row["piece_first"], pa.int64()),
                    pa.array(row["piece_n"], pa.int32()), pa.array(crcs, pa.int64())], names=[c.split()[0] for c in PIECES.split(", ")])

    return blocks.mapInArrow(decode, PIECES)


def _joined_crc(pieces: list[dict]) -> int:
    """crc32 of a document from those of its pieces: crc(A+B) = crc(B) xor the effect of A over len(B) zero bytes."""
    crc = 0
    for p in pieces:
        zeros = bytes(4 * p["n"])
        crc = p["crc"] ^ zlib.crc32(zeros, crc) ^ zlib.crc32(zeros, 0)
    return crc


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files alone."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    joined = _pieces(blocks).groupBy("part", "doc_start").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [p[0]["crc"] if len(p) == 1 else _joined_crc(p) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_start"), batch.column("doc_id"),
                                              batch.column("n_tokens"), pa.array(crcs, pa.int64())],
                                             names=["part", "doc_start", "doc_id", "n_tokens", "ids_crc32"])

    done = joined.mapInArrow(finish, "part int, doc_start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return done.join(_bases(blocks.select("part", "n")), "part").select(
        "doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, first, ids) per block, decoded: the stream of ids itself."""
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n"], row["width"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["first"]], pa.int64()),
                                                  pa.array([ids], pa.list_(pa.int64()))], names=["part", "first", "ids"])

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(decode, "part int, first bigint, ids array<bigint>")


def encode_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the blocks to a new table in the shared folder and return what its files hold per document."""
    spark = docs.sparkSession
    out = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, out, **options)
    return read_documents(spark, out)
