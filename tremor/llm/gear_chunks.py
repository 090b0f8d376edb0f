"""Substring dedup by content-defined chunking with a gear rolling hash.

A place in a text is a cut where the gear hash of the 16 bytes before it falls below a limit, so cuts depend on the
bytes around them alone and an insertion moves only the cuts beside it. From each cut a chunk runs to the first cut
at least ``least`` bytes on; chunks of different starts overlap, so that no chunk depends on where an earlier one
ended, and a repeated passage yields the same chunks in every text soon after it begins. Of the chunks with one
128-bit digest the first (by document, then place) stays; the others mark their bytes as repeated.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import unused
from tremor.plans.loops import CutTable

#: Mean bytes between cuts, least bytes of a chunk, and bytes after which a cut is made where the text has none.
SPACING, LEAST, LONGEST_GAP = 28, 64, 256
#: Least bytes of a repeated range: about twenty words. Shorter ones are single lines of boilerplate or chance.
LEAST_RANGE = 128
#: One random 16-bit number for each byte, made from a seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
_PIECE = 1 << 22


def cuts(raw: np.ndarray, spacing: int = SPACING, longest_gap: int = LONGEST_GAP) -> np.ndarray:
    """Ascending cuts of a text's UTF-8 bytes, 0 and the length among them, none within a character."""
    n, found = len(raw), [np.zeros(1, np.int64)]
    for a in range(0, n, _PIECE):
        begin = max(0, a - 15)
        h = GEAR[raw[begin:a + _PIECE]]
        for k in (1, 2, 4, 8):  # afterwards h[i] = sum of gear(byte i - j) << j for j < 16
            h[k:] = h[k:] + (h[:-k] << np.uint16(k))
        at = np.flatnonzero(h[a - begin:] < (1 << 16) // spacing) + a + 1
        found.append(at[at >= 16])
    start = np.concatenate(found)
    start = start[start < n]
    gap = np.diff(np.r_[start, n])
    if (gap > longest_gap).any():
        extra = [np.arange(s + longest_gap, s + g, longest_gap) for s, g in zip(start[gap > longest_gap], gap[gap > longest_gap])]
        start = np.sort(np.concatenate([start, *extra]))
    inside = (raw[start] & 0xC0) == 0x80
    while inside.any():  # forward to where a character begins; at most three steps
        start[inside] += 1
        start = start[start < n]
        inside = (raw[start] & 0xC0) == 0x80
    return np.unique(np.r_[start, n]) if n else np.zeros(1, np.int64)


def chunk_spans(raw: np.ndarray, least: int = LEAST, **options) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks; the rest of a text after the last full chunk makes none of its own.

    A text shorter than ``least`` is one chunk (an empty one has none).
    """
    at = cuts(raw, **options)
    if len(raw) < least:
        return (at[:1], at[-1:]) if len(raw) else (at[:0], at[:0])
    end = np.searchsorted(at, at + least)
    full = end < len(at)
    return at[full], at[end[full]]


def chunks(docs: DataFrame, least: int = LEAST, places: bool = True) -> DataFrame:
    """(d1, d2) per chunk and, with ``places``, (doc_id, row_hash, start, end) in UTF-8 bytes and whether it is the whole text."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, row, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                body = (text or "").encode("utf-8", "replace")
                start, end = chunk_spans(np.frombuffer(body, np.uint8), least)
                if not len(start):
                    continue
                raw = b"".join([xxhash.xxh3_128_digest(body[i:j]) for i, j in zip(start.tolist(), end.tolist())])
                digest = np.frombuffer(raw, "<i8").reshape(-1, 2)
                arrays = [pa.array(digest[:, 0]), pa.array(digest[:, 1])]
                if places:
                    arrays += [pa.array([key] * len(start), pa.int64()), pa.array([row] * len(start), pa.int64()), pa.array(start), pa.array(end),
                               pa.array((start == 0) & (end == len(body)))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "d1 bigint, d2 bigint" + (", doc_id bigint, row_hash bigint, start bigint, end bigint, whole boolean" if places else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"),
                       F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def repeated_spans(docs: DataFrame, least: int = LEAST, least_range: int = LEAST_RANGE) -> DataFrame:
    """(doc_id, row_hash, start, end, first_doc_id): byte ranges that repeat an earlier text, touching ones united.

    ``first_doc_id`` is the smallest document that first held a part of the range. Documents are ordered by
    ``doc_id``, null last, then by hash of the text; rows equal in both are one document. Null and empty texts and
    texts without a repeated chunk give no row; ranges below ``least_range`` bytes are left alone, but for texts that
    are repeated whole. Digests are counted first, so that only repeated ones are joined.
    """
    twice = CutTable(chunks(docs, least, places=False).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")).df
    found = CutTable(chunks(docs, least).join(twice, ["d1", "d2"])).df
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash", "start")
    first = CutTable(found.groupBy("d1", "d2").agg(F.min(order).alias("low"))).df
    later = found.join(first, ["d1", "d2"]).where(order != F.col("low")).select("doc_id", "row_hash", "start", "end", "whole", F.col("low.doc_id").alias("first_doc_id"))
    per = later.groupBy("doc_id", "row_hash", "start").agg(F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"), F.bool_or("whole").alias("whole"))
    own = Window.partitionBy("doc_id", "row_hash").orderBy("start")
    upto = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum((F.col("start") > F.coalesce("upto", F.lit(-1))).cast("int")).over(own)
    runs = per.withColumn("upto", upto).withColumn("run", run)
    ranges = runs.groupBy("doc_id", "row_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"),
                                                           F.bool_or("whole").alias("whole"))
    return ranges.where((F.col("end") - F.col("start") >= least_range) | F.col("whole")).drop("run", "whole")


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the ranges taken out of their texts; all rows and columns stay."""
    own, key, digest, ranges = (unused(docs, c) for c in ("_own_hash", "_cut_id", "_cut_hash", "_cut_ranges"))
    cut = spans.groupBy(F.col("doc_id").alias(key), F.col("row_hash").alias(digest)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(ranges))
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    both = marked.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)), "left")

    @F.pandas_udf("string")
    def taken_out(text, spans_):
        out = []
        for t, s in zip(text, spans_):
            if t is not None and s is not None:
                body, at, kept = t.encode("utf-8", "replace"), 0, []
                for x in s:
                    kept.append(body[at:x["start"]])
                    at = x["end"]
                t = b"".join([*kept, body[at:]]).decode()
            out.append(t)
        return type(text)(out)

    text = F.when(F.col(ranges).isNull(), F.col("text")).otherwise(taken_out("text", ranges))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
