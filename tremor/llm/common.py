"""Shared pieces of the operators: table access, deterministic fold columns, bounded text slices."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\r\v\f"
#: A-Z only: other letters keep their case, as the word rules of the operators say.
LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(frame: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``frame`` has such a column."""
    while name.lower() in {c.lower() for c in frame.columns}:
        name = "_" + name
    return name


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(-1))


def n_words(text: str) -> Column:
    """Number of maximal runs of characters other than the six ASCII white-space characters; null counts 0.

    Runs are counted, so the text is never split into an array.
    """
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def slices(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` characters together (one row at least)."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > limit:
            yield first, k
            first, held = k, 0
        held += size
    if first < len(texts):
        yield first, len(texts)
