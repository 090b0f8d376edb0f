"""Registered queries of the package: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import (decontaminate, gear_chunks, lexical_search, licenses, mixing, period_runs, projection_forest, rule_ensemble, simhash, string_kernel, token_counts,
                        token_planes, winnow)
from tremor.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    return string_kernel.predict(docs, string_kernel.train(docs, ~F.col("held_out")), "doc_id", "held_out")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


@query
def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    return rule_ensemble.score(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0, "doc_id", "held_out")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "removed_lines")


ORACLES["op4_winnow"] = winnow.ORACLE


@query
def op6_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_chunks.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "first_doc_id")


@query
def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op8_licenses"] = licenses.oracle()


@query
def op8_licenses_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), joined=True)


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "doc_id")
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in documents whose crc32(doc_id) ends in 0, the words from one place on repeat with a fixed period.

    ``text`` keeps its words in order; rows with a null ``doc_id`` stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.where(h % 10 == 0).select("doc_id", F.expr(r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')").alias("w"), F.floor(h / 10).alias("g"), F.size("w").alias("n"))
    placed = words.withColumn("a", F.col("g") % F.greatest("n", F.lit(1))).withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p"))
    again = F.expr("concat(slice(w, 1, int(a)), flatten(array_repeat(slice(w, int(a) + 1, int(p)), int(times))))")
    changed = placed.withColumn("times", times).select("doc_id", F.when(F.col("n") > 0, F.array_join(F.slice(again, F.lit(1), F.col("n")), " ")).alias("text"))
    return docs.where((h % 10 != 0) | h.isNull()).select("doc_id", "text").unionAll(changed)


@query
def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.collapse_runs(with_repeats(table(spark, sf_dir, "documents")), "doc_id")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", period_runs.strongest("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = lexical_search.ORACLE
