"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is the sequence of its non-empty lines. Every window of ``window`` lines selects its smallest line hash
(the last of equal ones) as a fingerprint, so any two equal runs of that length share one. Fingerprints that occur
once are left behind; the places of the others are joined, and each is extended both ways: all windows around it are
compared with the first window of equal lines. Windows that are not the first are repeated, overlapping ones unite
to whole runs, and the lines of repeated runs are deleted.

As each place is joined with the first of its kind alone, a line that a third of all documents hold costs no more
than any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import unused
from tremor.plans.loops import CutTable

WINDOW = 3


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row_hash, w) per window: the place it selects, the numbers of its lines and the digest of them.

    Each array that a lambda looks into is a column of an earlier projection, used twice in the next, so that Spark
    computes it once for a document and not again for every element.
    """
    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    filled = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"),
        F.filter(lines, lambda s: s["line"] != "").alias("lines"))
    hashed = filled.select("doc_id", "row_hash", "lines", F.transform("lines", lambda s, i: F.struct(F.xxhash64(s["line"]).alias("value"), (-i).alias("back"))).alias("hashed"))
    n = F.least(F.size("lines"), F.size("hashed"))
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<int>"))
    own = lambda c, s: F.slice(c, s, F.lit(window))
    return hashed.select("doc_id", "row_hash", F.explode(F.transform(starts, lambda s: F.struct(
        F.array_min(own("hashed", s)).alias("pick"), F.transform(own("lines", s), lambda x: x["no"]).alias("nos"),
        F.md5(F.array_join(F.transform(own("lines", s), lambda x: x["line"]), "\n")).alias("key")))).alias("w"))


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row_hash, lines): for each document with repeated runs, the numbers of their lines from 0."""
    places = CutTable(_windows(docs, window).select("doc_id", "row_hash", F.col("w.pick.value").alias("value"), (-F.col("w.pick.back")).alias("place"),
                                                    F.col("w.nos").alias("nos"), F.unhex("w.key").alias("key"))).df
    place = F.struct("doc_id", "row_hash", "place")
    common = CutTable(places.groupBy("value").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("value")).df
    joined = CutTable(places.join(common, "value", "left_semi").select("doc_id", "row_hash", "nos", "key")).df
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash", F.get("nos", F.lit(0)).alias("at"))
    first = CutTable(joined.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high")).where(F.col("low") != F.col("high")).select("key", "low")).df
    later = joined.join(first, "key").where(order != F.col("low")).select("doc_id", "row_hash", F.explode("nos").alias("line"))
    return later.groupBy("doc_id", "row_hash").agg(F.collect_set("line").alias("lines"))


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated runs deleted from the texts, and ``n_lines`` and ``removed_lines`` of each row added.

    A run is repeated if its lines stood in this order earlier: in a document with a smaller ``doc_id`` (null last,
    then by hash of the text) or above in the same one. Empty lines are no part of a run and stay. Rows equal in
    ``doc_id`` and text are one document. Null texts stay null with 0 lines; an empty text has one empty line.
    """
    own, key, digest, out = (unused(docs, c) for c in ("_own_hash", "_gone_id", "_gone_hash", "_gone_lines"))
    removed = repeated_lines(docs, window).select(F.col("doc_id").alias(key), F.col("row_hash").alias(digest), F.col("lines").alias(out))
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    both = marked.join(removed, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)), "left")
    parts = unused(docs, "_lines")
    cut = both.select(*[F.col(f"`{c}`") for c in docs.columns], out, F.split(F.col("text").cast("string"), "\n").alias(parts))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), out), lambda i: F.get(F.col(parts), i))
    text = F.when(F.col(out).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return cut.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                      F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size(out), F.lit(0)).cast("long").alias("removed_lines"))


ORACLE = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
     numbered AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM split),
     filled AS (SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos FROM numbered WHERE line <> ''),
     win AS (SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
     ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM win WHERE c IS NOT NULL),
     gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
     marked AS (SELECT n.doc_id, n.no, n.line, g.pos IS NOT NULL AS gone_too FROM numbered n LEFT JOIN filled f USING (doc_id, no) LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos),
     kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone_too), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone_too) AS removed_lines FROM marked GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.removed_lines, 0) AS removed_lines FROM documents d LEFT JOIN kept k USING (doc_id)
"""
