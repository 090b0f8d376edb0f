"""Edge quality: how far one edge can be trusted, and why."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor import constants as C
from tremor.functions import columns as X

_RANK = {name: i for i, name in enumerate(C.QUALITY_NAMES)}


def edge_quality(edges: DataFrame) -> DataFrame:
    """Add ``quality``, ``quality_reasons`` and ``quality_warnings``.

    A stated status comes first, else confidence thresholds; missing evidence and doubtful
    warnings can only lower the result.
    """
    conf = F.coalesce("confidence", F.lit(0.0))
    explicit = F.lower(F.coalesce("status", F.lit("")))
    stated = explicit.isin(*C.QUALITY_NAMES)
    no_evidence = ~F.coalesce("has_evidence", F.lit(False))
    given = F.coalesce("warnings", X.no_strings())
    warnings = F.when(no_evidence, F.array_append(given, F.lit("edge has no evidence"))).otherwise(given)
    doubtful = X.any_contains(F.lower(F.array_join(warnings, " ")), C.SUSPICIOUS_MARKERS)
    dead = (conf <= 0) | (explicit == "rejected")

    by_confidence = X.labels_when([(conf >= t, _RANK[n]) for n, t in C.QUALITY_THRESHOLDS], _RANK["suspicious"])
    rank: Column = F.when(stated, X.lookup(explicit, _RANK)).otherwise(by_confidence)
    rank = F.when(no_evidence, F.least(rank, F.lit(_RANK["weak"]))).otherwise(rank)
    rank = F.when(doubtful, F.least(rank, F.lit(_RANK["suspicious"]))).otherwise(rank)
    rank = F.when(dead, F.lit(0)).otherwise(rank)
    overstated = (rank == _RANK["confirmed"]) & (conf < 0.84)
    rank = F.when(overstated, F.lit(_RANK["likely"])).otherwise(rank)

    threshold_text = X.labels_when(
        [(stated, F.concat(F.lit("explicit resolver status: "), explicit))]
        + [(conf >= t, f"confidence >= {t:.2f}") for _, t in C.QUALITY_THRESHOLDS], "confidence < 0.55")
    reasons = X.present([
        (F.lit(True), threshold_text),
        (no_evidence, "downgraded because evidence is missing"),
        (doubtful, "downgraded by false-positive guard warning"),
        (dead, "rejected or zero confidence"),
        (overstated, "confirmed requires confidence >= 0.84"),
    ])
    return edges.withColumns({
        "quality": F.element_at(F.array(*[F.lit(n) for n in C.QUALITY_NAMES]), rank + 1),
        "quality_reasons": reasons, "quality_warnings": warnings,
    })


def active_edges(edges: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Edges a traversal may follow. Uses a stored ``quality`` column when there is one."""
    graded = edges if "quality" in edges.columns else edge_quality(edges)
    return graded.where(F.col("quality").isin(*C.ACTIVE_QUALITIES) & (F.col("confidence") >= min_confidence))


def bucket_edges(edges: DataFrame) -> DataFrame:
    """Add the report section of each edge; statuses without a section count as suspicious."""
    status = F.coalesce("quality", "status", F.lit("weak"))
    return edges.withColumn("bucket", F.when(status.isin(*C.BUCKETS), status).otherwise("suspicious"))
