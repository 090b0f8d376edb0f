"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. A source takes each of its documents as often as fits whole, and for
the rest of its budget picks documents once more: their exact lengths are counted, a proportional share of every
length is taken, and what is then left is filled by bounded-knapsack dynamic programming over the lengths still
available. The plan says how many documents of each (source, length) are taken once more; a seeded hash order says
which. Only the counts by length of one source meet in one task, never its documents.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import n_words
from tremor.plans.loops import CutTable, global_index

#: A document is taken at most this often.
MAX_REPEATS = 3
#: Budgets up to this many words are fitted by dynamic programming; larger rests are first brought below it greedily.
WINDOW = 1 << 16


def subset_sum(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is the largest that is reachable within ``budget``.

    Bounded knapsack: each length is offered in bundles of 1, 2, 4, ... documents; ``made_by`` keeps the bundle that
    first reached a sum, and walking back over it gives the selection.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    made_by = np.full(budget + 1, -1, np.int32)
    bundles: list[tuple[int, int]] = []
    for k, (length, count) in enumerate(zip(lengths, counts)):
        left, size = min(count, budget // length), 1
        while left > 0 and not reach[budget]:
            n = min(size, left)
            left, size = left - n, size * 2
            step = n * length
            if step > budget:
                break
            new = reach[:-step] & ~reach[step:]
            made_by[step:][new] = len(bundles)
            reach[step:] |= new
            bundles.append((k, n))
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, n = bundles[made_by[at]]
        taken[k] += n
        at -= n * lengths[k]
    return taken


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int = WINDOW) -> list[int]:
    """Documents to take of each length (ascending, positive) for a budget of words."""
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, taken))
    for k in range(len(lengths) - 1, -1, -1):  # longest first, down to a rest the table below can hold
        if rest <= window:
            break
        more = min(counts[k] - taken[k], (rest - window) // lengths[k] + 1, rest // lengths[k])
        taken[k] += more
        rest -= more * lengths[k]
    for k, more in enumerate(subset_sum(lengths, [c - t for c, t in zip(counts, taken)], min(rest, window))):
        taken[k] += more
    return taken


def _source_key(source: str) -> Column:
    """Null sources as a key of their own that no name can equal."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(skey, source_size, target) from (skey, nulls, source_size).

    Sources in order of their names, null last, weigh ``weights`` in turn and share all words; what would exceed
    ``max_repeats`` times a source's own size is shared again among the others. Each round settles the sources that
    reach their limit, and only a few sums per round come to the driver.
    """
    numbered = global_index(sizes, "nulls", "skey", name="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    frame = CutTable(numbered.select("skey", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("limit"))).df
    rate = 0.0
    while True:
        full = F.col("limit") < F.col("weight") * F.lit(rate)
        row = frame.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("limit"))).alias("spent"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        new = ((row["all"] or 0) - (row["spent"] or 0)) / row["open"] if row["open"] else rate
        if new <= rate:
            break
        rate = new
    return frame.select("skey", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(rate)).alias("target"))


def mix(docs: DataFrame, carry: Sequence[str], weights: Sequence[float] = (1, 2, 3), seed: int = 7,
        max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Every row of ``docs`` with its ``copies`` and the columns ``size``, ``source_size`` and ``target``.

    A null text has size 0; documents of size 0 are never picked for a rest and cost nothing in a whole pass.
    Equal rows are told apart by nothing, so any of them may be the one that is taken. Sources of size 0 have target
    0. An empty table gives an empty result. The ``carry`` columns come back as ``row``, a struct, so none clashes.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), _source_key("source").alias("skey"), n_words("text").alias("size"),
                       F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h"))
    if "text" not in carry:
        base = CutTable(base).df
        narrow = base.drop("row")
    else:
        narrow = CutTable(base.drop("row")).df
    histogram = CutTable(narrow.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))).df
    sizes = histogram.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("nulls", F.col("skey") == "-")
    goal = CutTable(targets(sizes, weights, max_repeats)).df

    def one_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["size"] > 0].sort_values("size")
        out = rows[["skey", "size"]].assign(passes=0, extra=0)
        if rows.empty:
            return out
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = min(int(target // total), max_repeats)
        budget = 0 if passes == max_repeats else round(target - passes * total)
        return out.assign(passes=passes, extra=fit(rows["size"].tolist(), rows["n"].tolist(), budget))

    chosen = histogram.join(goal, "skey").groupBy("skey").applyInPandas(one_source, "skey string, size long, passes int, extra long")
    # a group's documents are dealt to about sqrt(n) buckets by hash; whole buckets are taken in order, one is split
    plan = CutTable(histogram.join(goal, "skey").join(chosen, ["skey", "size"], "left").select(
        "skey", "size", "source_size", "target", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("extra", F.lit(0)).alias("extra"),
        F.ceil(F.sqrt("n")).cast("long").alias("buckets"), (F.col("extra") < F.col("n")).alias("split"))).df
    open_ = plan.where((F.col("extra") > 0) & F.col("split")).select("skey", "size", "extra", "buckets")
    slim = narrow.join(open_, ["skey", "size"]).withColumn("bucket", F.pmod("h", "buckets"))
    upto = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # dealt anew by bucket: else the join's partitions by (skey, size) would serve the counts, a common length in one task
    counted = slim.repartition("skey", "size", "bucket").groupBy("skey", "size", "bucket").agg(F.count(F.lit(1)).alias("held"), F.first("extra").alias("extra"))
    edge = CutTable(counted.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
                    .where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("held") >= F.col("extra")))
                    .select("skey", "size", F.col("bucket").alias("edge"), (F.col("extra") - F.col("before")).alias("quota"))).df
    bounds = plan.join(edge, ["skey", "size"], "left")
    ready = CutTable(bounds).df
    placed = base.join(ready, ["skey", "size"]).withColumn("bucket", F.pmod("h", "buckets"))
    at_edge = placed.where(F.col("bucket") == F.col("edge")).withColumn(
        "more", (F.row_number().over(Window.partitionBy("skey", "size").orderBy("h")) <= F.col("quota")).cast("int"))
    others = placed.where(~F.col("bucket").eqNullSafe(F.col("edge"))).withColumn(
        "more", F.when(F.col("extra") == 0, 0).when(~F.col("split"), 1).otherwise((F.col("bucket") < F.col("edge")).cast("int")))
    out = ("row", "size", "source_size", "target", (F.col("passes") + F.col("more")).cast("long").alias("copies"))
    return at_edge.select(*out).unionByName(others.select(*out))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; those it leaves out are dropped."""
    mixed = mix(docs, docs.columns, **options).where(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])
