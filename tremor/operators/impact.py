"""Impact queries: bounded traversal for many questions at once, path scores and explanations."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor import constants as C
from tremor.functions import columns as X
from tremor.functions.textjoin import contains_join
from tremor.operators.graph import dedupe_edges
from tremor.operators.quality import active_edges, edge_quality
from tremor.plans.loops import CutTable


# --- seeds -------------------------------------------------------------------------------------

def match_seeds(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, rank) from queries (query_id, target, symbol, file_path).

    A symbol or file matches by containment, a target exactly and by containment only when no
    node has that id. The query text itself is always a seed, after the matched nodes.
    """
    q = queries.select(
        "query_id", F.coalesce("symbol", "file_path", "target").alias("q"),
        F.when(F.col("file_path").isNotNull(), "file").when(F.col("symbol").isNotNull(), "symbol").otherwise("target").alias("mode"),
    ).where(F.col("q") != "")
    by_file = q.where("mode = 'file'").select("query_id", F.col("q"))
    by_symbol, by_target = q.where("mode = 'symbol'"), q.where("mode = 'target'")
    exact = by_target.join(nodes.select(F.col("id").alias("q"), F.col("id").alias("node_id")), "q")
    loose = by_target.join(exact.select("query_id"), "query_id", "left_anti").unionByName(by_symbol).select("query_id", "q")

    ids = nodes.select(F.col("id").alias("node_id"), F.col("id").alias("_text"))
    names = nodes.where(F.col("name").isNotNull()).select(F.col("id").alias("node_id"), F.col("name").alias("_text"))
    files = nodes.where(F.coalesce("file", F.lit("")) != "").select(F.col("id").alias("node_id"), F.col("file").alias("_text"))
    pick = lambda df: df.select("query_id", "node_id")
    loose_hits = pick(contains_join(ids.unionByName(names), "_text", loose, "q"))
    file_hits = pick(contains_join(files.unionByName(ids), "_text", by_file, "q")).unionByName(
        pick(contains_join(by_file, "q", files, "_text")))
    matched = pick(exact).unionByName(loose_hits).unionByName(file_hits).distinct().withColumn("rank", F.lit(0))
    own = q.select("query_id", F.col("q").alias("node_id"), F.lit(1).alias("rank"))
    return matched.unionByName(own).groupBy("query_id", "node_id").agg(F.min("rank").alias("rank"))


# --- traversal ---------------------------------------------------------------------------------

def _facts_of_edge() -> list[Column]:
    """What a path needs to know about each edge it uses."""
    def get(name):
        return F.lower(F.coalesce(F.col(name), F.lit("")))

    by_source = X.lookup("source", {"EXTRACTED": "static_proven", "RUNTIME_CONFIRMED": "runtime_observed"}, "static_inferred")
    standing = F.coalesce(F.nullif("validation_status", F.lit("")), F.nullif("evidence_class", F.lit("")), by_source)
    return [
        "confidence", "kind", "id", "ord",
        standing.isin("runtime_observed", "static_proven").alias("proven"),
        (get("resolution_status").isin("ambiguous", "unresolved") | get("status").isin("ambiguous", "suspicious")).alias("ambiguous"),
        get("validation_status").isin("unresolved", "quarantined").alias("unresolved"),
    ]


def hops(edges: DataFrame, direction: str = "both", best_first: bool = False) -> DataFrame:
    """Directed steps (src, dst) of active edges with the sort key that breaks ties. Edges are stored once, whatever the direction.

    ``best_first`` orders the steps out of a node by falling confidence, then target.
    """
    if direction not in ("downstream", "upstream", "both"):
        raise ValueError(f"unknown direction: {direction}")
    for name in ("validation_status", "evidence_class", "resolution_status"):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(None).cast("string"))
    base = CutTable(edges.select("from_id", "to_id", *_facts_of_edge())).df
    rest = ["confidence", "kind", "id", "proven", "ambiguous", "unresolved"]

    def step(src, dst, arrow, a, b):
        return base.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(arrow).alias("arrow"),
                           F.struct(a.alias("a"), b.alias("b")).alias("key"), *rest)

    if best_first:
        return step("from_id", "to_id", "->", -F.col("confidence"), F.concat_ws("\u0001", "to_id", "ord"))
    down = step("from_id", "to_id", "->", F.lit(0.0), F.col("ord"))
    up = step("to_id", "from_id", "<-", F.lit(1.0), F.col("ord"))
    return {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]


def walk(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None, targets: DataFrame | None = None,
         without: Sequence[str] = ()) -> DataFrame:
    """Breadth-first search for every query at once; one row per (query, visited node), seeds at depth 0.

    A node keeps the first path a queue would have found: paths compare by the sequence of step
    keys, so the minimum per node is taken by a combinable aggregate instead of a queue. Each
    level is one join and is written out; levels are read back for the visited test. With
    ``targets`` (query_id, node_id) a query stops once its target is reached. Columns named in ``without`` are not carried.
    """
    start = seeds.select(
        "query_id", "node_id", F.lit(0).alias("depth"),
        F.array(F.struct(F.col("rank").cast("double").alias("a"), F.col("node_id").alias("b"))).alias("path"),
        F.array().cast("array<string>").alias("edge_ids"), F.array(F.col("node_id")).alias("node_ids"),
        F.col("node_id").alias("chain"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("product"),
        F.lit(True).alias("proven"), F.lit(False).alias("ambiguous"), F.lit(False).alias("unresolved")).drop(*without)
    fields = [c for c in start.columns if c not in ("query_id", "node_id")]
    levels = [CutTable(start)]
    frontier = levels[0].df
    visited = frontier
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        f, s = frontier.alias("f"), steps.alias("s")
        bounded = F.least(F.greatest(F.col("s.confidence"), F.lit(0.0)), F.lit(1.0))
        arrow = F.col("s.arrow")
        grown = {
            "depth": F.lit(depth),
            "path": F.array_append("f.path", F.col("s.key")),
            "edge_ids": F.array_append("f.edge_ids", F.col("s.id")),
            "node_ids": F.array_append("f.node_ids", F.col("s.dst")),
            "chain": F.concat("f.chain", F.lit(" "), arrow, F.lit(" ("), "s.kind", F.lit(", c="), F.col("s.confidence").cast("string"),
                              F.lit(") "), arrow, F.lit(" "), "s.dst"),
            "confidence": F.least("f.confidence", "s.confidence"),
            "product": F.col("f.product") * bounded,
            "proven": F.col("f.proven") & F.col("s.proven"),
            "ambiguous": F.col("f.ambiguous") | F.col("s.ambiguous"),
            "unresolved": F.col("f.unresolved") | F.col("s.unresolved")}
        found = f.join(s, F.col("f.node_id") == F.col("s.src")).select(
            "f.query_id", F.col("s.dst").alias("node_id"), *[grown[c].alias(c) for c in fields])
        fresh = found.join(visited.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        first = fresh.groupBy("query_id", "node_id").agg(F.min(F.struct(*["path"] + [c for c in fields if c != "path"])).alias("_p"))
        level = CutTable(first.select("query_id", "node_id", *[F.col(f"_p.{c}").alias(c) for c in fields]))
        if level.is_empty():
            break
        levels.append(level)
        visited = visited.unionByName(level.df)
        frontier = level.df
        if targets is not None:
            done = level.df.join(targets, ["query_id", "node_id"], "left_semi").select("query_id").distinct()
            frontier = frontier.join(done, "query_id", "left_anti")
    return visited


def reach(steps: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(s, n, depth): what each seed meets in at most ``max_depth`` steps and how far away, itself at depth 0; no paths.

    steps (src, dst) and seeds (s) are numbers, so a row is three of them, where ``walk`` holds a path of texts. Each level
    is one join and one combinable minimum.
    """
    known = CutTable(seeds.select("s", F.col("s").alias("n"), F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        edge = known.df.where(F.col("depth") == depth - 1)
        found = edge.join(steps, F.col("n") == F.col("src")).select("s", F.col("dst").alias("n"), F.lit(depth).alias("depth"))
        after = CutTable(known.df.unionByName(found).groupBy("s", "n").agg(F.min("depth").alias("depth")))
        known.drop()
        known = after
    return known.df


def affected_edges(edges: DataFrame, visited: DataFrame, direction: str = "both", max_depth: int | None = None) -> DataFrame:
    """(query_id, edge_id): active edges leaving a node that was expanded, in an allowed direction."""
    expanded = visited if max_depth is None else visited.where(F.col("depth") < max_depth)
    expanded = expanded.select("query_id", "node_id")
    ends = {"downstream": ["from_id"], "upstream": ["to_id"], "both": ["from_id", "to_id"]}[direction]
    touched = edges.select(F.col("id").alias("edge_id"), F.explode(F.array(*ends)).alias("node_id"))
    return expanded.join(touched, "node_id").select("query_id", "edge_id").distinct()


def impact_batch(edges: DataFrame, seeds: DataFrame, direction: str = "both", max_depth: int | None = None,
                 min_confidence: float = 0.0, without: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(reached nodes with first path, affected edges) for every query id in ``seeds``."""
    active = active_edges(edges, min_confidence)
    visited = walk(hops(active, direction), seeds, max_depth, without=without)
    return visited.where("depth > 0"), affected_edges(active, visited, direction, max_depth)


def impact_query(nodes: DataFrame, edges: DataFrame, queries: DataFrame, direction: str = "both",
                 max_depth: int | None = None, min_confidence: float = 0.0) -> dict[str, DataFrame]:
    """Seeds, reached nodes (placeholder kind FUNCTION where no node row exists) and affected edges."""
    seeds = CutTable(match_seeds(nodes, queries)).df
    reached, touched = impact_batch(edges, seeds, direction, max_depth, min_confidence)
    return {"seeds": seeds, "reached": describe(reached, nodes), "edges": touched}


def rows_within(rows: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """The observations of every edge that a walk of ``depth`` steps from ``seeds`` can touch, whatever the edge's quality.

    An edge id must belong to one pair of ends, so that all observations of an edge stay together. Only hashes of ends
    are stored and followed; where two ids share one, some rows too many stay, which the walk itself does not reach.
    """
    sides = {"downstream": [("a", "b")], "upstream": [("b", "a")], "both": [("a", "b"), ("b", "a")]}[direction]
    ends = CutTable(rows.select(F.xxhash64("from_id").alias("a"), F.xxhash64("to_id").alias("b"))).df
    frontier = near = CutTable(seeds.select(F.xxhash64("node_id").alias("n")).distinct()).df
    for _ in range(depth - 1):
        found = [ends.join(frontier, F.col(src) == F.col("n"), "left_semi").select(F.col(dst).alias("n")).distinct() for src, dst in sides]
        level = CutTable((found[0].unionByName(found[1]).distinct() if len(found) > 1 else found[0]).join(near, "n", "left_anti"))
        if level.is_empty():
            break
        frontier, near = level.df, near.unionByName(level.df)
    near, out, kept = CutTable(near).df, rows, F.lit(False)
    for src, _ in sides:
        end = {"a": "from_id", "b": "to_id"}[src]
        out = out.join(near.select(F.col("n").alias(f"_{src}")), F.xxhash64(end) == F.col(f"_{src}"), "left")
        kept = kept | F.col(f"_{src}").isNotNull()
    return out.where(kept).select(*rows.columns)


def impact_of_rows(nodes: DataFrame, rows: DataFrame, queries: DataFrame, max_depth: int, direction: str = "both") -> dict[str, DataFrame]:
    """``impact_query`` over edge observations: only those near the questions are deduplicated and graded."""
    seeds = CutTable(match_seeds(nodes, queries)).df
    edges = CutTable(edge_quality(dedupe_edges(rows_within(rows, seeds, max_depth, direction)))).df
    reached, touched = impact_batch(edges, seeds, direction, max_depth)
    return {"seeds": seeds, "reached": describe(reached, nodes), "edges": touched}


def impact_batch_of_rows(rows: DataFrame, seeds: DataFrame, direction: str, max_depth: int, without: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``impact_batch`` over edge observations: only those near the seeds are deduplicated and graded."""
    edges = CutTable(edge_quality(dedupe_edges(rows_within(rows, seeds, max_depth, direction)))).df
    return impact_batch(edges, seeds, direction, max_depth, without=without)


def describe(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach node kind and name; ids without a node row become FUNCTION placeholders."""
    known = nodes.select(F.col("id").alias("node_id"), "kind", "name", "file", "criticality", F.lit(True).alias("known"))
    return reached.join(known, "node_id", "left").withColumns({
        "kind": F.coalesce("kind", F.lit("FUNCTION")), "name": F.coalesce("name", "node_id"),
        "known": F.coalesce("known", F.lit(False))})


# --- scores ------------------------------------------------------------------------------------

def path_status(proven: Column | str = "proven") -> Column:
    """A path is confirmed only when every edge is proven or was observed."""
    return F.when(X.col(proven), "confirmed").otherwise("likely")


def chain_confidence(product: Column | str = "product", length: Column | str = "depth") -> Column:
    """Geometric mean of the edge confidences; an empty path is certain."""
    return F.when(X.col(length) > 0, F.pow(X.col(product), 1.0 / X.col(length))).otherwise(1.0)


def chain_status(confidence: Column, ambiguous: Column, unresolved: Column, labels: str = "en") -> Column:
    names = C.CHAIN_LABELS[labels]
    return X.labels_when(
        [(ambiguous, names["ambiguous"]), (unresolved, names["needs_review"])]
        + [(confidence >= t, names[n]) for n, t in C.CHAIN_THRESHOLDS], names["ambiguous"])


def criticality(kind: Column | str = "kind", stated: Column | str = "criticality", table: dict | None = None,
                default: float = C.DEFAULT_CRITICALITY) -> Column:
    by_kind = X.lookup(F.upper(X.col(kind)), {**C.CRITICALITY_BY_KIND, **(table or {})}, default)
    return F.when(X.col(stated).isNotNull(), F.greatest(X.col(stated), F.lit(0.0))).otherwise(by_kind)


def rank_impact(reached: DataFrame, decay: float = C.DECAY, default: float = C.DEFAULT_CRITICALITY,
                table: dict | None = None, labels: str = "en") -> DataFrame:
    """Score = criticality x chain confidence x decay^distance. Placeholders get the default criticality."""
    if not 0.0 < decay <= 1.0:
        raise ValueError("decay must be in (0, 1]")
    crit = F.when(F.col("known"), criticality(table=table, default=default)).otherwise(F.lit(default))
    conf = chain_confidence()
    return reached.withColumns({
        "node_criticality": crit, "path_confidence": conf,
        "confidence_status": chain_status(conf, F.col("ambiguous"), F.col("unresolved"), labels),
        "impact_score": crit * conf * F.pow(F.lit(decay), F.col("depth")),
    })


def top_impact(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.orderBy(F.desc("impact_score"), "node_id").limit(n)


def kind_group(kind: Column | str = "kind") -> Column:
    k = F.upper(X.col(kind))
    return X.labels_when([
        (k == "FILE", "files"), (k == "CLASS", "classes"), (k.isin("FUNCTION", "METHOD", "SYMBOL"), "functions"),
        (k.isin("ROUTE", "HTTP_ROUTE"), "routes"), (k == "TEST", "tests"),
        (k.isin("EXTERNAL_LIBRARY", "SUPPORT_PACK", "LIBRARY"), "external_libraries"),
    ], F.concat(F.lower(k), F.lit("s")))


def group_affected(reached: DataFrame) -> DataFrame:
    return reached.withColumn("group", kind_group())


def direct_neighbours(edges: DataFrame, touched: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, side, node_id): the other ends of affected edges at the query text itself."""
    used = touched.join(edges.select(F.col("id").alias("edge_id"), "from_id", "to_id"), "edge_id").join(queries, "query_id")
    sides = F.array_compact(F.array(
        F.when(F.col("to_id") == F.col("q"), F.struct(F.lit("upstream").alias("side"), F.col("from_id").alias("node_id"))),
        F.when(F.col("from_id") == F.col("q"), F.struct(F.lit("downstream").alias("side"), F.col("to_id").alias("node_id")))))
    return used.select("query_id", F.explode(sides).alias("s")).select("query_id", "s.side", "s.node_id").distinct()


def query_diagnostics(queries: DataFrame, seeds: DataFrame, edges: DataFrame, touched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Why a query found nothing. queries: (query_id, q)."""
    matched = seeds.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("matched_node_count"))
    mentions = edges.select(F.col("id").alias("edge_id"), F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("q"))
    ends = queries.join(mentions, "q").groupBy("query_id").agg(F.count(F.lit(1)).alias("matched_edge_endpoint_count"))
    active = touched.groupBy("query_id").agg(F.count(F.lit(1)).alias("active_edge_count"))
    out = queries.select("query_id").join(matched, "query_id", "left").join(ends, "query_id", "left").join(active, "query_id", "left").fillna(0)
    m, e, a = F.col("matched_node_count"), F.col("matched_edge_endpoint_count"), F.col("active_edge_count")
    return out.withColumns({
        "isolated": (m > 0) & (a == 0),
        "reason": F.when((m > 0) & (a == 0), "node_has_no_active_edges").when((m == 0) & (e == 0), "no_matching_node_or_edge_endpoint"),
        "warning": F.when((e > 0) & (a == 0), "query matched an edge endpoint but no active traversal edge"),
    })


# --- explanations ------------------------------------------------------------------------------

def explain_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Explain the first edge, in list order, between each requested (from_id, to_id[, kind])."""
    graded = edge_quality(edges)
    fields = ["id", "kind", "source", "confidence", "rule_id", "quality", "quality_warnings"]
    # One row per pair with the first edge of each kind, in list order; edges are dealt by pair once, requests once.
    dealt = graded.select("from_id", "to_id", F.col("kind").alias("_kind"), F.struct("ord", F.struct(*fields).alias("edge")).alias("_e")).repartition("from_id", "to_id")
    firsts = dealt.groupBy("from_id", "to_id", "_kind").agg(F.min("_e").alias("_e"))
    of_pair = firsts.groupBy("from_id", "to_id").agg(F.array_sort(F.collect_list("_e")).alias("_edges"))
    fits = F.filter("_edges", lambda e: F.col("kind").isNull() | (F.col("kind") == e["edge"]["kind"]))
    out = requests.join(of_pair, ["from_id", "to_id"], "left").withColumn("edge", F.get(fits, F.lit(0))["edge"])
    found = F.col("edge").isNotNull()
    src, rule = F.col("edge.source"), F.nullif(F.col("edge.rule_id"), F.lit(""))
    inferred, packed = src == "INFERRED", src == "SUPPORT_PACK"
    steps = F.when(found, X.present([
        (inferred, "Edge was inferred via precision resolver resolution logic."),
        (inferred & rule.isNotNull(), F.concat(F.lit("Applied support pack rule: "), rule)),
        (packed, F.concat(F.lit("Edge was produced by support pack rule: "), F.coalesce(rule, F.lit("")), F.lit("."))),
        (~inferred & ~packed, "Edge was directly extracted from AST (extractor: unknown)."),
    ])).otherwise(F.array(F.concat(F.lit("No edge found from "), "from_id", F.lit(" to "), "to_id", F.lit("."))))
    low = X.present([(F.col("edge.confidence") < 0.70, "Low confidence edge (confidence < 0.70). Use with caution.")])
    warnings = F.when(found, F.concat(low, F.col("edge.quality_warnings"))).otherwise(
        F.array(F.concat(F.lit("No edge connects "), "from_id", F.lit(" and "), "to_id", F.lit("."))))
    return out.select(
        "request_id", "from_id", "to_id", found.alias("found"), F.col("edge.id").alias("edge_id"),
        F.coalesce("edge.confidence", F.lit(0.0)).alias("confidence"), F.coalesce(src, F.lit("UNKNOWN")).alias("source"),
        F.col("edge.quality").alias("status"), steps.alias("reasoning_steps"), warnings.alias("warnings"))


def impact_path(edges: DataFrame, pairs: DataFrame, max_depth: int = 20) -> DataFrame:
    """Fewest-hop path over active edges for each (query_id, from_id, to_id); ties go to confidence."""
    seeds = pairs.select("query_id", F.col("from_id").alias("node_id"), F.lit(0).alias("rank"))
    targets = pairs.select("query_id", F.col("to_id").alias("node_id"))
    visited = walk(hops(active_edges(edges), best_first=True), seeds, max_depth, targets, without=["chain"])
    hit = visited.join(targets, ["query_id", "node_id"], "left_semi").drop("node_id", "path")
    conf = chain_confidence()
    return pairs.join(hit, "query_id", "left").select(
        "query_id", "from_id", "to_id", F.col("depth").isNotNull().alias("found"), "depth",
        F.coalesce("node_ids", X.no_strings()).alias("node_ids"), F.coalesce("edge_ids", X.no_strings()).alias("edge_ids"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("depth").isNotNull(), conf).alias("chain_confidence"),
        F.when(F.col("depth").isNotNull(), chain_status(conf, F.lit(False), F.lit(False))).alias("chain_status"),
        F.when(F.col("depth").isNotNull(), path_status()).alias("path_status"))


def impact_path_of_rows(rows: DataFrame, pairs: DataFrame, max_depth: int = 20) -> DataFrame:
    """``impact_path`` over edge observations: only those that lead to some target, and that some start reaches, are deduplicated and walked.

    Every step into a node that leads to a target stays, so the first path to it is the same one.
    """
    leading = CutTable(rows_within(rows, pairs.select(F.col("to_id").alias("node_id")), max_depth, "upstream")).df
    between = rows_within(leading, pairs.select(F.col("from_id").alias("node_id")), max_depth, "downstream")
    return impact_path(CutTable(edge_quality(dedupe_edges(between))).df, pairs, max_depth)


def token_saving(frame: DataFrame, full: str = "full_tokens", selected: str = "selected_tokens") -> DataFrame:
    """Measured context reduction; never a made-up percentage."""
    f, s = F.col(full), F.col(selected)
    ok = f.isNotNull() & s.isNotNull() & (f > 0) & (s >= 0)
    ratio = F.greatest(F.lit(0.0), 1.0 - s.cast("double") / f.cast("double"))
    return frame.withColumns({
        "saving_status": F.when(ok, "measured").otherwise("not_measured"),
        "saving_ratio": F.when(ok, ratio), "saving_percent": F.when(ok, F.round(ratio * 100.0, 2)),
    })
