"""Graph upkeep: deduplication, merging, integrity reports, components and degrees.

Edges are a flat table; their evidence is a separate table keyed by edge id, so that one edge
observed millions of times never becomes one huge nested value.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor import constants as C
from tremor.functions import columns as X
from tremor.plans.loops import CutTable, content_hash, cut, global_index


# --- deduplication -----------------------------------------------------------------------------

def dedupe_nodes(rows: DataFrame, lists: list[str] = (), scalars: list[str] = (), order: str = "ord") -> DataFrame:
    """One row per node id: first kind, first non-empty name, first scalar values.

    List items are united in order of first appearance; other kinds and other scalar values are
    kept as ``<name>_conflicts``. Everything is a combinable aggregate: a hot id is reduced
    before the shuffle to its distinct values.
    """
    named = F.col("name").isNotNull() & (F.col("name") != "")
    aggs = [
        F.min_by("kind", order).alias("kind"),
        F.coalesce(F.min_by(F.when(named, F.col("name")), F.when(named, F.col(order))), F.lit("")).alias("name"),
        F.collect_set("kind").alias("kind_conflicts"),
    ]
    for s in scalars:
        aggs += [F.min_by(s, F.when(F.col(s).isNotNull(), F.col(order))).alias(s),
                 F.collect_set(s).alias(f"{s}_conflicts")]
    out = rows.groupBy("id").agg(*aggs)
    for s in ["kind", *scalars]:
        out = out.withColumn(f"{s}_conflicts", F.array_sort(F.array_except(f"{s}_conflicts", F.array(s))))
    for item in lists:
        firsts = (
            rows.where(F.col(item).isNotNull()).groupBy("id", item).agg(F.min(order).alias("_o"))
            .groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", item))), lambda s: s[item]).alias(item))
        )
        out = out.join(firsts, "id", "left")
    return out


def _priority(source: str = "source") -> Column:
    return X.lookup(source, C.SOURCE_PRIORITY, 0)


def _last(c: str, order: str) -> Column:
    """Last non-null value in list order: a later observation without the property keeps the old one."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)


def _earliest(order: str, *cols: str) -> Column:
    """The order and ``cols`` of the first row in list order."""
    return F.min(F.when(F.col(order).isNotNull(), F.struct(order, *cols)))


#: Keys that occur more than once and go to every task; with more of them all rows are dealt out.
FEW_SHARED = 500_000


def apart(rows: DataFrame, order: str = "ord") -> tuple[DataFrame | None, DataFrame]:
    """(observations that stand alone, the others): a lone one has an id and a (from, to, kind) that no other observation has.

    Most edges are observed once. Only hashes of ids and ends are dealt out to tell which are not; the few that occur again are then known
    to every task, so that lone rows stay where they are; the others are stored. Two ids of one hash only send rows to the others. With more
    than ``FEW_SHARED`` such hashes all rows are others and the first part is None.
    """
    own, ends = F.xxhash64(F.lit(0), "id"), F.xxhash64(F.lit(1), "from_id", "to_id", "kind")
    again = CutTable(rows.select(F.explode(F.array(own, ends)).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))
    if again.count() > FEW_SHARED:
        again.drop()
        return None, rows
    marked = rows
    for name, key in (("_i", own), ("_e", ends)):
        marked = marked.join(F.broadcast(again.df.select(F.col("_h").alias(name))), key == F.col(name), "left")
    lone = F.col("_i").isNull() & F.col("_e").isNull() & F.col("id").isNotNull() & F.col(order).isNotNull()
    return marked.where(lone).drop("_i", "_e"), cut(marked.where(~lone).drop("_i", "_e"))


def _alone(rows: DataFrame, *more: Column | str) -> DataFrame:
    """The edge of each lone observation."""
    return rows.where(~_blank_endpoint()).select("id", "from_id", "to_id", "kind", "source", "confidence", "rule_id", "status", "warnings",
                                                 F.col("ev_text").isNotNull().alias("has_evidence"), *more)


def dedupe_edges(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row per edge: first by (from, to, kind, rule), whatever the source, then by id.

    Highest confidence and highest-priority source win; later properties replace earlier ones. What goes by the same
    order is one struct, so that the long order text travels once for it. An observation that stands alone is its edge, and is not dealt out.
    """
    lone, shared = apart(rows, order)
    out = _merged(shared, order)
    return (out if lone is None else _alone(lone).unionByName(out)).withColumn("ord", X.canonical_order())


def placed_edges(rows: DataFrame, order: str = "ord") -> DataFrame:
    """The edges of ``dedupe_edges`` with the ``file`` and ``line`` of their first evidence; a lone observation brings its own."""
    lone, shared = apart(rows, order)
    first = evidence_places(shared, order).groupBy(F.col("edge_id").alias("id")).agg(F.min_by(F.struct("file", "line"), "ord").alias("_at"))
    out = _merged(shared, order).join(first, "id", "left").withColumns({"file": F.col("_at.file"), "line": F.col("_at.line")}).drop("_at")
    out = out.withColumn("ord", X.canonical_order())
    return out if lone is None else placed_alone(lone).unionByName(out)


def placed_alone(lone: DataFrame, *more: str) -> DataFrame:
    """``placed_edges`` of lone observations, with the columns ``more`` of each."""
    seen = F.col("ev_text").isNotNull()
    at = [F.when(seen, F.col(f"ev_{c}")).alias(c) for c in ("file", "line")]
    return _alone(lone, *at, *more).withColumn("ord", X.canonical_order())


def _merged(rows: DataFrame, order: str) -> DataFrame:
    by_key = rows.where(~_blank_endpoint()).groupBy("from_id", "to_id", "kind", "rule_id").agg(
        _earliest(order, "id").alias("_f"),
        F.max_by("source", _priority()).alias("source"),
        F.max("confidence").alias("confidence"),
        _last("status", order), _last("warnings", order),
        F.max(F.col("ev_text").isNotNull()).alias("has_evidence"),
        F.max(order).alias("_last"),
    ).withColumns({"id": F.col("_f.id"), "_first": F.col(f"_f.{order}")})
    return by_key.groupBy("id").agg(
        _earliest("_first", "from_id", "to_id", "kind").alias("_f"),
        F.max_by("source", _priority()).alias("source"),
        F.max("confidence").alias("confidence"),
        F.max_by("rule_id", "_last").alias("rule_id"),
        _last("status", "_last"), _last("warnings", "_last"),
        F.max("has_evidence").alias("has_evidence"),
    ).select("id", *[F.col(f"_f.{c}").alias(c) for c in ("from_id", "to_id", "kind")],
             "source", "confidence", "rule_id", "status", "warnings", "has_evidence")


def dedupe_evidence(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Evidence items of each edge, each (description, file, line, source) once, with first position."""
    return rows.where(F.col("ev_text").isNotNull()).groupBy(
        F.col("id").alias("edge_id"), F.col("ev_text").alias("description"),
        F.col("ev_file").alias("file"), F.col("ev_line").alias("line"), "source",
    ).agg(F.min(order).alias("ord"))


def evidence_places(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(edge_id, file, line, ord) of every observation with evidence: the places of ``dedupe_evidence`` without its texts.

    Which place comes first, and which places there are, can be read from these rows as well; they need no shuffle.
    """
    return rows.where(F.col("ev_text").isNotNull()).select(
        F.col("id").alias("edge_id"), F.col("ev_file").alias("file"), F.col("ev_line").alias("line"), F.col(order).alias("ord"))


def _blank_endpoint() -> Column:
    return (F.trim(F.coalesce("from_id", F.lit(""))) == "") | (F.trim(F.coalesce("to_id", F.lit(""))) == "")


def edge_reject_reason() -> Column:
    conf = F.col("confidence")
    return X.labels_when([
        (_blank_endpoint(), "missing_endpoint"),
        (F.col("kind").isNull() | ~F.col("kind").isin(*C.EDGE_KINDS), "invalid_kind"),
        (F.col("source").isNull() | ~F.col("source").isin(*C.EDGE_SOURCES), "invalid_source"),
        (conf.isNull() | F.isnan(conf) | (conf < 0) | (conf > 1), "invalid_confidence"),
    ])


def split_invalid_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid edges, rejects with ``reason``)."""
    tagged = edges.withColumn("reason", edge_reject_reason())
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def merge_graphs(node_rows: DataFrame, edge_rows: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Merge tagged graphs (column ``extractor``): later node values win, edges are told apart by
    kind, source and evidence signature too."""
    nodes = node_rows.groupBy("id").agg(
        F.max_by("kind", order).alias("kind"), F.max_by("name", order).alias("name"),
        F.max_by("line", F.when(F.col("line").isNotNull(), F.col(order))).alias("line"),
        F.array_sort(F.collect_set("extractor")).alias("extractors"),
    )
    signature = X.row_digest("ev_text", "ev_file", "ev_line")
    edges = edge_rows.withColumn("evidence_signature", signature).groupBy(
        "from_id", "to_id", "kind", "source", "evidence_signature").agg(
        F.max("confidence").alias("confidence"), F.min_by("id", order).alias("id"),
        F.array_sort(F.collect_set("extractor")).alias("extractors"),
    )
    return nodes, edges


# --- contracts ---------------------------------------------------------------------------------

def annotate_contracts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Default the three status dimensions; with ``nodes`` (id, stable_id) add canonical endpoints."""
    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in edges.columns else default

    out = edges.withColumns({
        "resolution_status": given("resolution_status", F.when(F.col("source") == "AI_PROPOSED", "proposal").otherwise("resolved")),
        "evidence_class": given("evidence_class", X.lookup("source", C.EVIDENCE_CLASS, "unknown")),
        "validation_status": given("validation_status", F.when(
            F.col("source") == "RUNTIME_CONFIRMED", "runtime_observed").otherwise("not_validated")),
        "observation": F.struct("source", "confidence"),
    })
    if nodes is not None:
        for end in ("from", "to"):
            side = nodes.select(F.col("id").alias(f"{end}_id"), F.col("stable_id").alias(f"canonical_{end}"))
            out = out.join(side, f"{end}_id", "left")
    return out


def contract_errors() -> Column:
    """Array of contract violations of one edge."""
    res, ev, val = F.col("resolution_status"), F.col("evidence_class"), F.col("validation_status")
    observed = val == "runtime_observed"
    return X.present([
        ((res == "unresolved") & observed, "unresolved edge cannot be runtime_observed"),
        ((ev == "static_proven") & (res == "ambiguous"), "static_proven edge cannot be ambiguous"),
        ((F.col("source") == "AI_PROPOSED") & observed & ~F.coalesce("validated_hypothesis", F.lit(False)),
         "AI proposal lacks validation gate provenance"),
        (observed & ~(F.coalesce("runtime_observation", F.lit(False)) | (F.col("source") == "RUNTIME_CONFIRMED")),
         "runtime_observed edge lacks runtime observation"),
        ((res == "unresolved") & (F.col("confidence") >= 1.0), "unresolved edge cannot have confidence 1.0"),
    ])


def with_contract_columns(edges: DataFrame) -> DataFrame:
    """Add the columns the contract rules read where a source does not carry them."""
    types = {"resolution_status": "string", "evidence_class": "string", "validation_status": "string",
             "validated_hypothesis": "boolean", "runtime_observation": "boolean"}
    return edges.withColumns({n: F.lit(None).cast(t) for n, t in types.items() if n not in edges.columns})


def contract_violations(edges: DataFrame) -> DataFrame:
    return with_contract_columns(edges).select("id", F.explode(contract_errors()).alias("error"))


# --- integrity ---------------------------------------------------------------------------------

ALIAS_PREFIXES = ("method:", "class:", "function:", "module:", "file:")


def node_aliases(nodes: DataFrame) -> DataFrame:
    """Every text a node answers to: id, name, id without kind prefix, that up to its first colon."""
    rest = X.labels_when([(F.startswith("id", F.lit(p)), F.substr("id", F.lit(len(p) + 1))) for p in ALIAS_PREFIXES])
    head = F.when(F.contains(rest, F.lit(":")), F.substring_index(rest, ":", 1))
    name = F.when(F.col("name") != "", F.col("name"))
    return nodes.select(F.explode(F.array_compact(F.array("id", name, rest, head))).alias("alias")).distinct()


def endpoint_refs(edges: DataFrame) -> DataFrame:
    """Both endpoints of each edge as rows (edge_id, position, node_id), one scan of the edges."""
    return edges.select(F.col("id").alias("edge_id"), F.posexplode(F.array("from_id", "to_id")).alias("position", "node_id"))


def missing_endpoints(nodes: DataFrame, edges: DataFrame, use_aliases: bool = True) -> DataFrame:
    """(edge_id, position, node_id) of endpoints that name no node."""
    known = node_aliases(nodes).withColumnRenamed("alias", "node_id") if use_aliases else nodes.select(F.col("id").alias("node_id"))
    return endpoint_refs(edges).join(known, "node_id", "left_anti")


def graph_quality_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts with status ok or warning."""
    ids = nodes.groupBy(F.col("id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    node_part = ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_node_id_count"))
    orphan = ids.join(endpoint_refs(edges).select("node_id"), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_node_count"))
    edge_part = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    dangling = missing_endpoints(nodes, edges).agg(F.count_distinct("edge_id").alias("dangling_edge_count"))
    # Each side is a single aggregate row.
    out = node_part.join(orphan, F.lit(True)).join(edge_part, F.lit(True)).join(dangling, F.lit(True))
    bad = (F.col("dangling_edge_count") > 0) | (F.col("duplicate_node_id_count") > 0)
    return out.withColumn("status", F.when(bad, "warning").otherwise("ok"))


def quality_gate(nodes: DataFrame, edges: DataFrame, stage: str) -> DataFrame:
    """One row per stage: dangling edges, inferred edges without evidence, bad numbers, bad contracts."""
    inferred = F.col("source").isin("INFERRED", "SUPPORT_PACK", "AI_PROPOSED")
    bad_conf = F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1)
    own = with_contract_columns(edges).agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.count_if(inferred & ~F.col("has_evidence")).alias("missing_evidence"),
        F.count_if(bad_conf).alias("invalid_confidence"),
        F.count_if(F.size(contract_errors()) > 0).alias("invalid_status_combinations"))
    dangling = missing_endpoints(nodes, edges, use_aliases=False).agg(F.count_distinct("edge_id").alias("dangling_edges"))
    total = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    out = own.join(dangling, F.lit(True)).join(total, F.lit(True))
    faults = F.col("dangling_edges") + F.col("missing_evidence") + F.col("invalid_confidence") + F.col("invalid_status_combinations")
    return out.withColumns({"stage": F.lit(stage), "status": F.when(faults == 0, "ok").otherwise("warning")})


def placeholder_kind(node_id: Column | str) -> Column:
    v = X.col(node_id)
    return X.labels_when([
        (v.startswith("module:"), "MODULE"), (v.startswith("class:"), "CLASS"), (v.startswith("method:"), "METHOD"),
        (v.startswith("HTTP "), "ROUTE"), (v.startswith("file:"), "FILE"),
        (v.startswith("react") | v.isin("fastapi", "fetch", "JSON.stringify"), "EXTERNAL_LIBRARY"),
    ], "FUNCTION")


def quarantine_dangling(nodes: DataFrame, edges: DataFrame, first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(placeholder nodes, edges): dangling edges become suspicious with a warning naming the ids.

    ``first_only`` marks just the first edge, in list order, that mentions a missing id.
    """
    missing = missing_endpoints(nodes, edges)
    placeholders = missing.select(F.col("node_id").alias("id")).distinct().select(
        "id", placeholder_kind("id").alias("kind"), F.col("id").alias("name"), F.lit("unresolved_endpoint").alias("resolution_status"))
    if first_only:
        firsts = missing.join(edges.select(F.col("id").alias("edge_id"), "ord"), "edge_id").groupBy("node_id").agg(
            F.min_by("edge_id", "ord").alias("edge_id"))
        missing = missing.join(firsts, ["node_id", "edge_id"], "left_semi")
    # At most two endpoints per edge, so the list is bounded.
    listed = missing.groupBy(F.col("edge_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "node_id"))), lambda s: s["node_id"]), ", ").alias("_ids"))
    warning = F.concat(F.lit("dangling edge: missing endpoint(s) "), F.col("_ids"))
    hit = F.col("_ids").isNotNull()
    out = edges.join(listed, "id", "left").withColumns({
        "warnings": F.when(hit, F.array_union(F.coalesce("warnings", X.no_strings()), F.array(warning))).otherwise(F.col("warnings")),
        "status": F.when(hit, "suspicious").otherwise(F.col("status")),
        "quality_guard": F.when(hit, "quarantined_dangling_endpoint"),
    }).drop("_ids")
    return placeholders, out


def graph_fingerprint(frame: DataFrame, *cols: str, by: list[str] = ()) -> DataFrame:
    """Content fingerprint that does not depend on row order.

    Row digests are added up as exact decimals, so the aggregate combines on each task and no
    list of rows is ever built.
    """
    digest = X.row_digest(*cols)
    part = lambda start: F.conv(F.substr(digest, F.lit(start), F.lit(12)), 16, 10).cast("decimal(38,0)")
    sums = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(part(1)), F.lit(0)).alias("_a"), F.coalesce(F.sum(part(13)), F.lit(0)).alias("_b"))
    return sums.withColumn("fingerprint", F.sha2(F.concat_ws(
        ":", *[F.col(c).cast("string") for c in ("row_count", "_a", "_b")]), 256)).drop("_a", "_b")


# --- structure ---------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """Weakly connected components as (node_id, component = smallest member id).

    Alternating large-star and small-star rounds: each round is one per-node minimum and one
    join, the edge count never grows, and a hub only ever contributes to a minimum. Ends when a round changes nothing.
    """
    pairs = edges.select(F.greatest("from_id", "to_id").alias("u"), F.least("from_id", "to_id").alias("v"))
    members = pairs.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    state = CutTable(pairs.where("u <> v").distinct())
    before = content_hash(state.df)
    while True:
        both = state.df.union(state.df.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = CutTable(large.where("u <> v").distinct())
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
        new = CutTable(small.where("u <> v").distinct())
        large.drop()
        state.drop()
        state = new
        after = content_hash(state.df)
        if after == before:
            break
        before = after
    roots = state.df.groupBy(F.col("u").alias("node_id")).agg(F.min("v").alias("component"))
    return members.join(roots, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component, community_id): labels count up in order of the smallest member id."""
    comp = components(edges)
    lone = nodes.select(F.col("id").alias("node_id")).join(comp, "node_id", "left_anti").withColumn("component", F.col("node_id"))
    labelled = cut(comp.unionByName(lone))
    index = global_index(labelled.select("component").distinct(), "component")
    number = F.col("index").cast("string")
    label = F.concat(F.lit("community-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
    return labelled.join(index, "component").select("node_id", "component", label.alias("community_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every known or mentioned id with its degree; a self loop counts twice."""
    counted = endpoint_refs(edges).select("node_id", F.lit(1).alias("n"))
    listed = nodes.select(F.col("id").alias("node_id"), F.lit(0).alias("n"))
    return counted.unionByName(listed).groupBy("node_id").agg(F.sum("n").alias("degree"))


def hubs(degree: DataFrame) -> DataFrame:
    """Nodes whose degree reaches max(3, half the top degree)."""
    top = degree.agg(F.max("degree").alias("_top"))
    return degree.join(F.broadcast(top), (F.col("degree") > 0) & (
        F.col("degree") >= F.greatest(F.lit(3.0), F.col("_top") * 0.5))).drop("_top")


def top_degree(degree: DataFrame, n: int = 20) -> DataFrame:
    return degree.orderBy(F.desc("degree"), "node_id").limit(n)


def reverse_dependencies(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Who depends on each node, with the place of the first evidence item."""
    first = evidence.groupBy(F.col("edge_id").alias("id")).agg(
        F.min_by(F.struct("file", "line"), "ord").alias("_ev"))
    return edges.join(first, "id", "left").select(
        F.col("to_id").alias("source_id"), F.col("from_id").alias("dependent_id"), F.col("kind").alias("dependency_kind"),
        F.col("_ev.file").alias("evidence_file"), F.col("_ev.line").alias("evidence_line"), "confidence")


def reverse_dependency_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("record_count"), F.count_distinct("source_id").alias("source_count"),
        F.count_distinct("dependent_id").alias("dependent_count"))


def graph_slice(nodes: DataFrame, edges: DataFrame, text: str = "", kinds: list[str] = (), sources: list[str] = (),
                languages: list[str] = (), min_confidence: float = 0.0, hide_tests: bool = False,
                hide_external: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass the filters and the edges between them."""
    keep = nodes
    if text:
        t = F.lit(text.lower())
        keep = keep.where(F.contains(F.lower(F.concat_ws(" ", "id", "name", "file")), t))
    if kinds:
        keep = keep.where(F.col("kind").isin(*kinds))
    if languages:
        keep = keep.where(X.suffix_language("file").isin(*languages))
    if hide_tests:
        keep = keep.where(~((F.col("kind") == "TEST") | F.contains(F.lower(F.coalesce("file", F.lit(""))), F.lit("test"))))
    if hide_external:
        keep = keep.where(F.col("kind") != "EXTERNAL_LIBRARY")
    inside = edges.where(F.col("confidence") >= min_confidence)
    if sources:
        inside = inside.where(F.col("source").isin(*sources))
    ids = keep.select("id")
    inside = (inside.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
              .join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))
    return keep, inside


def stable_ids(nodes: DataFrame, project_root: str = "") -> DataFrame:
    """``kind:slug:digest`` ids that survive renumbering of legacy ids."""
    root = project_root.replace("\\", "/").rstrip("/")
    path = X.slashes(F.coalesce("file", F.lit("<external>")))
    if root:
        path = F.when(path.startswith(root), F.ltrim(F.substr(path, F.lit(len(root) + 1)), F.lit("/"))).otherwise(path)
    else:
        path = F.ltrim(path, F.lit("/"))
    name = F.when(F.col("id") != "", F.col("id")).otherwise(F.col("name"))
    slug = F.trim(F.regexp_replace(F.concat_ws(":", path, name), "[^A-Za-z0-9_.:/-]+", "_"), F.lit("_"))
    digest = F.substr(F.sha1(F.concat(F.lit(root + "/"), path, F.lit(":"), name, F.lit(":"), F.col("kind"))), F.lit(1), F.lit(12))
    return nodes.withColumn("stable_id", F.concat_ws(":", F.lower("kind"), slug, digest))
