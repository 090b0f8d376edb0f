"""Registered queries of graph upkeep (D) and stable ids (C10)."""
from pyspark.sql import functions as F

from tremor.catalog.core import define, graph_edges, graph_evidence, joined, query, r6, using
from tremor.operators import graph as G
from tremor.sources import projection as P



@query("D01_dedupe_nodes", using("node_rows") + """, firsts AS (SELECT id, tag, min(ord) AS o FROM node_rows GROUP BY ALL)
SELECT id, kind, name, line, (SELECT string_agg(tag, '|' ORDER BY o) FROM firsts f WHERE f.id = n.id) AS tags,
       coalesce((SELECT string_agg(k, '|' ORDER BY k) FROM (SELECT unnest(kinds) AS k) WHERE k <> kind), '') AS kind_conflicts,
       coalesce((SELECT string_agg(CAST(l AS VARCHAR), '|' ORDER BY l) FROM (SELECT unnest(lns) AS l) WHERE l <> line), '') AS line_conflicts
FROM (SELECT id, arg_min(kind, ord) AS kind, coalesce(arg_min(name, ord) FILTER (name <> ''), '') AS name, arg_min(line, ord) AS line,
      list(DISTINCT kind) AS kinds, list(DISTINCT line) AS lns FROM node_rows GROUP BY id) n""")
def d01(spark, sf):
    out = G.dedupe_nodes(P.node_rows(spark, sf), lists=["tag"], scalars=["line"])
    return out.select("id", "kind", "name", "line", F.array_join("tag", "|").alias("tags"),
                      F.array_join("kind_conflicts", "|").alias("kind_conflicts"),
                      F.array_join("line_conflicts", "|").alias("line_conflicts"))


@query("D02_dedupe_edges", using("edges") + """SELECT id, from_id, to_id, kind, source, confidence, rule_id, status,
       warning AS warnings, has_evidence FROM edges""")
def d02(spark, sf):
    return graph_edges(spark, sf).select("id", "from_id", "to_id", "kind", "source", r6("confidence").alias("confidence"),
                                         "rule_id", "status", F.array_join("warnings", "|").alias("warnings"), "has_evidence")


@query("D03_dedupe_evidence", using("evidence") + "SELECT * FROM evidence")
def d03(spark, sf):
    return graph_evidence(spark, sf)


# Raw observations damaged on purpose by rules over their own columns.
DAMAGED = """SELECT id, CASE WHEN confidence = 0.85 THEN 'KNOWS' ELSE kind END AS kind,
  CASE WHEN rule_id = 'owner' AND ev_line = 7 THEN '  ' ELSE from_id END AS from_id, to_id,
  CASE WHEN confidence = 0.95 THEN 'GUESS' ELSE source END AS source,
  CASE WHEN ev_line = 3 AND rule_id <> 'owner' THEN confidence + 0.3 ELSE confidence END AS confidence, ord FROM ({rows}) d"""
define("damaged", DAMAGED.format(rows="SELECT * FROM edge_rows"), ["edge_rows"])


@query("D04_split_invalid_edges", using("damaged") + """SELECT CASE
   WHEN trim(from_id) = '' OR trim(to_id) = '' THEN 'missing_endpoint' WHEN kind NOT IN ('CONTAINS', 'DECLARES', 'CALLS', 'TESTS') THEN 'invalid_kind'
   WHEN source NOT IN ('EXTRACTED', 'INFERRED', 'SUPPORT_PACK', 'EXTERNAL_TOOL') THEN 'invalid_source'
   WHEN confidence < 0 OR confidence > 1 THEN 'invalid_confidence' ELSE 'valid' END AS outcome, count(*) AS n, min(ord) AS first_ord
 FROM damaged GROUP BY ALL""")
def d04(spark, sf):
    good, bad = G.split_invalid_edges(P.run(spark, sf, DAMAGED.format(rows=P.EDGE_ROWS)))
    both = good.select(F.lit("valid").alias("outcome"), "ord").unionByName(bad.select(F.col("reason").alias("outcome"), "ord"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


TAGGED = "SELECT *, CASE tag WHEN 'A' THEN 'ast' WHEN 'N' THEN 'external' ELSE 'pattern' END AS extractor FROM ({rows}) t"
TAGGED_EDGES = "SELECT *, CASE source WHEN 'EXTERNAL_TOOL' THEN 'external' ELSE 'ast' END AS extractor FROM ({rows}) t"


@query("D05_merge_graphs_nodes", using("node_rows") + """SELECT id, arg_max(kind, ord) AS kind, arg_max(name, ord) AS name, arg_max(line, ord) AS line,
  string_agg(DISTINCT CASE tag WHEN 'A' THEN 'ast' WHEN 'N' THEN 'external' ELSE 'pattern' END, '|' ORDER BY CASE tag WHEN 'A' THEN 'ast' WHEN 'N' THEN 'external' ELSE 'pattern' END) AS extractors
  FROM node_rows GROUP BY id""")
def d05(spark, sf):
    n, _ = G.merge_graphs(P.run(spark, sf, TAGGED.format(rows=P.NODE_ROWS)), P.run(spark, sf, TAGGED_EDGES.format(rows=P.EDGE_ROWS)))
    return n.withColumn("extractors", joined("extractors"))


@query("D05_merge_graphs_edges", using("edge_rows") + """SELECT from_id, to_id, kind, source, max(confidence) AS confidence, arg_min(id, ord) AS id,
  CASE source WHEN 'EXTERNAL_TOOL' THEN 'external' ELSE 'ast' END AS extractors
  FROM edge_rows GROUP BY from_id, to_id, kind, source, ev_text, ev_file, ev_line""")
def d05b(spark, sf):
    _, e = G.merge_graphs(P.run(spark, sf, TAGGED.format(rows=P.NODE_ROWS)), P.run(spark, sf, TAGGED_EDGES.format(rows=P.EDGE_ROWS)))
    return e.select("from_id", "to_id", "kind", "source", "confidence", "id", joined("extractors").alias("extractors"))


STABLE = """SELECT id, kind, name, concat(lower(kind), ':',
    trim(regexp_replace(concat(file, ':', id), '[^A-Za-z0-9_.:/-]+', '_', 'g'), '_'), ':',
    substr(sha1(concat('/', file, ':', id, ':', kind)), 1, 12)) AS stable_id FROM nodes"""
define("stable", STABLE.replace("sha1(", "sha1("), ["nodes"])


@query("C10_stable_ids", using("stable") + "SELECT id, stable_id FROM stable")
def c10(spark, sf):
    return G.stable_ids(P.nodes(spark, sf)).select("id", "stable_id")


@query("D06_annotate_contracts", using("edges", "stable") + """SELECT e.id, CASE WHEN source = 'AI_PROPOSED' THEN 'proposal' ELSE 'resolved' END AS resolution_status,
  CASE source WHEN 'EXTRACTED' THEN 'static_proven' WHEN 'INFERRED' THEN 'static_inferred' WHEN 'SUPPORT_PACK' THEN 'support_pack_rule'
    WHEN 'EXTERNAL_TOOL' THEN 'external_observation' ELSE 'unknown' END AS evidence_class,
  CASE WHEN source = 'RUNTIME_CONFIRMED' THEN 'runtime_observed' ELSE 'not_validated' END AS validation_status,
  f.stable_id AS canonical_from, t.stable_id AS canonical_to
  FROM edges e LEFT JOIN stable f ON f.id = e.from_id LEFT JOIN stable t ON t.id = e.to_id""")
def d06(spark, sf):
    out = G.annotate_contracts(graph_edges(spark, sf), G.stable_ids(P.nodes(spark, sf)))
    return out.select("id", "resolution_status", "evidence_class", "validation_status", "canonical_from", "canonical_to")


CONTRACTS = """SELECT id, CASE WHEN rule_id = 'rule_F' AND source = 'INFERRED' THEN 'AI_PROPOSED' ELSE source END AS source, confidence, has_evidence,
  CASE WHEN confidence = 1.0 THEN 'unresolved' WHEN confidence < 0.6 THEN 'ambiguous' ELSE 'resolved' END AS resolution_status,
  CASE WHEN source = 'EXTRACTED' THEN 'static_proven' ELSE 'static_inferred' END AS evidence_class,
  CASE WHEN kind = 'TESTS' THEN 'runtime_observed' ELSE 'not_validated' END AS validation_status,
  status = 'confirmed' AS validated_hypothesis, status = 'weak' AS runtime_observation FROM edges"""
define("contracts", CONTRACTS, ["edges"])
define("violations", """SELECT id, unnest(list_filter([
   CASE WHEN resolution_status = 'unresolved' AND validation_status = 'runtime_observed' THEN 'unresolved edge cannot be runtime_observed' END,
   CASE WHEN evidence_class = 'static_proven' AND resolution_status = 'ambiguous' THEN 'static_proven edge cannot be ambiguous' END,
   CASE WHEN source = 'AI_PROPOSED' AND validation_status = 'runtime_observed' AND NOT coalesce(validated_hypothesis, false) THEN 'AI proposal lacks validation gate provenance' END,
   CASE WHEN validation_status = 'runtime_observed' AND NOT coalesce(runtime_observation, false) THEN 'runtime_observed edge lacks runtime observation' END,
   CASE WHEN resolution_status = 'unresolved' AND confidence >= 1 THEN 'unresolved edge cannot have confidence 1.0' END], lambda x: x IS NOT NULL)) AS error FROM contracts""", ["contracts"])


def _contracts(spark, sf):
    e = graph_edges(spark, sf)
    return e.select(
        "id", "from_id", "to_id", F.when((F.col("rule_id") == "rule_F") & (F.col("source") == "INFERRED"), "AI_PROPOSED").otherwise(F.col("source")).alias("source"),
        "confidence", "has_evidence",
        F.when(F.col("confidence") == 1.0, "unresolved").when(F.col("confidence") < 0.6, "ambiguous").otherwise("resolved").alias("resolution_status"),
        F.when(F.col("source") == "EXTRACTED", "static_proven").otherwise("static_inferred").alias("evidence_class"),
        F.when(F.col("kind") == "TESTS", "runtime_observed").otherwise("not_validated").alias("validation_status"),
        (F.col("status") == "confirmed").alias("validated_hypothesis"), (F.col("status") == "weak").alias("runtime_observation"))


@query("D07_contract_violations", using("violations") + "SELECT * FROM violations")
def d07(spark, sf):
    return G.contract_violations(_contracts(spark, sf))


# Nodes renamed so that every alias form occurs.
ALIASED = """SELECT CASE WHEN kind = 'CLASS' THEN concat('class:', name, ':', line) WHEN kind = 'METHOD' THEN concat('method:', id)
   WHEN kind = 'ROUTE' THEN concat('file:', file) ELSE id END AS id, kind, name FROM ({rows}) a"""


@query("D08_node_aliases", using("nodes") + ", aliased AS (" + ALIASED.format(rows="SELECT * FROM nodes") + """),
 parts AS (SELECT id, name, CASE WHEN id LIKE 'class:%' THEN substr(id, 7) WHEN id LIKE 'method:%' THEN substr(id, 8) WHEN id LIKE 'file:%' THEN substr(id, 6) END AS rest FROM aliased)
 SELECT id AS alias FROM parts UNION SELECT name FROM parts WHERE name <> '' UNION SELECT rest FROM parts WHERE rest IS NOT NULL
 UNION SELECT split_part(rest, ':', 1) FROM parts WHERE contains(rest, ':')""")
def d08(spark, sf):
    return G.node_aliases(P.run(spark, sf, ALIASED.format(rows=P.NODES)))


define("known_ids", "SELECT id FROM nodes UNION SELECT name FROM nodes", ["nodes"])
define("dangling", """SELECT id AS edge_id, 0 AS position, from_id AS node_id FROM edges ANTI JOIN known_ids k ON k.id = from_id
  UNION ALL SELECT id, 1, to_id FROM edges ANTI JOIN known_ids k ON k.id = to_id""", ["known_ids", "edges"])


@query("D09_graph_quality_report", using("dangling") + """SELECT (SELECT count(*) FROM nodes) AS node_count,
  (SELECT count(*) - count(DISTINCT id) FROM nodes) AS duplicate_node_id_count,
  (SELECT count(*) FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges WHERE from_id = nodes.id) AND NOT EXISTS (SELECT 1 FROM edges WHERE to_id = nodes.id)) AS orphan_node_count,
  (SELECT count(*) FROM edges) AS edge_count, (SELECT count(DISTINCT edge_id) FROM dangling) AS dangling_edge_count,
  CASE WHEN (SELECT count(*) FROM dangling) > 0 THEN 'warning' ELSE 'ok' END AS status""")
def d09(spark, sf):
    return G.graph_quality_report(P.nodes(spark, sf), graph_edges(spark, sf))


@query("D10_quality_gate", using("violations", "nodes") + """SELECT 'resolved' AS stage, 'warning' AS status, (SELECT count(*) FROM nodes) AS node_count,
  (SELECT count(*) FROM edges) AS edge_count,
  (SELECT count(*) FROM edges WHERE from_id NOT IN (SELECT id FROM nodes) OR to_id NOT IN (SELECT id FROM nodes)) AS dangling_edges,
  (SELECT count(*) FROM contracts WHERE source IN ('INFERRED', 'SUPPORT_PACK', 'AI_PROPOSED') AND NOT has_evidence) AS missing_evidence,
  CAST(0 AS BIGINT) AS invalid_confidence, (SELECT count(DISTINCT id) FROM violations) AS invalid_status_combinations""")
def d10(spark, sf):
    return G.quality_gate(P.nodes(spark, sf), _contracts(spark, sf), "resolved")


@query("D11_quarantine_dangling", using("dangling") + """SELECT e.id, CASE WHEN d.ids IS NOT NULL THEN 'suspicious' ELSE status END AS status,
  concat_ws('|', warning, 'dangling edge: missing endpoint(s) ' || d.ids) AS warnings FROM edges e
  LEFT JOIN (SELECT edge_id, string_agg(node_id, ', ' ORDER BY position) AS ids FROM dangling GROUP BY edge_id) d ON d.edge_id = e.id""")
def d11(spark, sf):
    _, e = G.quarantine_dangling(P.nodes(spark, sf), graph_edges(spark, sf))
    return e.select("id", "status", F.coalesce(F.array_join("warnings", "|"), F.lit("")).alias("warnings"))


@query("D11_quarantine_placeholders", using("dangling") + """SELECT DISTINCT node_id AS id, 'FUNCTION' AS kind, node_id AS name,
  'unresolved_endpoint' AS resolution_status FROM dangling""")
def d11b(spark, sf):
    return G.quarantine_dangling(P.nodes(spark, sf), graph_edges(spark, sf))[0]


@query("D12_graph_fingerprint", using("edges") + """, h AS (SELECT kind, md5(concat_ws(chr(1), id, from_id, to_id, source, rule_id, coalesce(status, chr(2)))) AS d FROM edges)
  SELECT kind, count(*) AS row_count, sha256(concat_ws(':', count(*), sum(CAST(CAST('0x' || substr(d, 1, 12) AS BIGINT) AS HUGEINT)),
   sum(CAST(CAST('0x' || substr(d, 13, 12) AS BIGINT) AS HUGEINT)))) AS fingerprint FROM h GROUP BY kind""")
def d12(spark, sf):
    return G.graph_fingerprint(graph_edges(spark, sf), "id", "from_id", "to_id", "source", "rule_id", "status", by=["kind"])


# Large orders only: the whole graph is one component through the regions.
define("sparse", "SELECT concat('order:', l_orderkey) AS from_id, concat('part:', l_partkey) AS to_id FROM @lineitem WHERE l_quantity >= 50")
SPARSE_NODES = "SELECT concat('order:', o_orderkey) AS id FROM @orders UNION ALL SELECT concat('part:', p_partkey) FROM @part"


@query("D13_communities", using("sparse") + f""", spots AS ({SPARSE_NODES}),
  link AS (SELECT from_id AS a, to_id AS b FROM sparse UNION SELECT to_id, from_id FROM sparse),
  reach(a, b) AS (SELECT a, a FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
  comp AS (SELECT a AS node_id, min(b) AS component FROM reach GROUP BY a UNION ALL SELECT id, id FROM spots WHERE id NOT IN (SELECT a FROM link)),
  numbered AS (SELECT component, row_number() OVER (ORDER BY component) AS i FROM (SELECT DISTINCT component FROM comp))
  SELECT node_id, component, concat('community-', CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END) AS community_id
  FROM comp JOIN numbered USING (component)""")
def d13(spark, sf):
    edges = P.run(spark, sf, "SELECT concat('order:', l_orderkey) AS from_id, concat('part:', l_partkey) AS to_id FROM @lineitem WHERE l_quantity >= 50")
    return G.communities(P.run(spark, sf, SPARSE_NODES), edges)


define("degree", """SELECT node_id, count(n) AS degree FROM (SELECT from_id AS node_id, 1 AS n FROM edges UNION ALL SELECT to_id, 1 FROM edges
  UNION ALL SELECT id, NULL FROM nodes) GROUP BY node_id""", ["nodes", "edges"])


@query("D14_degrees", using("degree") + "SELECT * FROM degree")
def d14(spark, sf):
    return G.degrees(P.nodes(spark, sf), graph_edges(spark, sf))


@query("D15_hubs", using("degree") + """SELECT node_id, degree FROM degree WHERE degree > 0 AND degree >= greatest(3, (SELECT max(degree) FROM degree) * 0.5)""")
def d15(spark, sf):
    return G.hubs(G.degrees(P.nodes(spark, sf), graph_edges(spark, sf)))


@query("D15_top_degree", using("degree") + "SELECT node_id, degree FROM degree ORDER BY degree DESC, node_id LIMIT 20")
def d15b(spark, sf):
    return G.top_degree(G.degrees(P.nodes(spark, sf), graph_edges(spark, sf)))


@query("D16_reverse_dependencies", using("edges", "evidence") + """, f AS (SELECT edge_id, arg_min(file, ord) AS file, arg_min(line, ord) AS line FROM evidence GROUP BY edge_id)
  SELECT to_id AS source_id, from_id AS dependent_id, kind AS dependency_kind, f.file AS evidence_file, f.line AS evidence_line, confidence
  FROM edges LEFT JOIN f ON f.edge_id = id""")
def d16(spark, sf):
    return G.reverse_dependencies(graph_edges(spark, sf), graph_evidence(spark, sf))


@query("D16_reverse_dependency_counts", using("edges") + """SELECT count(*) AS record_count, count(DISTINCT to_id) AS source_count,
  count(DISTINCT from_id) AS dependent_count FROM edges""")
def d16b(spark, sf):
    return G.reverse_dependency_counts(G.reverse_dependencies(graph_edges(spark, sf), graph_evidence(spark, sf)))


@query("D17_graph_slice", using("edges", "nodes") + """, keep AS (SELECT id FROM nodes WHERE contains(lower(concat_ws(' ', id, name, file)), 'er') AND kind <> 'EXTERNAL_LIBRARY'
    AND NOT (kind = 'TEST' OR contains(lower(file), 'test')) AND file LIKE '%.py')
  SELECT id, from_id, to_id FROM edges WHERE confidence >= 0.7 AND source IN ('EXTRACTED', 'INFERRED')
    AND from_id IN (SELECT id FROM keep) AND to_id IN (SELECT id FROM keep)""")
def d17(spark, sf):
    _, e = G.graph_slice(P.nodes(spark, sf), graph_edges(spark, sf), text="er", sources=["EXTRACTED", "INFERRED"],
                         languages=["python"], min_confidence=0.7, hide_tests=True, hide_external=True)
    return e.select("id", "from_id", "to_id")
