"""Registered queries of edge quality, scoring and impact (E)."""
from pyspark.sql import functions as F

from tremor.catalog.core import define, graph_edges, query, r6, using, walk_sql
from tremor.operators import impact as I
from tremor.operators import quality as Q
from tremor.plans.loops import cut
from tremor.sources import projection as P

_REASONS = """list_filter([
  CASE WHEN status IN ('rejected', 'suspicious', 'weak', 'likely', 'confirmed') THEN 'explicit resolver status: ' || status
       WHEN confidence >= 0.84 THEN 'confidence >= 0.84' WHEN confidence >= 0.7 THEN 'confidence >= 0.70'
       WHEN confidence >= 0.55 THEN 'confidence >= 0.55' ELSE 'confidence < 0.55' END,
  CASE WHEN NOT has_evidence THEN 'downgraded because evidence is missing' END,
  CASE WHEN doubt THEN 'downgraded by false-positive guard warning' END,
  CASE WHEN dead THEN 'rejected or zero confidence' END,
  CASE WHEN over THEN 'confirmed requires confidence >= 0.84' END], lambda x: x IS NOT NULL)"""


@query("E01_edge_quality", using("graded") + "SELECT id, quality FROM graded")
def e01(spark, sf):
    return Q.edge_quality(graph_edges(spark, sf)).select("id", "quality")


@query("E02_quality_reasons", using("graded") + f"""SELECT id, array_to_string({_REASONS}, '|') AS reasons,
  concat_ws('|', warning, CASE WHEN NOT has_evidence THEN 'edge has no evidence' END) AS warnings FROM graded""")
def e02(spark, sf):
    return Q.edge_quality(graph_edges(spark, sf)).select(
        "id", F.array_join("quality_reasons", "|").alias("reasons"), F.array_join("quality_warnings", "|").alias("warnings"))


@query("E03_active_edges", using("active") + "SELECT id, confidence FROM active WHERE confidence >= 0.6")
def e03(spark, sf):
    return Q.active_edges(graph_edges(spark, sf), 0.6).select("id", "confidence")


@query("E04_bucket_edges", using("graded") + "SELECT quality AS bucket, count(*) AS n, min(id) AS first_id FROM graded GROUP BY 1")
def e04(spark, sf):
    return Q.bucket_edges(Q.edge_quality(graph_edges(spark, sf))).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


# Questions of every kind: exact target, target known only in part, symbol, file, and a miss.
QUESTIONS = """SELECT * FROM (VALUES ('q1', 'part:17', NULL, NULL), ('q2', 'urgent bolt', NULL, NULL), ('q3', NULL, 'NATION_1', NULL),
  ('q4', NULL, NULL, 'src/brand_12/part_7'), ('q5', 'missing:3', NULL, NULL), ('q6', 'nowhere at all', NULL, NULL), ('q7', NULL, 'er:9', NULL),
  ('q8', NULL, NULL, 'repo/src/core/nation_1.py')) AS v(query_id, target, symbol, file_path)"""
_Q = f"""questions AS ({QUESTIONS}), asked AS (SELECT query_id, coalesce(symbol, file_path, target) AS q,
   CASE WHEN file_path IS NOT NULL THEN 'f' WHEN symbol IS NOT NULL THEN 's' ELSE 't' END AS mode FROM questions),
 hit AS (SELECT query_id, id FROM asked, nodes WHERE mode = 'f' AND (contains(file, q) OR contains(q, file) OR contains(id, q))
   UNION SELECT query_id, id FROM asked, nodes WHERE mode = 's' AND (contains(id, q) OR contains(name, q))
   UNION SELECT query_id, id FROM asked, nodes WHERE mode = 't' AND id = q
   UNION SELECT query_id, id FROM asked, nodes WHERE mode = 't' AND q NOT IN (SELECT id FROM nodes) AND (contains(id, q) OR contains(name, q))),
 seeds AS (SELECT query_id, node_id, min(rank) AS rank FROM (SELECT query_id, id AS node_id, 0 AS rank FROM hit UNION ALL SELECT query_id, q, 1 FROM asked) GROUP BY ALL)"""


def _questions(spark):
    return spark.sql(QUESTIONS)


@query("E05_match_seeds", using("nodes") + ", " + _Q + " SELECT query_id, node_id, rank FROM seeds")
def e05(spark, sf):
    return I.match_seeds(P.nodes(spark, sf), _questions(spark))


ONE = "SELECT * FROM (VALUES ('q1', 'part:17', NULL, NULL)) AS v(query_id, target, symbol, file_path)"
_ONE_SEED = "SELECT 'q1' AS query_id, 'part:17' AS node_id, 0 AS rank"
DEPTH = 4


def _single(spark, sf):
    question = spark.sql(ONE.replace("NULL, NULL", "CAST(NULL AS STRING), CAST(NULL AS STRING)"))
    return I.impact_of_rows(P.nodes(spark, sf), P.edge_rows(spark, sf), question, DEPTH)


@query("E06_impact_query", using("active", "nodes") + walk_sql(_ONE_SEED, DEPTH) +
       "SELECT node_id, coalesce(n.kind, 'FUNCTION') AS kind, depth, round(confidence, 6) AS confidence FROM visited v LEFT JOIN nodes n ON n.id = v.node_id WHERE depth > 0")
def e06(spark, sf):
    out = _single(spark, sf)
    return out["reached"].select("node_id", "kind", "depth", r6("confidence").alias("confidence"))


@query("E06_affected_edges", using("active") + walk_sql(_ONE_SEED, DEPTH) +
       f"""SELECT id AS edge_id FROM active JOIN visited v ON v.node_id = from_id AND v.depth < {DEPTH}
           UNION SELECT id FROM active JOIN visited v ON v.node_id = to_id AND v.depth < {DEPTH}""")
def e06b(spark, sf):
    out = _single(spark, sf)
    return out["edges"].select("edge_id")


@query("E08_explanation_chain", using("active") + walk_sql(_ONE_SEED, DEPTH) + "SELECT node_id, chain FROM visited WHERE depth > 0")
def e08(spark, sf):
    out = _single(spark, sf)
    return out["reached"].select("node_id", "chain")


@query("E09_path_status", using("active") + walk_sql(_ONE_SEED, DEPTH, "upstream") +
       "SELECT node_id, CASE WHEN proven THEN 'confirmed' ELSE 'likely' END AS status FROM visited WHERE depth > 0")
def e09(spark, sf):
    edges = cut(Q.edge_quality(graph_edges(spark, sf)))
    seeds = spark.sql(_ONE_SEED)
    reached, _ = I.impact_batch(edges, seeds, "upstream", DEPTH)
    return reached.select("node_id", I.path_status().alias("status"))


_CHAIN = "CASE WHEN c >= 0.9 THEN 'confirmed' WHEN c >= 0.75 THEN 'high_probability' WHEN c >= 0.55 THEN 'needs_review' ELSE 'ambiguous' END"


@query("E10_chain_confidence", using("active") + walk_sql(_ONE_SEED, DEPTH) + f"""SELECT node_id, round(confidence, 6) AS path_confidence,
   round(c, 6) AS chain_confidence FROM (SELECT *, pow(product, 1.0 / depth) AS c FROM visited WHERE depth > 0)""")
def e10(spark, sf):
    out = _single(spark, sf)
    return out["reached"].select("node_id", r6("confidence").alias("path_confidence"), r6(I.chain_confidence()).alias("chain_confidence"))


@query("E11_chain_status", using("graded") + f"""SELECT id, CASE WHEN coalesce(status, '') IN ('ambiguous', 'suspicious') THEN 'ambiguous'
   WHEN NOT has_evidence THEN 'needs_review' ELSE {_CHAIN.replace('c >=', 'confidence >=')} END AS chain_status FROM graded""")
def e11(spark, sf):
    e = graph_edges(spark, sf)
    return e.select("id", I.chain_status(F.col("confidence"), F.coalesce("status", F.lit("")).isin("ambiguous", "suspicious"), ~F.col("has_evidence")).alias("chain_status"))


_CRIT = """CASE WHEN criticality IS NOT NULL THEN greatest(criticality, 0) ELSE CASE upper(kind) WHEN 'ROUTE' THEN 1.4 WHEN 'HTTP_ROUTE' THEN 1.4
   WHEN 'CLASS' THEN 1.2 WHEN 'METHOD' THEN 1.1 WHEN 'FUNCTION' THEN 1.0 WHEN 'TEST' THEN 0.7 WHEN 'EXTERNAL_LIBRARY' THEN 0.8 ELSE 1.0 END END"""


@query("E12_criticality", using("nodes") + f"SELECT id, CAST({_CRIT} AS DOUBLE) AS criticality FROM nodes")
def e12(spark, sf):
    return P.nodes(spark, sf).select("id", I.criticality().alias("criticality"))


_SCORED = f""", scored AS (SELECT v.node_id, depth, CAST(CASE WHEN n.id IS NULL THEN 1.0 ELSE {_CRIT} END AS DOUBLE) AS node_criticality,
   pow(product, 1.0 / depth) AS c FROM visited v LEFT JOIN nodes n ON n.id = v.node_id WHERE depth > 0),
 ranked AS (SELECT *, node_criticality * c * pow(0.85, depth) AS impact_score FROM scored)"""


@query("E13_rank_impact", using("active", "nodes") + walk_sql(_ONE_SEED, DEPTH) + _SCORED + f"""SELECT node_id, depth, node_criticality,
   round(c, 6) AS path_confidence, {_CHAIN} AS confidence_status, round(impact_score, 6) AS impact_score FROM ranked""")
def e13(spark, sf):
    out = _single(spark, sf)
    return I.rank_impact(out["reached"]).select("node_id", "depth", "node_criticality", r6("path_confidence").alias("path_confidence"),
                                                "confidence_status", r6("impact_score").alias("impact_score"))


@query("E13_top_impact", using("active", "nodes") + walk_sql(_ONE_SEED, DEPTH) + _SCORED +
       "SELECT node_id, round(impact_score, 6) AS impact_score FROM ranked ORDER BY round(impact_score, 6) DESC, node_id LIMIT 50")
def e13b(spark, sf):
    out = _single(spark, sf)
    scored = I.rank_impact(out["reached"]).withColumn("impact_score", r6("impact_score"))
    return I.top_impact(scored, 50).select("node_id", "impact_score")


_GROUP = """CASE upper(kind) WHEN 'FILE' THEN 'files' WHEN 'CLASS' THEN 'classes' WHEN 'FUNCTION' THEN 'functions' WHEN 'METHOD' THEN 'functions'
  WHEN 'ROUTE' THEN 'routes' WHEN 'TEST' THEN 'tests' WHEN 'EXTERNAL_LIBRARY' THEN 'external_libraries' ELSE lower(kind) || 's' END"""


@query("E14_group_affected", using("active", "nodes") + walk_sql(_ONE_SEED, DEPTH) + f"""SELECT {_GROUP} AS "group", count(*) AS n, min(node_id) AS first_id
  FROM (SELECT v.node_id, coalesce(n.kind, 'FUNCTION') AS kind FROM visited v LEFT JOIN nodes n ON n.id = v.node_id WHERE depth > 0) GROUP BY 1""")
def e14(spark, sf):
    out = _single(spark, sf)
    return I.group_affected(out["reached"]).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_id"))


# Every urgent order asks what it reaches downstream; one result set per order.
_ROUTE_SEEDS = "SELECT concat('r', o_orderkey) AS query_id, concat('order:', o_orderkey) AS node_id, 0 AS rank FROM @orders WHERE o_orderpriority = '1-URGENT'"
BATCH_DEPTH = 3


@query("E07_impact_batch", using("active") + walk_sql(_ROUTE_SEEDS, BATCH_DEPTH, "downstream") + """SELECT query_id, node_id, depth,
   round(confidence, 6) AS confidence FROM visited WHERE depth > 0""")
def e07(spark, sf):
    reached, _ = I.impact_batch_of_rows(P.edge_rows(spark, sf), P.run(spark, sf, _ROUTE_SEEDS), "downstream", BATCH_DEPTH,
                                        without=["edge_ids", "node_ids", "chain", "product", "proven", "ambiguous", "unresolved"])
    return reached.select("query_id", "node_id", "depth", r6("confidence").alias("confidence"))


# Exact questions: every part, some without any edge, and every missing target.
_PART_Q = "SELECT concat('part:', p_partkey) AS q FROM @part UNION SELECT concat('missing:', l_partkey) FROM @lineitem WHERE l_quantity = 1 UNION SELECT concat('ghost:', s_suppkey) FROM @supplier"
define("part_q", _PART_Q)


def _part_queries(spark, sf):
    q = P.run(spark, sf, _PART_Q).withColumn("query_id", F.col("q"))
    seeds = q.select("query_id", F.col("q").alias("node_id"), F.lit(0).alias("rank"))
    edges = cut(Q.edge_quality(graph_edges(spark, sf)))
    # One step expands the seeds alone, so the edges it touches need no walk.
    return q, seeds, edges, I.affected_edges(Q.active_edges(edges), seeds)


@query("E15_direct_neighbours", using("active", "part_q") + """SELECT DISTINCT q AS query_id, 'upstream' AS side, from_id AS node_id FROM part_q JOIN active ON to_id = q
  UNION SELECT q, 'downstream', to_id FROM part_q JOIN active ON from_id = q""")
def e15(spark, sf):
    q, _, edges, touched = _part_queries(spark, sf)
    return I.direct_neighbours(edges, touched, q)


@query("E16_query_diagnostics", using("active", "part_q", "nodes") + """, d AS (SELECT q AS query_id, (SELECT count(*) FROM nodes WHERE id = q) AS m,
   coalesce(e.n, 0) AS e, coalesce(a.n, 0) AS a FROM part_q
   LEFT JOIN (SELECT to_id AS q, count(*) AS n FROM edges GROUP BY 1) e USING (q) LEFT JOIN (SELECT to_id AS q, count(*) AS n FROM active GROUP BY 1) a USING (q))
  SELECT query_id, m AS matched_node_count, e AS matched_edge_endpoint_count, a AS active_edge_count, m > 0 AND a = 0 AS isolated,
   CASE WHEN m > 0 AND a = 0 THEN 'node_has_no_active_edges' WHEN m = 0 AND e = 0 THEN 'no_matching_node_or_edge_endpoint' END AS reason,
   CASE WHEN e > 0 AND a = 0 THEN 'query matched an edge endpoint but no active traversal edge' END AS warning FROM d""")
def e16(spark, sf):
    q, seeds, edges, touched = _part_queries(spark, sf)
    return I.query_diagnostics(q, seeds, edges, touched, P.nodes(spark, sf))


# One request per shipped line that names the kind wrongly for late lines, plus pairs nothing joins.
_REQUESTS = """SELECT concat('x', l_orderkey, '-', l_partkey, '-', l_linenumber) AS request_id, concat('order:', l_orderkey) AS from_id,
   concat('part:', l_partkey) AS to_id, CASE WHEN l_linenumber = 1 THEN 'TESTS' WHEN l_linenumber = 2 THEN 'CALLS' END AS kind FROM @lineitem
   GROUP BY l_orderkey, l_partkey, l_linenumber"""
define("requests", _REQUESTS)


@query("E17_explain_edges", using("graded", "requests") + f"""SELECT DISTINCT ON (request_id) r.request_id, r.from_id, r.to_id, g.id IS NOT NULL AS found, g.id AS edge_id,
   coalesce(confidence, 0.0) AS confidence, coalesce(source, 'UNKNOWN') AS source, quality AS status,
   CASE WHEN g.id IS NULL THEN concat('No edge found from ', r.from_id, ' to ', r.to_id, '.')
        WHEN source = 'INFERRED' THEN 'Edge was inferred via precision resolver resolution logic.' || CASE WHEN rule_id <> '' THEN '|Applied support pack rule: ' || rule_id ELSE '' END
        WHEN source = 'SUPPORT_PACK' THEN concat('Edge was produced by support pack rule: ', rule_id, '.')
        ELSE 'Edge was directly extracted from AST (extractor: unknown).' END AS reasoning_steps,
   CASE WHEN g.id IS NULL THEN concat('No edge connects ', r.from_id, ' and ', r.to_id, '.')
        ELSE concat_ws('|', CASE WHEN confidence < 0.7 THEN 'Low confidence edge (confidence < 0.70). Use with caution.' END, warning,
             CASE WHEN NOT has_evidence THEN 'edge has no evidence' END) END AS warnings
   FROM requests r LEFT JOIN graded g ON g.from_id = r.from_id AND g.to_id = r.to_id AND (r.kind IS NULL OR r.kind = g.kind) ORDER BY request_id, g.ord""")
def e17(spark, sf):
    out = I.explain_edges(graph_edges(spark, sf), P.run(spark, sf, _REQUESTS))
    return out.withColumns({"reasoning_steps": F.array_join("reasoning_steps", "|"), "warnings": F.array_join("warnings", "|")})


# From every urgent order to the region of the customer with the same number; many pairs are not connected.
_PAIRS = """SELECT concat('p', o_orderkey) AS query_id, concat('order:', o_orderkey) AS from_id, concat('region:', o_orderkey % 5) AS to_id
  FROM @orders WHERE o_orderpriority = '1-URGENT'"""
define("pairs", _PAIRS)


@query("E18_impact_path", using("active", "pairs") + walk_sql("SELECT query_id, from_id AS node_id, 0 AS rank FROM pairs", 3, best_first=True) + f"""
  SELECT p.query_id, p.from_id, p.to_id, v.node_id IS NOT NULL AS found, depth, coalesce(array_to_string(node_ids, '|'), '') AS node_ids,
   round(coalesce(confidence, 0.0), 6) AS confidence, round(pow(product, 1.0 / depth), 6) AS chain_confidence,
   CASE WHEN proven THEN 'confirmed' WHEN v.node_id IS NOT NULL THEN 'likely' END AS path_status
  FROM pairs p LEFT JOIN visited v ON v.query_id = p.query_id AND v.node_id = p.to_id""")
def e18(spark, sf):
    out = I.impact_path_of_rows(P.edge_rows(spark, sf), P.run(spark, sf, _PAIRS), max_depth=20)
    return out.select("query_id", "from_id", "to_id", "found", "depth", F.array_join("node_ids", "|").alias("node_ids"),
                      r6("confidence").alias("confidence"), r6("chain_confidence").alias("chain_confidence"), "path_status")


_TOKENS = "SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE n_chars END AS full_tokens, CAST(length(replace(text, ' ', '')) AS BIGINT) - 50 AS selected_tokens FROM @documents"


@query("E19_token_saving", f"""SELECT doc_id, CASE WHEN ok THEN 'measured' ELSE 'not_measured' END AS saving_status,
  round(CASE WHEN ok THEN r END, 6) AS saving_ratio, CASE WHEN ok THEN round(r * 100, 2) END AS saving_percent FROM (
  SELECT *, full_tokens IS NOT NULL AND full_tokens > 0 AND selected_tokens >= 0 AS ok,
   greatest(0.0, 1.0 - CAST(selected_tokens AS DOUBLE) / CAST(full_tokens AS DOUBLE)) AS r FROM ({_TOKENS}))""")
def e19(spark, sf):
    return I.token_saving(P.run(spark, sf, _TOKENS)).select("doc_id", "saving_status", r6("saving_ratio").alias("saving_ratio"), "saving_percent")
