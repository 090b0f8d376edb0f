"""Registered queries of unknown regions (H), run confirmation (I) and evaluation (M)."""
from pyspark.sql import functions as F

from tremor.catalog.core import define, graph_edges, query, using
from tremor.operators import coverage as H
from tremor.operators import evaluate as M
from tremor.operators import runs as R
from tremor.plans.loops import cut
from tremor.sources import projection as P

# Call expressions: one per shipped line, some terminal, some with a receiver, in several languages.
CALL_NODES = """SELECT concat('call:', l_orderkey, ':', l_partkey, ':', l_linenumber, ':', l_suppkey) AS id, 'CALL_EXPR' AS kind, 'call' AS name,
   concat('src/lines/order_', CAST(floor(l_orderkey / 20) AS BIGINT), CASE l_suppkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END) AS file, max(l_linenumber) AS line,
   CASE WHEN max(l_quantity) <= 3 THEN 'print' WHEN max(l_quantity) <= 6 THEN 'logger.info' WHEN max(l_quantity) <= 9 THEN 'HTTP send'
        ELSE concat('svc.ship_', l_partkey) END AS call_name,
   CASE max(l_returnflag) WHEN 'A' THEN 'self.svc' WHEN 'N' THEN 'repo' END AS receiver, concat('ship_', l_partkey) AS method,
   concat('order:', l_orderkey) AS scope, CASE WHEN max(l_tax) > 0.075 THEN 'Ambiguous' END AS resolution_status,
   max(l_linestatus) AS flag, max(l_quantity) AS qty, max(l_discount) AS disc, l_partkey AS pk, l_orderkey AS ok
 FROM @lineitem GROUP BY l_orderkey, l_partkey, l_linenumber, l_suppkey"""
REGION_NODES = f"""SELECT id, kind, name, file, line, call_name, receiver, method, scope, resolution_status FROM ({CALL_NODES}) c
 UNION ALL SELECT concat('part:', p_partkey), 'FUNCTION', p_name, concat('src/part_', p_partkey, '.py'), p_size, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
   CAST(NULL AS STRING), CASE WHEN p_size = 7 THEN 'unresolved' END FROM @part"""
# Resolved calls, pack edges by place and by scope, and doubtful edges.
REGION_EDGES = f"""SELECT concat(from_id, '__', kind, '__', to_id) AS id, from_id, to_id, kind, source, rule_id, status, warning, ev_file, ev_line FROM (
  SELECT id AS from_id, concat('part:', pk) AS to_id, 'RESOLVES_TO' AS kind, CASE WHEN disc < 0.05 THEN 'EXTRACTED' ELSE 'INFERRED' END AS source, '' AS rule_id,
    CASE WHEN disc = 0.1 THEN 'suspicious' END AS status, CASE WHEN disc = 0.09 THEN 'ambiguous receiver' END AS warning, file AS ev_file, line AS ev_line
    FROM ({CALL_NODES}) c WHERE flag = 'O' AND qty > 20
  UNION ALL SELECT concat('pack:', p_partkey), concat('order:', p_partkey), 'PROVIDED_BY_SUPPORT_PACK', 'SUPPORT_PACK', 'scope_rule', CAST(NULL AS STRING), CAST(NULL AS STRING),
    concat('src/lines/order_', p_partkey, '.ts'), p_size % 7 + 1 FROM @part WHERE p_size <= 20) e"""
define("call_nodes", CALL_NODES)
define("rnodes", REGION_NODES)
define("redges", REGION_EDGES)
define("packed", """SELECT DISTINCT call_id, rule_id FROM (SELECT n.id AS call_id, e.rule_id FROM rnodes n JOIN redges e ON e.source = 'SUPPORT_PACK' AND e.ev_file = n.file AND e.ev_line = n.line WHERE n.kind = 'CALL_EXPR'
   UNION ALL SELECT n.id, e.rule_id FROM rnodes n JOIN redges e ON e.source = 'SUPPORT_PACK' AND e.to_id = n.scope WHERE n.kind = 'CALL_EXPR')""", ["rnodes", "redges"])
define("regions", """SELECT *, CASE WHEN kind = 'suspicious_edge' THEN 'suspicious' ELSE 'unresolved' END AS status,
   substr(sha256(concat_ws('|', kind, coalesce(file, 'None'), coalesce(scope, 'None'), coalesce(call_name, 'None'), coalesce(receiver, 'None'), coalesce(method, 'None'))), 1, 20) AS fingerprint FROM (
  SELECT 'unknown:unresolved_call:' || id AS region_id, id AS target_id, 'unresolved_call' AS kind, file, line, true AS has_evidence, call_name, receiver, method, scope,
    CASE WHEN receiver IS NOT NULL THEN 'unresolved_call_target' WHEN starts_with(call_name, 'HTTP ') OR contains(lower(call_name), 'route') THEN 'unresolved_route_prefix' ELSE 'unresolved_receiver' END AS taxonomy
    FROM rnodes n WHERE kind = 'CALL_EXPR' AND NOT EXISTS (SELECT 1 FROM packed WHERE call_id = n.id) AND NOT EXISTS (SELECT 1 FROM redges WHERE from_id = n.id)
  UNION ALL SELECT 'unknown:isolated_symbol:' || id, id, 'isolated_symbol', file, line, true, NULL, NULL, NULL, NULL, NULL FROM rnodes n WHERE kind = 'FUNCTION' AND NOT EXISTS (SELECT 1 FROM redges WHERE to_id = n.id)
  UNION ALL SELECT 'unknown:explicit_resolution_gap:' || id, id, 'explicit_resolution_gap', file, line, true, NULL, NULL, NULL, NULL, NULL FROM rnodes n
    WHERE lower(resolution_status) IN ('unresolved', 'ambiguous') AND NOT EXISTS (SELECT 1 FROM packed WHERE call_id = n.id)
  UNION ALL SELECT 'unknown:suspicious_edge:' || id, id, 'suspicious_edge', ev_file, ev_line, true, NULL, NULL, NULL, NULL, NULL FROM redges WHERE status = 'suspicious' OR warning IS NOT NULL)""", ["packed"])
define("rated", """SELECT *, CASE WHEN first = 'candidate' AND row_number() OVER (PARTITION BY first, kind, file, line, call_name, receiver, method ORDER BY (kind = 'suspicious_edge'), target_id) > 1 THEN 'duplicate' ELSE first END AS outcome,
   CASE WHEN kind = 'suspicious_edge' THEN 100 ELSE 60 END + CASE WHEN receiver IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN receiver LIKE 'self.%' THEN 15 ELSE 0 END + 10 AS score FROM (
   SELECT *, CASE WHEN kind = 'isolated_symbol' THEN 'isolated_symbol' WHEN kind = 'explicit_resolution_gap' THEN 'no_evidence' ELSE 'candidate' END AS first FROM regions)""", ["regions"])


def _region_graph(spark, sf):
    """Nodes, edges and places of evidence; the calls both hold are grouped once, and all are stored, as each kind of region reads them again."""
    calls = cut(P.run(spark, sf, CALL_NODES))
    of_calls = lambda sql: cut(spark.sql(P.spark_text(sql.replace(CALL_NODES, "SELECT * FROM {calls}"), sf), calls=calls))
    nodes, flat = of_calls(REGION_NODES), of_calls(REGION_EDGES)
    edges = flat.withColumn("warnings", F.when(F.col("warning").isNotNull(), F.array("warning")))
    evidence = flat.select(F.col("id").alias("edge_id"), F.col("ev_file").alias("file"), F.col("ev_line").alias("line"), F.lit("0").alias("ord"))
    return nodes, edges, evidence


def _regions(spark, sf):
    return H.unknown_regions(*_region_graph(spark, sf))


@query("H01_unknown_regions", using("regions") + "SELECT region_id, status, file, line, taxonomy, fingerprint FROM regions")
def h01(spark, sf):
    return _regions(spark, sf).select("region_id", "status", "file", "line", "taxonomy", "fingerprint")


@query("H02_resolved_by_pack", using("packed") + "SELECT * FROM packed")
def h02(spark, sf):
    nodes, edges, evidence = _region_graph(spark, sf)
    return H.resolved_by_pack(nodes.where("kind = 'CALL_EXPR'"), edges, evidence)


@query("H03_select_regions", using("rated") + "SELECT *, rank <= 2000 AS selected FROM (SELECT region_id, score, least(score, 100) AS priority, row_number() OVER (ORDER BY score DESC, region_id) AS rank FROM rated WHERE outcome = 'candidate')")
def h03(spark, sf):
    return H.select_regions(_regions(spark, sf)).select("region_id", "score", "priority", "rank", "selected")


@query("H03_selection_counts", using("rated") + """SELECT *, least(candidate_count, 2000) AS selected, greatest(candidate_count - 2000, 0) AS excluded_limit FROM (
   SELECT count(*) FILTER (outcome = 'candidate') AS candidate_count, count(*) FILTER (outcome = 'no_evidence') AS excluded_no_evidence,
   count(*) FILTER (outcome = 'isolated_symbol') AS excluded_isolated_symbol, count(*) FILTER (outcome = 'duplicate') AS excluded_duplicate FROM rated)""")
def h03b(spark, sf):
    return H.selection_counts(_regions(spark, sf))


_CHANGED = "SELECT concat('src/lines/order_', o_orderkey, '.py') AS file FROM @orders WHERE o_orderpriority = '1-URGENT'"


@query("H04_select_regions_for_change", using("rated") + f"SELECT *, rank <= 50 AS selected FROM (SELECT region_id, score, row_number() OVER (ORDER BY score DESC, region_id) AS rank FROM rated WHERE outcome = 'candidate' AND file IN ({_CHANGED}))")
def h04(spark, sf):
    return H.select_regions_for_change(_regions(spark, sf), P.run(spark, sf, _CHANGED)).select("region_id", "score", "rank", "selected")


@query("H05_research_requests", using("rated") + """SELECT 'ur-' || substr(sha256(region_id), 1, 16) AS request_id, region_id, rank FROM (
   SELECT region_id, row_number() OVER (ORDER BY score DESC, region_id) AS rank FROM rated WHERE outcome = 'candidate')""")
def h05(spark, sf):
    return H.research_requests(H.select_regions(_regions(spark, sf))).select("request_id", "region_id", "rank")


define("called", """SELECT n.*, CASE WHEN call_name IN ('print', 'logger.info') THEN 'external_terminal' WHEN p.call_id IS NOT NULL THEN 'pack' WHEN r.ex THEN 'exact'
    WHEN r.ex IS NOT NULL THEN 'inferred' ELSE 'unresolved' END AS outcome,
   CASE right(file, 3) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' ELSE 'go' END AS language
  FROM rnodes n LEFT JOIN (SELECT DISTINCT call_id FROM packed) p ON p.call_id = n.id
  LEFT JOIN (SELECT from_id, bool_or(source = 'EXTRACTED') AS ex FROM redges WHERE kind = 'RESOLVES_TO' GROUP BY 1) r ON r.from_id = n.id WHERE n.kind = 'CALL_EXPR'""", ["packed"])


def _called(spark, sf):
    nodes, edges, evidence = _region_graph(spark, sf)
    return H.classify_calls(nodes, edges, H.resolved_by_pack(nodes.where("kind = 'CALL_EXPR'"), edges, evidence))


@query("H06_resolution_coverage", using("called") + """SELECT *, round((resolved_exact + resolved_inferred) / eligible_for_resolution, 4) AS resolution_rate,
   round(actionable_unresolved / eligible_for_resolution, 4) AS actionable_unresolved_rate, true AS accounting_valid FROM (
  SELECT coalesce(language, '(all)') AS language, count(*) AS callsites_total, count(*) FILTER (outcome = 'exact') AS resolved_exact, count(*) FILTER (outcome IN ('inferred', 'pack')) AS resolved_inferred,
   count(*) FILTER (outcome = 'external_terminal') AS external_terminal, count(*) FILTER (outcome = 'unresolved') AS actionable_unresolved, count(*) FILTER (outcome = 'pack') AS support_pack_resolved,
   count(*) FILTER (outcome <> 'external_terminal') AS eligible_for_resolution FROM called GROUP BY ROLLUP (language))""")
def h06(spark, sf):
    return H.resolution_coverage(_called(spark, sf))


@query("H07_top_patterns", using("called") + """SELECT substr(sha256(regexp_replace(concat_ws('|', call_name, coalesce(receiver, ''), coalesce(method, ''), coalesce(scope, '')), '\\d+', '#', 'g')), 1, 16) AS fingerprint, count(*) AS n
  FROM called WHERE outcome IN ('external_terminal', 'unresolved') GROUP BY 1 ORDER BY n DESC, fingerprint LIMIT 20""")
def h07(spark, sf):
    return H.top_patterns(_called(spark, sf))


HYPOTHESES = """SELECT concat('h', l_orderkey, '-', l_partkey, '-', l_linenumber, '-', l_suppkey) AS hypothesis_id,
   CASE WHEN l_linenumber = 1 THEN concat('m', l_orderkey) END AS id, CASE WHEN l_quantity = 2 THEN '' ELSE concat('order:', l_orderkey) END AS from_id,
   CASE WHEN l_quantity = 1 THEN concat('missing:', l_partkey) ELSE concat('part:', l_partkey) END AS to_id,
   CASE WHEN l_discount = 0.1 THEN 'AFFECTS' WHEN l_discount = 0.09 THEN 'KNOWS' ELSE 'CALLS' END AS kind, max(1 - l_discount * 5) AS confidence
  FROM @lineitem GROUP BY ALL"""
HYPOTHESES = HYPOTHESES.replace("GROUP BY ALL", "GROUP BY l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_discount")
TRACED = """SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN concat('m', o_orderkey) END AS edge_id, concat('order:', l_orderkey) AS from_id, concat('part:', l_partkey) AS to_id, 'CALLS' AS kind
  FROM @lineitem JOIN @orders ON o_orderkey = l_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""
define("hyp", HYPOTHESES)
define("traced", TRACED)
define("judged", """SELECT h.*, CASE WHEN from_id = '' OR kind IN ('AFFECTS', 'KNOWS') THEN 'invalid edge contract'
   WHEN from_id NOT IN (SELECT id FROM nodes) OR to_id NOT IN (SELECT id FROM nodes) THEN 'hypothesis endpoint is not present in graph'
   WHEN NOT (coalesce(id IN (SELECT edge_id FROM traced WHERE edge_id IS NOT NULL), false) OR EXISTS (SELECT 1 FROM traced t WHERE t.from_id = h.from_id AND t.to_id = h.to_id AND t.kind = h.kind)) THEN 'no independent runtime evidence' END AS reason FROM hyp h""",
       ["hyp", "traced", "nodes"])


def _judged(spark, sf):
    return H.judge_hypotheses(P.run(spark, sf, HYPOTHESES), P.nodes(spark, sf), P.run(spark, sf, TRACED))


@query("H08_judge_hypotheses", using("judged") + "SELECT hypothesis_id, reason FROM judged")
def h08(spark, sf):
    return _judged(spark, sf).select("hypothesis_id", "reason")


@query("H08_promote_hypotheses", using("judged") + """SELECT coalesce(id, concat('runtime:', from_id, ':', kind, ':', to_id)) AS id, from_id, to_id, kind,
   round(least(0.98, greatest(0.8, confidence)), 6) AS confidence, 'confirmed' AS status FROM judged WHERE reason IS NULL""")
def h08b(spark, sf):
    return H.promote_hypotheses(_judged(spark, sf)).select("id", "from_id", "to_id", "kind", F.round("confidence", 6).alias("confidence"), "status")


# --- runs --------------------------------------------------------------------------------------

# Edges between an order's method and its customer's; dear orders also exist under a second package.
RUN_EDGES = """SELECT concat('e', o_orderkey) AS id, 'CALLS' AS kind, concat('method:app.orders.o', o_orderkey, '.place') AS from_id, concat('method:app.customers.c', o_custkey, '.bill') AS to_id,
   'INFERRED' AS source, CAST(0.85 AS DOUBLE) AS confidence FROM @orders
 UNION ALL SELECT concat('x', o_orderkey), 'CALLS', concat('lib.orders.o', o_orderkey, '.place'), concat('lib.customers.c', o_custkey, '.bill'), 'EXTRACTED', 0.7 FROM @orders WHERE o_totalprice > 400000
 UNION ALL SELECT concat('d', o_orderkey), 'CALLS', concat('app.orders.o', o_orderkey, '.place'), concat('app.customers.c', o_custkey, '.bill'), 'EXTRACTED', 0.7 FROM @orders WHERE o_totalprice < 20000"""
RUN_CALLS = """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN concat('app.orders.o', o_orderkey, '.place') WHEN '2-HIGH' THEN concat('orders.o', o_orderkey, '.place')
     WHEN '3-MEDIUM' THEN concat('o', o_orderkey, '.place') WHEN '4-NOT SPECIFIED' THEN concat('mono.app.orders.o', o_orderkey, '.place') ELSE concat('app.ghost.o', o_orderkey, '.place') END AS caller,
   CASE WHEN o_orderpriority = '3-MEDIUM' THEN concat('mono.app.customers.c', o_custkey, '.bill') WHEN o_orderpriority = '2-HIGH' THEN concat('c', o_custkey, '.bill')
     WHEN o_totalprice BETWEEN 100000 AND 120000 THEN concat('app.orders.o', o_orderkey, '.place') ELSE concat('app.customers.c', o_custkey, '.bill') END AS callee,
   CASE WHEN o_custkey % 37 = 0 THEN '.venv/lib/orders.py' WHEN o_custkey % 41 = 0 THEN 'src/generated/orders_pb.py' ELSE concat('src/orders/o', o_orderkey, '.py') END AS caller_file, CAST(o_custkey % 90 AS INT) AS caller_line,
   concat('src/customers/c', o_custkey, '.py') AS callee_file, CAST(o_custkey % 70 AS INT) AS callee_line, concat('tests/test_', o_custkey % 100, '.py::test_it') AS test_id,
   CAST(CASE WHEN o_custkey % 2 = 0 THEN 0.98 ELSE 0.9 END AS DOUBLE) AS confidence, concat('run_', o_orderstatus) AS run_id FROM @orders"""
RUN_CALLS = RUN_CALLS + " UNION ALL " + RUN_CALLS.replace("@orders", "@orders WHERE o_orderstatus = 'F'")
RUNS = "SELECT concat('run_', o_orderstatus) AS run_id, CASE WHEN o_orderstatus = 'O' THEN 'test_failed' ELSE 'ok' END AS status FROM @orders GROUP BY o_orderstatus"
define("run_edges", RUN_EDGES)
define("run_calls", RUN_CALLS)
define("kept_calls", "SELECT * FROM run_calls WHERE NOT contains(caller_file, '.venv') AND NOT contains(caller_file, '_pb.py')", ["run_calls"])
define("once", """SELECT DISTINCT * FROM kept_calls WHERE caller <> callee AND run_id <> 'run_O'""", ["kept_calls"])
define("npairs", "SELECT DISTINCT caller, callee FROM once", ["once"])
_N = "regexp_replace({}, '^(method:|function:|class:)', '')"
define("nedges", f"SELECT id, {_N.format('from_id')} AS f, {_N.format('to_id')} AS t, regexp_extract(from_id, 'o[0-9]+\\.place') AS k FROM run_edges", ["run_edges"])
define("xmatch", "SELECT caller, callee, count(*) AS n, min(id) AS id FROM npairs JOIN nedges ON f = caller AND t = callee GROUP BY ALL", ["npairs", "nedges"])
define("smatch", """SELECT caller, callee, count(*) AS n, min(id) AS id FROM npairs p JOIN nedges ON k = regexp_extract(caller, 'o[0-9]+\\.place')
   AND (f = caller OR ends_with(caller, '.' || f) OR ends_with(f, '.' || caller)) AND (t = callee OR ends_with(callee, '.' || t) OR ends_with(t, '.' || callee))
   WHERE NOT EXISTS (SELECT 1 FROM xmatch x WHERE x.caller = p.caller AND x.callee = p.callee) GROUP BY ALL""", ["xmatch"])
define("pair_match", "SELECT *, 'exact' AS how FROM xmatch UNION ALL SELECT *, 'suffix' FROM smatch", ["smatch"])
define("confirmed", """SELECT m.id AS edge_id, o.test_id, max(o.confidence) AS runtime_confidence FROM once o JOIN pair_match m ON m.caller = o.caller AND m.callee = o.callee WHERE m.n = 1 GROUP BY ALL""", ["pair_match"])


def _once(spark, sf):
    calls = R.filter_calls(P.run(spark, sf, RUN_CALLS), exclude=["*_pb.py"])
    return R.distinct_calls(calls, P.run(spark, sf, RUNS))


def _matched(spark, sf):
    calls = _once(spark, sf)
    edges = P.run(spark, sf, RUN_EDGES)
    return calls, edges, R.match_calls(calls, edges)


@query("I01_filter_calls", using("kept_calls") + "SELECT caller, callee, caller_file, test_id FROM kept_calls")
def i01(spark, sf):
    return R.filter_calls(P.run(spark, sf, RUN_CALLS), exclude=["*_pb.py"]).select("caller", "callee", "caller_file", "test_id")


@query("I02_distinct_calls", using("once") + "SELECT caller, callee, caller_file, caller_line, callee_file, callee_line, test_id FROM once")
def i02(spark, sf):
    return _once(spark, sf).select(*R.CALL_KEY)


@query("I03_match_calls", using("confirmed") + "SELECT * FROM confirmed")
def i03(spark, sf):
    return _matched(spark, sf)[2]["matched"].select("edge_id", "test_id", "runtime_confidence")


@query("I03_match_diagnostics", using("pair_match") + "SELECT caller, callee, n AS matches, CASE how WHEN 'exact' THEN 'warning' ELSE 'info' END AS level FROM pair_match WHERE n > 1")
def i03b(spark, sf):
    return _matched(spark, sf)[2]["diagnostics"].drop("message")


@query("I04_apply_confirmations", using("confirmed") + """SELECT e.id, greatest(confidence, coalesce(c.rc, 0)) AS confidence, c.id IS NOT NULL AS runtime_confirmed, coalesce(c.n, 0) AS confirming_tests,
   CASE WHEN c.id IS NOT NULL THEN source || '|RUNTIME_CONFIRMED' ELSE source END AS sources FROM run_edges e
   LEFT JOIN (SELECT edge_id AS id, max(runtime_confidence) AS rc, count(DISTINCT test_id) AS n FROM confirmed GROUP BY 1) c ON c.id = e.id""")
def i04(spark, sf):
    _, edges, m = _matched(spark, sf)
    return R.apply_confirmations(edges, m["matched"]).select("id", "confidence", "runtime_confirmed", "confirming_tests", F.array_join("sources", "|").alias("sources"))


@query("I04_observed_edges", using("pair_match") + """SELECT concat('runtime:', caller, ':CALLS:', callee) AS id, max(confidence) AS confidence, count(DISTINCT test_id) AS confirming_tests FROM once o
   WHERE NOT EXISTS (SELECT 1 FROM pair_match m WHERE m.caller = o.caller AND m.callee = o.callee AND m.n = 1) GROUP BY caller, callee""")
def i04b(spark, sf):
    return R.observed_edges(_matched(spark, sf)[2]["unmatched"]).select("id", "confidence", "confirming_tests")


@query("I05_run_summary", using("confirmed") + """SELECT (SELECT count(*) FROM once) AS runtime_calls, (SELECT count(DISTINCT test_id) FROM once) AS tests, (SELECT count(*) FROM confirmed) AS matched_edges,
   (SELECT count(*) FROM once o WHERE NOT EXISTS (SELECT 1 FROM pair_match m WHERE m.caller = o.caller AND m.callee = o.callee AND m.n = 1)) AS unmatched_calls""")
def i05(spark, sf):
    calls, _, m = _matched(spark, sf)
    return R.run_summary(calls, m["matched"], m["unmatched"])


# --- evaluation --------------------------------------------------------------------------------

EXPECTED = "SELECT concat('fx', l_suppkey % 10) AS fixture_id, concat('order:', l_orderkey) AS from_id, concat('part:', l_partkey) AS to_id, 'CALLS' AS kind FROM @lineitem WHERE l_tax < 0.03"
FORBIDDEN = """SELECT concat('fx', l_suppkey % 10) AS fixture_id, concat('order:', l_orderkey) AS from_id, concat('part:', l_partkey) AS to_id, 'TESTS' AS kind FROM @lineitem WHERE l_tax > 0.06
  UNION ALL SELECT 'fx_only_absent', concat('nation:', n_nationkey), 'nowhere', 'CALLS' FROM @nation"""
FIXTURES = "SELECT concat('fx', s_suppkey % 10) AS fixture_id, CASE WHEN s_suppkey % 10 < 4 THEN 'python' WHEN s_suppkey % 10 < 7 THEN 'go' ELSE 'typescript' END AS language, CASE WHEN s_suppkey % 10 = 3 THEN 'alias binding' ELSE 'binding' END AS rule_text FROM @supplier GROUP BY s_suppkey % 10"
define("want", EXPECTED)
define("bad", FORBIDDEN)
define("fixtures", FIXTURES)
_M = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fp + fn > 0 THEN 0.0 END, 6) AS precision_vs_forbidden,
   round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN tp + fp + fn > 0 THEN 1.0 END, 6) AS recall,
   round(CASE WHEN tp + fp + fn = 0 THEN NULL WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS f1,
   CASE WHEN tp + fp + fn = 0 THEN 'no_positive_cases' WHEN fp = 0 AND fn = 0 THEN 'passed' ELSE 'failed' END AS status"""
define("fcounts", """SELECT fixture_id, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp FROM (
   SELECT w.fixture_id, CASE WHEN e.id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN e.id IS NULL THEN 1 ELSE 0 END AS fn, 0 AS fp FROM (SELECT DISTINCT * FROM want) w LEFT JOIN edges e ON e.from_id = w.from_id AND e.to_id = w.to_id AND e.kind = w.kind
   UNION ALL SELECT b.fixture_id, 0, 0, CASE WHEN e.id IS NOT NULL THEN 1 ELSE 0 END FROM (SELECT DISTINCT * FROM bad) b LEFT JOIN edges e ON e.from_id = b.from_id AND e.to_id = b.to_id AND e.kind = b.kind) GROUP BY 1""", ["want", "bad", "edges"])
_OUT = f"tp AS true_positive, fn AS false_negative, fp AS false_positive, {_M}"


def _counts(spark, sf):
    return M.fixture_counts(graph_edges(spark, sf), P.run(spark, sf, EXPECTED), P.run(spark, sf, FORBIDDEN))


def _fixtures(spark, sf):
    return P.run(spark, sf, FIXTURES).withColumns({"rules": F.split("rule_text", " "), "positive_support": F.lit(True)})


@query("M01_edge_metrics", using("fcounts") + f"SELECT fixture_id, {_OUT} FROM fcounts")
def m01(spark, sf):
    return M.with_metrics(_counts(spark, sf))


define("by_level", """SELECT CASE WHEN grouping(language) = 1 THEN 'overall' ELSE 'language' END AS level, coalesce(language, '(all)') AS name, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp
   FROM fcounts JOIN fixtures USING (fixture_id) GROUP BY ROLLUP (language)
   UNION ALL SELECT 'rule', name, sum(tp)::BIGINT, sum(fn)::BIGINT, sum(fp)::BIGINT FROM (SELECT unnest(string_split(rule_text, ' ')) AS name, tp, fn, fp FROM fcounts JOIN fixtures USING (fixture_id)) GROUP BY name""", ["fcounts", "fixtures"])


@query("M02_metrics_by", using("by_level") + f"SELECT level, name, {_OUT} FROM by_level")
def m02(spark, sf):
    return M.metrics_by(_counts(spark, sf), _fixtures(spark, sf))


@query("M02_quality_gates", using("by_level") + """SELECT fp = 0 AS forbidden_violations_zero, tp / (tp + fp) >= 0.95 AS precision_at_least_0_95,
   (SELECT bool_and(tp > 0) FROM fcounts JOIN fixtures USING (fixture_id)) AS positive_support_has_tp FROM by_level WHERE level = 'overall'""")
def m02b(spark, sf):
    counts = _counts(spark, sf)
    return M.quality_gates(M.metrics_by(counts, _fixtures(spark, sf)), counts, _fixtures(spark, sf))


_STATE = "SELECT from_id, to_id, kind, min(confidence) AS confidence, min(CASE WHEN confidence < 0.6 THEN 'ambiguous' ELSE 'resolved' END) AS resolution_status FROM ({rows}) r WHERE {when} GROUP BY from_id, to_id, kind"
_B, _A = "shipped < DATE '2000-01-01'", "shipped >= DATE '1998-01-01'"
define("gb", _STATE.format(rows="SELECT * FROM edge_rows", when=_B), ["edge_rows"])
define("ga", _STATE.format(rows="SELECT * FROM edge_rows", when=_A), ["edge_rows"])


@query("M03_compare_graphs", using("gb", "ga", "bad") + """SELECT
   (SELECT count(*) > 0 FROM gb WHERE NOT EXISTS (SELECT 1 FROM ga WHERE ga.from_id = gb.from_id AND ga.to_id = gb.to_id AND ga.kind = gb.kind)) AS edge_removed,
   (SELECT count(*) > 0 FROM ga WHERE NOT EXISTS (SELECT 1 FROM gb WHERE ga.from_id = gb.from_id AND ga.to_id = gb.to_id AND ga.kind = gb.kind)) AS edge_added,
   (SELECT coalesce(bool_or(ga.resolution_status <> gb.resolution_status), false) FROM ga JOIN gb USING (from_id, to_id, kind)) AS status_changed,
   (SELECT coalesce(bool_or(ga.confidence < gb.confidence), false) FROM ga JOIN gb USING (from_id, to_id, kind)) AS confidence_lowered,
   (SELECT bool_or(resolution_status = 'ambiguous') FROM ga) AS ambiguous_or_confidence_lowered,
   (SELECT count(*) > 0 FROM ga JOIN gb ON ga.from_id = gb.from_id AND ga.kind = gb.kind AND ga.to_id <> gb.to_id) AS edge_target_changed,
   NOT EXISTS (SELECT 1 FROM ga JOIN bad USING (from_id, to_id, kind)) AS forbidden_edge_absent""")
def m03(spark, sf):
    state = lambda w: P.run(spark, sf, _STATE.format(rows=P.EDGE_ROWS, when=w))
    return M.compare_graphs(state(_B), state(_A), P.run(spark, sf, FORBIDDEN))


CHECKS = """SELECT concat('a', l_orderkey, '-', l_partkey, '-', l_linenumber, '-', l_suppkey) AS check_id, concat('proj', l_suppkey) AS project, CASE WHEN l_linenumber % 2 = 0 THEN 'required_edge' ELSE 'known_gap_edge' END AS type,
    concat('order:', l_orderkey) AS from_id, concat('part:', l_partkey) AS to_id, 'CALLS' AS kind, CAST(NULL AS STRING) AS needle FROM @lineitem GROUP BY l_orderkey, l_partkey, l_linenumber, l_suppkey
  UNION ALL SELECT concat('b', p_partkey), concat('proj', p_partkey % 90), CASE WHEN p_size % 2 = 0 THEN 'required_node_contains' ELSE 'known_gap_node_contains' END, NULL, NULL, NULL, concat('rt:', p_partkey, CASE WHEN p_size = 1 THEN 'zz' ELSE '' END) FROM @part
  UNION ALL SELECT concat('c', s_suppkey), concat('proj', s_suppkey), CASE WHEN s_suppkey % 2 = 0 THEN 'forbidden_edge_substring' ELSE 'known_gap_forbidden_edge_substring' END, NULL, NULL, NULL, concat('TESTS order:', s_suppkey, ' ->') FROM @supplier
  UNION ALL SELECT concat('d', n_nationkey), concat('proj', n_nationkey), CASE WHEN n_nationkey % 2 = 0 THEN 'expected_unknown_libraries' ELSE 'forbidden_unknown_libraries' END, NULL, NULL, NULL, n_name FROM @nation"""
UNKNOWN = "SELECT n_name AS name FROM @nation WHERE n_regionkey IN (1, 2)"
define("checks", CHECKS)
define("unknown_libs", UNKNOWN)
define("hits", """SELECT k.check_id FROM checks k SEMI JOIN edges e ON e.from_id = k.from_id AND e.to_id = k.to_id AND e.kind = k.kind WHERE k.type LIKE '%\\_edge' ESCAPE '\\'
   UNION SELECT w.check_id FROM (SELECT * FROM checks WHERE type LIKE '%node_contains') w JOIN (SELECT DISTINCT k.needle FROM (SELECT DISTINCT needle FROM checks WHERE type LIKE '%node_contains') k JOIN nodes n ON contains(n.id, k.needle)) h USING (needle)
   UNION SELECT w.check_id FROM (SELECT * FROM checks WHERE type LIKE '%substring') w JOIN (SELECT DISTINCT k.needle FROM (SELECT DISTINCT needle FROM checks WHERE type LIKE '%substring') k
     JOIN (SELECT DISTINCT concat(kind, ' ', from_id, ' -> ', to_id) AS t FROM edges) ON contains(t, k.needle)) h USING (needle)
   UNION SELECT k.check_id FROM checks k SEMI JOIN unknown_libs u ON u.name = k.needle WHERE NOT (k.type LIKE '%\\_edge' ESCAPE '\\' OR k.type LIKE '%node_contains' OR k.type LIKE '%substring')""",
   ["checks", "unknown_libs", "edges", "nodes"])
define("checked", "SELECT c.*, h.check_id IS NOT NULL AS found FROM checks c LEFT JOIN hits h USING (check_id)", ["hits"])
define("checked2", """SELECT *, CASE WHEN starts_with(type, 'known_gap_forbidden') THEN CASE WHEN found THEN 'known_gap' ELSE 'pass' END WHEN starts_with(type, 'known_gap') THEN CASE WHEN found THEN 'pass' ELSE 'known_gap' END
     WHEN starts_with(type, 'forbidden') THEN CASE WHEN found THEN 'fail' ELSE 'pass' END ELSE CASE WHEN found THEN 'pass' ELSE 'fail' END END AS check_status FROM checked""", ["checked"])


def _checked(spark, sf):
    return M.run_checks(P.run(spark, sf, CHECKS), P.nodes(spark, sf), graph_edges(spark, sf), P.run(spark, sf, UNKNOWN))


@query("M04_run_checks", using("checked2") + "SELECT check_id, type, found, check_status FROM checked2")
def m04(spark, sf):
    return _checked(spark, sf).select("check_id", "type", "found", "check_status")


@query("M04_check_status", using("checked2") + """SELECT project, count(*) AS checks, count(*) FILTER (check_status = 'fail') AS failed, count(*) FILTER (check_status = 'known_gap') AS known_gaps,
   CASE WHEN count(*) FILTER (check_status = 'fail') > 0 THEN 'failed' WHEN count(*) FILTER (check_status = 'known_gap') > 0 THEN 'known_gaps' ELSE 'ok' END AS status FROM checked2 GROUP BY project""")
def m04b(spark, sf):
    return M.check_status(_checked(spark, sf))


LISTED = """SELECT DISTINCT CASE WHEN l_tax < 0.03 THEN 'must_find' WHEN l_tax < 0.06 THEN 'should_find' ELSE 'must_not_find' END AS list, concat('order:', l_orderkey) AS from_id, concat('part:', l_partkey) AS to_id, 'CALLS' AS kind FROM @lineitem"""
define("listed", LISTED)


@query("M05_compare_expected", using("listed", "edges") + """SELECT l.list, l.from_id, l.to_id, l.kind, concat(list, '_', CASE WHEN list = 'must_not_find' THEN CASE WHEN e.id IS NULL THEN 'absent' ELSE 'present' END
   ELSE CASE WHEN e.id IS NULL THEN 'missing' ELSE 'found' END END) AS outcome FROM listed l LEFT JOIN edges e ON e.from_id = l.from_id AND e.to_id = l.to_id AND e.kind = l.kind""")
def m05(spark, sf):
    return M.compare_expected(graph_edges(spark, sf), P.run(spark, sf, LISTED))


@query("M06_determinism", using("edges") + "SELECT CAST(2 AS BIGINT) AS runs, true AS deterministic, count(*) AS row_count FROM edges")
def m06(spark, sf):
    cols = ("id", "kind", "source", "confidence", "rule_id", "status")
    # The rows of the second run come in another order; only the columns that its edges are made of are moved, and once.
    shuffled = cut(P.edge_rows(spark, sf).select("id", "from_id", "to_id", "kind", "rule_id", "source", "confidence", "status", "warnings", "ev_text", "ord").repartition(7))
    from tremor.operators.graph import dedupe_edges
    return M.determinism(graph_edges(spark, sf), dedupe_edges(shuffled), *cols)
