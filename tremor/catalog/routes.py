"""Registered queries of routes and endpoints (K) and page text (C12)."""
from pyspark.sql import functions as F

from tremor.catalog.core import define, query, using
from tremor.functions import paths as PA
from tremor.operators import routes as R
from tremor.operators import usage as U
from tremor.sources import projection as P

_C6 = lambda c: F.round(c, 6).alias("confidence")
_NO_HOST = "regexp_replace(url, '^[a-z]+://[^/?#]*', '')"
define("urls", f"SELECT page_id, CASE WHEN p = '' OR p LIKE '?%' THEN '/' || p ELSE p END AS rel FROM (SELECT page_id, regexp_replace({_NO_HOST}, '#.*$', '') AS p FROM @pages)")


@query("K01_canonical_path", using("urls") + """SELECT page_id, path, CAST(0 AS INT) AS dynamic_segments FROM (SELECT page_id, CASE WHEN c <> '/' THEN rtrim(c, '/') ELSE c END AS path FROM (
   SELECT page_id, regexp_replace('/' || split_part(rel, '?', 1), '/{2,}', '/', 'g') AS c FROM urls))""")
def k01(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", PA.canonical_path("url").alias("path")).withColumn("dynamic_segments", PA.dynamic_segments("path"))


@query("K02_canonical_query", using("urls") + """SELECT page_id, CASE WHEN contains(rel, '?') THEN array_to_string(list_sort(list_filter(string_split(split_part(rel, '?', 2), '&'), lambda x: x <> '')), '&') ELSE '' END AS query FROM urls""")
def k02(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", PA.canonical_query("url").alias("query"))


_EXPRS = """SELECT p_partkey, lower(CASE p_size % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'post' WHEN 2 THEN NULL ELSE 'Put' END) AS method, CASE p_size % 9
   WHEN 0 THEN concat('"/api/p', p_partkey, '/"') WHEN 1 THEN concat('`/api/p', p_partkey, '/${ item.id }?x=1`') WHEN 2 THEN concat('/api/p', p_partkey, '/:id/<kind>') WHEN 3 THEN concat('"/api/p', p_partkey, '/" + id')
   WHEN 4 THEN concat('"/api/p', p_partkey, '/" + encodeURIComponent(user.name) + "/x"') WHEN 5 THEN concat('api//p', p_partkey, '/{a}/{b}') WHEN 6 THEN '' WHEN 7 THEN concat('p', p_partkey) ELSE concat('/api/p', p_partkey) END AS route FROM @part"""
define("exprs", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN NULL ELSE 'PUT' END AS method, CASE p_size % 9 WHEN 0 THEN concat('/api/p', p_partkey) WHEN 1 THEN concat('/api/p', p_partkey, '/{param}')
   WHEN 2 THEN concat('/api/p', p_partkey, '/{param}/{param}') WHEN 3 THEN concat('/api/p', p_partkey, '/{param}') WHEN 4 THEN '/{param}{param}{param}' WHEN 5 THEN concat('/api/p', p_partkey, '/{param}/{param}')
   WHEN 6 THEN '/' WHEN 7 THEN concat('/p', p_partkey) ELSE concat('/api/p', p_partkey) END AS canonical_path,
   CASE p_size % 9 WHEN 1 THEN 'item_id' WHEN 2 THEN 'kind|id' WHEN 3 THEN 'id' WHEN 4 THEN concat('api_p', p_partkey, '|user_name|x') WHEN 5 THEN 'a|b' ELSE '' END AS param_names,
   CASE p_size % 9 WHEN 1 THEN 0.85 WHEN 3 THEN 0.65 WHEN 4 THEN 0.65 WHEN 6 THEN 0.3 WHEN 7 THEN 0.3 ELSE 0.95 END::DOUBLE AS route_confidence FROM @part""")


@query("K03_normalize_routes", using("exprs") + "SELECT * FROM exprs")
def k03(spark, sf):
    return R.normalize_routes(P.run(spark, sf, _EXPRS)).withColumn("param_names", F.array_join("param_names", "|")).drop("route")


_PARTS = "SELECT p_partkey, p_size % 3 = 0 AS two, p_type FROM @part"


@query("K04_endpoint_value", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('/api/p', p_partkey, '/{param}') WHEN 1 THEN concat('/api/p', p_partkey, '/{param}/x') WHEN 2 THEN NULL ELSE concat('/api/{param}/p', p_partkey) END AS endpoint FROM @part""")
def k04(spark, sf):
    part = P.table(spark, sf, "part").withColumns({"i": F.col("p_size") % 4, "key": F.concat(F.lit("p"), F.col("p_partkey"))})
    piece = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    lit = lambda *xs: piece("literal", F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs]))
    hole = piece("param", F.lit("id"))
    parts = (F.when(F.col("i") == 0, F.array(lit("/api/", F.col("key")), hole)).when(F.col("i") == 1, F.array(lit("/api//", F.col("key"), "/"), hole, lit("/x/")))
             .when(F.col("i") == 2, F.array(hole, lit("/x"))).otherwise(F.array(lit("/api/${ver}/", F.col("key"), "?q=1"))))
    return part.select("p_partkey", PA.endpoint_parts(parts).alias("endpoint"))


@query("K05_route_pairs", using("exprs") + """SELECT DISTINCT a.canonical_path, a.method AS left_method, b.method AS right_method FROM exprs a JOIN (SELECT canonical_path, CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE method END AS method FROM exprs) b USING (canonical_path)
   WHERE a.method IS NULL OR b.method IS NULL OR a.method = b.method""")
def k05(spark, sf):
    left = R.normalize_routes(P.run(spark, sf, _EXPRS))
    right = left.withColumn("method", F.when(F.col("p_partkey") % 2 == 0, "GET").otherwise(F.col("method")))
    return R.route_pairs(left, right)


_ROUTERS = "SELECT concat(conv_id, ':', turn) AS router, concat('/t', turn) AS prefix FROM @conversations"
_INCLUDES = "SELECT concat(conv_id, ':', turn - 1) AS parent, concat(conv_id, ':', turn) AS child, CASE WHEN turn % 2 = 0 THEN concat('c', turn, '/') ELSE '' END AS prefix, turn AS ord FROM @conversations WHERE turn > 0"
_ROUTES = "SELECT concat(conv_id, ':', turn) AS router, CASE role WHEN 'user' THEN 'get' ELSE 'post' END AS method, concat('/say/', conv_id) AS path, concat('h:', conv_id, ':', turn) AS handler FROM @conversations"
define("prefixed", "SELECT conv_id, turn, role, string_agg(CASE WHEN turn > 0 AND turn % 2 = 0 THEN concat('/c', turn, '/t', turn) ELSE concat('/t', turn) END, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix FROM @conversations")


@query("K06_compose_routes", using("prefixed") + "SELECT CASE role WHEN 'user' THEN 'GET' ELSE 'POST' END AS method, concat(prefix, '/say/', conv_id) AS path, concat('h:', conv_id, ':', turn) AS handler, 0.92::DOUBLE AS confidence FROM prefixed")
def k06(spark, sf):
    return R.compose_routes(P.run(spark, sf, _ROUTERS), P.run(spark, sf, _INCLUDES), P.run(spark, sf, _ROUTES))


@query("K07_object_routes", using("prefixed") + "SELECT concat('h:', conv_id, ':', turn) AS from_id, concat(prefix, '/say/', conv_id) AS to_id, 'ROUTE' AS kind, CASE role WHEN 'user' THEN 'GET' ELSE 'POST' END AS method, 0.95::DOUBLE AS confidence FROM prefixed")
def k07(spark, sf):
    late = P.run(spark, sf, _INCLUDES).select(F.lit("elsewhere").alias("parent"), "child", F.lit("/wrong").alias("prefix"), (F.col("ord") + 1000).alias("ord"))
    dec = P.run(spark, sf, _ROUTES).select(F.col("router").alias("object"), "method", "path", F.col("handler").alias("target"))
    return R.object_routes(P.run(spark, sf, _ROUTERS).withColumnRenamed("router", "object"), P.run(spark, sf, _INCLUDES).unionByName(late), dec)


@query("K07_ambiguous_parents", "SELECT concat(conv_id, ':', turn) AS child, 'elsewhere' AS parent, concat(conv_id, ':', turn - 1) AS kept FROM @conversations WHERE turn > 0")
def k07b(spark, sf):
    late = P.run(spark, sf, _INCLUDES).select(F.lit("elsewhere").alias("parent"), "child", F.lit("/wrong").alias("prefix"), (F.col("ord") + 1000).alias("ord"))
    return R.single_parents(P.run(spark, sf, _INCLUDES).unionByName(late))[1]


@query("K08_reject_conflicting_routes", """SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN 'AFFECTS' ELSE 'ROUTE_HANDLES' END AS kind, CASE WHEN p_size % 4 = 0 THEN 0.2 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN p_size % 4 = 0 THEN 'rejected' END AS status FROM @part""")
def k08(spark, sf):
    edges = P.run(spark, sf, """SELECT p_partkey AS k, concat('HTTP GET /x', p_partkey, CASE WHEN p_size % 4 = 1 THEN '/' ELSE '' END) AS from_id, concat('h:', p_partkey) AS to_id, 'ROUTE_HANDLES' AS kind, CAST(0.8 AS DOUBLE) AS confidence, CAST(NULL AS STRING) AS status FROM @part""")
    composed = P.run(spark, sf, """SELECT concat('h:', p_partkey) AS handler, CASE WHEN p_size % 4 = 2 THEN 'POST' ELSE 'get' END AS method, CASE WHEN p_size % 4 = 0 THEN concat('/v1/x', p_partkey) ELSE concat('/x', p_partkey) END AS path FROM @part WHERE p_size % 4 <> 3""")
    return R.reject_conflicting_routes(edges, composed).select("k", "kind", "confidence", "status")


@query("K09_evaluate_paths", """SELECT concat(n, p_partkey) AS def_id, CASE n WHEN 'base' THEN '/api' WHEN 'path' THEN concat('/api/p', p_partkey) WHEN 'fn' THEN concat('/api/p', p_partkey, '/{param}') ELSE concat('/api/p', p_partkey, '/', CASE WHEN p_size % 2 = 0 THEN '7' ELSE '{param}' END) END AS value,
   CASE n WHEN 'base' THEN 0.95 WHEN 'path' THEN 0.93 WHEN 'fn' THEN 0.9 ELSE CASE WHEN p_size % 3 = 0 THEN 0.9 ELSE 0.85 END END::DOUBLE AS confidence FROM @part, (VALUES ('base'), ('path'), ('fn'), ('use')) v(n) WHERE p_size <> 5""")
def k09(spark, sf):
    defs = P.run(spark, sf, """SELECT concat('base', p_partkey) AS def_id, 'm' AS module, '' AS ps FROM @part UNION ALL SELECT concat('path', p_partkey), 'm', '' FROM @part
      UNION ALL SELECT concat('fn', p_partkey), 'm', 'id' FROM @part UNION ALL SELECT concat('use', p_partkey), CASE WHEN p_size % 3 = 0 THEN 'm' ELSE 'other' END, '' FROM @part""")
    parts = P.run(spark, sf, """SELECT concat('base', p_partkey) AS def_id, 0 AS pos, CASE WHEN p_size = 5 THEN 'ref' ELSE 'literal' END AS kind, '/api' AS text, CASE WHEN p_size = 5 THEN concat('use', p_partkey) END AS target, CAST(NULL AS STRING) AS arg FROM @part
      UNION ALL SELECT concat('path', p_partkey), 0, 'ref', NULL, concat('base', p_partkey), NULL FROM @part UNION ALL SELECT concat('path', p_partkey), 1, 'literal', concat('/p', p_partkey), NULL, NULL FROM @part
      UNION ALL SELECT concat('fn', p_partkey), 0, 'ref', NULL, concat('path', p_partkey), NULL FROM @part UNION ALL SELECT concat('fn', p_partkey), 1, 'literal', '/', NULL, NULL FROM @part UNION ALL SELECT concat('fn', p_partkey), 2, 'param', 'id', NULL, NULL FROM @part
      UNION ALL SELECT concat('use', p_partkey), 0, 'call', NULL, concat('fn', p_partkey), CASE WHEN p_size % 2 = 0 THEN '7' END FROM @part""")
    return R.evaluate_paths(defs.select("def_id", "module", F.filter(F.array("ps"), lambda p: p != "").alias("params")), parts.withColumn("args", F.array("arg")).drop("arg"))


@query("K10_expand_exports", """SELECT concat('s', s_suppkey) AS module, 'a' AS local, concat('own.', s_suppkey) AS target FROM @supplier UNION ALL SELECT concat('n', n_nationkey), 'a', concat('reg.', n_regionkey) FROM @nation UNION ALL SELECT concat('n', n_nationkey), 'b', concat('regb.', n_regionkey) FROM @nation
   UNION ALL SELECT concat('s', s_suppkey), 'b', concat('regb.', n_regionkey) FROM @supplier JOIN @nation ON n_nationkey = s_nationkey UNION ALL SELECT concat('s', s_suppkey), concat('x', n_regionkey), concat('n', n_nationkey, '.x') FROM @supplier JOIN @nation ON n_nationkey = s_nationkey""")
def k10(spark, sf):
    imports = P.run(spark, sf, """SELECT concat('s', s_suppkey) AS module, '*' AS local, concat('n', s_nationkey) AS target FROM @supplier UNION ALL SELECT concat('s', s_suppkey), 'a', concat('own.', s_suppkey) FROM @supplier
      UNION ALL SELECT concat('n', n_nationkey), 'a', concat('reg.', n_regionkey) FROM @nation UNION ALL SELECT concat('n', n_nationkey), 'b', concat('regb.', n_regionkey) FROM @nation""")
    exports = P.run(spark, sf, "SELECT concat('n', n_nationkey) AS module, concat('x', n_regionkey) AS name, concat('n', n_nationkey, '.x') AS target FROM @nation UNION ALL SELECT concat('n', n_nationkey), 'b', 'shadowed' FROM @nation")
    return R.expand_exports(imports, exports)


_CALLS = """SELECT p_partkey AS call_id, CASE p_size % 8 WHEN 0 THEN 'fetch' WHEN 1 THEN 'apiClient.post' WHEN 2 THEN 'request' WHEN 3 THEN 'client.request' WHEN 4 THEN 'getJson' WHEN 5 THEN 'mystery' WHEN 6 THEN 'request' ELSE 'dup' END AS callee,
   CASE p_size % 8 WHEN 2 THEN 'put' WHEN 6 THEN 'fly' ELSE concat('/u', p_partkey) END AS a0, concat('/u', p_partkey) AS a1, p_size % 8 AS i, p_size FROM @part"""
define("wrapped", """SELECT p_partkey AS call_id, i, CASE i WHEN 0 THEN CASE WHEN p_size > 25 THEN 'POST' ELSE 'GET' END WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'GET' ELSE 'GET' END AS method, concat('/u', p_partkey) AS url_expr,
   CASE i WHEN 0 THEN 0.82 WHEN 1 THEN 0.89 WHEN 2 THEN 0.84 WHEN 3 THEN 0.84 WHEN 4 THEN 0.86 ELSE 0.4 END::DOUBLE AS confidence, i = 7 AS ambiguous FROM (SELECT *, p_size % 8 AS i FROM @part) WHERE i NOT IN (5, 6)""")


def _wrapped(spark, sf):
    none = F.lit(None).cast("map<string,string>")
    calls = P.run(spark, sf, _CALLS)
    p0 = F.when(F.col("i") == 3, F.create_map(F.lit("url"), F.col("a1"), F.lit("method"), F.lit("delete"))).otherwise(none)
    p1 = F.when((F.col("i") == 0) & (F.col("p_size") > 25), F.create_map(F.lit("method"), F.lit("post"))).otherwise(none)
    calls = calls.withColumn("args", F.array(F.struct(F.col("a0").alias("text"), p0.alias("props")), F.struct(F.col("a1").alias("text"), p1.alias("props"))))
    own = spark.createDataFrame([("dup", "GET", None, 0, None, None, None, 0.9), ("dup", "POST", None, 0, None, None, None, 0.9)], R.WRAPPER_SCHEMA)
    return R.resolve_wrappers(calls, R.default_wrappers(spark).unionByName(own))


@query("K11_resolve_wrappers", using("wrapped") + "SELECT call_id, method, url_expr, confidence, ambiguous FROM wrapped")
def k11(spark, sf):
    return _wrapped(spark, sf).select("call_id", "method", "url_expr", "confidence", "ambiguous")


@query("K12_frontend_http_calls", using("wrapped") + """SELECT concat('f', call_id) AS from_id, concat('HTTP ', method, ' ', url_expr, CASE WHEN call_id % 3 = 0 THEN '/{param}' ELSE '' END) AS to_id, confidence, CASE WHEN confidence >= 0.84 THEN 'confirmed' WHEN confidence >= 0.75 THEN 'likely' WHEN confidence >= 0.55 THEN 'weak' ELSE 'suspicious' END AS status FROM (
   SELECT * REPLACE (least(confidence, CASE WHEN call_id % 5 = 0 THEN 0.62 ELSE 0.93 END) AS confidence) FROM wrapped)""")
def k12(spark, sf):
    w = _wrapped(spark, sf)
    resolved = w.select(F.concat(F.lit("f"), "call_id").alias("function"), "method", F.concat("url_expr", F.when(F.col("call_id") % 3 == 0, "/${id}?b=2&a=1").otherwise("")).alias("value"),
                        F.col("confidence").alias("wrapper_confidence"), F.lit(0.93).alias("value_confidence"), (F.col("call_id") % 5 == 0).alias("unresolved"))
    return R.frontend_http_calls(resolved).select("from_id", "to_id", "confidence", "status")


_SVC = "concat('svc_', CAST(floor(p_partkey / 20) AS BIGINT))"
_TAIL = "CASE p_size % 5 WHEN 0 THEN '/{id}' WHEN 1 THEN '/:id/' WHEN 2 THEN '//<id>' WHEN 3 THEN '/items' ELSE '' END"
_CTAIL = "CASE p_size % 5 WHEN 0 THEN '/{param}' WHEN 1 THEN '/{param}' WHEN 2 THEN '/{param}' WHEN 3 THEN '/items' ELSE '' END"
_VERB = "CASE p_size % 4 WHEN 1 THEN 'POST' WHEN 3 THEN 'PUT' ELSE 'GET' END"
BACK = f"""SELECT {_SVC} AS service, lower({_VERB}) AS method, concat('/api/', lower(p_type), '/p', p_partkey, {{tail}}) AS path, concat('h:', p_partkey) AS handler, CAST(0.92 AS DOUBLE) AS confidence FROM @part
  UNION ALL SELECT {_SVC}, lower({_VERB}), concat('/api/', lower(p_type), '/p', p_partkey, {{tail}}), concat('g:', p_partkey), CAST(0.8 AS DOUBLE) FROM @part WHERE p_size % 7 = 0"""
FRONT = f"""SELECT DISTINCT {_SVC} AS service, CASE WHEN l_returnflag = 'N' THEN 'POST' ELSE 'GET' END AS method,
    concat(CASE WHEN l_linenumber = 7 THEN '/legacy/' ELSE '/api/' END, lower(p_type), '/p', p_partkey, CASE WHEN l_linenumber = 6 THEN '/gone' ELSE {_CTAIL} END) AS path, CAST(CASE WHEN l_returnflag = 'R' THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence
  FROM @lineitem JOIN @part ON p_partkey = l_partkey"""
define("back", "SELECT service, upper(method) AS method, path, handler, confidence FROM (" + BACK.format(tail=_CTAIL) + ")")
define("front", f"SELECT service, method, path, max(confidence) AS hc FROM ({FRONT}) GROUP BY ALL")
define("xm", "SELECT f.*, b.handler, b.confidence AS rc, count(*) OVER (PARTITION BY f.service, f.method, f.path) AS n FROM front f JOIN back b USING (service, method, path)", ["front", "back"])
_ST = "CASE WHEN c >= 0.84 THEN 'confirmed' WHEN c >= 0.75 THEN 'likely' WHEN c >= 0.55 THEN 'weak' ELSE 'suspicious' END"
define("endpoint_match", f"""SELECT service, method, path, 'matched' AS outcome, handler, n AS candidates, c AS confidence, {_ST} AS status FROM (SELECT *, least(hc, rc, CASE WHEN n > 1 THEN 0.78 ELSE 0.95 END) AS c FROM xm)
  UNION ALL SELECT f.service, f.method, f.path, CASE WHEN w.n IS NOT NULL THEN 'method_mismatch' WHEN s.n IS NOT NULL THEN 'suffix_only' ELSE 'unresolved' END, CASE WHEN w.n IS NOT NULL THEN w.h ELSE s.h END, coalesce(w.n, s.n, 0),
    CASE WHEN w.n IS NOT NULL THEN 0.0 WHEN s.n IS NOT NULL THEN 0.5 END, CASE WHEN w.n IS NOT NULL THEN 'rejected' WHEN s.n IS NOT NULL THEN 'suspicious' END FROM (SELECT * FROM front f WHERE NOT EXISTS (SELECT 1 FROM back b WHERE b.service = f.service AND b.method = f.method AND b.path = f.path)) f
   LEFT JOIN (SELECT service, path, count(*) AS n, min(handler) AS h FROM back GROUP BY ALL) w ON w.service = f.service AND w.path = f.path
   LEFT JOIN (SELECT service, method, string_split(path, '/')[-1] AS l, count(*) AS n, min(handler) AS h FROM back GROUP BY ALL) s ON s.service = f.service AND s.method = f.method AND s.l = string_split(f.path, '/')[-1]""", ["xm"])


def _matched(spark, sf):
    return R.match_routes(P.run(spark, sf, FRONT), P.run(spark, sf, BACK.format(tail=_TAIL)))


@query("K13_match_routes", using("endpoint_match") + "SELECT service, method, path, outcome, handler, candidates, round(confidence, 6) AS confidence, status FROM endpoint_match")
def k13(spark, sf):
    return _matched(spark, sf).withColumn("confidence", F.round("confidence", 6))


_LEFT = "SELECT concat('/v', p_size % 3, '/', lower(p_type), '/k', p_partkey) AS left_path, CASE WHEN p_size % 2 = 0 THEN 'get' END AS method, concat('c:', p_partkey) AS from_id FROM @part"
_RIGHT = """SELECT CASE p_size % 4 WHEN 0 THEN concat('/{v}/', lower(p_type), '/k', p_partkey) WHEN 1 THEN concat('/v', p_size % 3, '/:t/k', p_partkey, '/') WHEN 2 THEN concat('//v', p_size % 3, '/', lower(p_type), '/k', p_partkey) ELSE concat('/v9/{t}/k', p_partkey) END AS right_path,
   CASE WHEN p_size % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, concat('h:', p_partkey) AS handler FROM @part"""
define("tmpl", f"SELECT p.p_partkey AS k, l.left_path, l.method AS lm, r.right_path, r.method AS rm, CASE WHEN p_size % 4 = 2 THEN 1.0 ELSE 0.86 END::DOUBLE AS confidence FROM @part p JOIN ({_LEFT}) l ON l.from_id = concat('c:', p.p_partkey) JOIN ({_RIGHT}) r ON r.handler = concat('h:', p.p_partkey) WHERE p_size % 4 <> 3")


@query("K14_match_templates", using("tmpl") + "SELECT left_path, right_path, confidence FROM tmpl")
def k14(spark, sf):
    return R.match_templates(P.run(spark, sf, _LEFT), P.run(spark, sf, _RIGHT)).withColumn("confidence", F.round("confidence", 6))


@query("K15_propagate_endpoints", "SELECT concat('f', conv_id, ':', max(turn)) AS caller, concat('/c', conv_id) AS endpoint, CAST(max(turn) AS INT) AS depth FROM @conversations GROUP BY conv_id HAVING max(turn) BETWEEN 1 AND 12")
def k15(spark, sf):
    last = "SELECT conv_id AS cid, max(turn) AS m FROM @conversations GROUP BY conv_id"
    calls = P.run(spark, sf, f"""SELECT concat('f', conv_id, ':', turn) AS caller, concat('f', conv_id, ':', turn - 1) AS callee, 0 AS pos, 'p' AS value, CASE WHEN turn = m THEN concat('/c', conv_id) END AS path
      FROM @conversations JOIN ({last}) x ON cid = conv_id WHERE turn > 0""")
    sinks = P.run(spark, sf, "SELECT concat('f', conv_id, ':0') AS caller, 'fetch' AS callee, 0 AS pos, 'p' AS value, CAST(NULL AS STRING) AS path FROM @conversations WHERE turn = 0")
    params = P.run(spark, sf, "SELECT concat('f', conv_id, ':', turn) AS function, 0 AS pos, 'p' AS name FROM @conversations")
    return R.propagate_endpoints(sinks, calls, params)


@query("K16_match_http_edges", using("tmpl") + "SELECT concat('c:', k) AS from_id, concat('h:', k) AS to_id, confidence, 'MATCHES_ENDPOINT' AS kind FROM tmpl WHERE lm IS NULL OR upper(lm) = rm")
def k16(spark, sf):
    http = P.run(spark, sf, _LEFT).withColumnRenamed("left_path", "path")
    return R.match_http_edges(http, P.run(spark, sf, _RIGHT).withColumnRenamed("right_path", "path")).withColumn("confidence", F.round("confidence", 6))


_REL = """SELECT 'USES_HOOK' AS relation, concat('comp:', o_orderkey) AS from_id, concat('use', o_custkey) AS to_id FROM @orders UNION ALL SELECT 'EXPOSES_ACTION', concat('use', c_custkey), concat('act:', c_nationkey) FROM @customer
  UNION ALL SELECT 'FRONTEND_TEST_TARGET', concat('test:', s_suppkey), concat('comp:', s_nationkey) FROM @supplier UNION ALL SELECT 'OTHER', 'a', 'b' FROM @nation"""


@query("K17_frontend_relations", f"""SELECT DISTINCT from_id, to_id, relation, CASE relation WHEN 'FRONTEND_TEST_TARGET' THEN 'TESTS' ELSE 'DEPENDS_ON' END AS kind, CASE relation WHEN 'USES_HOOK' THEN 0.88 WHEN 'EXPOSES_ACTION' THEN 0.84 ELSE 0.82 END::DOUBLE AS confidence,
   CASE relation WHEN 'USES_HOOK' THEN 'confirmed' ELSE 'likely' END AS status FROM ({_REL}) WHERE relation <> 'OTHER'""")
def k17(spark, sf):
    return R.frontend_relations(P.run(spark, sf, _REL))


@query("K18_backend_routes", """SELECT CASE WHEN p_size % 3 = 0 THEN concat('HTTP GET /x', p_partkey) ELSE concat('r:', p_partkey) END AS from_id, CASE WHEN p_size % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN p_size % 3 = 0 THEN concat('/x', p_partkey) ELSE concat('/y', p_partkey) END AS path,
   CASE WHEN p_size % 2 = 0 THEN 'own' ELSE concat('h:', p_partkey) END AS handler, CASE WHEN p_size % 5 = 0 THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'flask' END AS framework FROM @part WHERE p_size % 3 <> 2 AND NOT (p_size % 2 = 1 AND p_size % 5 = 0)""")
def k18(spark, sf):
    nodes = P.run(spark, sf, """SELECT CASE WHEN p_size % 3 = 0 THEN concat('HTTP GET /x', p_partkey) ELSE concat('r:', p_partkey) END AS id, 'ROUTE' AS kind, CASE WHEN p_size % 3 = 1 THEN 'post' END AS method, CASE WHEN p_size % 3 = 1 THEN concat('/y', p_partkey) END AS path,
      CASE WHEN p_size % 2 = 0 THEN 'own' END AS handler, CAST(NULL AS DOUBLE) AS confidence FROM @part""")
    edges = P.run(spark, sf, """SELECT CASE WHEN p_size % 3 = 0 THEN concat('HTTP GET /x', p_partkey) ELSE concat('r:', p_partkey) END AS from_id, concat('h:', p_partkey) AS to_id, 'ROUTE_HANDLES' AS kind, CAST(0.9 AS DOUBLE) AS confidence, 'flask' AS framework, concat('o', p_partkey) AS ord FROM @part WHERE p_size % 5 <> 0""")
    return R.backend_routes(nodes, edges)


@query("K19_service_endpoints", using("back", "front") + "SELECT DISTINCT concat('c', f.service, f.method, f.path) AS from_id, handler AS to_id, 'MATCHES_ENDPOINT' AS kind, 0.78::DOUBLE AS confidence FROM front f JOIN back b USING (service, method, path)")
def k19(spark, sf):
    http = P.run(spark, sf, FRONT).withColumn("from_id", F.concat(F.lit("c"), "service", "method", "path"))
    return R.service_endpoints(http, P.run(spark, sf, BACK.format(tail=_TAIL)))


_DUP = "SELECT concat('order:', l_orderkey) AS from_id, concat('part:', l_partkey) AS to_id, CASE l_returnflag WHEN 'A' THEN 'ROUTES_TO' WHEN 'N' THEN 'HTTP_CALLS' ELSE 'WEIRD' END AS kind, 1 - 5 * l_discount AS confidence, CASE WHEN l_tax > 0.05 THEN 'suspicious' WHEN l_tax > 0.02 THEN 'likely' ELSE 'confirmed' END AS status FROM @lineitem"


@query("K20_best_endpoint_edges", f"SELECT from_id, to_id, kind, round(max(confidence), 6) AS confidence FROM ({_DUP}) GROUP BY ALL")
def k20(spark, sf):
    return R.best_endpoint_edges(P.run(spark, sf, _DUP)).select("from_id", "to_id", "kind", _C6("confidence"))


@query("K21_bridge_edges", f"""SELECT concat_ws('__', 'endpoint_bridge', k, from_id, to_id) AS id, k AS kind, kind AS original_kind, status FROM (SELECT DISTINCT from_id, to_id, kind, status, CASE kind WHEN 'ROUTES_TO' THEN 'MATCHES_ENDPOINT' ELSE kind END AS k FROM ({_DUP}) WHERE status <> 'suspicious' AND kind <> 'WEIRD')""")
def k21(spark, sf):
    return R.bridge_edges(P.run(spark, sf, _DUP)).select("id", "kind", "original_kind", "status").distinct()


@query("C11_usage_examples", """SELECT library, doc_id, pos, line FROM (SELECT library, doc_id, pos - 1 AS pos, trim(line) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM @documents) JOIN (SELECT DISTINCT lower(p_type) AS library FROM @part UNION ALL SELECT unnest(['reaux', 'the', 'License'])) ON contains(line, library))""")
def c11(spark, sf):
    libs = P.run(spark, sf, "SELECT DISTINCT lower(p_type) AS library FROM @part UNION ALL SELECT * FROM (VALUES ('reaux'), ('the'), ('License')) AS v(library)")
    return U.usage_examples(P.table(spark, sf, "documents").select(F.col("doc_id"), F.col("text").alias("content")), libs, "doc_id")


_MUTE = "<(script|style|head|meta|link|noscript)\\b[^>]*>.*?</(script|style|head|meta|link|noscript)\\s*>"


@query("C12_page_text", f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ') AS text FROM (
   SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '{_MUTE}', chr(1), 'gsi'), '<[A-Za-z/!][^>]*>', chr(1), 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM @pages)""")
def c12(spark, sf):
    return U.page_text(P.table(spark, sf, "pages")).select("page_id", "text")
