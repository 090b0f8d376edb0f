"""Registered queries of symbol resolution (J) and rule packs (L)."""
from pyspark.sql import functions as F

from tremor.catalog.core import define, graph_edges, query, using
from tremor.operators import rules as L
from tremor.operators import symbols as S
from tremor.plans.loops import cut
from tremor.sources import projection as P

_NO = "CAST(floor(p_partkey / 20) AS BIGINT)"
# One module per twenty parts; every part is a class and a helper function, every fifth has its own method.
PARTS = f"SELECT p_partkey AS k, {_NO} AS no, p_partkey % 20 AS slot, p_size, lower(p_type) AS t FROM @part"
define("pp", PARTS)
NODES = f"""SELECT concat('module:pkg.s', s_suppkey) AS id, 'MODULE' AS kind, CAST(NULL AS STRING) AS class_name, CAST(NULL AS STRING) AS return_type, CAST(NULL AS STRING) AS base, s_suppkey AS no FROM @supplier
 UNION ALL SELECT concat('class:pkg.s', no, '.Part', k), 'CLASS', NULL, NULL, CASE WHEN slot > 0 AND p_size % 2 = 0 THEN concat('pkg.s', no, '.Part', k - 1) END, no FROM ({PARTS}) p
 UNION ALL SELECT concat('class:pkg.s', s_suppkey, '.Meta'), 'CLASS', NULL, NULL, NULL, s_suppkey FROM @supplier
 UNION ALL SELECT concat('method:pkg.s', no, '.Part', k, '.run'), 'METHOD', concat('Part', k), NULL, NULL, no FROM ({PARTS}) p WHERE slot % 5 = 0
 UNION ALL SELECT concat('method:pkg.s', no, '.helper', k), 'METHOD', NULL, concat('pkg.s', no, '.Part', k), NULL, no FROM ({PARTS}) p"""


def _tables(spark, sf):
    flat = P.run(spark, sf, NODES)
    n = F.col("no")
    aliases = F.create_map(F.lit("Near"), F.concat(F.lit("pkg.s"), n, F.lit(".Part"), n * 20), F.lit("far"), F.concat(F.lit("pkg.s"), n + 1), F.lit("fn"), F.concat(F.lit("pkg.hub.fn"), n))
    nodes = flat.withColumns({"bases": F.array_compact(F.array("base")), "import_aliases": F.when(F.col("kind") == "MODULE", aliases)})
    edges = P.run(spark, sf, "SELECT 'IMPORTS' AS kind, concat('module:pkg.s', s_suppkey) AS from_id, concat('module:pkg.s', s_suppkey + 1) AS to_id FROM @supplier")
    t = S.symbol_tables(nodes, edges)
    hub = P.run(spark, sf, "SELECT 'pkg.hub' AS module, concat('fn', s_suppkey) AS alias, concat('pkg.s', s_suppkey, '.helper', s_suppkey * 20) AS target FROM @supplier")
    t["aliases"] = t["aliases"].unionByName(hub)
    return {name: cut(df) for name, df in t.items()}


@query("J01_symbol_tables", """SELECT 'modules' AS name, count(*) AS n FROM @supplier UNION ALL SELECT 'classes', (SELECT count(*) FROM @part) + (SELECT count(*) FROM @supplier) UNION ALL SELECT 'methods', count(*) + count(*) FILTER (p_partkey % 5 = 0) FROM @part
   UNION ALL SELECT 'functions', count(*) FROM @part UNION ALL SELECT 'bases', count(*) FROM @part WHERE p_partkey % 20 > 0 AND p_size % 2 = 0 UNION ALL SELECT 'aliases', 4 * count(*) FROM @supplier UNION ALL SELECT 'imports', count(*) FROM @supplier""")
def j01(spark, sf):
    out = None
    for name, df in _tables(spark, sf).items():
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("J02_module_for_scope", using("pp") + "SELECT concat('pkg.s', no, '.Part', k, '.run') AS scope, concat('pkg.s', no) AS module FROM pp UNION ALL SELECT concat('other', k, '.x.y'), concat('other', k) FROM pp")
def j02(spark, sf):
    scopes = P.run(spark, sf, f"SELECT concat('pkg.s', no, '.Part', k, '.run') AS scope FROM ({PARTS}) p UNION ALL SELECT concat('other', k, '.x.y') FROM ({PARTS}) p")
    return S.module_for_scope(scopes, P.run(spark, sf, "SELECT concat('pkg.s', s_suppkey) AS module FROM @supplier UNION ALL SELECT 'pkg' FROM @region"))


@query("J03_canonical_class", using("pp") + "SELECT CASE p_size % 5 WHEN 0 THEN concat('pkg.s', no, '.Part', k) WHEN 1 THEN concat('s', no, '.Part', k) WHEN 2 THEN concat('root.s', no, '.Part', k) ELSE concat('Part', k) END AS name, concat('pkg.s', no, '.Part', k) AS full FROM pp WHERE p_size % 5 <> 4 UNION SELECT 'Meta', concat('pkg.s', min(CAST(no AS VARCHAR)), '.Meta') FROM pp")
def j03(spark, sf):
    names = P.run(spark, sf, f"SELECT CASE p_size % 5 WHEN 0 THEN concat('pkg.s', no, '.Part', k) WHEN 1 THEN concat('s', no, '.Part', k) WHEN 2 THEN concat('root.s', no, '.Part', k) WHEN 3 THEN concat('Part', k) ELSE 'Meta' END AS name FROM ({PARTS}) p")
    return S.canonical_class(names, _tables(spark, sf)["classes"])


_CLASS_REFS = f"SELECT concat('pkg.s', no) AS module, CASE p_size % 4 WHEN 0 THEN concat('Part', k) WHEN 1 THEN 'Near' WHEN 2 THEN concat('Part', (no + 1) * 20) ELSE 'Nope' END AS name FROM ({PARTS}) p"


@query("J04_resolve_class", using("pp") + """SELECT DISTINCT concat('pkg.s', no) AS module, CASE p_size % 4 WHEN 0 THEN concat('Part', k) WHEN 1 THEN 'Near' ELSE concat('Part', (no + 1) * 20) END AS name,
   CASE p_size % 4 WHEN 0 THEN concat('pkg.s', no, '.Part', k) WHEN 1 THEN concat('pkg.s', no, '.Part', no * 20) ELSE concat('pkg.s', no + 1, '.Part', (no + 1) * 20) END AS full FROM pp
   WHERE p_size % 4 IN (0, 1) OR (p_size % 4 = 2 AND no + 1 IN (SELECT no FROM pp))""")
def j04(spark, sf):
    return S.resolve_class(P.run(spark, sf, _CLASS_REFS), _tables(spark, sf))


@query("J05_resolve_function", using("pp") + """SELECT DISTINCT concat('pkg.s', no) AS module, concat('pkg.s', no, '.Part', k) AS parent, CASE p_size % 4 WHEN 0 THEN concat('helper', k) WHEN 1 THEN 'fn' ELSE concat('helper', (no + 1) * 20) END AS name,
   CASE p_size % 4 WHEN 0 THEN concat('pkg.s', no, '.helper', k) WHEN 1 THEN concat('pkg.s', no, '.helper', no * 20) ELSE concat('pkg.s', no + 1, '.helper', (no + 1) * 20) END AS full FROM pp
   WHERE p_size % 4 IN (0, 1) OR (p_size % 4 = 2 AND no + 1 IN (SELECT no FROM pp))""")
def j05(spark, sf):
    refs = P.run(spark, sf, f"SELECT concat('pkg.s', no) AS module, concat('pkg.s', no, '.Part', k) AS parent, CASE p_size % 4 WHEN 0 THEN concat('helper', k) WHEN 1 THEN 'fn' WHEN 2 THEN concat('helper', (no + 1) * 20) ELSE 'none' END AS name FROM ({PARTS}) p")
    return S.resolve_function(refs, _tables(spark, sf))


@query("J06_resolve_member", using("pp") + "SELECT DISTINCT concat('pkg.s', no) AS module, 'far' AS alias, concat('helper', k + 20) AS member, concat('pkg.s', no + 1, '.helper', k + 20) AS full FROM pp WHERE k + 20 IN (SELECT k FROM pp)")
def j06(spark, sf):
    return S.resolve_member(P.run(spark, sf, f"SELECT concat('pkg.s', no) AS module, 'far' AS alias, concat('helper', k + 20) AS member FROM ({PARTS}) p"), _tables(spark, sf))


@query("J07_resolve_method", using("pp") + """, up(start, k) AS (SELECT k, k FROM pp UNION SELECT u.start, u.k - 1 FROM up u JOIN pp ON pp.k = u.k WHERE pp.slot % 5 <> 0 AND pp.slot > 0 AND pp.p_size % 2 = 0)
  SELECT concat('pkg.s', s.no, '.Part', s.k) AS class_full, 'run' AS method, concat('pkg.s', e.no, '.Part', e.k, '.run') AS full FROM up JOIN pp s ON s.k = up.start JOIN pp e ON e.k = up.k WHERE e.slot % 5 = 0""")
def j07(spark, sf):
    return S.resolve_method(P.run(spark, sf, f"SELECT concat('pkg.s', no, '.Part', k) AS class_full, 'run' AS method FROM ({PARTS}) p"), _tables(spark, sf))


@query("J08_exact_calls", using("pp") + "SELECT 'CALLS' AS kind, concat('pkg.s', no, '.Part', k, '.run') AS from_id, concat('pkg.s', no, '.helper', k) AS to_id FROM pp WHERE p_size % 3 <> 0 UNION ALL SELECT 'RESOLVES_TO', concat('call:', k), concat('method:pkg.s', no, '.helper', k) FROM pp WHERE p_size % 3 <> 0")
def j08(spark, sf):
    calls = P.run(spark, sf, f"SELECT concat('call:', k) AS id, concat('pkg.s', no, '.Part', k, '.run') AS scope, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE concat('helper', k) END AS call_name, CAST(NULL AS STRING) AS receiver FROM ({PARTS}) p UNION ALL SELECT concat('m:', k), 'pkg.s0', 'a.b', 'a' FROM ({PARTS}) p")
    return S.exact_calls(calls, _tables(spark, sf)).select("kind", "from_id", "to_id")


_ASSIGN = f"""SELECT concat('a1:', k) AS id, concat('pkg.s', no, '.Part', k, '.run') AS scope, 'v' AS target, {{name}} AS call_name, '1' AS ord FROM ({PARTS}) p"""


@query("J09_assign_types", using("pp") + "SELECT concat('pkg.s', no, '.Part', k, '.run') AS scope, 'v' AS target, concat('pkg.s', no, '.Part', k) AS type, CASE WHEN p_size % 4 = 0 AND slot > 0 THEN array_to_string(list_sort([concat('pkg.s', no, '.Part', k), concat('pkg.s', no, '.Part', no * 20)]), '|') ELSE concat('pkg.s', no, '.Part', k) END AS candidates FROM pp")
def j09(spark, sf):
    first = P.run(spark, sf, _ASSIGN.format(name="concat('Part', k)"))
    second = P.run(spark, sf, f"SELECT concat('a2:', k) AS id, concat('pkg.s', no, '.Part', k, '.run') AS scope, 'v' AS target, 'Near' AS call_name, '2' AS ord FROM ({PARTS}) p WHERE p_size % 4 = 0")
    return S.assign_types(first.unionByName(second), _tables(spark, sf)).select("scope", "target", "type", F.array_join("candidates", "|").alias("candidates"))


@query("J10_factory_types", using("pp") + "SELECT concat('pkg.s', no, '.Part', k, '.run') AS scope, 'v' AS target, concat('pkg.s', no, '.Part', k) AS type FROM pp")
def j10(spark, sf):
    return S.factory_types(P.run(spark, sf, _ASSIGN.format(name="concat('helper', k)")), _tables(spark, sf))


@query("J16_test_routes", using("pp") + "SELECT concat('method:tests.test_', k) AS from_id, concat('HTTP ', CASE p_size % 3 WHEN 0 THEN 'POST' ELSE 'GET' END, ' /x', k) AS to_id, 'TESTS' AS kind, 0.75::DOUBLE AS confidence FROM pp WHERE p_size % 3 < 2")
def j16(spark, sf):
    calls = P.run(spark, sf, f"SELECT concat(CASE WHEN p_size % 3 = 2 AND p_size % 2 = 0 THEN 'app.run_' ELSE 'tests.test_' END, k) AS scope, CASE p_size % 3 WHEN 0 THEN 'client.Post' WHEN 1 THEN 'client.get' ELSE CASE WHEN p_size % 2 = 0 THEN 'client.get' ELSE 'other.get' END END AS call_name, concat('\"/x', k, '\"') AS a FROM ({PARTS}) p")
    return S.test_routes(calls.withColumn("args", F.array("a")))


_LASTS = "SELECT conv_id AS cid, max(turn) AS m FROM @conversations GROUP BY conv_id"


@query("J18_reexport_chains", f"""SELECT concat('c', cid, '.t0') AS target, CASE WHEN m = 0 OR cid % 7 = 0 THEN concat('c', cid, '.t0') ELSE concat('c', cid, '.t', m) END AS resolved, CAST(CASE WHEN m = 0 OR cid % 7 = 0 THEN 1 ELSE m END AS INT) AS hops,
   m = 0 OR cid % 7 = 0 AS ambiguous, CASE WHEN m = 0 OR cid % 7 = 0 THEN 0.55 ELSE 0.98 END::DOUBLE AS confidence FROM ({_LASTS})""")
def j18(spark, sf):
    exports = P.run(spark, sf, f"""SELECT concat('c', conv_id) AS module, concat('t', turn) AS name, concat('c', conv_id, '.t', turn + 1) AS target FROM @conversations JOIN ({_LASTS}) x ON cid = conv_id WHERE turn < m
      UNION ALL SELECT concat('c', cid), 't0', 'elsewhere' FROM ({_LASTS}) y WHERE cid % 7 = 0""")
    return S.reexport_chains(P.run(spark, sf, f"SELECT concat('c', cid, '.t0') AS target FROM ({_LASTS}) z"), exports)


@query("J20_dataflow_facts", """SELECT DISTINCT concat('a', o_orderkey) AS source, concat('f', o_custkey, '.x') AS target, 'ARG_TO_PARAM' AS kind, 0.95::DOUBLE AS confidence FROM @orders
  UNION SELECT DISTINCT p_type, concat('obj.', p_partkey), 'VALUE_TO_FIELD', 0.95 FROM @part WHERE p_size % 2 = 0 UNION SELECT DISTINCT concat('a.', p_type), concat('obj.', p_partkey), 'FIELD_TO_FIELD', 0.95 FROM @part WHERE p_size % 2 = 1
  UNION SELECT DISTINCT concat('a.', p_type), concat('obj.', p_partkey), 'DESTRUCTURE_BINDING', 0.9 FROM @part WHERE p_size % 2 = 1 UNION SELECT s_name, concat('make.return.k', s_suppkey), 'RETURN_KEY_TO_SYMBOL', 0.95 FROM @supplier""")
def j20(spark, sf):
    calls = P.run(spark, sf, "SELECT concat('f', o_custkey) AS function, concat('a', o_orderkey) AS a FROM @orders").withColumn("args", F.array("a", F.lit("extra")))
    params = P.run(spark, sf, "SELECT concat('f', c_custkey) AS function, 0 AS pos, 'x' AS name FROM @customer")
    assigns = P.run(spark, sf, "SELECT concat('obj.', p_partkey) AS target, CASE WHEN p_size % 2 = 0 THEN p_type ELSE concat('a.', p_type) END AS value, CASE WHEN p_size % 2 = 1 THEN 'destructure' ELSE 'name' END AS value_kind FROM @part")
    returns = P.run(spark, sf, "SELECT 'make' AS function, concat('k', s_suppkey) AS key, s_name AS value FROM @supplier")
    return S.dataflow_facts(calls, params, assigns, returns)


@query("J21_lookup_symbol", using("pp") + "SELECT CASE p_size % 4 WHEN 0 THEN concat('pkg.s', no, '.Part', k) WHEN 1 THEN concat('Part', k) ELSE concat('s', no, '.Part', k) END AS name, concat('pkg.s', no, '.Part', k) AS qualified FROM pp WHERE p_size % 4 < 3")
def j21(spark, sf):
    names = P.run(spark, sf, f"SELECT CASE p_size % 4 WHEN 0 THEN concat('pkg.s', no, '.Part', k) WHEN 1 THEN concat('Part', k) WHEN 2 THEN concat('s', no, '.Part', k) ELSE 'nope' END AS name FROM ({PARTS}) p")
    return S.lookup_symbol(names, P.run(spark, sf, f"SELECT concat('Part', k) AS name, concat('pkg.s', no, '.Part', k) AS qualified, k AS ord FROM ({PARTS}) p"))


@query("J22_binding_calls", """SELECT DISTINCT concat('o', o_orderkey) AS from_id, CASE WHEN o_orderpriority = '1-URGENT' THEN concat('lib.f', o_custkey) WHEN o_custkey % 2 = 0 THEN concat('T', o_custkey, '.go') ELSE concat('bound', o_custkey, '.go') END AS to_id,
   CASE WHEN o_orderpriority <> '1-URGENT' AND o_custkey % 2 = 1 THEN 0.65 ELSE 0.9 END::DOUBLE AS confidence FROM @orders""")
def j22(spark, sf):
    calls = P.run(spark, sf, "SELECT concat('o', o_orderkey) AS caller, CASE WHEN o_orderpriority = '1-URGENT' THEN concat('f', o_custkey) END AS function, concat('r', o_custkey) AS receiver, 'go' AS method FROM @orders")
    bindings = P.run(spark, sf, "SELECT concat('f', c_custkey) AS name, concat('call:lib.f', c_custkey) AS target FROM @customer UNION ALL SELECT concat('r', c_custkey), concat('bound', c_custkey) FROM @customer")
    types = P.run(spark, sf, "SELECT concat('r', c_custkey) AS name, concat('T', c_custkey) AS type FROM @customer WHERE c_custkey % 2 = 0")
    return S.binding_calls(calls, bindings, types).select("from_id", "to_id", "confidence")


_CHAIN = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(1 - 5 * l_discount, 2) AS confidence, l_quantity = 1 AS rejected, l_quantity <> 2 AS has_types, l_quantity <> 3 AS method_exists, l_suppkey % 3 AS candidates, l_linenumber AS chain_length FROM @lineitem"


@query("J26_chain_quality", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(c, 6) AS chain_confidence, CASE WHEN rejected THEN 'rejected' WHEN NOT has_types OR NOT method_exists THEN 'suspicious' WHEN candidates > 1 THEN CASE WHEN confidence >= 0.72 THEN 'likely' ELSE 'weak' END
    WHEN c >= 0.78 THEN 'confirmed' WHEN c >= 0.62 THEN 'likely' WHEN c >= 0.4 THEN 'weak' ELSE 'suspicious' END AS chain_status FROM (SELECT *, CASE WHEN rejected THEN least(confidence, 0.2) WHEN NOT has_types OR NOT method_exists THEN least(confidence, 0.5)
    WHEN candidates > 1 THEN CASE WHEN confidence >= 0.72 THEN least(confidence, 0.74) ELSE least(confidence, 0.64) END ELSE least(confidence, CASE WHEN chain_length >= 4 THEN 0.8 WHEN chain_length = 3 THEN 0.85 WHEN chain_length = 2 THEN 0.9 ELSE 1 END) END AS c FROM ({_CHAIN}))""")
def j26(spark, sf):
    return S.chain_quality(P.run(spark, sf, _CHAIN)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("chain_confidence", 6).alias("chain_confidence"), "chain_status")


@query("J29_flag_conflicts", using("edges") + """SELECT e.id, CASE WHEN c.n > 1 THEN least(confidence, 0.55) ELSE confidence END AS confidence, CASE WHEN c.n > 1 THEN 'ambiguous' ELSE status END AS status, CASE WHEN c.n > 1 THEN c.n END AS candidate_count FROM edges e
   LEFT JOIN (SELECT kind, from_id, count(DISTINCT to_id) AS n FROM edges WHERE source = 'SUPPORT_PACK' GROUP BY ALL) c ON c.kind = e.kind AND c.from_id = e.from_id AND e.source = 'SUPPORT_PACK'""")
def j29(spark, sf):
    return S.flag_conflicts(graph_edges(spark, sf)).select("id", "confidence", "status", "candidate_count")


# --- rules -------------------------------------------------------------------------------------

_PACKS = """SELECT p_partkey AS rule_no, CASE p_size % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'verified' WHEN 2 THEN 'official' WHEN 3 THEN NULL WHEN 4 THEN 'experimental' WHEN 5 THEN 'staged' ELSE 'verified_on_fixture' END AS status,
  CASE WHEN p_size % 11 = 0 THEN 'trusted' END AS trust_level, CAST(1.0 AS DOUBLE) AS emit_confidence FROM @part"""


@query("L01_active_rules", f"""SELECT rule_no, t AS trust_level, CASE t WHEN 'experimental' THEN 0.65 WHEN 'verified_on_fixture' THEN 0.8 WHEN 'verified_on_real_project' THEN 0.9 ELSE 0.95 END::DOUBLE AS emit_confidence FROM (
   SELECT rule_no, CASE WHEN trust_level IS NOT NULL THEN trust_level WHEN status = 'verified' THEN 'verified_on_real_project' WHEN status = 'official' THEN 'trusted' WHEN status IS NULL THEN 'experimental' ELSE status END AS t FROM ({_PACKS})) WHERE t NOT IN ('draft', 'staged')""")
def l01(spark, sf):
    return L.active_rules(P.run(spark, sf, _PACKS)).select("rule_no", "trust_level", "emit_confidence")


_ORIGINS = "SELECT concat('pack', p_partkey) AS pack, CASE p_size % 2 WHEN 0 THEN 'Python' ELSE 'go' END AS language, concat('Lib', floor(p_partkey / 4)) AS library, CASE p_size % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'registry' WHEN 2 THEN 'shared' ELSE 'project' END AS origin FROM @part".replace("floor(p_partkey / 4)", "CAST(floor(p_partkey / 4) AS BIGINT)")


@query("L02_pick_packs", f"SELECT DISTINCT ON (lower(language), lower(library)) lower(language) AS language, lower(library) AS library, pack, origin FROM ({_ORIGINS}) ORDER BY lower(language), lower(library), CASE origin WHEN 'project' THEN 0 WHEN 'shared' THEN 1 WHEN 'registry' THEN 2 ELSE 3 END, pack")
def l02(spark, sf):
    return L.pick_packs(P.run(spark, sf, _ORIGINS))


@query("L03_rule_scope", using("pp") + "SELECT concat('n', k) AS id, CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'go' END AS rule_language, concat('pkg.s', no) AS module FROM pp")
def l03(spark, sf):
    nodes = P.run(spark, sf, f"SELECT concat('n', k) AS id, concat('pkg.s', no, '.Part', k) AS scope, CASE p_size % 3 WHEN 0 THEN 'a/b.py' WHEN 1 THEN 'x.TSX' END AS file FROM ({PARTS}) p")
    modules = P.run(spark, sf, f"SELECT concat('pkg.s', no, '.Part', k) AS scope, concat('pkg.s', no) AS module, 'm.go' AS file FROM ({PARTS}) p")
    return L.rule_scope(nodes, modules).select("id", "rule_language", "module")


_RULE_SCHEMA = """library string, rule_id string, rule_type string, trust_level string, match_decorator string, match_parameter_type string, match_methods array<string>, match_receiver string, match_receiver_type string, match_imported_library string,
  match_call_name string, match_test_class_name string, match_kind string, match_method_name string, emit_from string, emit_to string, emit_kind string, emit_confidence double"""


def _rule(library, rule_id, rule_type, trust="trusted", **kw):
    order = [c.strip().split(" ")[0] for c in _RULE_SCHEMA.replace("\n", " ").split(",")]
    return tuple({"library": library, "rule_id": rule_id, "rule_type": rule_type, "trust_level": trust, **kw}.get(c) for c in order)


def _rules(spark):
    return spark.createDataFrame([
        _rule("web", "get", "decorator_entrypoint", match_decorator="@app.get", emit_kind="ROUTE_HANDLES"),
        _rule("jobs", "task", "task_entrypoint", "experimental", match_decorator="@task", emit_to="queue:{scope}"),
        _rule("db", "session", "constructor_injection", match_parameter_type="lib.Session", emit_to="db:session", emit_confidence=0.7),
        _rule("http", "send", "method_call_alias", match_methods=["send", "post"], match_receiver="client", match_imported_library="http"),
        _rule("http", "fetch", "framework_route", match_call_name="fetch", emit_to="HTTP GET /all"),
        _rule("test", "target", "test_target_pattern", match_test_class_name="Test"),
        _rule("std", "kind_call", "standard", match_kind="CALL_EXPR", match_call_name="client.send", emit_to="std:send", emit_kind="CALLS"),
        _rule("std", "method", "standard", match_method_name="post", match_imported_library="http.core", emit_to="std:post", emit_kind="CALLS", emit_confidence=0.6),
        _rule("std", "blank", "standard", match_call_name="fetch", emit_to=" ", emit_kind="CALLS"),
    ], _RULE_SCHEMA)


def _rule_nodes(spark, sf):
    flat = P.run(spark, sf, f"""SELECT concat('n:', k) AS id, CASE p_size % 4 WHEN 1 THEN 'CLASS' WHEN 2 THEN 'CALL_EXPR' ELSE 'METHOD' END AS kind, CASE p_size % 4 WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN concat('TestPart', k) ELSE concat('Part', k + 1) END ELSE concat('f', k) END AS name,
      CASE WHEN p_size % 4 = 1 THEN '' ELSE concat('pkg.s', no, '.f', k) END AS scope, concat('pkg.s', no) AS module, k, no, p_size FROM ({PARTS}) p""")
    i, j = F.col("p_size") % 4, F.col("p_size") % 3
    path = F.concat(F.when(j == 0, "@app.get('/x").when(j == 1, "@app.get_all('/y").otherwise("@task('/z"), F.col("k"), F.lit("')"))
    call = F.when(i == 2, F.when(j == 0, "client.send").when(j == 1, "fetch").otherwise("api.post"))
    return flat.withColumns({
        "decorators": F.when(i == 0, F.array(F.lit("@cached"), path)).otherwise(F.array().cast("array<string>")),
        "param_types": F.when(i == 3, F.create_map(F.lit("db"), F.when(j == 0, "lib.Session").otherwise("lib.Other"))).otherwise(F.lit(None).cast("map<string,string>")),
        "receiver_type": F.when((i == 3) & (j == 1), "lib.Session"), "call_name": call, "receiver": F.when(call.contains("."), F.substring_index(call, ".", 1)),
        "method_name": F.when(call.contains("."), F.element_at(F.split(call, r"\."), -1))})


def _imports(spark, sf):
    return P.run(spark, sf, "SELECT concat('pkg.s', s_suppkey) AS module, CASE WHEN s_suppkey % 2 = 0 THEN 'http.core' ELSE 'json' END AS imported FROM @supplier")


_RN = """SELECT k, no, p_size % 4 AS i, p_size % 3 AS j, concat('pkg.s', no, '.f', k) AS scope FROM pp"""


@query("L04_rule_decorator", using("pp") + f"SELECT concat('HTTP GET ', CASE j WHEN 0 THEN '/x' ELSE '/y' END, k) AS from_id, scope AS to_id, 'ROUTE_HANDLES' AS kind, 0.9::DOUBLE AS confidence FROM ({_RN}) WHERE i = 0 AND j < 2")
def l04(spark, sf):
    return L.rule_decorator(_rule_nodes(spark, sf), _rules(spark)).select("from_id", "to_id", "kind", "confidence")


@query("L05_rule_task", using("pp") + f"SELECT scope AS from_id, 'queue:' || scope AS to_id, 'DEPENDS_ON' AS kind FROM ({_RN}) WHERE i = 0 AND j = 2")
def l05(spark, sf):
    return L.rule_task(_rule_nodes(spark, sf), _rules(spark)).select("from_id", "to_id", "kind")


@query("L06_rule_injection", using("pp") + f"SELECT scope AS from_id, 'db:session' AS to_id, 0.7::DOUBLE AS confidence FROM ({_RN}) WHERE i = 3 AND j < 2")
def l06(spark, sf):
    return L.rule_injection(_rule_nodes(spark, sf), _rules(spark)).select("from_id", "to_id", "confidence")


@query("L07_rule_method_alias", using("pp") + f"SELECT scope AS from_id, 'external:http.send' AS to_id FROM ({_RN}) WHERE i = 2 AND j = 0 AND no % 2 = 0")
def l07(spark, sf):
    return L.rule_method_alias(_rule_nodes(spark, sf), _rules(spark), _imports(spark, sf)).select("from_id", "to_id")


@query("L08_rule_framework_route", using("pp") + f"SELECT scope AS from_id, 'HTTP GET /all' AS to_id FROM ({_RN}) WHERE i = 2 AND j = 1")
def l08(spark, sf):
    return L.rule_framework_route(_rule_nodes(spark, sf), _rules(spark)).select("from_id", "to_id")


@query("L09_rule_test_target", using("pp") + f", r AS ({_RN}) SELECT concat('n:', a.k) AS from_id, concat('n:', b.k) AS to_id FROM r a JOIN r b ON b.i = 1 AND b.j <> 0 AND b.k + 1 = a.k WHERE a.i = 1 AND a.j = 0")
def l09(spark, sf):
    return L.rule_test_target(_rule_nodes(spark, sf), _rules(spark)).select("from_id", "to_id")


@query("L14_rule_standard", using("pp") + f"SELECT scope AS from_id, 'std:send' AS to_id, 'kind_call' AS rule_id, 0.8::DOUBLE AS confidence FROM ({_RN}) WHERE i = 2 AND j = 0 UNION ALL SELECT scope, 'std:post', 'method', 0.6 FROM ({_RN}) WHERE i = 2 AND j = 2 AND no % 2 = 0 UNION ALL SELECT scope, ' ', 'blank', 0.8 FROM ({_RN}) WHERE i = 2 AND j = 1")
def l14(spark, sf):
    return L.rule_standard(_rule_nodes(spark, sf), _rules(spark), _imports(spark, sf)).select("from_id", "to_id", "rule_id", "confidence")


@query("L15_annotate_rule_edges", using("pp") + f"SELECT scope AS from_id, 'queue:' || scope AS to_id, 0.65::DOUBLE AS confidence, 'jobs' AS library FROM ({_RN}) WHERE i = 0 AND j = 2 UNION ALL SELECT scope, 'std:send', 0.8, 'std' FROM ({_RN}) WHERE i = 2 AND j = 0 UNION ALL SELECT scope, 'std:post', 0.6, 'std' FROM ({_RN}) WHERE i = 2 AND j = 2 AND no % 2 = 0")
def l15(spark, sf):
    nodes, rules = _rule_nodes(spark, sf), _rules(spark)
    edges = L.rule_task(nodes, rules).unionByName(L.rule_standard(nodes, rules, _imports(spark, sf)))
    return L.annotate_rule_edges(edges)[0].select("from_id", "to_id", "confidence", "library")


@query("L15_rule_edge_rejects", using("pp") + f"SELECT scope AS from_id, 'missing_endpoint' AS reason FROM ({_RN}) WHERE i = 2 AND j = 1")
def l15b(spark, sf):
    return L.annotate_rule_edges(L.rule_standard(_rule_nodes(spark, sf), _rules(spark), _imports(spark, sf)))[1].select("from_id", "reason")


def _drafts(spark, sf):
    flat = P.run(spark, sf, """SELECT 'lib' AS library, CASE WHEN p_size = 1 THEN '' ELSE concat('r', p_partkey) END AS rule_id, CASE WHEN p_size % 2 = 0 THEN 'standard' ELSE 'decorator_entrypoint' END AS rule_type, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'x' END AS emit_to,
      CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'LIKES' ELSE 'CALLS' END AS emit_kind, CASE WHEN p_size % 7 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS emit_confidence, p_size, CASE WHEN p_size % 4 = 0 THEN 'trusted' ELSE 'experimental' END AS trust_level, p_partkey FROM @part""")
    key = F.when(F.col("p_size") % 6 == 0, "method_name").otherwise("decorator")
    return flat.withColumn("match", F.when(F.col("p_size") % 8 == 0, F.lit(None).cast("map<string,string>")).otherwise(F.create_map(key, F.lit("v"))))


@query("L16_validate_rules", """SELECT p_partkey, e AS error FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN p_size = 1 THEN 'Missing rule id' END, CASE WHEN p_size % 8 = 0 THEN 'Missing ''match'' configuration' END, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'Emit missing ''to'' field' END,
   CASE WHEN p_size % 5 = 0 THEN 'Emit missing ''kind'' field' END, CASE WHEN p_size % 5 = 1 THEN 'Unknown edge kind' END, CASE WHEN p_size % 7 = 0 THEN 'Confidence outside [0, 1]' END], lambda x: x IS NOT NULL)) AS e FROM @part)""")
def l16(spark, sf):
    d = _drafts(spark, sf)
    return L.validate_rules(d.withColumn("library", F.col("p_partkey").cast("string"))).select(F.col("library").cast("bigint").alias("p_partkey"), "error")


@query("L17_validate_project_rules", """SELECT p_partkey, e AS error FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN p_size % 8 = 0 OR p_size % 6 = 0 THEN 'rule needs a strong match key' END, CASE WHEN p_size % 4 = 0 THEN 'project rules cannot be trusted' END], lambda x: x IS NOT NULL)) AS e FROM @part)""")
def l17(spark, sf):
    d = _drafts(spark, sf)
    return L.validate_project_rules(d.withColumn("library", F.col("p_partkey").cast("string"))).select(F.col("library").cast("bigint").alias("p_partkey"), "error")


@query("L20_registry_upsert", """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'new' WHEN p_size > 5 THEN 'old' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'new' END AS homepage, CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'unknown' END AS status FROM @part WHERE p_size > 5 OR p_size % 2 = 0""")
def l20(spark, sf):
    old = P.run(spark, sf, "SELECT p_partkey AS id, 'old' AS homepage, 'unknown' AS status FROM @part WHERE p_size > 5")
    new = P.run(spark, sf, "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'new' END AS homepage, 'active' AS status FROM @part WHERE p_size % 2 = 0")
    return L.registry_upsert(old, new, ["id"], ["homepage"], ["status"])


_VERSIONS = """SELECT concat('v', l_orderkey, '-', l_linenumber, '-', l_suppkey) AS pack_id, concat('python/lib', l_partkey) AS pack_key, concat('1.', l_orderkey, '.', l_linenumber, '.', l_suppkey) AS version, CASE l_returnflag WHEN 'A' THEN 'trusted' ELSE 'experimental' END AS trust_level,
   CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'retired' END AS status, l_shipdate AS created_at FROM @lineitem"""


@query("L20_registry_latest", f"SELECT DISTINCT ON (pack_key) pack_key, version, created_at FROM ({_VERSIONS}) WHERE status = 'active' ORDER BY pack_key, created_at DESC, version DESC")
def l20b(spark, sf):
    return L.registry_latest(P.run(spark, sf, _VERSIONS)).select("pack_key", "version", "created_at")


@query("L20_registry_overview", """SELECT (SELECT count(*) FROM @part) AS libraries_count, (SELECT count(*) FROM @lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS trusted_packs_count, (SELECT count(*) FROM @lineitem WHERE l_returnflag <> 'A' AND l_linestatus = 'O') AS experimental_packs_count,
   (SELECT count(*) FROM @orders WHERE o_orderstatus = 'O') AS pending_research_count, (SELECT count(*) FROM @pages WHERE page_id % 3 = 0) AS revalidation_candidates_count""")
def l20c(spark, sf):
    requests = P.run(spark, sf, "SELECT CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'done' END AS status FROM @orders")
    docs = P.run(spark, sf, "SELECT CASE WHEN page_id % 3 = 0 THEN 'x' END AS last_changed_at FROM @pages")
    return L.registry_overview(P.table(spark, sf, "part"), P.run(spark, sf, _VERSIONS), requests, docs)


@query("L20_registry_transition", f"SELECT pack_id, CASE WHEN status = 'retired' THEN 'draft' ELSE trust_level END AS trust_level, count(*) AS n FROM ({_VERSIONS}) GROUP BY ALL")
def l20d(spark, sf):
    v = P.run(spark, sf, _VERSIONS)
    moves = v.where("status = 'retired'").select("pack_id", F.lit("draft").alias("trust_level"), F.lit("bot").alias("reviewer")).distinct()
    keep = v.where("status = 'active'").join(moves.select("pack_id"), "pack_id", "left_anti").unionByName(v.where("status = 'retired'"))
    both = v.join(moves.select("pack_id").distinct(), "pack_id", "left_semi").where("status = 'active'").select("pack_id", "trust_level")
    out = L.registry_transition(keep, moves).select("pack_id", "trust_level").unionByName(both)
    return out.groupBy("pack_id", "trust_level").agg(F.count(F.lit(1)).alias("n"))


_KNOWN = "SELECT url, min(md5(CASE WHEN page_id % 4 = 0 THEN concat(html, 'x') ELSE html END)) AS content_hash, CAST(NULL AS STRING) AS last_changed_at FROM @pages WHERE page_id % 5 <> 0 GROUP BY url"
_SEEN = "SELECT url, min(md5(html)) AS content_hash, 'today' AS checked_at FROM @pages GROUP BY url"


@query("L21_doc_changes", f"""SELECT s.url, s.content_hash, CASE WHEN k.url IS NULL THEN 'new' WHEN k.content_hash <> s.content_hash THEN 'changed' ELSE 'same' END AS outcome, CASE WHEN k.content_hash <> s.content_hash THEN 'today' END AS last_changed_at
   FROM ({_SEEN}) s LEFT JOIN ({_KNOWN}) k ON k.url = s.url""")
def l21(spark, sf):
    return L.doc_changes(P.run(spark, sf, _KNOWN), P.run(spark, sf, _SEEN))


@query("L22_registry_search", "SELECT p_partkey, p_name AS name FROM @part WHERE p_size % 2 = 0 AND contains(lower(p_name), 'ring') AND p_size <> 4")
def l22(spark, sf):
    libs = P.run(spark, sf, "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'python' ELSE 'go' END AS ecosystem, CASE WHEN p_size = 4 THEN 'retired' ELSE 'active' END AS status FROM @part")
    return L.registry_search(libs, "Python", "active", "RING").select("p_partkey", "name")
