"""Routes and HTTP calls: composing, matching and bridging them."""
from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import columns as X
from tremor.functions import paths as PA
from tremor.plans.loops import CutTable

# Thresholds of the endpoint layer, and the HTTP verbs.
ENDPOINT_THRESHOLDS = (("confirmed", 0.84), ("likely", 0.75), ("weak", 0.55))
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def endpoint_status(confidence: Column) -> Column:
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return X.labels_when([(c >= t, s) for s, t in ENDPOINT_THRESHOLDS], "suspicious")


def normalize_routes(routes: DataFrame) -> DataFrame:
    """Add ``canonical_path``, ``param_names``, ``route_confidence`` and the upper-case method. routes: (route, method)."""
    return routes.withColumn("_r", PA.route_expression("route")).withColumns({
        "canonical_path": F.col("_r.path"), "param_names": F.col("_r.names"), "route_confidence": F.col("_r.confidence"),
        "method": F.upper("method")}).drop("_r")


def route_pairs(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Equivalent (method, path) keys of two normalised route tables; a loose match lets a missing method stand for any.

    Both sides are reduced to distinct keys, so a popular route is compared once.
    """
    key = lambda df, p: df.select(F.col("canonical_path"), F.col("method").alias(f"{p}_method")).distinct()
    both = key(left, "left").join(key(right, "right"), "canonical_path")
    if strict:
        same = F.coalesce("left_method", F.lit("*")) == F.coalesce("right_method", F.lit("*"))
    else:
        same = F.col("left_method").isNull() | F.col("right_method").isNull() | (F.col("left_method") == F.col("right_method"))
    return both.where(same)


# --- composition -------------------------------------------------------------------------------

def compose_prefixes(routers: DataFrame, includes: DataFrame, keep_cycle: bool = True) -> DataFrame:
    """(router, prefix): every full prefix of a router along its include edges, parents first.

    Walks from each router up to a root, one join per level; a router met twice ends the walk.
    routers: (router, prefix); includes: (parent, child, prefix).
    """
    local = CutTable(routers.groupBy("router").agg(F.max("prefix").alias("local"))).df
    ups = CutTable(includes.select(F.col("child").alias("at"), F.col("parent"), F.col("prefix").alias("inc")).distinct()).df
    known = local.select(F.col("router").alias("at"), "local")
    state = CutTable(local.select("router", F.col("router").alias("at"), F.lit("").alias("below"), F.array("router").alias("seen")))
    done = None
    while True:
        step = state.df.join(known, "at", "left").withColumn("local", F.coalesce("local", F.lit(""))).join(ups, "at", "left")
        step = CutTable(step)
        top = step.df.where("parent IS NULL").select("router", PA.join_paths(F.col("local"), F.col("below")).alias("prefix"))
        rise = step.df.where("parent IS NOT NULL").select(
            "router", F.col("parent").alias("at"), PA.join_paths(F.col("inc"), F.col("local"), F.col("below")).alias("below"),
            F.array_contains("seen", F.col("parent")).alias("again"), F.array_append("seen", F.col("parent")).alias("seen"))
        closed = rise.where("again").join(known, "at", "left")
        end = F.col("local") if keep_cycle else F.lit("")
        closed = closed.select("router", PA.join_paths(end, F.col("below")).alias("prefix"))
        part = top.unionByName(closed)
        done = part if done is None else done.unionByName(part)
        state = CutTable(rise.where("NOT again").drop("again"))
        if state.is_empty():
            break
    return done.distinct()


def compose_routes(routers: DataFrame, includes: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes with their full paths. routes: (router, method, path, handler)."""
    prefixes = compose_prefixes(routers, includes)
    return routes.join(prefixes, "router").select(
        F.upper("method").alias("method"), PA.join_paths(F.col("prefix"), F.col("path")).alias("path"), "handler", F.lit(0.92).alias("confidence")).distinct()


def single_parents(includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first include per child, ambiguous ones). includes: (parent, child, prefix, ord)."""
    first = includes.groupBy("child").agg(F.min_by(F.struct("parent", "prefix"), "ord").alias("f")).select("child", "f.parent", "f.prefix")
    clash = includes.join(first.select("child", F.col("parent").alias("kept")), "child").where("parent <> kept")
    return first, clash.select("child", "parent", "kept")


def object_routes(objects: DataFrame, includes: DataFrame, decorators: DataFrame) -> DataFrame:
    """Route edges of decorated handlers through a tree of composed objects. decorators: (object, method, path, target)."""
    parents, _ = single_parents(includes)
    prefixes = compose_prefixes(objects.select(F.col("object").alias("router"), "prefix"), parents, keep_cycle=False)
    return decorators.join(prefixes.withColumnRenamed("router", "object"), "object").select(
        F.col("target").alias("from_id"), PA.join_paths(F.col("prefix"), F.col("path")).alias("to_id"), F.lit("ROUTE").alias("kind"),
        F.upper("method").alias("method"), F.lit(0.95).alias("confidence"))


def reject_conflicting_routes(edges: DataFrame, composed: DataFrame) -> DataFrame:
    """Route edges whose path disagrees with the composed ones of the same handler and method are kept as
    rejected AFFECTS edges."""
    canon = lambda c: F.concat(F.lit("/"), F.btrim(c, F.lit("/")))
    method, path = F.regexp_extract("from_id", r"^HTTP (\S+) (.*)$", 1), F.regexp_extract("from_id", r"^HTTP (\S+) (.*)$", 2)
    marked = edges.withColumns({"_m": F.upper(method), "_p": canon(path)})
    known = composed.select(F.col("handler").alias("to_id"), F.upper("method").alias("_m"), F.lit(True).alias("_known")).distinct()
    same = composed.select(F.col("handler").alias("to_id"), F.upper("method").alias("_m"), canon(F.col("path")).alias("_p"), F.lit(True).alias("_same")).distinct()
    out = marked.join(known, ["to_id", "_m"], "left").join(same, ["to_id", "_m", "_p"], "left")
    bad = F.col("kind").isin("ROUTE_HANDLES", "MATCHES_ENDPOINT") & F.col("_known").isNotNull() & F.col("_same").isNull()
    return out.withColumns({
        "kind": F.when(bad, "AFFECTS").otherwise(F.col("kind")), "confidence": F.when(bad, F.least("confidence", F.lit(0.20))).otherwise(F.col("confidence")),
        "status": F.when(bad, "rejected").otherwise(F.col("status")),
        "rejection_reason": F.when(bad, "route path conflicts with module-qualified source route composition")}).drop("_m", "_p", "_known", "_same")


# --- matching ----------------------------------------------------------------------------------

def canonical_routes(routes: DataFrame) -> DataFrame:
    """Backend routes with upper-case method and canonical path. routes: (service, method, path, handler, confidence)."""
    return routes.withColumns({"method": F.upper(F.trim("method")), "path": PA.canonical_path("path"), "service": F.coalesce("service", F.lit(""))})


def match_routes(http: DataFrame, routes: DataFrame) -> DataFrame:
    """What each frontend endpoint (service, method, path, confidence) meets in the backend.

    outcome ``matched``: one row per handler of the same service, method and path, capped at .95,
    or .78 when there are several. Otherwise one row per endpoint: ``method_mismatch`` (same path,
    other method, rejected), ``suffix_only`` (same last segment, suspicious .50) or ``unresolved``.
    Near misses are summarised as a count with their first handler, not listed pair by pair.
    """
    key = ["service", "method", "path"]
    nodes = http.groupBy(*key).agg(F.max("confidence").alias("http_confidence"))
    back = canonical_routes(routes).groupBy(*key, "handler").agg(F.max("confidence").alias("route_confidence"))
    per_key = back.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    exact = nodes.join(back, key).join(per_key, key)
    conf = F.least("http_confidence", "route_confidence", F.when(F.col("n") > 1, 0.78).otherwise(0.95))
    hits = exact.select(*key, F.lit("matched").alias("outcome"), "handler", F.col("n").alias("candidates"), conf.alias("confidence"), endpoint_status(conf).alias("status"))
    rest = nodes.join(per_key, key, "left_anti")
    other = back.groupBy("service", "path").agg(F.count(F.lit(1)).alias("_wn"), F.min("handler").alias("_wh"))
    last = X.last_part("path")
    tail = back.groupBy("service", "method", last.alias("_last")).agg(F.count(F.lit(1)).alias("_sn"), F.min("handler").alias("_sh"))
    near = rest.withColumn("_last", last).join(other, ["service", "path"], "left").join(tail, ["service", "method", "_last"], "left")
    wrong, suffix = F.col("_wn").isNotNull(), F.col("_sn").isNotNull() & (F.col("_last") != "")
    missed = near.select(
        *key, F.when(wrong, "method_mismatch").when(suffix, "suffix_only").otherwise("unresolved").alias("outcome"),
        F.when(wrong, F.col("_wh")).when(suffix, F.col("_sh")).alias("handler"),
        F.when(wrong, F.col("_wn")).when(suffix, F.col("_sn")).otherwise(0).alias("candidates"),
        F.when(wrong, 0.0).when(suffix, 0.50).alias("confidence"), F.when(wrong, "rejected").when(suffix, "suspicious").alias("status"))
    return hits.unionByName(missed)


def _template(path: Column | str) -> tuple[Column, Column]:
    """(segments, mask) with mask marking literal segments 1 and placeholders 0."""
    segments = F.filter(F.split(PA.canonical_path(path), "/"), lambda s: s != "")
    return segments, F.array_join(F.transform(segments, lambda s: F.when(s == "{param}", "0").otherwise("1")), "")


def match_templates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_path, right_path, confidence) of paths that agree wherever both are literal.

    Not joined on segment count: for every pair of literal masks that occurs (a small table of
    shapes) both sides are keyed by the segments literal in both, and the keys are equal exactly
    when the paths match.
    """
    def shaped(df, p):
        segments, mask = _template(f"{p}_path")
        return df.select(f"{p}_path").distinct().select(f"{p}_path", segments.alias(f"{p}_seg"), mask.alias(f"{p}_mask"), PA.canonical_path(f"{p}_path").alias(f"{p}_canon"))

    lhs, rhs = shaped(left, "left"), shaped(right, "right")
    lm = lhs.select("left_mask", F.length("left_mask").alias("n")).distinct()
    rm = rhs.select("right_mask", F.length("right_mask").alias("n")).distinct()
    shapes = lm.join(rm, "n").drop("n")

    def key(seg):
        both = F.zip_with(F.split("left_mask", ""), F.split("right_mask", ""), lambda a, b: (a == "1") & (b == "1"))
        return F.array_join(F.zip_with(seg, both, lambda s, keep: F.when(keep, s).otherwise("*")), "/")

    lk = lhs.join(shapes, "left_mask").withColumn("_k", key(F.col("left_seg")))
    rk = rhs.join(shapes, "right_mask").withColumn("_k", key(F.col("right_seg")))
    pairs = lk.join(rk.select("right_path", "right_seg", "right_canon", "left_mask", "right_mask", "_k"), ["left_mask", "right_mask", "_k"])
    literal = F.size(F.filter(F.zip_with("left_seg", "right_seg", lambda a, b: a == b), lambda x: x))
    holes = F.exists(F.zip_with("left_seg", "right_seg", lambda a, b: a != b), lambda x: x)
    conf = F.when(F.col("left_canon") == F.col("right_canon"), 1.0).when(
        holes, F.least(F.lit(0.95), 0.82 + F.least(F.lit(0.13), literal * 0.02))).otherwise(0.95)
    return pairs.select("left_path", "right_path", conf.alias("confidence"))


def match_http_edges(http: DataFrame, routes: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """MATCHES_ENDPOINT edges where the templates match and the methods do not disagree.

    http: (from_id, method, path); routes: (handler, method, path).
    """
    found = match_templates(http.select(F.col("path").alias("left_path")), routes.select(F.col("path").alias("right_path"))).where(F.col("confidence") >= min_confidence)
    h = http.select(F.col("from_id"), F.upper("method").alias("_hm"), F.col("path").alias("left_path"))
    r = routes.select(F.col("handler").alias("to_id"), F.upper("method").alias("_rm"), F.col("path").alias("right_path"))
    out = found.join(h, "left_path").join(r, "right_path").where(F.col("_hm").isNull() | F.col("_rm").isNull() | (F.col("_hm") == F.col("_rm")))
    return out.groupBy("from_id", "to_id").agg(F.max("confidence").alias("confidence")).withColumn("kind", F.lit("MATCHES_ENDPOINT"))


def service_endpoints(http: DataFrame, routes: DataFrame) -> DataFrame:
    """Same-service path matches of the typed languages at .78. http: (service, from_id, method, path)."""
    r = routes.select("service", F.upper("method").alias("_rm"), PA.canonical_path("path").alias("path"), "handler").distinct()
    h = http.select("service", "from_id", F.upper("method").alias("_hm"), PA.canonical_path("path").alias("path")).distinct()
    out = h.join(r, ["service", "path"]).where(F.col("_hm").isNull() | (F.col("_hm") == F.col("_rm")))
    return out.select("from_id", F.col("handler").alias("to_id"), F.lit("MATCHES_ENDPOINT").alias("kind"), F.lit(0.78).alias("confidence")).distinct()


def backend_routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes of a graph: ROUTE nodes named ``HTTP METHOD path`` with handler, best confidence and framework."""
    pattern = r"^HTTP (\S+) (.*)$"
    base = nodes.where("kind = 'ROUTE'").select(
        F.col("id").alias("from_id"), F.coalesce(F.nullif(F.regexp_extract("id", pattern, 1), F.lit("")), F.upper("method")).alias("method"),
        F.coalesce(F.nullif(F.regexp_extract("id", pattern, 2), F.lit("")), F.col("path")).alias("path"),
        F.nullif("handler", F.lit("")).alias("_h"), F.coalesce("confidence", F.lit(0.85)).alias("_c")).where("method IS NOT NULL AND path IS NOT NULL")
    hits = edges.where("kind IN ('ROUTE_HANDLES', 'MATCHES_ENDPOINT')").groupBy("from_id").agg(
        F.min_by("to_id", "ord").alias("_to"), F.max("confidence").alias("_ec"),
        F.max_by("framework", F.when(F.col("framework").isNotNull(), F.col("ord"))).alias("_f"))
    out = base.join(hits, "from_id", "left")
    return out.select("from_id", "method", "path", F.coalesce("_h", "_to").alias("handler"), F.greatest("_c", "_ec").alias("confidence"),
                      F.coalesce("_f", F.lit("unknown")).alias("framework")).where("handler IS NOT NULL")


def best_endpoint_edges(edges: DataFrame) -> DataFrame:
    """The most confident edge per (from, to, kind)."""
    rest = [c for c in edges.columns if c not in ("from_id", "to_id", "kind")]
    best = edges.groupBy("from_id", "to_id", "kind").agg(F.max(F.struct("confidence", *[c for c in rest if c != "confidence"])).alias("b"))
    return best.select("from_id", "to_id", "kind", *[F.col(f"b.{c}").alias(c) for c in rest])


# Graph kind of each bridge edge kind.
BRIDGE_KINDS = {"ROUTES_TO": "MATCHES_ENDPOINT", "USES_HOOK": "DEPENDS_ON", "EXPOSES_ACTION": "DEPENDS_ON", "HTTP_CALLS": "HTTP_CALLS"}


def bridge_edges(edges: DataFrame) -> DataFrame:
    """Endpoint edges fit for the graph: active statuses only, kinds mapped, ids derived from the content."""
    kept = edges.where(F.col("status").isin("confirmed", "likely", "weak") & (F.coalesce("from_id", F.lit("")) != "") & (F.coalesce("to_id", F.lit("")) != ""))
    kept = kept.withColumns({"original_kind": F.col("kind"), "kind": X.lookup("kind", BRIDGE_KINDS)}).where("kind IS NOT NULL")
    return kept.withColumn("id", F.concat_ws("__", F.lit("endpoint_bridge"), "kind", "from_id", "to_id"))


# --- wrappers and calls ------------------------------------------------------------------------

# Built-in call styles (name, method, method argument, URL argument, options argument,
# config argument, default method, confidence). Argument positions count from 0.
WRAPPER_SCHEMA = "name string, method string, method_arg int, url_arg int, options_arg int, config_arg int, default_method string, confidence double"
DEFAULT_WRAPPERS = (
    ("fetch", None, None, 0, 1, None, "GET", 0.82),
    ("axios.get", "GET", None, 0, None, None, None, 0.88),
    ("axios.post", "POST", None, 0, None, None, None, 0.89),
    ("axios.put", "PUT", None, 0, None, None, None, 0.89),
    ("axios.patch", "PATCH", None, 0, None, None, None, 0.89),
    ("axios.delete", "DELETE", None, 0, None, None, None, 0.89),
    ("httpClient.get", "GET", None, 0, None, None, None, 0.86),
    ("httpClient.post", "POST", None, 0, None, None, None, 0.86),
    ("httpClient.put", "PUT", None, 0, None, None, None, 0.86),
    ("httpClient.patch", "PATCH", None, 0, None, None, None, 0.86),
    ("httpClient.delete", "DELETE", None, 0, None, None, None, 0.86),
    ("getJson", "GET", None, 0, None, None, None, 0.86),
    ("postJson", "POST", None, 0, None, None, None, 0.88),
    ("putJson", "PUT", None, 0, None, None, None, 0.86),
    ("patchJson", "PATCH", None, 0, None, None, None, 0.86),
    ("deleteJson", "DELETE", None, 0, None, None, None, 0.86),
    ("request", None, 0, 1, None, None, None, 0.84),
    ("client.request", None, None, None, None, 0, None, 0.84),
)
CLIENT_OBJECTS = ("httpClient", "client", "axios")
CALLER_OBJECTS = ("httpClient", "client", "axios", "apiClient")


def default_wrappers(spark) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_WRAPPERS), WRAPPER_SCHEMA)


def resolve_wrappers(calls: DataFrame, wrappers: DataFrame) -> DataFrame:
    """HTTP method and URL expression of calls that go through a known wrapper.

    calls: (call_id, callee, args array<struct<text:string, props:map<string,string>>>). A member call
    may use another client object with the same verb. Rules that disagree drop to .40.
    """
    parts = F.split("name", r"\.")
    client = (F.size(parts) == 2) & F.get(parts, 0).isin(*CLIENT_OBJECTS)
    # Each rule is listed under every callee it accepts, so calls meet rules by equality.
    names = F.when(client, F.array_union(F.array("name"), F.transform(
        F.array(*[F.lit(o) for o in CALLER_OBJECTS]), lambda o: F.concat(o, F.lit("."), F.get(parts, 1))))).otherwise(F.array("name"))
    rules = wrappers.withColumn("_seq", F.monotonically_increasing_id()).withColumn("callee", F.explode(names))
    arg = lambda i: F.get("args", F.col(i))
    verb = lambda c: F.when(F.upper(F.trim(c)).isin(*HTTP_METHODS), F.upper(F.trim(c)))
    hit = calls.join(rules, "callee")
    config, options = arg("config_arg"), arg("options_arg")
    url = F.when(F.col("config_arg").isNotNull(), F.element_at(config["props"], "url")).otherwise(arg("url_arg")["text"])
    stated = F.coalesce(F.upper("method"), verb(arg("method_arg")["text"]))
    method = F.coalesce(verb(F.element_at(options["props"], "method")), F.coalesce(stated, verb(F.element_at(config["props"], "method"))), F.upper("default_method"))
    found = hit.select("call_id", "callee", "_seq", method.alias("method"), url.alias("url_expr"), "confidence").where("method IS NOT NULL AND url_expr IS NOT NULL")
    one = found.groupBy("call_id", "callee").agg(
        F.min_by(F.struct("method", "url_expr", "confidence"), "_seq").alias("f"), F.count_distinct(F.struct("method", "url_expr")).alias("ways"))
    return one.select("call_id", "callee", "f.method", "f.url_expr", F.when(F.col("ways") > 1, 0.40).otherwise(F.col("f.confidence")).alias("confidence"),
                      (F.col("ways") > 1).alias("ambiguous"))


def frontend_http_calls(resolved: DataFrame) -> DataFrame:
    """HTTP call edges. resolved: (function, method, value, wrapper_confidence, value_confidence, unresolved)."""
    path = PA.canonical_path("value")
    dynamic = PA.dynamic_segments("path") > 0
    conf = F.least("wrapper_confidence", "value_confidence", F.when(dynamic, 0.90), F.when(F.col("unresolved"), 0.62))
    out = resolved.withColumns({"path": path, "query": PA.canonical_query("value")}).where("path <> ''")
    return out.withColumn("confidence", conf).select(
        F.col("function").alias("from_id"), F.concat_ws(" ", F.lit("HTTP"), "method", "path").alias("to_id"), F.lit("HTTP_CALLS").alias("kind"), "method", "path", "query",
        "confidence", endpoint_status(F.col("confidence")).alias("status"))


def evaluate_paths(definitions: DataFrame, parts: DataFrame) -> DataFrame:
    """(def_id, value, confidence) of path constants and helpers, evaluated bottom-up.

    definitions: (def_id, module, params array<string>); parts: (def_id, pos, kind, text, target, args)
    with kind literal, param, ref or call; ``target`` is the definition used, ``args`` the call's
    argument texts (null = dynamic). A definition is evaluated once all it uses is; a cycle never
    is. Parameter holes are kept by name until a call fills them.
    """
    hole = lambda name: F.concat(F.lit("\u0002"), name, F.lit("\u0003"))
    parts = CutTable(parts.join(definitions.select("def_id", "module"), "def_id")).df
    sizes = parts.groupBy("def_id").agg(F.count(F.lit(1)).alias("size"))
    meta = definitions.select(F.col("def_id").alias("target"), F.col("module").alias("t_module"), F.col("params").alias("t_params"))
    plain = parts.where("kind IN ('literal', 'param')").select(
        "def_id", "pos", F.when(F.col("kind") == "literal", F.col("text")).otherwise(hole(F.col("text"))).alias("value"),
        F.when(F.col("kind") == "literal", 0.95).otherwise(0.90).alias("conf"))
    uses = parts.where("kind IN ('ref', 'call')").join(meta, "target")
    waiting, known = definitions.select("def_id"), None
    while True:
        ready = plain
        if known is not None:
            filled = F.aggregate(F.arrays_zip("t_params", "args"), F.col("t_value"),
                                 lambda acc, z: F.replace(acc, hole(z["t_params"]), F.coalesce(z["args"], F.lit("{param}"))))
            used = uses.join(known.select(F.col("def_id").alias("target"), F.col("value").alias("t_value"), F.col("confidence").alias("t_conf")), "target").select(
                "def_id", "pos", F.when(F.col("kind") == "call", filled).otherwise(F.col("t_value")).alias("value"),
                F.least("t_conf", F.when(F.col("kind") == "ref", 0.94).when(F.col("module") == F.col("t_module"), 0.90).otherwise(0.85)).alias("conf"))
            ready = plain.unionByName(used)
        # Only definitions still open are assembled again.
        ready = ready.join(waiting, "def_id", "left_semi")
        whole = ready.groupBy("def_id").agg(
            F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]), "").alias("value"),
            F.min("conf").alias("conf")).join(sizes, "def_id").where("n = size")
        fresh = CutTable(whole.select("def_id", "value", F.when(F.col("size") > 1, F.least("conf", F.lit(0.93))).otherwise(F.col("conf")).alias("confidence")))
        if fresh.is_empty():
            break
        known = fresh.df if known is None else known.unionByName(fresh.df)
        waiting = CutTable(waiting.join(fresh.df, "def_id", "left_anti")).df
    if known is None:
        known = plain.select("def_id", "value", F.col("conf").alias("confidence")).limit(0)
    return known.withColumn("value", F.regexp_replace("value", "\u0002[^\u0003]*\u0003", "{param}"))


def expand_exports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Import maps with ``export *`` replaced by what the other module offers; own names win.

    imports: (module, local, target); exports: (module, name, target).
    """
    stars = imports.where("local = '*'").select("module", F.col("target").alias("_from"))
    own = imports.where("local <> '*'")
    offered = own.select(F.col("module").alias("_from"), "local", "target", F.lit(0).alias("_rank")).unionByName(
        exports.select(F.col("module").alias("_from"), F.col("name").alias("local"), "target", F.lit(1).alias("_rank")))
    via = stars.join(offered, "_from").groupBy("module", "local").agg(F.min_by("target", F.struct("_rank", "_from", "target")).alias("target"))
    return own.unionByName(via.join(own.select("module", "local"), ["module", "local"], "left_anti"))


def propagate_endpoints(sinks: DataFrame, calls: DataFrame, params: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(caller, endpoint, depth): endpoint arguments traced from sinks back through wrapper functions.

    sinks and calls: (caller, callee, pos, value, path) with ``path`` set when the argument is already a
    path; params: (function, pos, name). Wrappers are followed to any depth unless ``max_depth`` is given.
    """
    calls = CutTable(calls).df
    params = CutTable(params.select(F.col("function").alias("caller"), F.col("pos").alias("param_pos"), F.col("name").alias("value"))).df
    open_ = CutTable(sinks.where("path IS NULL").select("caller", "value").distinct())
    done = sinks.where("path IS NOT NULL").select("caller", F.col("path").alias("endpoint"), F.lit(0).alias("depth"))
    seen = open_.df
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        asked = open_.df.join(params, ["caller", "value"]).select(F.col("caller").alias("callee"), F.col("param_pos").alias("pos")).distinct()
        given = CutTable(calls.join(asked, ["callee", "pos"]))
        done = done.unionByName(given.df.where("path IS NOT NULL").select("caller", F.col("path").alias("endpoint"), F.lit(depth).alias("depth")))
        open_ = CutTable(given.df.where("path IS NULL").select("caller", "value").distinct().join(seen, ["caller", "value"], "left_anti"))
        if open_.is_empty():
            break
        seen = seen.unionByName(open_.df)
    return done.groupBy("caller", "endpoint").agg(F.min("depth").alias("depth"))


# Confidence and status of each frontend relation.
RELATIONS = {"USES_HOOK": ("DEPENDS_ON", 0.88, "confirmed"), "EXPOSES_ACTION": ("DEPENDS_ON", 0.84, "likely"), "FRONTEND_TEST_TARGET": ("TESTS", 0.82, "likely")}


def frontend_relations(facts: DataFrame) -> DataFrame:
    """Edges of component-to-hook, hook-to-action and test-to-symbol facts. facts: (relation, from_id, to_id)."""
    pick = lambda i: X.lookup("relation", {k: v[i] for k, v in RELATIONS.items()})
    ok = F.col("relation").isin(*RELATIONS) & (F.coalesce("from_id", F.lit("")) != "") & (F.coalesce("to_id", F.lit("")) != "")
    return facts.where(ok).select("from_id", "to_id", "relation").distinct().withColumns({"kind": pick(0), "confidence": pick(1), "status": pick(2)})
