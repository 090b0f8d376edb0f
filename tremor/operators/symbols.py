"""Names to symbols as keyed joins: modules, classes, functions, members, inherited methods, aliases."""
from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import columns as X
from tremor.plans.loops import CutTable



def _prefixes(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def _suffixes(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _tail(name: Column | str) -> Column:
    return X.last_part(name, r"\.")


def _head(name: Column | str) -> Column:
    return F.regexp_replace(X.col(name), r"\.?[^.]*$", "")


def symbol_tables(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Tables the resolvers join: modules, classes, methods, functions, bases, aliases, imports.

    nodes: (id, kind, class_name, return_type, bases array, import_aliases map).
    """
    bare = lambda p: F.regexp_replace("id", f"^{p}:", "")
    of = lambda kind: nodes.where(F.col("kind") == kind)
    module = lambda c: F.regexp_replace(c, "^module:", "")
    classes = of("CLASS").select(bare("class").alias("full"), "bases")
    methods = of("METHOD").select(bare("method").alias("full"), "class_name", "return_type")
    functions = methods.where(F.coalesce("class_name", F.lit("")) == "")
    return {
        "modules": of("MODULE").select(bare("module").alias("module")).distinct(),
        "classes": classes.select("full", _tail("full").alias("simple")).distinct(),
        "methods": methods.select("full").distinct(),
        "functions": functions.select("full", _tail("full").alias("simple"), "return_type").distinct(),
        "bases": classes.select("full", F.posexplode("bases").alias("pos", "base")),
        "aliases": of("MODULE").select(bare("module").alias("module"), F.explode("import_aliases").alias("alias", "target")),
        "imports": edges.where("kind = 'IMPORTS'").select(module("from_id").alias("module"), module("to_id").alias("imported")).distinct(),
    }


def module_for_scope(scopes: DataFrame, modules: DataFrame) -> DataFrame:
    """(scope, module): the longest module that is the scope or a dotted prefix of it, else its first part."""
    s = scopes.select("scope").distinct()
    hit = s.select("scope", F.explode(_prefixes(F.col("scope"))).alias("module")).join(modules, "module").groupBy("scope").agg(
        F.max_by("module", F.length("module")).alias("module"))
    return s.join(hit, "scope", "left").withColumn("module", F.coalesce("module", F.substring_index("scope", ".", 1)))


def canonical_class(names: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, full) of type names: exact, then dotted suffix, then suffix without the root, then a unique simple name.

    Classes are indexed once by suffix with their first full name, so a class name used everywhere
    is one index row.
    """
    index = classes.select("full", F.explode(_suffixes(F.col("full"))).alias("key")).groupBy("key").agg(
        F.min("full").alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.col("full") == F.col("key")).alias("whole"))
    rootless = F.when(F.contains("name", F.lit(".")), F.regexp_replace("name", r"^[^.]*\.", ""))
    keys = names.select("name").where("name <> ''").distinct().select("name", F.explode(F.array_compact(F.array(
        F.struct(F.lit(1).alias("r"), F.col("name").alias("key")),
        F.when(rootless.isNotNull(), F.struct(F.lit(2).alias("r"), rootless.alias("key"))),
        F.struct(F.lit(3).alias("r"), _tail("name").alias("key"))))).alias("k")).select("name", "k.r", "k.key")
    hit = keys.join(index, "key").where((F.col("r") < 3) | (F.col("n") == 1))
    full = F.when((F.col("r") == 1) & F.col("whole"), F.col("name")).otherwise(F.col("first"))
    return hit.groupBy("name").agg(F.min_by(full, "r").alias("full"))


def resolve_class(refs: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(module, name, full): dotted names first, then the import alias, the own module, imported modules."""
    r = refs.select("module", "name").distinct()
    known = t["classes"].select("full")
    alias = r.join(t["aliases"].withColumnRenamed("alias", "name"), ["module", "name"]).select("module", "name", F.col("target"))
    wanted = r.where(F.contains("name", F.lit("."))).select("module", "name", F.col("name").alias("target"), F.lit(0).alias("rank")).unionByName(
        alias.withColumn("rank", F.lit(1)))
    by_name = wanted.join(canonical_class(wanted.select(F.col("target").alias("name")), t["classes"]).withColumnRenamed("name", "target"), "target").select("module", "name", "rank", "full")
    own = r.select("module", "name", F.lit(2).alias("rank"), F.concat_ws(".", "module", "name").alias("full")).join(known, "full", "left_semi")
    far = r.join(t["imports"], "module").select("module", "name", F.lit(3).alias("rank"), F.concat_ws(".", "imported", "name").alias("full")).join(known, "full", "left_semi")
    return by_name.unionByName(own).unionByName(far).groupBy("module", "name").agg(F.min_by("full", F.struct("rank", "full")).alias("full"))


def resolve_function(refs: DataFrame, t: dict[str, DataFrame], max_reexports: int | None = None) -> DataFrame:
    """(module, parent, name, full): enclosing scope, own module, alias through re-exports, or the only imported
    module that defines it. Chains of aliases are followed to their ends unless ``max_reexports`` is given."""
    r = refs.select("module", "parent", "name").distinct()
    known = t["functions"].select("full")
    local = lambda rank, prefix: r.select("module", "parent", "name", F.lit(rank).alias("rank"), F.concat_ws(".", prefix, "name").alias("full")).join(known, "full", "left_semi")
    out = local(0, "parent").unionByName(local(1, "module"))
    chain = r.select("module", "name").distinct().join(t["aliases"].withColumnRenamed("alias", "name"), ["module", "name"]).select("module", "name", "target")
    step = t["aliases"].select(F.concat_ws(".", "module", "alias").alias("target"), F.col("target").alias("_next"))
    seen = None
    for hop in count():
        if hop == max_reexports:
            break
        table = CutTable(chain.distinct())
        chain = table.df
        if table.is_empty():
            break
        seen = chain if seen is None else seen.unionByName(chain)
        hit = chain.join(known.withColumnRenamed("full", "target"), "target", "left_semi")
        out = out.unionByName(r.join(hit.select("module", "name", F.col("target").alias("full"), F.lit(2 + hop).alias("rank")), ["module", "name"]).select(
            "module", "parent", "name", "rank", "full"))
        # a target met before is on a cycle
        chain = chain.join(step, "target").select("module", "name", F.col("_next").alias("target")).join(seen, ["module", "name", "target"], "left_anti")
    far = r.select("module", "name").distinct().join(t["imports"], "module").select("module", "name", F.concat_ws(".", "imported", "name").alias("full")).join(known, "full", "left_semi")
    only = far.groupBy("module", "name").agg(F.min("full").alias("full"), F.count(F.lit(1)).alias("n")).where("n = 1")
    out = out.unionByName(r.join(only.drop("n"), ["module", "name"]).select("module", "parent", "name", F.lit(1 << 30).alias("rank"), "full"))
    return out.groupBy("module", "parent", "name").agg(F.min_by("full", "rank").alias("full"))


def resolve_member(refs: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(module, alias, member, full) of ``alias.member`` where the alias is an imported module."""
    out = refs.select("module", "alias", "member").distinct().join(t["aliases"], ["module", "alias"]).select(
        "module", "alias", "member", F.concat_ws(".", "target", "member").alias("full"))
    return out.join(t["methods"], "full", "left_semi")


def resolve_method(refs: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(class_full, method, full): the method of a class or of its nearest base, breadth first in base order."""
    methods, bases = t["methods"], CutTable(t["bases"]).df
    state = CutTable(refs.select("class_full", "method").distinct().select(
        "class_full", "method", F.col("class_full").alias("at"), F.array().cast("array<int>").alias("path")))
    seen, found = state.df.select("class_full", "method", "at"), None
    while True:
        here = state.df.withColumn("full", F.concat_ws(".", "at", "method"))
        hit = CutTable(here.join(methods, "full", "left_semi").groupBy("class_full", "method").agg(F.min_by("full", "path").alias("full")))
        found = hit.df if found is None else found.unionByName(hit.df)
        up = state.df.join(hit.df, ["class_full", "method"], "left_anti").join(bases.withColumnRenamed("full", "at"), "at").select(
            "class_full", "method", F.col("base").alias("at"), F.array_append("path", F.col("pos")).alias("path"))
        up = up.join(seen, ["class_full", "method", "at"], "left_anti").groupBy("class_full", "method", "at").agg(F.min("path").alias("path"))
        state = CutTable(up)
        if state.is_empty():
            break
        seen = seen.unionByName(state.df.select("class_full", "method", "at"))
    return found


def exact_calls(calls: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """CALLS and RESOLVES_TO edges at 1.0 for plain function calls. calls: (id, scope, call_name, receiver)."""
    plain = calls.where((F.coalesce("receiver", F.lit("")) == "") & (F.col("scope") != "") & ~F.contains("call_name", F.lit(".")))
    placed = plain.join(module_for_scope(plain, t["modules"]), "scope").select("id", "scope", "module", _head("scope").alias("parent"), F.col("call_name").alias("name"))
    hit = placed.join(resolve_function(placed, t), ["module", "parent", "name"])
    return hit.select(F.explode(F.array(
        F.struct(F.lit("CALLS").alias("kind"), F.col("scope").alias("from_id"), F.col("full").alias("to_id")),
        F.struct(F.lit("RESOLVES_TO").alias("kind"), F.col("id").alias("from_id"), F.concat(F.lit("method:"), "full").alias("to_id")))).alias("e")).select(
        "e.kind", "e.from_id", "e.to_id").distinct().withColumns({"source": F.lit("EXTRACTED"), "confidence": F.lit(1.0), "resolution_status": F.lit("resolved_exact")})


def assign_types(assignments: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(scope, target, type, candidates): the class a variable is built from, first in list order; other classes
    make it ambiguous. assignments: (id, scope, target, call_name, ord)."""
    a = assignments.where("call_name <> '' AND scope <> '' AND target <> ''")
    placed = a.join(module_for_scope(a, t["modules"]), "scope").withColumn("name", F.col("call_name"))
    typed = placed.join(resolve_class(placed, t), ["module", "name"])
    return typed.groupBy("scope", "target").agg(F.min_by("full", "ord").alias("type"), F.min_by("id", "ord").alias("assignment_id"),
                                                F.array_sort(F.collect_set("full")).alias("candidates"))


def factory_types(assignments: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(scope, target, type) of variables assigned from a function with a return annotation."""
    a = assignments.where("call_name <> '' AND scope <> '' AND target <> ''")
    placed = a.join(module_for_scope(a, t["modules"]), "scope").select("id", "scope", "target", "ord", "module", _head("scope").alias("parent"), F.col("call_name").alias("name"))
    hit = placed.join(resolve_function(placed, t), ["module", "parent", "name"]).join(t["functions"].select("full", "return_type").where("return_type IS NOT NULL"), "full")
    canon = canonical_class(hit.select(F.col("return_type").alias("name")), t["classes"]).select(F.col("name").alias("return_type"), F.col("full").alias("_c"))
    typed = hit.join(canon, "return_type", "left").withColumn("type", F.coalesce("_c", "return_type"))
    return typed.groupBy("scope", "target").agg(F.min_by("type", "ord").alias("type"))


# Client verbs that name a route in a test.
CLIENT_VERBS = ("get", "post", "put", "delete", "patch", "options", "head")


def test_routes(calls: DataFrame) -> DataFrame:
    """TESTS edges from ``client.<verb>(path)`` calls inside test scopes. calls: (scope, call_name, args array)."""
    verb = F.lower(F.get(F.split("call_name", r"\."), 1))
    inside = (F.col("scope") != "") & F.contains(F.lower("scope"), F.lit("test")) & (F.substring_index("call_name", ".", 1) == "client")
    path = F.regexp_replace(F.get("args", 0), "^['\"]+|['\"]+$", "")
    hit = calls.where(inside & verb.isin(*CLIENT_VERBS) & (F.size("args") > 0))
    return hit.select(F.concat(F.lit("method:"), "scope").alias("from_id"), F.concat(F.lit("HTTP "), F.upper(verb), F.lit(" "), path).alias("to_id"),
                      F.lit("TESTS").alias("kind"), F.lit(0.75).alias("confidence")).distinct()


def reexport_chains(targets: DataFrame, exports: DataFrame) -> DataFrame:
    """(target, resolved, hops, ambiguous, confidence) through re-exports. exports: (module, name, target).

    A name exported to two places, or a cycle, stops the chain as ambiguous at .55.
    """
    full = F.when(F.coalesce("module", F.lit("")) != "", F.concat_ws(".", "module", "name")).otherwise(F.col("name"))
    rows = exports.select(full.alias("full"), "name", F.coalesce("target", full).alias("to"))
    index = lambda key: rows.groupBy(F.col(key).alias("key")).agg(F.min("to").alias("to"), F.count_distinct("to").alias("n"))
    whole, simple = CutTable(index("full").unionByName(index("name").join(index("full").select("key"), "key", "left_anti"))).df, CutTable(index("name")).df
    first = targets.select("target").distinct()
    start = first.join(whole.withColumnRenamed("key", "target"), "target", "left")
    loose = start.where("n IS NULL").select("target", _tail("target").alias("key")).where("key <> target").join(simple, "key").select("target", "to", "n")
    opened = CutTable(start.where("n IS NOT NULL").select("target", "to", "n").unionByName(loose))
    shape = lambda df, at, hops, amb: df.select("target", at.alias("resolved"), hops.alias("hops"), amb.alias("ambiguous"))
    done = shape(first.join(opened.df.select("target"), "target", "left_anti"), F.col("target"), F.lit(0), F.lit(False))
    done = done.unionByName(shape(opened.df.where("n > 1"), F.col("target"), F.lit(1), F.lit(True)))
    done = done.unionByName(shape(opened.df.where("n = 1 AND to = target"), F.col("target"), F.lit(1), F.lit(False)))
    state = CutTable(opened.df.where("n = 1 AND to <> target").select("target", F.col("to").alias("at"), F.array("target").alias("seen"), F.lit(1).alias("hops")))
    while True:
        step = CutTable(state.df.join(whole.withColumnRenamed("key", "at"), "at", "left").withColumn("cycle", F.array_contains("seen", F.col("at"))))
        s = step.df
        done = done.unionByName(shape(s.where("cycle"), F.col("at"), F.col("hops"), F.lit(True)))
        done = done.unionByName(shape(s.where("NOT cycle AND n IS NULL"), F.col("at"), F.col("hops"), F.lit(False)))
        done = done.unionByName(shape(s.where("NOT cycle AND n > 1"), F.col("at"), F.col("hops") + 1, F.lit(True)))
        done = done.unionByName(shape(s.where("NOT cycle AND n = 1 AND to = at"), F.col("at"), F.col("hops") + 1, F.lit(False)))
        state = CutTable(s.where("NOT cycle AND n = 1 AND to <> at").select("target", F.col("to").alias("at"), F.array_append("seen", F.col("at")).alias("seen"), (F.col("hops") + 1).alias("hops")))
        if state.is_empty():
            break
    conf = F.when(F.col("ambiguous"), 0.55).when(F.col("hops") > 0, 0.98).otherwise(1.0)
    return done.withColumn("confidence", conf)


def dataflow_facts(calls: DataFrame, params: DataFrame, assignments: DataFrame, returns: DataFrame) -> DataFrame:
    """(source, target, kind, confidence): arguments to parameters, values to fields, return keys, destructuring.

    calls: (function, args array); params: (function, pos, name); assignments: (target, value, value_kind);
    returns: (function, key, value).
    """
    arg = calls.select("function", F.posexplode("args").alias("pos", "arg")).join(params, ["function", "pos"]).select(
        F.col("arg").alias("source"), F.concat_ws(".", "function", "name").alias("target"), F.lit("ARG_TO_PARAM").alias("kind"), F.lit(0.95).alias("confidence"))
    dotted = F.contains("target", F.lit(".")) & F.col("value").isNotNull()
    field = assignments.where(dotted).select(F.col("value").alias("source"), "target", F.when(F.contains("value", F.lit(".")), "FIELD_TO_FIELD").otherwise("VALUE_TO_FIELD").alias("kind"), F.lit(0.95).alias("confidence"))
    key = returns.select(F.col("value").alias("source"), F.concat("function", F.lit(".return."), "key").alias("target"), F.lit("RETURN_KEY_TO_SYMBOL").alias("kind"), F.lit(0.95).alias("confidence"))
    part = assignments.where("value_kind = 'destructure'").select(F.col("value").alias("source"), "target", F.lit("DESTRUCTURE_BINDING").alias("kind"), F.lit(0.9).alias("confidence"))
    return arg.unionByName(field).unionByName(key).unionByName(part).distinct()


def lookup_symbol(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, qualified): by qualified name, then simple name (first registered), then the only dotted suffix.

    symbols: (name, qualified, ord).
    """
    q = names.select(F.col("name").alias("asked")).distinct()
    by_qualified = q.join(symbols.select(F.col("qualified").alias("asked"), F.col("qualified").alias("hit")).distinct(), "asked").withColumn("rank", F.lit(0))
    simple = symbols.groupBy(F.col("name").alias("asked")).agg(F.min_by("qualified", "ord").alias("hit"))
    by_simple = q.join(simple, "asked").withColumn("rank", F.lit(1))
    tails = symbols.select("qualified", F.explode(F.slice(_suffixes(F.col("qualified")), F.lit(2), F.size(F.split("qualified", r"\.")))).alias("asked")).distinct().groupBy("asked").agg(
        F.min("qualified").alias("hit"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    by_tail = q.join(tails, "asked").withColumn("rank", F.lit(2))
    return by_qualified.unionByName(by_simple).unionByName(by_tail).groupBy(F.col("asked").alias("name")).agg(F.min_by("hit", "rank").alias("qualified"))


def binding_calls(calls: DataFrame, bindings: DataFrame, types: DataFrame) -> DataFrame:
    """Call edges through bindings: .90 for functions and typed receivers, .65 for receivers of unknown type.

    calls: (caller, function, receiver, method); bindings: (name, target); types: (name, type).
    """
    b = lambda c, out: bindings.groupBy(F.col("name").alias(c)).agg(F.max("target").alias(out))
    ty = types.groupBy(F.col("name").alias("receiver")).agg(F.max("type").alias("_type"))
    rows = calls.join(b("function", "_f"), "function", "left").join(b("receiver", "_r"), "receiver", "left").join(ty, "receiver", "left")
    free = F.coalesce("function", F.lit("")) != ""
    target = F.when(free, F.regexp_replace(F.coalesce("_f", "function"), "^call:", "")).otherwise(F.concat_ws(".", F.coalesce("_type", "_r", "receiver"), "method"))
    untyped = ~free & F.col("_type").isNull()
    return rows.where(free | ((F.coalesce("receiver", F.lit("")) != "") & (F.coalesce("method", F.lit("")) != ""))).select(
        F.coalesce("caller", F.lit("<module>")).alias("from_id"), target.alias("to_id"), F.lit("CALLS").alias("kind"),
        F.when(untyped, 0.65).otherwise(0.90).alias("confidence"),
        F.when(untyped, F.concat(F.lit("unresolved receiver type for "), "receiver", F.lit("."), "method")).alias("diagnostic")).distinct()


def chain_quality(frame: DataFrame) -> DataFrame:
    """Status of a receiver chain. frame: (confidence, rejected, has_types, method_exists, candidates, chain_length)."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    bad = ~F.col("has_types") | ~F.col("method_exists")
    many = F.col("candidates") > 1
    n = F.col("chain_length")
    length_cap = F.when(n >= 4, 0.80).when(n == 3, 0.85).when(n == 2, 0.90).otherwise(1.0)
    out = F.when(F.col("rejected"), F.least(c, F.lit(0.2))).when(bad, F.least(c, F.lit(0.5))).when(
        many, F.when(c >= 0.72, F.least(c, F.lit(0.74))).otherwise(F.least(c, F.lit(0.64)))).otherwise(F.least(c, length_cap))
    plain = F.when(F.col("chain_confidence") >= 0.78, "confirmed").when(F.col("chain_confidence") >= 0.62, "likely").when(F.col("chain_confidence") >= 0.40, "weak").otherwise("suspicious")
    return frame.withColumn("chain_confidence", out).withColumn("chain_status", F.when(F.col("rejected"), "rejected").when(bad, "suspicious").when(
        many, F.when(c >= 0.72, "likely").otherwise("weak")).otherwise(plain))


def flag_conflicts(edges: DataFrame) -> DataFrame:
    """Pack edges of one (kind, from) with several targets become ambiguous, capped at .55.

    The target count comes from an aggregate joined back, so one very busy source is counted before
    it is shuffled.
    """
    pack = F.col("source") == "SUPPORT_PACK"
    counts = edges.where(pack).groupBy("kind", "from_id").agg(F.count_distinct("to_id").alias("candidate_count")).where("candidate_count > 1")
    out = edges.join(counts, ["kind", "from_id"], "left")
    hit = pack & F.col("candidate_count").isNotNull()
    return out.withColumns({
        "confidence": F.when(hit, F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence")), "status": F.when(hit, "ambiguous").otherwise(F.col("status")),
        "quality_guard": F.when(hit, "support_pack_candidate_conflict"), "candidate_count": F.when(hit, F.col("candidate_count"))})
