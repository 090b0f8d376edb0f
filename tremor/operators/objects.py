"""Calls through nested objects: object bindings, aliases of receiver chains, chains to types, calls.

A path is an array of parts; a part in brackets is kept as ``[key``, which no name can be.

params: (class, param, type, confidence); fields: (owner, field, type, confidence, ord); assignments: (scope, target, value, confidence, ord);
entries: (scope, target, key, value, type, confidence, ord); providers: (provider, type, confidence, ord); returns: (scope, type,
confidence, ord); aliases: (scope, alias, target, confidence, ord); all names and paths as text, null confidences by default.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import columns as X
from tremor.operators.symbols import _prefixes, chain_quality
from tremor.plans.loops import CutTable

# Confidences of facts that give none.
PARAM, FIELD, PROVIDER, RETURN, ENTRY, ASSIGNED, ALIAS, ASSIGNED_ALIAS = 0.95, 0.9, 0.82, 0.8, 0.8, 0.95, 0.88, 0.85
# Fixed value: what a chain that never ends keeps of its confidence.
ENDLESS = 0.2
BINDING = ["owner", "path", "type", "confidence"]
ALIASES = ["place", "alias", "target", "confidence", "ord"]


def path_parts(text: Column | str) -> Column:
    """``self.repos['a'].find()`` as ``[self, repos, [a, find]``; a key that is no literal is kept as written. Null gives an empty path."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.coalesce(X.col(text), F.lit(""))), r"\(\)$", "")), '"', "'")
    found = F.regexp_extract_all(plain, F.lit(r"(\[\s*'[^']*'\s*\]|\[[^\]]*\]?|[A-Za-z_][A-Za-z0-9_]*)"), 1)

    def part(p):
        inner = F.trim(F.regexp_replace(p, r"^\[|\]$", ""))
        key = F.when(inner.rlike("^'[^']*'$"), F.regexp_replace(inner, "^'|'$", "")).when(inner == "", "<dynamic>").otherwise(inner)
        return F.when(p.startswith("["), F.concat(F.lit("["), key)).otherwise(p)
    return F.transform(found, part)


def _is_key(part: Column) -> Column:
    return F.coalesce(part.startswith("["), F.lit(False))


def _after(path: Column, n: Column | int) -> Column:
    """The parts after the first ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(path, n + 1, F.greatest(F.size(path) - n, F.lit(0)))


def _sure(default: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence"), F.lit(default))))


def owner_of(scopes: DataFrame, classes: DataFrame) -> DataFrame:
    """(scope, owner): the longest known class the scope is or lies in, else all before its last dot, else null. classes: (class)."""
    s = scopes.select("scope").where("scope <> ''").distinct()
    inside = s.select("scope", F.explode(_prefixes(F.col("scope"))).alias("class")).join(classes.select("class").distinct(), "class")
    known = inside.groupBy("scope").agg(F.max_by("class", F.length("class")).alias("owner"))
    above = F.when(F.contains("scope", F.lit(".")), F.regexp_replace("scope", r"\.[^.]*$", ""))
    return s.join(known, "scope", "left").withColumn("owner", F.coalesce("owner", above))


def _place(scope: Column, owner: Column, path: Column) -> Column:
    """Where an alias holds: paths of ``self`` in the whole class, others in their scope."""
    return F.when((F.get(path, F.lit(0)) == "self") & owner.isNotNull(), F.concat(F.lit("class "), owner)).otherwise(F.concat(F.lit("scope "), scope))


def object_bindings(f: dict[str, DataFrame], classes: DataFrame) -> dict[str, DataFrame]:
    """Tables ``params`` and ``paths`` (owner, path, type, confidence), ``providers`` (path, type, confidence), ``aliases`` (place, alias, target, confidence, ord).

    ``paths`` holds fields, nested fields and dictionary entries; an entry's path ends with its key. A binding that several facts
    give is taken from the first: declared fields before assigned ones, then list order. Facts without an owner are left out.
    """
    params = f["params"].where("class <> '' AND param <> '' AND type <> ''").select(
        F.col("class").alias("owner"), "param", "type", _sure(PARAM).alias("confidence")).groupBy("owner", "param", "type").agg(F.min("confidence").alias("confidence"))
    params = CutTable(params).df
    scoped = functools.reduce(DataFrame.unionByName, [f[n].select("scope") for n in ("assignments", "entries", "aliases")])
    owners = CutTable(owner_of(scoped, classes)).df
    declared = f["fields"].where("owner <> '' AND field <> '' AND type <> ''").select(
        "owner", F.split("field", r"\.").alias("path"), "type", _sure(FIELD).alias("confidence"), F.lit(0).alias("stage"), "ord").withColumn("path", F.filter("path", lambda p: p != ""))
    a = CutTable(f["assignments"].join(owners, "scope").where("owner IS NOT NULL").withColumn("to", path_parts("target"))).df
    stored = a.where((F.get("to", F.lit(0)) == "self") & (F.size("to") > 1) & ~F.exists("to", _is_key)).withColumn("sure", _sure(ASSIGNED)).drop("confidence").join(
        params.select("owner", F.col("param").alias("value"), "type", "confidence"), ["owner", "value"])
    assigned = stored.select("owner", _after(F.col("to"), 1).alias("path"), "type", F.least("sure", "confidence").alias("confidence"), F.lit(1).alias("stage"), "ord")
    first = lambda df: df.groupBy("owner", "path", "type").agg(F.min_by("confidence", F.struct("stage", "ord")).alias("confidence"))
    fields = CutTable(first(declared.unionByName(assigned))).df

    e = f["entries"].join(owners, "scope").where("owner IS NOT NULL").withColumn("to", path_parts("target"))
    # ``self.a = {key: value}`` gives the key apart, ``self.a[key] = value`` has it in the target
    e = e.withColumn("path", _after(F.col("to"), 1)).withColumn("path", F.when(F.col("key").isNotNull(), F.concat("path", F.array(F.concat(F.lit("["), "key")))).otherwise(F.col("path")))
    e = CutTable(e.where((F.get("to", F.lit(0)) == "self") & (F.size("path") > 1) & _is_key(F.element_at("path", -1))).select(
        "owner", "path", F.col("type").alias("told"), "value", _sure(ENTRY).alias("sure"), "ord", F.col("key").isNotNull().alias("whole"))).df
    open_ = e.where("coalesce(told, '') = '' AND value <> ''")
    exact = open_.join(params.select("owner", F.col("param").alias("value"), "type"), ["owner", "value"])
    far = open_.where("whole").join(params.select("owner", F.col("param").alias("value")), ["owner", "value"], "left_anti").select("owner", "value").distinct().withColumn("path", path_parts("value"))
    start = far.join(params.groupBy("owner", "param").agg(F.collect_set("type").alias("types")).withColumnRenamed("owner", "o"),
                     (F.col("o") == F.col("owner")) & (F.col("param") == F.get("path", F.lit(0)))).select(
        "owner", "path", _after(F.col("path"), 1).alias("rest"), "types", F.lit(1.0).alias("confidence"))
    walked = _walk(start, fields, nested=False).select("owner", F.col("path").alias("value_path"), F.explode("types").alias("type"))
    deep = far.withColumnRenamed("path", "value_path").join(walked, ["owner", "value_path"]).join(open_.where("whole"), ["owner", "value"])
    pick = lambda df: df.select("owner", "path", "type", F.col("sure").alias("confidence"), F.lit(0).alias("stage"), "ord")
    entries = first(functools.reduce(DataFrame.unionByName, [pick(e.where("told <> ''").withColumnRenamed("told", "type")), pick(exact), pick(deep)]))

    gives = f["providers"].select(path_parts("provider").alias("path"), "type", _sure(PROVIDER).alias("confidence"), F.lit(0).alias("stage"), "ord").unionByName(
        f["returns"].select(path_parts("scope").alias("path"), "type", _sure(RETURN).alias("confidence"), F.lit(1).alias("stage"), "ord"))
    providers = gives.where((F.size("path") > 0) & (F.col("type") != "")).groupBy("path", "type").agg(F.min_by("confidence", F.struct("stage", "ord")).alias("confidence"))

    text = F.trim("value")
    plain = ~text.rlike(r"^[{\[(`\"']") & ~text.rlike(r"[():,]") & (text.rlike(r"[.\[]") | text.isin("self", "this"))
    told = f["aliases"].join(owners, "scope", "left").select("scope", "owner", path_parts("alias").alias("alias"), path_parts("target").alias("target"), _sure(ALIAS).alias("confidence"), F.lit(1).alias("stage"), "ord")
    seen = a.where(plain).select("scope", "owner", F.col("to").alias("alias"), path_parts("value").alias("target"), _sure(ASSIGNED_ALIAS).alias("confidence"), F.lit(0).alias("stage"), "ord").where("alias <> target")
    aliases = told.unionByName(seen).where((F.size("alias") > 0) & (F.size("target") > 0)).withColumn("place", _place(F.col("scope"), F.col("owner"), F.col("alias")))
    aliases = aliases.groupBy("place", "alias", "target").agg(F.min_by("confidence", F.struct("stage", "ord")).alias("confidence"), F.min(F.struct("stage", "ord")).alias("ord"))
    return {"params": params.withColumn("path", F.array("param")).select(*BINDING), "paths": fields.unionByName(entries), "providers": providers, "aliases": aliases.select(*ALIASES)}


def expand_aliases(chains: DataFrame, aliases: DataFrame) -> DataFrame:
    """(scope, owner, path, expanded, confidence, hops, rejected), one row per distinct chain; ``aliases`` as ``object_bindings`` gives them.

    The longest prefix that is an alias is replaced, until none is; of equal aliases the first counts, confidences are multiplied.
    There is no limit of steps: a chain that comes back to an earlier path is rejected with a fifth of its confidence, and so is
    one that grows for ever. The latter is known by its head, as no alias sees further than ``longest`` parts: if a head recurs and
    the path was never shorter in between, the same steps follow again. The head compared is renewed whenever the path gets
    shorter than it was there, and at every power of two, so each chain carries one of them.
    """
    rules = CutTable(aliases.groupBy("place", "alias").agg(F.min_by(F.struct("target", "confidence"), "ord").alias("r")).select("place", "alias", "r.*")).df
    longest = F.lit(rules.agg(F.max(F.size("alias"))).first()[0] or 0)
    head = lambda p: F.slice(p, F.lit(1), longest)
    key = ["scope", "owner", "path"]
    now = F.col("now")
    front = CutTable(chains.select(*key).distinct().select(
        *key, F.col("path").alias("now"), F.lit(1.0).alias("confidence"), F.lit(0).alias("hops"), F.lit(False).alias("rejected"),
        F.array("path").alias("seen"), head(F.col("path")).alias("base"), F.size("path").alias("low"))).df
    done, state = [], ["now", "confidence", "hops", "rejected", "seen", "base", "low"]
    while not front.isEmpty():
        n = F.least(F.size(now), longest)
        asks = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(now, F.lit(1), i)))
        keyed = front.select(*key, F.struct(*state).alias("s"), F.explode_outer(asks).alias("alias"), _place(F.col("scope"), F.col("owner"), now).alias("place"))
        hit = keyed.join(rules, ["place", "alias"], "left").withColumn("r", F.when(F.col("target").isNotNull(), F.struct("target", "confidence", F.size("alias").alias("n"))))
        best = hit.groupBy(*key).agg(F.any_value("s").alias("s"), F.max_by("r", F.col("r.n")).alias("r"))
        moved = F.col("r").isNotNull()
        after = F.concat("r.target", _after(F.col("s.now"), F.col("r.n")))
        stepped = best.where(moved).select(*key, "s", F.col("r.confidence").alias("c"), after.alias("after"), (F.col("s.hops") + 1).alias("hops"))
        back = F.array_contains("s.seen", F.col("after"))
        lower = F.size("after") < F.col("s.low")
        grown = ~lower & (head(F.col("after")) == F.col("s.base"))
        renew = lower | (F.bit_count("hops") == 1)
        left = stepped.select(
            *key, F.col("after").alias("now"), (F.col("s.confidence") * F.col("c") * F.when(back | grown, ENDLESS).otherwise(1.0)).alias("confidence"), "hops", (back | grown).alias("rejected"),
            F.concat("s.seen", F.array("after")).alias("seen"), F.when(renew, head(F.col("after"))).otherwise(F.col("s.base")).alias("base"), F.when(renew, F.size("after")).otherwise(F.col("s.low")).alias("low"))
        round_ = CutTable(left.withColumn("ended", F.col("rejected")).unionByName(best.where(~moved).select(*key, "s.*", F.lit(True).alias("ended"))))
        done.append(round_.df.where("ended").select(*key, F.col("now").alias("expanded"), "confidence", "hops", "rejected"))
        front = round_.df.where("NOT ended").drop("ended")
    none = chains.sparkSession.createDataFrame([], "scope string, owner string, path array<string>, expanded array<string>, confidence double, hops int, rejected boolean")
    return functools.reduce(DataFrame.unionByName, done, none)


def _walk(start: DataFrame, paths: DataFrame, nested: bool = True) -> DataFrame:
    """(owner, path, types, confidence) of rows whose ``rest`` can be followed to its end from ``types``; the lowest confidence on the way.

    Each round takes the longest bound path that any type of a row has; a key is met only together with the field before it.
    """
    state = ["rest", "confidence"]
    key = ["owner", "path"]
    done, front = [], CutTable(start.select(*key, "types", *state))
    while not front.is_empty():
        done.append(front.df.where(F.size("rest") == 0).select(*key, "types", "confidence"))
        rest = F.col("rest")
        names = F.array_position(F.transform(rest, _is_key), True)
        run = F.when(names == 0, F.size(rest)).otherwise((names - 1).cast("int")) if nested else F.when(names == 1, 0).otherwise(F.least(F.size(rest), F.lit(1)))
        keyed = _is_key(F.get(rest, F.lit(1))) & ~_is_key(F.get(rest, F.lit(0)))
        lengths = F.when(keyed, F.array(F.lit(2)) if nested else F.array().cast("array<int>")).when(run > 0, F.sequence(F.lit(1), run))
        asks = front.df.where(F.size("rest") > 0).select(*key, *state, "types", F.explode(lengths).alias("n")).select(
            *key, *state, F.explode("types").alias("at"), "n", F.slice("rest", F.lit(1), F.col("n")).alias("step"))
        found = asks.join(paths.select(F.col("owner").alias("at"), F.col("path").alias("step"), F.col("type").alias("to"), F.col("confidence").alias("c")), ["at", "step"])
        by_length = found.groupBy(*key, "n").agg(F.collect_set("to").alias("types"), F.min("c").alias("c"), F.any_value("rest").alias("rest"), F.any_value("confidence").alias("confidence"))
        best = by_length.groupBy(*key).agg(F.max_by(F.struct("types", "c", "rest", "confidence", "n"), "n").alias("b"))
        front = CutTable(best.select(*key, "b.types", _after(F.col("b.rest"), F.col("b.n")).alias("rest"), F.least("b.confidence", "b.c").alias("confidence")))
    none = start.sparkSession.createDataFrame([], "owner string, path array<string>, types array<string>, confidence double")
    return functools.reduce(DataFrame.unionByName, done, none)


def resolve_chain(chains: DataFrame, b: dict[str, DataFrame]) -> DataFrame:
    """(scope, owner, path, types, confidence, rejected), one row per distinct chain; ``types`` is null where nothing is known.

    After aliases: a provider of the whole path, else from ``self`` along fields, nested fields and dictionary entries, else a
    constructor parameter of that name. The confidence is the lowest on the way times that of the aliases.
    """
    e = CutTable(expand_aliases(chains, b["aliases"])).df
    gives = b["providers"].groupBy("path").agg(F.collect_set("type").alias("types"), F.min("confidence").alias("c")).withColumnRenamed("path", "expanded")
    known = CutTable(e.where("NOT rejected").join(gives, "expanded", "left")).df
    rest = known.where("types IS NULL AND owner IS NOT NULL").select("owner", "expanded").distinct()
    itself = F.get("expanded", F.lit(0)) == "self"
    start = rest.where(itself).select("owner", F.col("expanded").alias("path"), _after(F.col("expanded"), 1).alias("rest"), F.array("owner").alias("types"), F.lit(1.0).alias("confidence"))
    named = b["params"].groupBy("owner", "path").agg(F.collect_set("type").alias("types"), F.min("confidence").alias("confidence"))
    local = rest.where(~itself).withColumnRenamed("expanded", "path").join(named, ["owner", "path"])
    walked = _walk(start, b["paths"]).unionByName(local.select("owner", "path", "types", "confidence")).select("owner", F.col("path").alias("expanded"), F.col("types").alias("t2"), F.col("confidence").alias("c2"))
    ends = known.join(walked, ["owner", "expanded"], "left").select(
        "scope", "owner", "path", F.coalesce("types", "t2").alias("types"), (F.col("confidence") * F.coalesce("c", "c2", F.lit(1.0))).alias("confidence"), "rejected")
    return ends.unionByName(e.where("rejected").select("scope", "owner", "path", F.lit(None).cast("array<string>").alias("types"), "confidence", "rejected"))


def nested_calls(calls: DataFrame, b: dict[str, DataFrame], methods: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of calls (id, scope, receiver text, method); methods: (class, method).

    edges: (id, from_id, to_id, confidence, status), one per type that has the method; unresolved: (id, reason, status, candidates).
    """
    c = calls.where("scope <> '' AND method <> '' AND receiver IS NOT NULL").withColumn("path", path_parts("receiver"))
    c = CutTable(c.join(owner_of(c, classes), "scope").select("id", "scope", "owner", "path", "method")).df
    r = CutTable(resolve_chain(c.where(F.size("path") > 0), b)).df
    same = [c[k].eqNullSafe(r[k]) for k in ("scope", "owner", "path")]
    full = CutTable(c.join(r, same, "left").select(c["id"], c["scope"], c["path"], c["method"], "types", "confidence", F.coalesce("rejected", F.lit(False)).alias("rejected"))).df
    has = methods.where("class <> '' AND method <> ''").select(F.col("class").alias("type"), "method").distinct()
    met = full.select("id", "scope", "path", "method", "confidence", "rejected", F.explode("types").alias("type")).join(has, ["type", "method"])
    n = met.groupBy("id").agg(F.count(F.lit(1)).alias("candidates"))
    rows = met.join(n, "id").withColumns({"has_types": F.lit(True), "method_exists": F.lit(True), "chain_length": F.size(F.filter("path", lambda p: ~_is_key(p)))})
    edges = chain_quality(rows).select("id", F.col("scope").alias("from_id"), F.concat_ws(".", "type", "method").alias("to_id"), F.col("chain_confidence").alias("confidence"), F.col("chain_status").alias("status"))
    lost = full.join(n.select("id"), "id", "left_anti").select(
        "id", F.when(F.col("types").isNull(), "receiver type unresolved").otherwise("method missing on resolved receiver type").alias("reason"),
        F.when(F.col("rejected"), "rejected").otherwise("unresolved").alias("status"), F.coalesce(F.size("types"), F.lit(0)).alias("candidates"))
    return edges, lost
