"""Types of variables, constructor parameters and fields by a fixpoint, and the method calls they resolve.

A cell is what can have types: ``var`` (scope, name), ``param`` (constructor scope, name) or ``field`` (class, "self.x").
It holds the set of all types that the first round to reach it gives it, and is closed from then on, so a cycle
of bindings ends by itself and the number of rounds is that of the longest chain. A round looks again only at receivers
that asked for a cell of the round before, and binds fields from the new cells alone.

assignments: (id, scope, target, value, call_name, args array, keyword_args map, ord); params: (scope, pos, param, annotation);
calls: (id, scope, receiver, method_name); ``t``: ``symbols.symbol_tables``.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators import symbols as S
from tremor.plans.loops import CutTable

# Wrappers whose first argument is the class that is built.
WRAPPERS = ("providers.Factory", "providers.Singleton")
CELL = ["kind", "owner", "name"]
#: Parts of the cell table before they are written as one again.
PARTS = 8


def _class_of(scope: Column) -> Column:
    return F.when(F.contains(scope, F.lit(".")), F.regexp_replace(scope, r"\.[^.]*$", ""))


def seed_cells(assignments: DataFrame, params: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(kind, owner, name, type, via): variables by constructor, else by factory, else annotated; annotated parameters."""
    noted = params.where("annotation <> ''")
    full = S.canonical_class(noted.select(F.col("annotation").alias("name")), t["classes"]).withColumnRenamed("name", "annotation")
    noted = noted.join(full, "annotation", "left").select(F.col("scope").alias("owner"), F.col("param").alias("name"), F.coalesce("full", "annotation").alias("type"), F.lit(None).cast("string").alias("via"))
    built = S.assign_types(assignments, t).select(F.col("scope").alias("owner"), F.col("target").alias("name"), F.explode("candidates").alias("type"), F.col("assignment_id").alias("via"))
    made = S.factory_types(assignments, t).select(F.col("scope").alias("owner"), F.col("target").alias("name"), "type", F.lit(None).cast("string").alias("via"))
    var = built.unionByName(made.join(built, ["owner", "name"], "left_anti"))
    var = var.unionByName(noted.join(built.select("owner", "name").union(made.select("owner", "name")), ["owner", "name"], "left_anti"))
    return var.select(F.lit("var").alias("kind"), "*").unionByName(noted.select(F.lit("param").alias("kind"), "*")).distinct()


def constructor_args(assignments: DataFrame, params: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(via, owner, name, scope, value): arguments by parameter of the constructor that is called; places win over keywords."""
    wrapped = F.col("call_name").isin(*WRAPPERS) & (F.size("args") > 0)
    a = assignments.where("call_name <> '' AND scope <> ''").select(
        F.col("id").alias("via"), "scope", F.when(wrapped, F.col("args")[0]).otherwise(F.col("call_name")).alias("call"),
        F.when(wrapped, F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0)))).otherwise(F.col("args")).alias("args"), "keyword_args")
    placed = a.join(S.module_for_scope(a, t["modules"]), "scope").withColumnRenamed("call", "name")
    built = placed.join(S.resolve_class(placed, t), ["module", "name"]).withColumn("owner", F.concat("full", F.lit(".__init__")))
    places = built.select("via", "owner", "scope", F.posexplode("args").alias("pos", "value")).join(
        params.select(F.col("scope").alias("owner"), "pos", F.col("param").alias("name")), ["owner", "pos"])
    words = built.select("via", "owner", "scope", F.explode("keyword_args").alias("name", "value"))
    both = places.select("via", "owner", "name", "scope", "value", F.lit(0).alias("r")).unionByName(words.withColumn("r", F.lit(1)))
    return both.groupBy("via", "owner", "name", "scope").agg(F.min_by("value", "r").alias("value"))


def _key(rank: int, kind: str, owner: Column, name: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), owner.alias("owner"), name.alias("name"))


def _asks(at: Column, rest: Column) -> Column:
    """Cells that may type the next part of a receiver whose parts so far have the type ``at``."""
    own = F.concat(F.lit("self."), rest[0])
    return F.array(_key(0, "field", at, own), _key(1, "var", F.concat(at, F.lit(".__init__")), own), _key(2, "var", at, rest[0]))


def receiver_type(refs: DataFrame, cells: DataFrame, modules: DataFrame, local_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scope, receiver, type) of dotted receivers, all types there are, and (scope, receiver, kind, owner, name) of every cell asked for.

    A receiver as a whole comes before its parts: a field of the class, a variable of the constructor, the scope, the module.
    Parts are followed one a round, as long as any receiver has one left; ``local_first`` asks the scope's own variable first.
    """
    r = refs.select("scope", "receiver").distinct()
    r = r.join(S.module_for_scope(r, modules), "scope").withColumn("cls", _class_of(F.col("scope")))
    scope, receiver, module, cls = (F.col(c) for c in ("scope", "receiver", "module", "cls"))
    parts, field = F.split("receiver", r"\."), receiver.startswith("self.") & cls.isNotNull()
    whole = F.array_compact(F.array(
        F.when(F.lit(local_first), _key(-1, "var", scope, receiver)), F.when(field, _key(0, "field", cls, receiver)),
        F.when(field, _key(1, "var", F.concat(cls, F.lit(".__init__")), receiver)), _key(2, "var", scope, receiver), _key(3, "var", module, receiver)))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    base = F.when(parts[0] == "self", _asks(cls, rest)).otherwise(F.array(_key(0, "var", scope, parts[0]), _key(1, "var", module, parts[0])))
    empty = F.array().cast("array<string>")
    # a type that is reached by whole name leaves no parts; "self" itself is the class
    start = r.where("receiver <> 'self'").select("scope", "receiver", F.lit(0).alias("how"), F.lit("").alias("at"), empty.alias("rest"), whole.alias("keys")).unionByName(
        r.where(F.contains("receiver", F.lit(".")) & ((parts[0] != "self") | cls.isNotNull())).select(
            "scope", "receiver", F.lit(1).alias("how"), F.lit("").alias("at"), F.when(parts[0] == "self", F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest).alias("rest"), base.alias("keys")))
    done = [r.where("receiver = 'self' AND cls IS NOT NULL").select("scope", "receiver", F.lit(0).alias("how"), F.col("cls").alias("type"))]
    asked, front = [], CutTable(start)
    while not front.is_empty():
        keys = front.df.select("scope", "receiver", "how", "at", "rest", F.explode("keys").alias("k")).select("scope", "receiver", "how", "at", "rest", "k.*").where("owner IS NOT NULL")
        asked.append(keys.select("scope", "receiver", *CELL))
        hits = keys.join(cells.select(*CELL, "type"), CELL).groupBy("scope", "receiver", "how", "at", "rest", "rank").agg(F.collect_set("type").alias("types"))
        moved = CutTable(hits.groupBy("scope", "receiver", "how", "at", "rest").agg(F.min_by("types", "rank").alias("types")).select(
            "scope", "receiver", "how", "rest", F.explode("types").alias("type")).distinct())
        done.append(moved.df.where(F.size("rest") == 0).select("scope", "receiver", "how", "type"))
        left = moved.df.where(F.size("rest") > 0)
        front = CutTable(left.select("scope", "receiver", "how", F.col("type").alias("at"), F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"), _asks(F.col("type"), F.col("rest")).alias("keys")))
    out = functools.reduce(DataFrame.unionByName, done)
    best = out.groupBy("scope", "receiver", "how").agg(F.collect_set("type").alias("types")).groupBy("scope", "receiver").agg(F.min_by("types", "how").alias("types"))
    none = refs.sparkSession.createDataFrame([], "scope string, receiver string, kind string, owner string, name string")
    return best.select("scope", "receiver", F.explode("types").alias("type")), functools.reduce(DataFrame.unionByName, asked, none).distinct()


def bind_params(args: DataFrame, typed: DataFrame, cells: DataFrame) -> DataFrame:
    """New ``param`` cells: arguments whose types are known, for parameters that have none yet."""
    found = args.join(typed.withColumnRenamed("receiver", "value"), ["scope", "value"])
    return found.select(F.lit("param").alias("kind"), "owner", "name", "type", "via").distinct().join(cells.select(*CELL).distinct(), CELL, "left_anti")


def bind_fields(assignments: DataFrame, new: DataFrame, cells: DataFrame) -> DataFrame:
    """New ``field`` cells from the ``new`` ones: ``self.x = parameter`` and ``self.y = self.x``; a field takes all types of its source."""
    a = assignments.where(F.col("target").startswith("self.") & F.contains("scope", F.lit(".")) & (F.col("value") != "")).select(
        F.col("id").alias("via"), "scope", "value", F.col("target").alias("name"), _class_of(F.col("scope")).alias("owner"))
    of = lambda kind, owner: new.where(F.col("kind") == kind).select(F.col("owner").alias(owner), F.col("name").alias("value"), "type")
    rows = a.join(of("param", "scope"), ["scope", "value"]).select("owner", "name", "type", "via").unionByName(
        a.where(F.col("value").startswith("self.")).join(of("field", "owner"), ["owner", "value"]).select("owner", "name", "type", "via"))
    return rows.select(F.lit("field").alias("kind"), "owner", "name", "type", "via").distinct().join(cells.select(*CELL).distinct(), CELL, "left_anti")


def type_cells(assignments: DataFrame, params: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """All cells with their types: rounds of ``bind_params`` and ``bind_fields`` until a round brings no new cell."""
    args = CutTable(constructor_args(assignments, params, t)).df
    new = CutTable(seed_cells(assignments, params, t))
    tables, asked, due = [new], None, args.select("scope", F.col("value").alias("receiver")).distinct()
    while not new.is_empty():
        cells = functools.reduce(DataFrame.unionByName, [c.df for c in tables])
        if asked is not None:
            due = asked.df.join(new.df.select(*CELL).distinct(), CELL, "left_semi").select("scope", "receiver").distinct()
        due = CutTable(due).df
        typed, looked = receiver_type(due, cells, t["modules"], local_first=True)
        typed = CutTable(typed).df
        waiting = looked if asked is None else asked.df.join(due, ["scope", "receiver"], "left_anti").unionByName(looked)
        after = CutTable(waiting.join(typed.select("scope", "receiver").distinct(), ["scope", "receiver"], "left_anti"))
        new = CutTable(bind_params(args, typed, cells).unionByName(bind_fields(assignments, new.df, cells)))
        if asked is not None:
            asked.drop()
        asked = after
        tables.append(new)
        if len(tables) > PARTS:
            whole = CutTable(functools.reduce(DataFrame.unionByName, [c.df for c in tables]))
            for part in tables[:-1]:
                part.drop()
            tables = [whole]
    return functools.reduce(DataFrame.unionByName, [c.df for c in tables])


def binding_edges(cells: DataFrame) -> DataFrame:
    """PARAM_BINDS_TO and FIELD_BINDS_TO edges at 0.90, from the assignment to the class."""
    kind = F.when(F.col("kind") == "param", "PARAM_BINDS_TO").otherwise("FIELD_BINDS_TO")
    return cells.where("kind <> 'var' AND via IS NOT NULL").select(
        kind.alias("kind"), F.col("via").alias("from_id"), F.concat(F.lit("class:"), "type").alias("to_id"), F.lit("INFERRED").alias("source"),
        F.lit(0.9).alias("confidence"), F.lit("resolved_inferred").alias("resolution_status")).distinct()


def method_calls(calls: DataFrame, cells: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """CALLS and RESOLVES_TO edges of calls with a receiver.

    ``module.member`` is exact (1.0); ``self`` 0.90, other receivers 0.85, to the method of the type or its nearest base, else to
    ``type.method``; ``super()`` starts at the first base. A receiver of several types gives a CALLS edge at 0.55 to each.
    """
    c = calls.where("scope <> '' AND receiver <> '' AND method_name <> ''")
    placed = c.join(S.module_for_scope(c, t["modules"]), "scope")
    member = S.resolve_member(placed.select("module", F.col("receiver").alias("alias"), F.col("method_name").alias("member")), t)
    exact = placed.join(member.select("module", F.col("alias").alias("receiver"), F.col("member").alias("method_name"), "full"), ["module", "receiver", "method_name"])
    rest = CutTable(placed.join(exact.select("id"), "id", "left_anti").select("id", "scope", "receiver", "method_name")).df
    typed = receiver_type(rest.where("receiver <> 'super()'"), cells, t["modules"])[0]
    above = rest.where("receiver = 'super()'").select("scope", _class_of(F.col("scope")).alias("full")).where("full IS NOT NULL").distinct().join(t["bases"].where("pos = 0"), "full", "left")
    typed = typed.unionByName(above.select("scope", F.lit("super()").alias("receiver"), F.coalesce("base", "full").alias("type")))
    n = typed.groupBy("scope", "receiver").agg(F.count(F.lit(1)).alias("n"))
    hit = CutTable(rest.join(typed, ["scope", "receiver"]).join(n, ["scope", "receiver"])).df
    target = S.resolve_method(hit.where("n = 1").select(F.col("type").alias("class_full"), F.col("method_name").alias("method")), t)
    sure = hit.where("n = 1").join(target.select(F.col("class_full").alias("type"), F.col("method").alias("method_name"), "full"), ["type", "method_name"], "left")
    plain = F.concat_ws(".", "type", "method_name")
    out = [(exact, F.col("full"), F.lit(1.0), "resolved_exact", "EXTRACTED", True), (sure, F.coalesce("full", plain), F.when(F.col("receiver") == "self", 0.9).otherwise(0.85), "resolved_inferred", "INFERRED", True),
           (hit.where("n > 1"), plain, F.lit(0.55), "ambiguous", "INFERRED", False)]
    edges = []
    for df, to, confidence, status, source, both in out:
        e = [F.struct(F.lit("CALLS").alias("kind"), F.col("scope").alias("from_id"), to.alias("to_id"))]
        e += [F.struct(F.lit("RESOLVES_TO").alias("kind"), F.col("id").alias("from_id"), F.concat(F.lit("method:"), to).alias("to_id"))] if both else []
        edges.append(df.select(F.explode(F.array(*e)).alias("e"), F.lit(source).alias("source"), confidence.alias("confidence"), F.lit(status).alias("resolution_status")).select("e.*", "source", "confidence", "resolution_status"))
    every = functools.reduce(DataFrame.unionByName, edges)
    return every.groupBy("kind", "from_id", "to_id").agg(*[F.max_by(c, "confidence").alias(c) for c in ("source", "resolution_status")], F.max("confidence").alias("confidence"))


def resolve_types(assignments: DataFrame, params: DataFrame, calls: DataFrame, t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(cells, edges): the fixpoint, its binding edges and the calls it resolves."""
    cells = CutTable(type_cells(assignments, params, t)).df
    return cells, binding_edges(cells).unionByName(method_calls(calls, cells, t))
