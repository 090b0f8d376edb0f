"""Registered queries of nested objects (J23, J24, J25, J27): every part holds the part before it, some through aliases, maps and providers."""
from pyspark.sql import functions as F

from tremor.catalog.core import query, r6, using
from tremor.catalog.symbols import PARTS
from tremor.operators import objects as O
from tremor.plans.loops import cut
from tremor.sources import projection as P

_CLASS = "concat('pkg.s', no, '.Part', k)"
_AT = lambda back: f"concat('pkg.s', no, '.Part', k - {back})"
_NONE = "CAST(NULL AS DOUBLE)"
FACTS = {
    "params": f"SELECT {_CLASS} AS class, 'dep' AS param, {_AT(1)} AS type, {_NONE} AS confidence FROM ({PARTS}) p WHERE slot > 0",
    "fields": f"SELECT {_CLASS} AS owner, 'near.dep' AS field, {_CLASS} AS type, {_NONE} AS confidence, 0 AS ord FROM ({PARTS}) p WHERE p_size % 5 = 0",
    "assignments": f"""SELECT concat({_CLASS}, '.__init__') AS scope, 'self.dep' AS target, 'dep' AS value, {_NONE} AS confidence, 0 AS ord FROM ({PARTS}) p
      UNION ALL SELECT concat({_CLASS}, '.__init__'), 'self.dep', 'dep', 0.3, 1 FROM ({PARTS}) p WHERE p_size % 9 = 0
      UNION ALL SELECT concat({_CLASS}, '.__init__'), 'self.alias', 'self.dep', NULL, 2 FROM ({PARTS}) p WHERE p_size % 3 = 0
      UNION ALL SELECT concat({_CLASS}, '.go'), 'far', 'self.dep.dep', NULL, 3 FROM ({PARTS}) p""",
    "entries": f"SELECT concat({_CLASS}, '.__init__') AS scope, 'self.by' AS target, 'd' AS key, 'dep' AS value, CAST(NULL AS STRING) AS type, {_NONE} AS confidence, 0 AS ord FROM ({PARTS}) p WHERE p_size % 4 = 0",
    "providers": f"SELECT concat('box.p', k) AS provider, {_CLASS} AS type, {_NONE} AS confidence, 0 AS ord FROM ({PARTS}) p",
    "returns": f"SELECT concat('make', k) AS scope, {_CLASS} AS type, {_NONE} AS confidence, 0 AS ord FROM ({PARTS}) p WHERE p_size % 2 = 0",
    "aliases": f"""SELECT concat({_CLASS}, '.go') AS scope, 's' AS alias, 'self.alias' AS target, {_NONE} AS confidence, 0 AS ord FROM ({PARTS}) p WHERE p_size % 3 = 0
      UNION ALL SELECT concat({_CLASS}, '.ring'), 'x', 'y', NULL, 1 FROM ({PARTS}) p WHERE p_size % 7 = 0
      UNION ALL SELECT concat({_CLASS}, '.ring'), 'y', 'x', NULL, 2 FROM ({PARTS}) p WHERE p_size % 7 = 0"""}


def _bindings(spark, sf):
    facts = {name: P.run(spark, sf, sql) for name, sql in FACTS.items()}
    return O.object_bindings(facts, _classes(spark, sf))


def _classes(spark, sf):
    return P.run(spark, sf, f"SELECT {_CLASS} AS class FROM ({PARTS}) p")


def _chains(spark, sf, *texts):
    """(scope, owner, path) of the same receivers in every part; a text is (method, expression, condition)."""
    rows = " UNION ALL ".join(f"SELECT concat({_CLASS}, '.{m}') AS scope, {_CLASS} AS owner, {e} AS receiver FROM ({PARTS}) p WHERE {w}" for m, e, w in texts)
    return P.run(spark, sf, rows).select("scope", "owner", O.path_parts("receiver").alias("path"))


_text = lambda c: F.array_join(c, ".").alias(c)


@query("J23_object_bindings", using("pp") + f"""SELECT 'path' AS kind, {_CLASS} AS owner, 'dep' AS path, {_AT(1)} AS type, 0.95::DOUBLE AS confidence FROM pp WHERE slot > 0
  UNION ALL SELECT 'path', {_CLASS}, 'near.dep', {_CLASS}, 0.9 FROM pp WHERE p_size % 5 = 0 UNION ALL SELECT 'path', {_CLASS}, 'by.[d', {_AT(1)}, 0.8 FROM pp WHERE p_size % 4 = 0 AND slot > 0
  UNION ALL SELECT 'provider', '', concat('box.p', k), {_CLASS}, 0.82 FROM pp UNION ALL SELECT 'provider', '', concat('make', k), {_CLASS}, 0.8 FROM pp WHERE p_size % 2 = 0
  UNION ALL SELECT 'alias', concat('class ', {_CLASS}), 'self.alias', 'self.dep', 0.85 FROM pp WHERE p_size % 3 = 0 UNION ALL SELECT 'alias', concat('scope ', {_CLASS}, '.go'), 's', 'self.alias', 0.88 FROM pp WHERE p_size % 3 = 0
  UNION ALL SELECT 'alias', concat('scope ', {_CLASS}, '.go'), 'far', 'self.dep.dep', 0.85 FROM pp UNION ALL SELECT 'alias', concat('scope ', {_CLASS}, '.ring'), 'x', 'y', 0.88 FROM pp WHERE p_size % 7 = 0
  UNION ALL SELECT 'alias', concat('scope ', {_CLASS}, '.ring'), 'y', 'x', 0.88 FROM pp WHERE p_size % 7 = 0""")
def j23(spark, sf):
    b = _bindings(spark, sf)
    rows = b["paths"].select(F.lit("path").alias("kind"), "owner", _text("path"), "type", "confidence")
    rows = rows.unionByName(b["providers"].select(F.lit("provider").alias("kind"), F.lit("").alias("owner"), _text("path"), "type", "confidence"))
    return rows.unionByName(b["aliases"].select(F.lit("alias").alias("kind"), F.col("place").alias("owner"), F.array_join("alias", ".").alias("path"), F.array_join("target", ".").alias("type"), "confidence"))


_SHORT, _FAR, _RING = ("go", "'s.dep'", "p_size % 3 = 0"), ("go", "'far.dep'", "slot >= 0"), ("ring", "'x.z'", "slot >= 0")


@query("J24_expand_aliases", using("pp") + f"""SELECT concat({_CLASS}, '.go') AS scope, 's.dep' AS path, 'self.dep.dep' AS expanded, round(0.88 * 0.85, 6)::DOUBLE AS confidence, 2 AS hops, false AS rejected FROM pp WHERE p_size % 3 = 0
  UNION ALL SELECT concat({_CLASS}, '.go'), 'far.dep', 'self.dep.dep.dep', 0.85, 1, false FROM pp
  UNION ALL SELECT concat({_CLASS}, '.ring'), 'x.z', 'x.z', CASE WHEN p_size % 7 = 0 THEN round(0.88 * 0.88 * 0.2, 6) ELSE 1 END, CASE WHEN p_size % 7 = 0 THEN 2 ELSE 0 END, p_size % 7 = 0 FROM pp""")
def j24(spark, sf):
    out = O.expand_aliases(_chains(spark, sf, _SHORT, _FAR, _RING), cut(_bindings(spark, sf)["aliases"]))
    return out.select("scope", _text("path"), _text("expanded"), r6("confidence").alias("confidence"), "hops", "rejected")


@query("J25_resolve_chain", using("pp") + f"""SELECT concat({_CLASS}, '.go') AS scope, 's.dep' AS path, {_AT(2)} AS types, round(0.88 * 0.85 * 0.95, 6)::DOUBLE AS confidence FROM pp WHERE p_size % 3 = 0 AND slot > 1
  UNION ALL SELECT concat({_CLASS}, '.go'), 'far.dep', {_AT(3)}, round(0.85 * 0.95, 6) FROM pp WHERE slot > 2 UNION ALL SELECT concat({_CLASS}, '.go'), 'self.near.dep.dep', {_AT(1)}, 0.9 FROM pp WHERE p_size % 5 = 0 AND slot > 0
  UNION ALL SELECT concat({_CLASS}, '.go'), 'self.by.[d', {_AT(1)}, 0.8 FROM pp WHERE p_size % 4 = 0 AND slot > 0 UNION ALL SELECT concat({_CLASS}, '.go'), concat('box.p', k), {_CLASS}, 0.82 FROM pp
  UNION ALL SELECT concat({_CLASS}, '.go'), 'dep', {_AT(1)}, 0.95 FROM pp WHERE slot > 0""")
def j25(spark, sf):
    every = [("go", e, "slot >= 0") for e in ("'self.near.dep.dep'", '"self.by[\'d\']"', "concat('box.p', k)", "'dep'")]
    b = {name: cut(df) for name, df in _bindings(spark, sf).items()}
    out = O.resolve_chain(_chains(spark, sf, _SHORT, _FAR, _RING, *every), b).where("types IS NOT NULL")
    return out.select("scope", _text("path"), F.array_join(F.array_sort("types"), "|").alias("types"), r6("confidence").alias("confidence"))


def _calls(spark, sf):
    calls = P.run(spark, sf, f"""SELECT concat('a', k) AS id, concat({_CLASS}, '.go') AS scope, 's.dep' AS receiver, 'run' AS method FROM ({PARTS}) p WHERE p_size % 3 = 0
      UNION ALL SELECT concat('b', k), concat({_CLASS}, '.go'), concat('box.p', k), 'run' FROM ({PARTS}) p""")
    methods = P.run(spark, sf, f"SELECT {_CLASS} AS class, 'go' AS method FROM ({PARTS}) p UNION ALL SELECT {_CLASS}, 'run' FROM ({PARTS}) p WHERE slot % 5 = 0")
    return O.nested_calls(calls, {name: cut(df) for name, df in _bindings(spark, sf).items()}, methods, _classes(spark, sf))


@query("J27_nested_calls", using("pp") + f"""SELECT concat('a', k) AS id, concat({_CLASS}, '.go') AS from_id, concat({_AT(2)}, '.run') AS to_id, round(0.88 * 0.85 * 0.95, 6)::DOUBLE AS confidence, 'likely' AS status FROM pp WHERE p_size % 3 = 0 AND slot > 1 AND (slot - 2) % 5 = 0
  UNION ALL SELECT concat('b', k), concat({_CLASS}, '.go'), concat({_CLASS}, '.run'), 0.82, 'confirmed' FROM pp WHERE slot % 5 = 0""")
def j27(spark, sf):
    return _calls(spark, sf)[0].withColumn("confidence", r6("confidence"))


@query("J27_unresolved_calls", using("pp") + """SELECT concat('a', k) AS id, CASE WHEN slot > 1 THEN 'method missing on resolved receiver type' ELSE 'receiver type unresolved' END AS reason, 'unresolved' AS status, CASE WHEN slot > 1 THEN 1 ELSE 0 END AS candidates FROM pp WHERE p_size % 3 = 0 AND (slot < 2 OR (slot - 2) % 5 <> 0)
  UNION ALL SELECT concat('b', k), 'method missing on resolved receiver type', 'unresolved', 1 FROM pp WHERE slot % 5 <> 0""")
def j27b(spark, sf):
    return _calls(spark, sf)[1]
