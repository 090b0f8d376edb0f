"""Registered queries of the type fixpoint (J11 to J15): every part is a class whose constructor takes the part before it."""
from functools import reduce

from pyspark.sql import DataFrame

from tremor.catalog.core import query, using
from tremor.catalog.symbols import PARTS, _tables
from tremor.operators import types as T
from tremor.plans.loops import cut
from tremor.sources import projection as P

_CLASS = "concat('pkg.s', no, '.Part', k)"
_INIT = "concat('pkg.s', no, '.Part', k, '.__init__')"
# Every part is built in its module from the variable of the part before; its constructor stores it, some store it twice.
ASSIGNS = f"""SELECT concat('b', k) AS id, concat('pkg.s', no, '.build') AS scope, concat('v', k) AS target, CAST(NULL AS STRING) AS value, {_CLASS} AS call_name,
   CASE WHEN slot > 0 THEN array(concat('v', k - 1)) ELSE array() END AS args, CAST(NULL AS MAP<STRING, STRING>) AS keyword_args, int(k) AS ord FROM ({PARTS}) p
 UNION ALL SELECT concat('f', k), {_INIT}, 'self.dep', 'dep', NULL, array(), NULL, int(k) FROM ({PARTS}) p
 UNION ALL SELECT concat('g', k), {_INIT}, 'self.alias', 'self.dep', NULL, array(), NULL, int(k) FROM ({PARTS}) p WHERE p_size % 3 = 0"""
PARAMS = f"SELECT {_INIT} AS scope, 0 AS pos, 'dep' AS param, CAST(NULL AS STRING) AS annotation FROM ({PARTS}) p"
CALLS = f"""SELECT concat('c', k) AS id, concat('pkg.s', no, '.Part', k, '.go') AS scope, CASE WHEN p_size % 3 = 0 THEN 'self.alias.dep' ELSE 'self.dep.dep' END AS receiver,
   CASE WHEN (slot + 3) % 5 = 0 THEN 'run' ELSE 'other' END AS method_name FROM ({PARTS}) p"""
# What the fixpoint has to find, in closed form.
_ONE, _TWO = "slot > 0", "slot > 1"
_BEFORE = "concat('pkg.s', no, '.Part', k - 1)"
_CALLED = "concat('pkg.s', no, '.Part', k - 2, CASE WHEN (slot + 3) % 5 = 0 THEN '.run' ELSE '.other' END)"
_FOUND = f"""SELECT 'CALLS' AS kind, concat('pkg.s', no, '.Part', k, '.go') AS from_id, {_CALLED} AS to_id, 0.85::DOUBLE AS confidence FROM pp WHERE {_TWO}
 UNION ALL SELECT 'RESOLVES_TO', concat('c', k), concat('method:', {_CALLED}), 0.85 FROM pp WHERE {_TWO}"""


def _facts(spark, sf) -> tuple[DataFrame, DataFrame, dict]:
    return cut(P.run(spark, sf, ASSIGNS)), cut(P.run(spark, sf, PARAMS)), _tables(spark, sf)


def _params(assigns, params, t):
    seeds = cut(T.seed_cells(assigns, params, t))
    args = cut(T.constructor_args(assigns, params, t))
    typed, _ = T.receiver_type(args.withColumnRenamed("value", "receiver"), seeds, t["modules"], local_first=True)
    return seeds, T.bind_params(args, typed, seeds)


@query("J11_bind_params", using("pp") + f"SELECT {_INIT} AS owner, 'dep' AS name, {_BEFORE} AS type, concat('b', k) AS via FROM pp WHERE {_ONE}")
def j11(spark, sf):
    return _params(*_facts(spark, sf))[1].select("owner", "name", "type", "via")


@query("J12_bind_fields", using("pp") + f"SELECT {_CLASS} AS owner, 'self.dep' AS name, {_BEFORE} AS type, concat('f', k) AS via FROM pp WHERE {_ONE}")
def j12(spark, sf):
    assigns, params, t = _facts(spark, sf)
    seeds, new = _params(assigns, params, t)
    new = cut(new)
    return T.bind_fields(assigns, new, reduce(DataFrame.unionByName, [seeds, new])).select("owner", "name", "type", "via")


@query("J13_receiver_type", using("pp") + f"SELECT concat('pkg.s', no, '.Part', k, '.go') AS scope, CASE WHEN p_size % 3 = 0 THEN 'self.alias.dep' ELSE 'self.dep.dep' END AS receiver, concat('pkg.s', no, '.Part', k - 2) AS type FROM pp WHERE {_TWO}")
def j13(spark, sf):
    assigns, params, t = _facts(spark, sf)
    return T.receiver_type(P.run(spark, sf, CALLS), cut(T.type_cells(assigns, params, t)), t["modules"])[0]


@query("J14_method_calls", using("pp") + _FOUND)
def j14(spark, sf):
    assigns, params, t = _facts(spark, sf)
    return T.method_calls(P.run(spark, sf, CALLS), cut(T.type_cells(assigns, params, t)), t).select("kind", "from_id", "to_id", "confidence")


@query("J15_resolve_types", using("pp") + _FOUND + f""" UNION ALL SELECT 'PARAM_BINDS_TO', concat('b', k), concat('class:', {_BEFORE}), 0.9 FROM pp WHERE {_ONE}
 UNION ALL SELECT 'FIELD_BINDS_TO', concat('f', k), concat('class:', {_BEFORE}), 0.9 FROM pp WHERE {_ONE}
 UNION ALL SELECT 'FIELD_BINDS_TO', concat('g', k), concat('class:', {_BEFORE}), 0.9 FROM pp WHERE {_ONE} AND p_size % 3 = 0""")
def j15(spark, sf):
    assigns, params, t = _facts(spark, sf)
    return T.resolve_types(assigns, params, P.run(spark, sf, CALLS), t)[1].select("kind", "from_id", "to_id", "confidence")
