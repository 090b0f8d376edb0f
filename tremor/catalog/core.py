"""Query registry and the shared SQL pieces of the checks."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor import constants as C
from tremor.operators.graph import dedupe_edges, dedupe_evidence
from tremor.sources import projection as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the statement that must give the same rows."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = P.duck_text(sql)
        return fn
    return add


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_edges(P.edge_rows(spark, sf))


def graph_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_evidence(P.edge_rows(spark, sf))


def r6(c):
    return F.round(c, 6)


def joined(c: str, sep: str = "|"):
    """Array column as one sorted text, for outputs."""
    return F.array_join(F.array_sort(F.col(c)), sep)


# --- SQL pieces --------------------------------------------------------------------------------

PRIORITY_SQL = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SOURCE_PRIORITY.items()) + " ELSE 0 END"
_MARKER_SQL = " OR ".join(f"contains(wtext, '{m}')" for m in C.SUSPICIOUS_MARKERS)

PIECES = {
    "nodes": P.NODES,
    "edge_rows": P.EDGE_ROWS,
    "node_rows": P.NODE_ROWS,
    "edges_by_key": f"""
        SELECT from_id, to_id, kind, rule_id, arg_min(id, ord) AS id, arg_max(source, {PRIORITY_SQL}) AS source,
               max(confidence) AS confidence, arg_max(status, ord) FILTER (status IS NOT NULL) AS status,
               arg_max(warning, ord) FILTER (warning IS NOT NULL) AS warning, bool_or(ev_text IS NOT NULL) AS has_evidence,
               min(ord) AS o1, max(ord) AS o2
        FROM edge_rows WHERE trim(from_id) <> '' AND trim(to_id) <> '' GROUP BY ALL""",
    "edges": f"""
        SELECT *, concat_ws(chr(1), from_id, to_id, kind, source, rule_id, id) AS ord FROM (
        SELECT id, arg_min(from_id, o1) AS from_id, arg_min(to_id, o1) AS to_id, arg_min(kind, o1) AS kind,
               arg_max(source, {PRIORITY_SQL}) AS source, max(confidence) AS confidence, arg_max(rule_id, o2) AS rule_id,
               arg_max(status, o2) FILTER (status IS NOT NULL) AS status,
               arg_max(warning, o2) FILTER (warning IS NOT NULL) AS warning, bool_or(has_evidence) AS has_evidence
        FROM edges_by_key GROUP BY id)""",
    "evidence": """
        SELECT id AS edge_id, ev_text AS description, ev_file AS file, ev_line AS line, source, min(ord) AS ord
        FROM edge_rows WHERE ev_text IS NOT NULL GROUP BY ALL""",
    "graded": f"""
        SELECT *, CASE rank WHEN 0 THEN 'rejected' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'weak' WHEN 3 THEN 'likely'
                  ELSE 'confirmed' END AS quality FROM (
        SELECT * REPLACE (CASE WHEN rank = 4 AND confidence < 0.84 THEN 3 ELSE rank END AS rank), rank = 4 AND confidence < 0.84 AS over FROM (
        SELECT *, CASE WHEN dead THEN 0 ELSE least(base, CASE WHEN has_evidence THEN 4 ELSE 2 END, CASE WHEN doubt THEN 1 ELSE 4 END) END AS rank FROM (
        SELECT *, {_MARKER_SQL} AS doubt, confidence <= 0 OR coalesce(status, '') = 'rejected' AS dead,
               CASE status WHEN 'rejected' THEN 0 WHEN 'suspicious' THEN 1 WHEN 'weak' THEN 2 WHEN 'likely' THEN 3 WHEN 'confirmed' THEN 4
               ELSE CASE WHEN confidence >= 0.84 THEN 4 WHEN confidence >= 0.7 THEN 3 WHEN confidence >= 0.55 THEN 2 ELSE 1 END END AS base FROM (
        SELECT *, lower(concat_ws(' ', warning, CASE WHEN NOT has_evidence THEN 'edge has no evidence' END)) AS wtext FROM edges))))""",
    "active": "SELECT * FROM graded WHERE quality IN ('confirmed', 'likely', 'weak')",
}
#: Pieces that many statements name more than once; computed once in each.
SHARED = {"edges", "graded", "packed", "dangling", "checks"}
NEEDS = {"edges_by_key": ["edge_rows"], "edges": ["edges_by_key"], "evidence": ["edge_rows"], "graded": ["edges"], "active": ["graded"]}


def define(name: str, sql: str, needs: list[str] = ()) -> None:
    """Add a named SQL piece other checks can build on."""
    PIECES[name] = sql
    NEEDS[name] = list(needs)


def using(*names: str) -> str:
    """``WITH RECURSIVE`` clause holding the named pieces and whatever they build on."""
    order: list[str] = []

    def visit(n):
        for m in NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    kept = lambda n: "MATERIALIZED " if n in SHARED else ""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {kept(n)}({PIECES[n]})" for n in order) + "\n"


def walk_sql(seeds: str, depth: int, direction: str = "both", active: str = "active", best_first: bool = False) -> str:
    """CTEs of a level-by-level search from ``seeds`` (query_id, node_id, rank); ends in table ``visited``."""
    down = ("SELECT from_id AS src, to_id AS dst, '->' AS arrow, {k} AS key, confidence, kind, id, source FROM " + active)
    if best_first:
        steps = down.format(k="concat(CAST(CAST(round(1000 - confidence * 100) AS INT) AS VARCHAR), chr(1), to_id, chr(1), ord)")
    else:
        up = ("SELECT to_id, from_id, '<-', concat('1', ord), confidence, kind, id, source FROM " + active)
        down = down.format(k="concat('0', ord)")
        steps = {"downstream": down, "upstream": up.replace("to_id, from_id, '<-', concat('1', ord), confidence, kind, id, source",
                 "to_id AS src, from_id AS dst, '<-' AS arrow, concat('1', ord) AS key, confidence, kind, id, source"),
                 "both": down + " UNION ALL " + up}[direction]
    out = [f", steps AS ({steps})",
           f"""l0 AS (SELECT query_id, node_id, 0 AS depth, [concat(rank, node_id)] AS path, CAST([] AS VARCHAR[]) AS edge_ids,
               [node_id] AS node_ids, node_id AS chain, CAST(1.0 AS DOUBLE) AS confidence, CAST(1.0 AS DOUBLE) AS product, true AS proven FROM ({seeds}))"""]
    seen = "SELECT * FROM l0"
    for i in range(1, depth + 1):
        out.append(f"""l{i} AS (SELECT DISTINCT ON (query_id, node_id) * FROM (
            SELECT f.query_id, s.dst AS node_id, {i} AS depth, list_append(f.path, s.key) AS path, list_append(f.edge_ids, s.id) AS edge_ids,
                   list_append(f.node_ids, s.dst) AS node_ids,
                   concat(f.chain, ' ', s.arrow, ' (', s.kind, ', c=', s.confidence, ') ', s.arrow, ' ', s.dst) AS chain,
                   least(f.confidence, s.confidence) AS confidence, f.product * s.confidence AS product,
                   f.proven AND s.source IN ('EXTRACTED', 'RUNTIME_CONFIRMED') AS proven
            FROM l{i-1} f JOIN steps s ON f.node_id = s.src
            WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.query_id = f.query_id AND v.node_id = s.dst))
            ORDER BY query_id, node_id, path)""")
        seen += f" UNION ALL SELECT * FROM l{i}"
    out.append(f"visited AS ({seen})")
    return ",\n".join(out) + "\n"
