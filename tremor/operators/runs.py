"""Confirm edges with the calls a test run observed."""
from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import columns as X
from tremor.plans.loops import CutTable

CALL_KEY = ["caller", "callee", "caller_file", "caller_line", "callee_file", "callee_line", "test_id"]

# Folders whose code is never observed.
EXCLUDED_PARTS = (".venv", "venv", "site-packages", "__pycache__", ".pytest_cache", "node_modules")


def _glob(path: Column, pattern: str) -> Column:
    if not set(pattern) & set("*?["):
        return path == pattern
    return path.rlike("(?s)^" + fnmatch.translate(pattern).replace("(?s:", "(?:").replace("\\Z", "").replace("\\z", "") + "$")


def path_included(path: Column | str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a project-relative path may be observed: no excluded folder, no excluded glob, and one of
    the included globs when there are any."""
    p = X.slashes(path)
    excludes = [e.replace("\\", "/") for e in (*EXCLUDED_PARTS, *exclude)]
    names = F.array(*[F.lit(e) for e in excludes])
    ok = F.coalesce(p != "", F.lit(False)) & ~p.startswith("<") & ~p.startswith("/") & ~p.startswith("../")
    ok = ok & ~F.arrays_overlap(F.split(p, "/"), names)
    for e in excludes:
        ok = ok & ~_glob(p, e)
    if include:
        some = F.lit(False)
        for i in include:
            some = some | _glob(p, i.replace("\\", "/"))
        ok = ok & some
    return F.coalesce(ok, F.lit(False))


def filter_calls(calls: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    return calls.where(path_included("caller_file", include, exclude) & path_included("callee_file", include, exclude))


def distinct_calls(calls: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Each observed call once, no self calls; with ``runs`` (run_id, status) only those of passed runs."""
    kept = calls.where("caller <> callee")
    if runs is not None:
        kept = kept.join(runs.where("status = 'ok'").select("run_id"), "run_id", "left_semi")
    return kept.dropDuplicates(CALL_KEY)


def normalize_symbol(symbol: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(X.col(symbol), F.lit(""))), "^(method:|function:|class:)", "")


def _last_parts(parts: str, n: str) -> Column:
    return F.slice(F.col(parts), -F.col(n), F.col(n))


def meeting_keys(pairs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of pairs (caller, callee, parts _c, _d) and edges (edge_id, parts _from, _to), each once for every count of
    parts on the other side, with a hash ``_k`` of the ends that both have."""
    shapes = lambda df, *cols: F.broadcast(df.select(*cols).distinct())

    def keyed(df: DataFrame, left: str, right: str, *keep: str) -> DataFrame:
        long = df.withColumns({"_a": F.least("_nc", "_nf"), "_b": F.least("_nd", "_nt")})
        return long.select(*keep, "_nc", "_nd", "_nf", "_nt", F.xxhash64(_last_parts(left, "_a"), _last_parts(right, "_b")).alias("_k"))

    return (keyed(pairs.crossJoin(shapes(edges, "_nf", "_nt")), "_c", "_d", "caller", "callee"),
            keyed(edges.crossJoin(shapes(pairs, "_nc", "_nd")), "_from", "_to", "edge_id", "_from", "_to"))


def match_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, callee, how, matches, edge_id): one row per distinct called pair that meets any CALLS edge.

    ``edge_id`` is set only when the match is unique. Exact names come first; for the rest, names
    may differ by a dotted prefix on either side. So the shorter of two names is the end of the longer one: a pair
    whose names have so many parts meets the edges whose names have so many parts by the ends that both have. Each row
    is sent once for every count of parts on the other side, with a hash of those ends, and two popular method names
    do not pair every caller with every edge.
    """
    split = lambda c: F.split(c, r"\.")
    e = CutTable(edges.where(F.upper("kind") == "CALLS").select(
        F.col("id").alias("edge_id"), split(normalize_symbol("from_id")).alias("_from"), split(normalize_symbol("to_id")).alias("_to"))
        .withColumns({"_nf": F.size("_from"), "_nt": F.size("_to")})).df
    p = CutTable(pairs.select("caller", "callee", split(normalize_symbol("caller")).alias("_c"), split(normalize_symbol("callee")).alias("_d"))
                 .withColumns({"_nc": F.size("_c"), "_nd": F.size("_d")})).df
    asked, known = meeting_keys(p, e)
    c, d = split(normalize_symbol("caller")), split(normalize_symbol("callee"))
    same = lambda name, part, n, m: F.slice(name, -F.least(n, m), F.least(n, m)) == F.slice(part, -F.least(n, m), F.least(n, m))
    met = asked.join(known, ["_nc", "_nd", "_nf", "_nt", "_k"]).where(same(c, F.col("_from"), "_nc", "_nf") & same(d, F.col("_to"), "_nd", "_nt"))
    whole = (F.col("_nc") == F.col("_nf")) & (F.col("_nd") == F.col("_nt"))
    named = (normalize_symbol("caller") != "") & (normalize_symbol("callee") != "")
    each = met.where(whole | named).groupBy("caller", "callee", "edge_id").agg(F.count_if(whole).alias("_n"))
    exact = F.col("_n") > 0
    found = each.groupBy("caller", "callee").agg(
        F.sum("_n").alias("_exact"), F.min(F.when(exact, F.col("edge_id"))).alias("_own"), F.count(F.lit(1)).alias("_all"), F.min("edge_id").alias("_any"))
    matches = F.when(F.col("_exact") > 0, F.col("_exact")).otherwise(F.col("_all"))
    one = F.when(matches == 1, F.when(F.col("_exact") > 0, F.col("_own")).otherwise(F.col("_any")))
    return CutTable(found.select("caller", "callee", matches.alias("matches"), one.alias("edge_id"),
                                 F.when(F.col("_exact") > 0, "exact").otherwise("suffix").alias("how"))).df


def match_calls(calls: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Matched (edge, test) rows, unmatched calls, and diagnostics of ambiguous pairs."""
    calls = CutTable(calls).df
    found = match_pairs(calls.select("caller", "callee").distinct(), edges)
    joined = calls.join(found.where("edge_id IS NOT NULL").select("caller", "callee", "edge_id"), ["caller", "callee"], "left")
    best = F.struct("confidence", "caller_file", "caller_line", "callee_file", "callee_line")
    matched = joined.where("edge_id IS NOT NULL").groupBy("edge_id", "test_id").agg(F.max(best).alias("b")).select(
        "edge_id", "test_id", F.col("b.confidence").alias("runtime_confidence"), "b.caller_file", "b.caller_line", "b.callee_file", "b.callee_line")
    ambiguous = found.where("edge_id IS NULL").select(
        "caller", "callee", "matches", F.when(F.col("how") == "exact", "warning").otherwise("info").alias("level"),
        F.when(F.col("how") == "exact", "Runtime call matched multiple exact CALLS edges and was left unmatched.")
        .otherwise("Runtime call had ambiguous suffix matches and was left unmatched.").alias("message"))
    return {"matched": matched, "unmatched": joined.where("edge_id IS NULL").drop("edge_id"), "diagnostics": ambiguous}


def apply_confirmations(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Raise confidence and mark edges that a run confirmed. The confirming tests stay in ``matched``,
    one row per (edge, test); running this twice on the same matches changes nothing."""
    by_edge = matched.groupBy(F.col("edge_id").alias("id")).agg(
        F.max(F.coalesce("runtime_confidence", F.lit(0.98))).alias("runtime_confidence"),
        F.count_distinct("test_id").alias("confirming_tests"))
    hit = F.col("runtime_confidence").isNotNull()
    return edges.join(by_edge, "id", "left").withColumns({
        "confidence": F.greatest("confidence", "runtime_confidence"),
        "runtime_confirmed": hit, "confirming_tests": F.coalesce("confirming_tests", F.lit(0)),
        "validation_status": F.when(hit, "runtime_observed"),
        "sources": F.when(hit, F.array_distinct(F.array("source", F.lit("RUNTIME_CONFIRMED")))).otherwise(F.array("source"))})


def confirmation_evidence(matched: DataFrame, tests: DataFrame) -> DataFrame:
    """Evidence rows of the confirmations. tests: (test_id, file)."""
    files = tests.groupBy("test_id").agg(F.max("file").alias("file"))
    text = F.when(F.coalesce("test_id", F.lit("")) != "", F.concat(F.lit("Runtime confirmed by "), "test_id")).otherwise("Runtime confirmed by tests")
    return matched.join(files, "test_id", "left").select(
        "edge_id", text.alias("description"), F.coalesce("file", F.lit("")).alias("file"), F.lit("RUNTIME_CONFIRMED").alias("source"), "runtime_confidence")


def observed_edges(unmatched: DataFrame) -> DataFrame:
    """Opt-in: edges for calls no static edge explains, marked as observations only."""
    return unmatched.groupBy("caller", "callee").agg(F.max("confidence").alias("confidence"), F.count_distinct("test_id").alias("confirming_tests")).select(
        F.concat(F.lit("runtime:"), "caller", F.lit(":CALLS:"), "callee").alias("id"), F.lit("CALLS").alias("kind"),
        F.col("caller").alias("from_id"), F.col("callee").alias("to_id"), F.lit("RUNTIME_CONFIRMED").alias("source"),
        "confidence", F.lit("runtime_only_observation").alias("validation_status"), "confirming_tests")


def quarantine(unmatched: DataFrame) -> DataFrame:
    return unmatched.withColumns({
        "kind": F.lit("runtime_only_observation"), "status": F.lit("quarantined"),
        "reason": F.lit("runtime target was not mapped to a static graph edge")})


def run_summary(calls: DataFrame, matched: DataFrame, unmatched: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (calls.agg(F.count(F.lit(1)).alias("runtime_calls"), F.count_distinct("test_id").alias("tests"))
            .join(n(matched, "matched_edges"), F.lit(True)).join(n(unmatched, "unmatched_calls"), F.lit(True)))
