"""How large tables are taken to be and how they are dealt out: what a driver and its tasks meet at size."""
from pyspark.sql import functions as F

from tremor import catalog
from tremor.catalog import delta as delta_queries
from tremor.functions import textjoin
from tremor.operators import extract
from tremor.plans.loops import cut


def test_stored_table_of_repeated_texts_is_not_broadcast(spark):
    """300,000 rows of the same texts are one small file, and some 40 MB for the driver that would broadcast them."""
    rows = spark.range(0, 300_000, 1, 4).select((F.col("id") % 50_000).alias("id"), F.lit("a path that every row has " * 4).alias("text"))
    joined = cut(rows).join(cut(rows.withColumnRenamed("text", "other")), "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_files_of_one_piece_are_parsed_by_all_cores_in_few_batches(spark):
    """A task's rows leave it in batches of many files, and the files of one partition go to all tasks."""
    files = spark.range(0, 400, 1, 1).select(F.lit("r").alias("repo"), F.concat(F.lit("p"), "id", F.lit(".py")).alias("path"), F.lit("import os\n\n\ndef f(a):\n    return g(a)\n").alias("content"))

    def sizes(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows for b in batches]})

    found = [r["n"] for r in extract.syntax(files).mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 400 * 5 and len(found) < 400
    assert len({r["p"] for r in extract.syntax(files).select(F.spark_partition_id().alias("p")).collect()}) >= spark.sparkContext.defaultParallelism


def test_stream_of_a_table_in_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k // 2}", "en", "web", 6) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["seq"], r["change"]) for r in catalog.QUERIES["S01_stream_file_changes"](spark, str(tmp_path)).collect())
    assert got == [(k, "added" if k == 0 else "modified") for k in range(0, 40, 2)]


def test_needles_meet_few_texts_they_are_not_in(spark):
    """Ids of one pattern share all their short grams: a candidate must share more than three digits."""
    ids = spark.range(0, 20_000, 1, 4).select(F.concat(F.lit("part:"), "id").alias("text"))
    needles = spark.range(10_000, 20_000, 7, 4).select(F.concat(F.lit("rt:"), "id").alias("needle"))
    grams = textjoin._grams
    sizes = []
    textjoin._grams = lambda text, n: sizes.append(n) or grams(text, n)
    try:
        assert textjoin.contains_join(ids, "text", needles, "needle").count() == needles.count()
    finally:
        textjoin._grams = grams
    assert set(sizes) == {8}


def _written(call):
    """The tables that ``call`` stores, by their columns."""
    from tremor.plans import loops
    found, init = [], loops.CutTable.__init__

    def watched(self, df):
        found.append(df)
        init(self, df)

    loops.CutTable.__init__ = watched
    try:
        call()
    finally:
        loops.CutTable.__init__ = init
    return found


def test_review_walks_carry_no_paths(spark):
    """A row of a review's walk is three numbers, and a symbol is walked once however many changes touch it."""
    stored = _written(lambda: catalog.QUERIES["F06_review_report"](spark, "/root/testdata/sf0.001").count())
    assert not any("path" in df.columns and "chain" in df.columns for df in stored)
    walked = [df for df in stored if df.columns == ["s", "n", "depth"]]
    assert walked and all(dict(df.dtypes)[c] in ("bigint", "int") for df in walked for c in df.columns)


def test_facts_of_a_state_are_computed_once(spark):
    """The context of a rerun reads both states' observations once each, not once for every join."""
    asked = []
    rows = delta_queries.P.edge_rows
    delta_queries.P.edge_rows = lambda *a: asked.append(a) or rows(*a)
    try:
        out = catalog.QUERIES["G06_context_facts"](spark, "/root/testdata/sf0.001")
    finally:
        delta_queries.P.edge_rows = rows
    assert len(asked) == 2 and "lineitem" not in "".join(out.inputFiles())


def test_few_needles_are_looked_for_without_grams(spark, monkeypatch):
    """Both ways give the same rows; a handful of needles is met without cutting the texts into grams."""
    hay = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat", "a License", "", None, "other the the", "x"])], "i int, text string")
    needles = spark.createDataFrame([("the",), ("License",), ("the",), ("",), (None,), ("x",), ("absent",)], "needle string")
    got = lambda: sorted((r["i"], r["needle"]) for r in textjoin.contains_join(hay, "text", needles, "needle").collect())
    grams, cuts = textjoin._grams, []
    monkeypatch.setattr(textjoin, "_grams", lambda text, n: cuts.append(n) or grams(text, n))
    few = got()
    assert few == [(0, "the"), (0, "the"), (1, "License"), (4, "the"), (4, "the"), (5, "x")] and not cuts
    monkeypatch.setattr(textjoin, "FEW", 0)
    assert got() == few and cuts


def test_summary_and_tests_of_changes_read_stored_parts(spark):
    """The parts that a query reads more than once are tables, so that their joins are not planned and broadcast again."""
    for name, columns in (("B14_hygiene_summary", ["id", "reachability", "tags"]), ("B15_unknown_libraries", ["repo", "ecosystem", "name"]),
                          ("F05_recommended_tests", ["file", "node", "_p"])):
        assert any(df.columns == columns for df in _written(lambda: catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))), name


def test_checks_read_edges_once(spark):
    """The deduplicated edges feed two kinds of checks: they are stored once, by their keys alone."""
    stored = _written(lambda: catalog.QUERIES["M04_check_status"](spark, "/root/testdata/sf0.001"))
    assert sum(df.columns == ["from_id", "to_id", "kind"] for df in stored) == 1 and any("needle" in df.columns and "project" in df.columns for df in stored)


def test_regions_read_calls_once(spark):
    """Calls are grouped once for nodes and edges, and the queue takes candidates out of one minimum, without joining the regions to it."""
    stored = _written(lambda: catalog.QUERIES["H05_research_requests"](spark, "/root/testdata/sf0.001"))
    from_lines = [df for df in stored if "lineitem" in "".join(df.inputFiles())]
    assert len(from_lines) == 1 and {"flag", "qty"} <= set(from_lines[0].columns)


def test_queue_keeps_the_first_of_each_signature(spark):
    from tremor.operators import coverage
    rows = [(f"unknown:{k}:{t}", t, k, f, 1, e, c, None, None, None, None) for k, t, f, e, c in [
        ("unresolved_call", "b", "x.py", True, "go"), ("unresolved_call", "a", "x.py", True, "go"), ("unresolved_call", "c", None, False, "go"), ("unresolved_call", "d", "x.py", True, None),
        ("isolated_symbol", "e", "x.py", True, None), ("suspicious_edge", "f", None, False, None), ("suspicious_edge", "g", None, False, None)]]
    regions = spark.createDataFrame(rows, "region_id string, target_id string, kind string, file string, line int, has_evidence boolean, call_name string, receiver string, method string, scope string, taxonomy string")
    of = lambda df: sorted(tuple(r[c] for c in ("region_id", "file", "call_name", "score", "priority", "outcome")) for r in df.collect())
    got = coverage.candidates(regions)
    assert of(got) == of(coverage.rate_regions(regions).where("outcome = 'candidate'")) and [r[0][-1] for r in of(got)] == ["f", "g", "a", "d"]
    assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()


def test_paths_between_pairs_meet_only_edges_that_lead_there(spark):
    """The path is the one over all edges; observations that lead to no target are not deduplicated."""
    from tremor.operators import graph, impact
    ends = [("a", "b"), ("b", "t"), ("a", "c"), ("c", "t"), ("a", "x"), ("x", "y"), ("z", "t"), ("b", "a"), ("t", "a")]
    rows = spark.createDataFrame([(f"{a}{b}", a, b, "CALLS", "r", "EXTRACTED", 0.9 if b != "c" else 0.95, None, "seen", f"{k:02}") for k, (a, b) in enumerate(ends)],
                                 "id string, from_id string, to_id string, kind string, rule_id string, source string, confidence double, status string, ev_text string, ord string"
                                 ).withColumn("warnings", F.lit(None).cast("array<string>"))
    pairs = spark.createDataFrame([("p", "a", "t"), ("q", "x", "t"), ("r", "z", "c")], "query_id string, from_id string, to_id string")
    of = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    got = []
    stored = _written(lambda: got.append(impact.impact_path_of_rows(rows, pairs)))
    assert of(got[0]) == of(impact.impact_path(graph.dedupe_edges(rows), pairs)) and of(got[0])[0][5] == "['a', 'c', 't']"
    assert {r["id"] for df in stored if "quality" in df.columns for r in df.collect()}.isdisjoint({"ax", "xy"})


def test_batch_walk_carries_what_its_result_shows(spark):
    stored = _written(lambda: catalog.QUERIES["E07_impact_batch"](spark, "/root/testdata/sf0.001").count())
    assert any("path" in df.columns for df in stored) and not any("chain" in df.columns or "node_ids" in df.columns for df in stored)


def test_each_request_is_explained_by_its_own_pair(spark):
    """Two requests of one id are two rows, each with the first edge of its pair and kind."""
    from tremor.operators import impact
    edges = spark.createDataFrame([(f"{a}{b}{k}{n}", a, b, k, "EXTRACTED", 0.9, "", None, True, f"{n}") for a, b, k, n in [("a", "b", "CALLS", 2), ("a", "b", "TESTS", 1), ("a", "b", "TESTS", 3), ("a", "c", "CALLS", 1)]],
                                  "id string, from_id string, to_id string, kind string, source string, confidence double, rule_id string, status string, has_evidence boolean, ord string"
                                  ).withColumn("warnings", F.lit(None).cast("array<string>"))
    asked = spark.createDataFrame([("r", "a", "b", "CALLS"), ("r", "a", "c", None), ("s", "a", "b", None), ("t", "a", "b", "HTTP_CALLS"), ("u", None, "b", None)], "request_id string, from_id string, to_id string, kind string")
    got = sorted((r["request_id"], r["to_id"], r["edge_id"]) for r in impact.explain_edges(edges, asked).collect())
    assert got == [("r", "b", "abCALLS2"), ("r", "c", "acCALLS1"), ("s", "b", "abTESTS1"), ("t", "b", None), ("u", "b", None)]


def test_rebuilt_nodes_read_no_new_edges(spark):
    """Comparing nodes needs the edges of the state before alone, and what stays is stored once."""
    asked, rows = [], delta_queries.P.edge_rows
    delta_queries.P.edge_rows = lambda *a: asked.append(a) or rows(*a)
    try:
        stored = _written(lambda: catalog.QUERIES["G08_equal_rebuild"](spark, "/root/testdata/sf0.001"))
    finally:
        delta_queries.P.edge_rows = rows
    assert len(asked) == 1 and any(df.columns == ["id", "kind", "name", "file"] for df in stored)


_ROWS = "id string, from_id string, to_id string, kind string, rule_id string, source string, confidence double, status string, ev_text string, ev_file string, ev_line int, ord string, shipped int"


def _observations(spark):
    """Lone rows, repeated ids and ends, one id of two pairs of ends, blank ends, no order, no evidence; in states 1, 2, both or none."""
    rows = [("ab", "a", "b", "CALLS", "r", 1), ("ac", "a", "c", "CALLS", "r", 3), ("ac", "a", "c", "CALLS", "q", 2), ("x", "a", "d", "CALLS", "r", 1), ("x", "b", "d", "CALLS", "s", 2),
            ("y", "a", "d", "CALLS", "s", 3), ("z1", "e", "f", "TESTS", "r", 3), ("z2", "e", "f", "TESTS", "r", 1), ("bl", " ", "b", "CALLS", "r", 3), ("bl", "g", "b", "CALLS", "r", 3), ("n", "h", "i", "CALLS", None, 0),
            ("o", "j", "k", "CALLS", "r", 2), (None, "l", "m", "CALLS", "r", 3)]
    full = [(i, a, b, k, r, "EXTRACTED" if n % 2 else "INFERRED", 0.5 + n / 100, "weak" if n % 3 else None, None if n % 5 == 4 else "seen", f"f{n}.py", n, None if i == "o" else f"{n:02}", s) for n, (i, a, b, k, r, s) in enumerate(rows)]
    return spark.createDataFrame(full, _ROWS).withColumn("warnings", F.when(F.col("ev_line") % 4 == 1, F.array(F.lit("w"))))


def _all(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_lone_observations_are_their_edges(spark, monkeypatch):
    """Only observations whose id or ends occur again are dealt out and merged; the edges and their places are those of the whole."""
    from tremor.operators import graph
    rows = _observations(spark)
    lone, shared = graph.apart(rows)
    assert sorted(r["id"] for r in lone.collect()) == ["ab", "n"] and shared.count() == rows.count() - 2
    edges, placed = _all(graph.dedupe_edges(rows)), _all(graph.placed_edges(rows))
    monkeypatch.setattr(graph, "FEW_SHARED", 0)
    assert graph.apart(rows)[0] is None and _all(graph.dedupe_edges(rows)) == edges and _all(graph.placed_edges(rows)) == placed


def test_difference_of_two_states_of_observations(spark):
    from tremor.operators import delta, facts, graph
    rows = _observations(spark)
    nodes = spark.createDataFrame([("a", "CLASS", "A", "a.py", 1, None), ("a", "CLASS", "A", "a.py", 2, None), ("b", "METHOD", None, None, None, 2.0)], "id string, kind string, name string, file string, line int, criticality double")
    states = {w: rows.where(f"shipped IN ({w}, 3)") for w in (1, 2)}
    old, new = (facts.facts_from_graph(nodes, graph.dedupe_edges(s), graph.evidence_places(s)) for s in states.values())
    got = delta.fact_diff_of_rows(nodes, rows, "shipped IN (1, 3)", "shipped IN (2, 3)")
    assert _all(got) == _all(delta.fact_diff(old, new)) and got.count() > 8


def test_shuffle_files_go_with_their_execution(spark):
    rows = spark.range(0, 1000, 1, 4)
    cut(rows.groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    again = rows.groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(again.collect()) == sorted(again.collect())


def test_reviews_without_lists_store_numbers(spark):
    """Required tests and the report meet edges by their numbers: neither stores edges with their ids and orders, and both are the review's."""
    for name in ("F04_required_tests", "F06_review_report"):
        stored = _written(lambda: catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert not any({"edge_id", "quality"} <= set(df.columns) or {"ord", "quality"} <= set(df.columns) for df in stored), name


def test_second_run_of_determinism_is_dealt_out_once(spark):
    stored = _written(lambda: catalog.QUERIES["M06_determinism"](spark, "/root/testdata/sf0.001"))
    assert sum("ev_text" in df.columns and "shipped" not in df.columns for df in stored) >= 1 and not any("ev_file" in df.columns and "shipped" not in df.columns for df in stored)
