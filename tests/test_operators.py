"""Hand-made cases and random inputs checked against plain Python."""
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tremor.functions import paths as PA
from tremor.functions.textjoin import contains_join
from tremor.operators import delta, evaluate, extract, graph, hygiene, impact, quality, review, routes, rules, runs, symbols
from tremor.plans.loops import cut, global_index
from tremor.sources import corpus, graphs
from tremor.streaming import feeds

EDGE = "id string, kind string, from_id string, to_id string, source string, confidence double, rule_id string, status string, warnings array<string>, has_evidence boolean"


def edges_of(spark, pairs, **over):
    base = {"kind": "CALLS", "source": "EXTRACTED", "confidence": 1.0, "rule_id": "", "status": None, "warnings": None, "has_evidence": True, **over}
    data = [(f"{a}-{b}-{i}", base["kind"], a, b, base["source"], base["confidence"], base["rule_id"], base["status"], base["warnings"], base["has_evidence"])
            for i, (a, b) in enumerate(pairs)]
    from tremor.functions.columns import canonical_order
    return spark.createDataFrame(data, EDGE).withColumn("ord", canonical_order())


@pytest.mark.parametrize("conf,status,warnings,evidence,expected", [
    (0.84, None, None, True, "confirmed"), (0.70, None, None, True, "likely"), (0.55, None, None, True, "weak"), (0.54, None, None, True, "suspicious"),
    (0.0, None, None, True, "rejected"), (1.0, None, None, False, "weak"), (1.0, None, ["Ambiguous owner"], True, "suspicious"),
    (0.5, "confirmed", None, True, "likely"), (1.0, "rejected", None, True, "rejected"), (0.9, "WEAK", None, True, "weak"),
])
def test_edge_quality(spark, conf, status, warnings, evidence, expected):
    e = edges_of(spark, [("a", "b")], confidence=conf, status=status, warnings=warnings, has_evidence=evidence)
    assert quality.edge_quality(e).first()["quality"] == expected


def python_walk(pairs, ords, start, depth, direction):
    """Queue search in edge list order: node -> (depth, path of edge ids)."""
    order = sorted(range(len(pairs)), key=lambda i: ords[i])
    found, queue, used = {}, deque([(start, 0, [])]), set()
    seen = {start}
    while queue:
        node, d, path = queue.popleft()
        if d >= depth:
            continue
        steps = []
        if direction in ("downstream", "both"):
            steps += [(pairs[i][1], i) for i in order if pairs[i][0] == node]
        if direction in ("upstream", "both"):
            steps += [(pairs[i][0], i) for i in order if pairs[i][1] == node]
        for nxt, i in steps:
            if i in used:
                continue
            used.add(i)
            if nxt not in seen:
                seen.add(nxt)
                found[nxt] = (d + 1, path + [i])
                queue.append((nxt, d + 1, path + [i]))
    return found, used


@pytest.mark.parametrize("direction,seed", [("both", 1), ("downstream", 2), ("upstream", 3)])
def test_walk_matches_queue_search(spark, direction, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)]
    e = edges_of(spark, pairs)
    ids = {r["id"]: i for i, r in enumerate(e.collect())}
    ords = [r["ord"] for r in e.collect()]
    starts = ["n0", "n1", "n2"]
    seeds = spark.createDataFrame([(s, s, 0) for s in starts], "query_id string, node_id string, rank int")
    reached, touched = impact.impact_batch(e, seeds, direction, 3)
    got = {(r["query_id"], r["node_id"]): (r["depth"], [ids[x] for x in r["edge_ids"]]) for r in reached.collect()}
    got_edges = {(r["query_id"], ids[r["edge_id"]]) for r in touched.collect()}
    for s in starts:
        found, used = python_walk(pairs, ords, s, 3, direction)
        assert {k[1]: v for k, v in got.items() if k[0] == s} == found
        assert {i for q, i in got_edges if q == s} == used


@pytest.mark.parametrize("direction", ["both", "downstream", "upstream"])
def test_only_observations_near_the_question_are_deduplicated(spark, direction):
    """F32, F33, F37 to F41: a question over observations gives what the whole graph gives, from few of them."""
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(330)]
    rows = edges_of(spark, pairs + pairs[:50], confidence=0.9).withColumns({
        "id": F.concat("from_id", F.lit(">"), "to_id"), "ord": F.concat_ws("|", F.lpad(F.monotonically_increasing_id().cast("string"), 12, "0"), "id"),
        "ev_text": F.when(F.hash("id") % 3 != 0, F.lit("seen"))})
    rows, nodes = cut(rows), spark.createDataFrame([(f"n{k}", "CLASS", f"name{k}", None, None) for k in range(250)], "id string, kind string, name string, file string, criticality double")
    asked = spark.createDataFrame([("q", pairs[0][direction == "upstream"], None, None)], "query_id string, target string, symbol string, file_path string")
    got = impact.impact_of_rows(nodes, rows, asked, 3, direction)
    want = impact.impact_query(nodes, graph.dedupe_edges(rows), asked, direction, 3)
    table = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for part in ("seeds", "reached", "edges"):
        assert table(got[part]) == table(want[part])
    assert got["reached"].count() > 0 and 0 < impact.rows_within(rows, got["seeds"], 3, direction).count() < 200


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [("hub", f"n{i:02d}") for i in range(0, 60, 9)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r["node_id"]: r["component"] for r in graph.components(edges_of(spark, pairs)).collect()}
    smallest = {}
    for n in got:
        smallest.setdefault(root(n), []).append(n)
    assert got == {n: min(ns) for ns in smallest.values() for n in ns}


def test_components_of_nothing(spark):
    assert graph.components(edges_of(spark, [])).count() == 0


def test_global_index_is_gapless(spark):
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(7)
    got = global_index(df, "k").orderBy("k").collect()
    assert [r["index"] for r in got] == list(range(1, 1001))


@pytest.mark.parametrize("needles", [5, 120])
def test_contains_join_is_complete(spark, needles):
    rng = random.Random(needles)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    hay = [word(rng.randrange(1, 12)) for _ in range(80)]
    want = sorted({word(rng.randrange(1, 6)) for _ in range(needles)})
    h = spark.createDataFrame([(i, t) for i, t in enumerate(hay)], "i int, text string")
    n = spark.createDataFrame([(w,) for w in want], "needle string")
    got = sorted((r["i"], r["needle"]) for r in contains_join(h, "text", n, "needle").collect())
    assert got == sorted((i, w) for i, t in enumerate(hay) for w in want if w in t)


def test_templates_match_brute_force(spark):
    rng = random.Random(9)
    seg = lambda: rng.choice(["a", "b", "{x}"])
    path = lambda: "/" + "/".join(seg() for _ in range(rng.randrange(1, 4)))
    left, right = sorted({path() for _ in range(25)}), sorted({path() for _ in range(25)})
    agree = lambda a, b: len(a) == len(b) and all(x == y or "{" in x or "{" in y for x, y in zip(a, b))
    want = {(l, r) for l in left for r in right if agree(l.split("/"), r.split("/"))}
    l = spark.createDataFrame([(p,) for p in left], "left_path string")
    r = spark.createDataFrame([(p,) for p in right], "right_path string")
    assert {(x["left_path"], x["right_path"]) for x in routes.match_templates(l, r).collect()} == want


@pytest.mark.parametrize("raw,path,query", [
    ("https://h.example/a//b/?z=1&a=2", "/a/b", "a=2&z=1"), ("/u/${id}/", "/u/{param}", ""), ("u/:id", "/u/{param}", ""), ("/u/<int:id>", "/u/{param}", ""),
    ("https://h.example", "/", ""), ("", "", ""), ("/", "/", ""),
])
def test_canonical_path(spark, raw, path, query):
    row = spark.createDataFrame([(raw,)], "u string").select(PA.canonical_path("u").alias("p"), PA.canonical_query("u").alias("q")).first()
    assert (row["p"], row["q"]) == (path, query)


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +10,3 @@ def f
 ctx
+one
-gone
+two
diff --git a/old.py b/old.py
--- a/old.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
"""


def test_parse_diffs(spark):
    rows = review.parse_diffs(spark.createDataFrame([(1, DIFF), (2, "")], "change_id int, diff_text string")).collect()
    assert sorted((r["path"], r["line"]) for r in rows if r["line"] is not None) == [("x.py", 11), ("x.py", 12)]
    assert {r["path"] for r in rows} == {"x.py"}


def test_path_match_is_by_whole_segments(spark):
    nodes = spark.createDataFrame([("src/a/b.py",), ("src/xa/b.py",)], "file string")
    files = spark.createDataFrame([(1, "a/b.py", 1), (2, "./repo/src/a/b.py", 1)], "change_id int, path string, position int")
    assert {(r["file"], r["change_id"]) for r in review.match_paths(nodes, files).collect()} == {("src/a/b.py", 1), ("src/a/b.py", 2)}


def test_quarantine_first_only(spark):
    nodes = spark.createDataFrame([("a", "a")], "id string, name string")
    e = edges_of(spark, [("a", "ghost"), ("a", "ghost"), ("a", "a")])
    _, every = graph.quarantine_dangling(nodes, e)
    _, first = graph.quarantine_dangling(nodes, e, first_only=True)
    assert every.where("status = 'suspicious'").count() == 2
    assert [r["id"] for r in first.where("status = 'suspicious'").collect()] == ["a-ghost-0"]


def test_router_cycle_ends(spark):
    routers = spark.createDataFrame([("a", "/a"), ("b", "/b")], "router string, prefix string")
    includes = spark.createDataFrame([("a", "b", "/i"), ("b", "a", "/j")], "parent string, child string, prefix string")
    got = {(r["router"], r["prefix"]) for r in routes.compose_prefixes(routers, includes).collect()}
    assert got == {("a", "/a/i/b/j/a"), ("b", "/b/j/a/i/b")}


def test_reexport_cycle_is_ambiguous(spark):
    exports = spark.createDataFrame([("m", "x", "n.x"), ("n", "x", "m.x"), ("p", "y", "q.z")], "module string, name string, target string")
    got = {r["target"]: (r["resolved"], r["ambiguous"], r["confidence"]) for r in symbols.reexport_chains(
        spark.createDataFrame([("m.x",), ("p.y",), ("none.k",)], "target string"), exports).collect()}
    assert got == {"m.x": ("m.x", True, 0.55), "p.y": ("q.z", False, 0.98), "none.k": ("none.k", False, 1.0)}


def test_ambiguous_suffix_stays_unmatched(spark):
    e = edges_of(spark, [("p.A.run", "p.B.go"), ("q.A.run", "q.B.go"), ("z.C.run", "z.D.go")])
    calls = spark.createDataFrame([("A.run", "B.go"), ("C.run", "D.go"), ("E.run", "B.go")], "caller string, callee string")
    got = {(r["caller"], r["matches"], r["edge_id"]) for r in runs.match_pairs(calls, e).collect()}
    assert got == {("A.run", 2, None), ("C.run", 1, "z.C.run-z.D.go-2")}


def test_pairs_meet_edges_once_for_each_count_of_parts(spark):
    """F17 to F20, F45: rows sent for a pair or an edge do not grow with the length of its names."""
    long = lambda k, n: ".".join([f"p{k}_{j}" for j in range(n)] + ["run"])
    names = [(long(k, 40), long(k + 100, 40)) for k in range(20)]
    edges = spark.createDataFrame([(f"e{k}", a, b, "CALLS") for k, (a, b) in enumerate(names)] + [("z", "run", "run", "CALLS")], "id string, from_id string, to_id string, kind string")
    short = [(".".join(a.split(".")[-3:]), ".".join(b.split(".")[-9:])) for a, b in names]
    calls = spark.createDataFrame([*names[:10], *short], "caller string, callee string")
    got = {(r["caller"], r["callee"]): (r["how"], r["matches"], r["edge_id"]) for r in runs.match_pairs(calls, edges).collect()}
    want = {n: ("exact", 1, f"e{k}") for k, n in enumerate(names[:10])} | {n: ("suffix", 2, None) for n in short}
    assert got == want
    parts = lambda df, a, b, n, m, x, y: df.withColumns({a: F.split(x, r"\.")}).withColumns({b: F.split(y, r"\.")}).withColumns({n: F.size(a), m: F.size(b)})
    asked, known = runs.meeting_keys(parts(calls, "_c", "_d", "_nc", "_nd", "caller", "callee"),
                                     parts(edges.withColumnRenamed("id", "edge_id"), "_from", "_to", "_nf", "_nt", "from_id", "to_id"))
    assert asked.count() == 30 * 2 and known.count() == 21 * 2


def test_path_filter(spark):
    paths = ["src/a.py", ".venv/x.py", "a/site-packages/b.py", "<string>", "gen/a_pb2.py", "/abs.py", ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r["p"] for r in df.where(runs.path_included("p", exclude=["*_pb2.py"])).collect()] == ["src/a.py"]
    assert [r["p"] for r in df.where(runs.path_included("p", include=["gen/*"])).collect()] == ["gen/a_pb2.py"]


def test_metrics_without_cases_are_null(spark):
    counts = spark.createDataFrame([("f", 0, 0, 0), ("g", 3, 1, 1)], "fixture_id string, true_positive long, false_negative long, false_positive long")
    got = {r["fixture_id"]: r for r in evaluate.with_metrics(counts).collect()}
    assert got["f"]["precision_vs_forbidden"] is None and got["f"]["status"] == "no_positive_cases"
    assert (got["g"]["precision_vs_forbidden"], got["g"]["recall"], got["g"]["f1"]) == (0.75, 0.75, 0.75)


def test_fingerprint_ignores_row_order(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("x"))
    assert evaluate.determinism(df, df.orderBy(F.desc("id")).repartition(5), "id", "x").first()["deterministic"]
    other = df.withColumn("x", F.when(F.col("id") == "7", "y"))
    assert not evaluate.determinism(df, other, "id", "x").first()["deterministic"]


def test_read_files_skips_foreign_trees(spark, tmp_path):
    for name in ("r1/src/a.py", "r1/node_modules/x.js", "r1/sub/.git/HEAD", "r1/sub/b.py", "r1/src/__init__.py", "r2/c.go"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x = 1\n")
    got = {(r["repo"], r["path"], r["content"]) for r in corpus.read_files(spark, str(tmp_path)).collect()}
    assert got == {("r1", "src/a.py", "x = 1\n"), ("r1", "src/__init__.py", "x = 1\n"), ("r2", "c.go", "x = 1\n")}


def test_graph_files_round_trip(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"repo": "r", "nodes": [{"id": "a", "kind": "CLASS"}], "edges": [{"kind": "CALLS", "from_node": "a", "to": "b"}, {"kind": "CALLS", "from": "a"}]}')
    docs = graphs.read_graph_json(spark, str(tmp_path / "g.json"))
    good, bad = graphs.graph_edge_rows(docs)
    assert [(r["id"], r["source"], r["confidence"]) for r in good.collect()] == [("a__CALLS__b", "EXTRACTED", 1.0)]
    assert bad.count() == 1 and graphs.graph_nodes(docs).first()["name"] == "a"
    e = edges_of(spark, [("b", "c"), ("a", "b")])
    graphs.write_graph(spark.createDataFrame([("b",), ("a",)], "id string"), e, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "edges")).count() == 2


def test_run_log(spark, tmp_path):
    import datetime as dt
    row = lambda i, day: (f"run{i}", dt.datetime(2024, 1, day), "/p", "ok", 1, 2, None)
    for batch in ([row(1, 1), row(2, 2)], [row(1, 3)]):
        graphs.append_run(spark.createDataFrame(batch, graphs.RUN_SCHEMA), str(tmp_path / "log"))
    assert [r["run_id"] for r in graphs.list_runs(spark.read.parquet(str(tmp_path / "log"))).collect()] == ["run1", "run2"]


def test_packs_and_facts(spark, tmp_path):
    (tmp_path / "packs" / "web").mkdir(parents=True)
    (tmp_path / "packs" / "web" / "p.json").write_text('{"library": "web", "status": "trusted", "edge_rules": [{"id": "r1", "type": "standard", "match": {"call_name": "f"}, "emit": {"to": "x", "kind": "CALLS", "confidence": 0.7}}]}')
    packs, rules = graphs.read_packs(spark, str(tmp_path / "packs"))
    assert packs.count() == 1
    r = rules.first()
    assert (r["rule_id"], r["match"]["call_name"], r["emit_confidence"]) == ("r1", "f", 0.7)
    facts = spark.createDataFrame([("fact:1", "python"), ("fact:2", "go")], "fact_id string, language string")
    graphs.write_facts(facts, str(tmp_path / "facts"))
    assert graphs.read_facts(spark, str(tmp_path / "facts")).count() == 2


SOURCE = '''
from .svc import Service as S
import lib

class A(S):
    def __init__(self, svc: S, n=3):
        self.svc = svc

    @lib.route("/x")
    async def go(self):
        return self.svc.run(lib.f(1), key=2)
'''


def test_extract_python(spark):
    files = spark.createDataFrame([("r", "pkg/a.py", SOURCE), ("r", "pkg/bad.py", "def (")], "repo string, path string, content string")
    rows = {r["id"]: r for r in extract.extract_python(files).where("kind <> 'ERROR'").collect()}
    assert rows["class:pkg.a.A"]["bases"] == ["pkg.svc.Service"]
    assert rows["method:pkg.a.A.__init__"]["param_types"] == {"svc": "pkg.svc.Service"}
    assert rows["method:pkg.a.A.__init__"]["param_defaults"] == {"n": "3"}
    assert rows["method:pkg.a.A.go"]["decorators"] == ["@lib.route('/x')"]
    call = next(r for i, r in rows.items() if i.endswith("self.svc.run"))
    assert (call["receiver"], call["method_name"], call["args"], call["keyword_args"]) == ("self.svc", "run", ["lib.f(1)"], {"key": "2"})
    assert extract.extract_python(files).where("kind = 'ERROR'").count() == 1


def test_extract_braces(spark):
    """Comments and strings hold no code; blocks own what stands in them; calls follow the words of each language."""
    js = "// class Not {}\nimport x from 'lib';\nclass A extends B {\n  go(a) {\n    if (a) { run(new Thing()); this.log('f( {'); }\n  }\n}\n/* function no() {} */\nfunction top(a) { ignored(); }\n"
    go = 'package svc\nimport (\n  "fmt"\n)\nfunc (s *Svc) Run(a int) {\n  x := new(T)\n  fmt.Println(x)\n}\nfunc Free() {}\n'
    java = 'package com.x;\nimport a.B;\nclass K {\n  String s = "class No {";\n  public void run(int a) { helper(a); }\n}\n'
    files = spark.createDataFrame([("r", "a.ts", js), ("r", "b.go", go), ("r", "K.java", java)], "repo string, path string, content string")
    got = {(r["kind"], r["id"]) for r in extract.extract_patterns(files).collect()}
    assert got == {("IMPORT", "module:lib"), ("CLASS", "A"), ("METHOD", "A.go"), ("CALL_EXPR", "call:A.go:5:run"), ("CALL_EXPR", "call:A.go:5:Thing"), ("CALL_EXPR", "call:A.go:5:this.log"), ("METHOD", "top"),
                   ("IMPORT", "module:fmt"), ("METHOD", "svc.Svc.Run"), ("CALL_EXPR", "call:svc.Svc.Run:6:new"), ("CALL_EXPR", "call:svc.Svc.Run:7:fmt.Println"), ("METHOD", "svc.Free"),
                   ("IMPORT", "module:a.B"), ("CLASS", "com.x.K"), ("METHOD", "com.x.K.run"), ("CALL_EXPR", "call:com.x.K.run:5:helper")}


def test_extract_nested_python(spark):
    text = "import os as o\nclass A:\n    class B(o.Base):\n        def f(self, x: o.T, *, k=1):\n            def g(): return h(x)\n            y = z = o.path.join('a', b=1)\n"
    got = {r["id"]: r for r in extract.extract_python(spark.createDataFrame([("r", "p/q.py", text)], "repo string, path string, content string")).collect()}
    assert set(got) == {"module:os", "class:p.q.A", "class:p.q.A.B", "method:p.q.A.B.f", "method:p.q.A.B.g", "call:p.q.A.B.g:5:h", "assignment:p.q.A.B.f:6:y", "assignment:p.q.A.B.f:6:z",
                        "call:p.q.A.B.f:6:o.path.join"}
    assert got["class:p.q.A.B"]["parent"] == "class:p.q.A" and got["method:p.q.A.B.f"]["param_order"] == ["x"]
    assert got["assignment:p.q.A.B.f:6:y"]["call_name"] == "o.path.join" and got["assignment:p.q.A.B.f:6:y"]["keyword_args"] == {"b": "1"}


def test_files_to_answers_of_two_repositories(spark, tmp_path):
    for repo in ("one", "two"):
        (tmp_path / repo / "pkg").mkdir(parents=True)
        (tmp_path / repo / "pkg" / "a.py").write_text("class A:\n    def go(self):\n        return helper()\n" + ("import os\n" if repo == "one" else ""))
    nodes, rows = extract.graph_rows(extract.extract_python(corpus.read_files(spark, str(tmp_path))))
    edges, nodes = cut(graph.dedupe_edges(rows)), cut(nodes)
    asked = spark.createDataFrame([("q", "one::class:pkg.a.A")], "query_id string, target string").withColumns({"symbol": F.lit(None).cast("string"), "file_path": F.lit(None).cast("string")})
    reached = {r["node_id"] for r in impact.impact_query(nodes, edges, asked, max_depth=3)["reached"].collect()}
    assert reached == {"one::file:pkg/a.py", "one::module:pkg.a", "one::method:pkg.a.A.go", "one::call:pkg.a.A.go:3:helper", "one::module:os"}
    assert edges.where("from_id LIKE 'two::%'").count() == 4 and edges.where("from_id LIKE 'one::%'").count() == 5


def test_refresh_keeps_other_files(spark):
    nodes = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f3")], "id string, file string")
    e = edges_of(spark, [("a", "b"), ("b", "c")])
    ids = [r["id"] for r in e.collect()]
    evidence = spark.createDataFrame([(ids[0], "f1"), (ids[1], "f2")], "edge_id string, file string")
    changed = spark.createDataFrame([("f1",)], "file string")
    n, kept = delta.refresh_graph(nodes, e, evidence, changed, nodes.where("id = 'a'"), e.limit(0))
    assert {r["id"] for r in n.collect()} == {"a", "c"} and [r["id"] for r in kept.collect()] == [ids[1]]


def test_file_stream_emits_changes_only(spark, tmp_path):
    """A busy path in random order over several batches, one state for a thousand rows each."""
    rng = random.Random(4)
    want = []
    for batch in range(3):
        rows = [("a", f"h{(batch * 5000 + k) // 1000}", batch * 5000 + k) for k in range(5000)] + [("b", "same", batch * 10 + 1)]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "path string, sha256 string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feeds.stream_file_changes(spark.readStream.schema("path string, sha256 string, seq long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    want = [("a", f"h{k}", k * 1000, "modified" if k else "added") for k in range(15)] + [("b", "same", 1, "added")]
    assert sorted(tuple(r) for r in feeds.read_file_changes(spark, str(tmp_path / "out")).collect()) == sorted(want)


def test_chains_are_followed_to_their_ends(spark):
    """One job or more for each link, so the longest chains run with ``TREMOR_ALL`` only."""
    frame, full = spark.createDataFrame, bool(os.environ.get("TREMOR_ALL"))
    n = 15
    defs = frame([(f"d{k}", "m", []) for k in range(n)], "def_id string, module string, params array<string>")
    parts = frame([("d0", 0, "literal", "/x", None, None)] + [(f"d{k}", 0, "ref", None, f"d{k - 1}", None) for k in range(1, n)],
                  "def_id string, pos int, kind string, text string, target string, args array<string>")
    assert {r["value"] for r in routes.evaluate_paths(defs, parts).collect()} == {"/x"} and routes.evaluate_paths(defs, parts).count() == n
    n = 40 if full else 12
    tables = {"methods": frame([(f"c{n}.run",)], "full string"), "bases": frame([(f"c{k}", 0, f"c{k + 1}") for k in range(n)], "full string, pos int, base string")}
    assert symbols.resolve_method(frame([("c0", "run")], "class_full string, method string"), tables).first()["full"] == f"c{n}.run"
    n = 70 if full else 12
    exports = frame([("", f"n{k}", f"n{k + 1}") for k in range(n)], "module string, name string, target string")
    got = symbols.reexport_chains(frame([("n0",)], "target string"), exports).first()
    assert (got["resolved"], got["ambiguous"]) == (f"n{n}", False)
    n = 50 if full else 12
    routers = frame([(f"r{k}", f"/p{k}") for k in range(n)], "router string, prefix string")
    includes = frame([(f"r{k}", f"r{k + 1}", "") for k in range(n - 1)], "parent string, child string, prefix string")
    last = {r["router"]: r["prefix"] for r in routes.compose_prefixes(routers, includes).collect()}[f"r{n - 1}"]
    assert last == "".join(f"/p{k}" for k in range(n))
    edges = frame([(f"v{k:03}", f"v{k + 1:03}") for k in range(150 if full else 65)], "from_id string, to_id string")
    assert {r["component"] for r in graph.components(edges).collect()} == {"v000"}


def test_rules_without_matching_types_give_no_edge(spark):
    nodes = spark.createDataFrame([("class:a.TestB", "CLASS", "TestB", "a", None, None, None, None)],
                                  "id string, kind string, name string, scope string, call_name string, receiver string, receiver_type string, method_name string")
    fields = ["library", "rule_id", "rule_type", "trust_level", "emit_to", "emit_kind", "match_imported_library", "match_test_class_name",
              *[f"match_{f}" for f in rules.STANDARD_FIELDS]]
    none = spark.createDataFrame([], ", ".join(f"{f} string" for f in fields) + ", emit_confidence double")
    imports = spark.createDataFrame([], "module string, imported string")
    assert rules.rule_standard(nodes, none, imports).count() == 0
    assert rules.rule_test_target(nodes, none).count() == 0


def test_role_of_header(spark):
    files = spark.createDataFrame([("a.go", "package x\n" * 30 + "// DO NOT EDIT"), ("b.go", "// @generated\npackage x")], "path string, content string")
    assert {r["path"]: r["role"] for r in hygiene.classify_file_roles(files).collect()} == {"a.go": "SOURCE", "b.go": "GENERATED"}
