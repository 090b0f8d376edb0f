"""Registered queries of sources (A) and corpus profiling (B), over generated repositories.

Twenty parts make one repository; its manifests come from the supplier with the same number. The
expected rows are written from the same columns, not parsed back out of the text.
"""
from pyspark.sql import functions as F

from tremor.catalog.core import define, joined, query, using
from tremor.operators import dependencies as DP
from tremor.operators import hygiene as H
from tremor.operators import profile as PR
from tremor.plans.loops import cut
from tremor.sources import corpus as CO
from tremor.sources import graphs as GR
from tremor.sources import projection as P

_N = "chr(10)"


def _text(*lines: str) -> str:
    """SQL text of the lines joined by newlines; {x} marks a column."""
    parts = []
    for line in lines:
        pieces = line.split("|")
        for i, p in enumerate(pieces):
            if p:
                parts.append(p if i % 2 else "'" + p.replace("'", "''") + "'")
        parts.append(_N)
    return "concat(" + ", ".join(parts) + ")"


_PY = _text("import os", "import requests, numpy.linalg", "from flask.views import View", "from . import sibling", "from lib_|t| import thing",
            "from web import w", "", "class Part|p_partkey|(View):", "    def run(self, a):", "        return helper(a)", "", "def helper(x):", "    return x")
_TS = _text("import React from 'react';", "import { a } from '@scope|t|/pkg/sub';", "import './local';", "const fs = require('fs');", "import x from 'lib-|t|/inner';",
            "export class Part|p_partkey| {}", "function helper(a) {}")
_JS = _text("const a = require('lodash');", "import b from 'left-|t|';", "", "function f|p_partkey|(x) {}", "function g (y) {}")
_GO = _text("package svc", "", "import (", '  "fmt"', '  "github.com/acme/|t|/v2"', ")", "", 'import "gopkg.in/yaml.v3"', "", "func (s *Svc) Run|p_partkey|(a int) {", "}")
_JAVA = _text("package com.acme.r|repo_no|;", "", "import java.util.List;", "import org.springframework.web.X;", "import com.acme.r|repo_no|.Other;", "import io.grpc.|t|.Server;",
              "", "public class Part|p_partkey| {", "    public void run() {", "    }", "}")
SOURCE_FILES = f"""SELECT concat('repo_', repo_no) AS repo, concat(CASE WHEN slot = 19 THEN 'node_modules/' ELSE '' END, CASE lang WHEN 0 THEN concat('src/', t, '/mod_', p_partkey, '.py')
    WHEN 1 THEN concat('web/part_', p_partkey, '.ts') WHEN 2 THEN concat('app/part_', p_partkey, '.js') WHEN 3 THEN concat('svc/part_', p_partkey, '.go')
    ELSE concat('java/Part', p_partkey, '.java') END) AS path,
  CASE lang WHEN 0 THEN {_PY} WHEN 1 THEN {_TS} WHEN 2 THEN {_JS} WHEN 3 THEN {_GO} ELSE {_JAVA} END AS content
 FROM (SELECT p_partkey, p_partkey % 20 AS slot, CAST(floor(p_partkey / 20) AS BIGINT) AS repo_no, p_size % 5 AS lang, lower(p_type) AS t FROM @part) p"""
_MANIFESTS = {
    "requirements.txt": ("s_suppkey % 3 = 0", _text("# deps", "requests>=2", "lib_economy==1.0", "-r x.txt", "pytest ; python_version>3", "", "Mystery-Lib[extra]~=1")),
    "package.json": ("true", _text('{"dependencies": {"react": "1", "lib-small": "^2"}, "devDependencies": {"vitest": "1", "@scopeeconomy/pkg": "1"}, "imports": {"#app/*": "./x"}}')),
    "go.mod": ("s_suppkey % 2 = 0", _text("module github.com/acme/repo|s_suppkey|", "", "require (", "  github.com/acme/economy v1", "  github.com/x/indirect v2 // indirect", ")",
                                          "require gopkg.in/yaml.v3 v3.0")),
    "pom.xml": ("s_suppkey % 4 = 1", _text("<project><dependency><groupId>io.grpc</groupId><artifactId>grpc-core</artifactId></dependency>",
                                           "<dependency> <groupId> com.lone </groupId></dependency></project>")),
    "build.gradle": ("s_suppkey % 4 = 3", _text("dependencies { implementation 'io.grpc:grpc-netty:1.2' }")),
    "pyproject.toml": ("s_suppkey % 3 = 1", _text("[project]", 'dependencies = ["fastapi>=1", "lib_small"]', "[project.optional-dependencies]", 'dev = ["pytest"]', 'extra = ["boto3"]')),
    "tsconfig.json": ("s_suppkey % 2 = 1", _text("{", "  // paths", '  "compilerOptions": { "paths": { "@app/*": ["src/*"] } }', "}")),
    "vite.config.ts": ("s_suppkey % 5 = 2", _text("export default { resolve: { alias: { '@ui': '/src/ui' } } }")),
    "src/tools/__init__.py": ("s_suppkey % 2 = 0", _text("x = 1")),
}
FILES = SOURCE_FILES + "".join(f"\n UNION ALL SELECT concat('repo_', s_suppkey), '{path}', {text} FROM @supplier WHERE {cond}" for path, (cond, text) in _MANIFESTS.items())
define("files", FILES)
define("src", "SELECT concat('repo_', CAST(floor(p_partkey / 20) AS BIGINT)) AS repo, CAST(floor(p_partkey / 20) AS BIGINT) AS no, p_partkey AS k, p_size % 5 AS lang, lower(p_type) AS t FROM @part WHERE p_partkey % 20 <> 19")
define("sup", "SELECT concat('repo_', s_suppkey) AS repo, s_suppkey AS k FROM @supplier")


def _files(spark, sf):
    """The generated corpus as a stored table, as a real corpus would be: in pieces for all cores, whatever the pieces of ``part``."""
    return cut(P.run(spark, sf, FILES).repartition(4 * spark.sparkContext.defaultParallelism, "repo", "path"))


_GIT = "SELECT repo, path FROM ({files}) f UNION ALL SELECT concat('repo_', s_suppkey), 'app/.git/HEAD' FROM @supplier WHERE s_suppkey % 7 = 0"


@query("A01_keep_files", using("files") + """SELECT repo, path FROM files WHERE NOT contains(path, 'node_modules/') AND NOT (path LIKE 'app/%' AND repo IN (SELECT repo FROM (SELECT concat('repo_', s_suppkey) AS repo FROM supplier WHERE s_suppkey % 7 = 0)))
   AND path SIMILAR TO '.*\\.(py|js)'""")
def a01(spark, sf):
    return CO.keep_files(P.run(spark, sf, _GIT.format(files=FILES)), [".py", ".js"])


@query("A02_scan_plan", using("files") + "SELECT repo, count(*) AS included_files FROM files WHERE NOT contains(path, 'node_modules/') GROUP BY repo")
def a02(spark, sf):
    return CO.scan_plan(_files(spark, sf))[0]


@query("A02_excluded_directories", using("files") + "SELECT DISTINCT repo, 'node_modules' AS directory FROM files WHERE contains(path, 'node_modules/')")
def a02b(spark, sf):
    return CO.scan_plan(_files(spark, sf))[1]


# One graph document per order: its lines as edges, in both endpoint spellings, some without an endpoint.
def _docs(spark, sf):
    line = P.run(spark, sf, """SELECT concat('doc_', l_orderkey) AS repo, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty, l_returnflag AS rf, 1 - l_discount * 5 AS conf FROM @lineitem""")
    edge = F.struct(
        F.when(F.col("qty") > 10, F.concat(F.lit("e"), F.col("ln"), F.lit("-"), F.col("pk"), F.lit("-"), F.col("sk"))).alias("id"), F.lit("CALLS").alias("kind"),
        F.when(F.col("rf") != "A", F.concat(F.lit("p:"), F.col("pk"))).alias("from"), F.when((F.col("rf") == "A") & (F.col("qty") != 3), F.concat(F.lit("p:"), F.col("pk"))).alias("from_node"),
        F.concat(F.lit("s:"), F.col("sk")).alias("to"), F.when(F.col("rf") != "N", "INFERRED").alias("source"), F.round("conf", 2).alias("confidence"))
    node = F.struct(F.when(F.col("qty") != 7, F.concat(F.lit("p:"), F.col("pk"))).alias("id"), F.when(F.col("rf") == "R", "CLASS").otherwise("FUNCTION").alias("kind"),
                    F.when(F.col("qty") > 5, F.concat(F.lit("part "), F.col("pk"))).alias("name"))
    link = F.struct(F.concat(F.lit("p:"), F.col("pk")).alias("source"), F.concat(F.lit("s:"), F.col("sk")).alias("target"),
                    F.when(F.col("rf") == "A", "calls").when(F.col("rf") == "N", "weird").alias("type"),
                    F.when(F.col("ln") == 1, "Extracted").when(F.col("ln") == 2, "INFERRED").when(F.col("ln") == 3, "ambiguous").when(F.col("ln") == 4, "0.95").when(F.col("ln") == 5, "x").alias("confidence"))
    docs = line.groupBy("repo").agg(F.collect_list(edge).alias("edges"), F.collect_list(node).alias("nodes"), F.collect_list(link).alias("links"))
    return GR.parse_graph_json(docs.select("repo", F.to_json(F.struct("nodes", "edges", "links")).alias("json")))


define("doc_rows", """SELECT concat('doc_', l_orderkey) AS repo, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty, l_returnflag AS rf, round(1 - l_discount * 5, 2) AS conf FROM @lineitem""")


@query("A03_read_graph_edges", using("doc_rows") + """SELECT repo, CASE WHEN qty > 10 THEN concat('e', ln, '-', pk, '-', sk) ELSE concat('p:', pk, '__CALLS__s:', sk) END AS id, concat('p:', pk) AS from_id, concat('s:', sk) AS to_id,
   CASE WHEN rf <> 'N' THEN 'INFERRED' ELSE 'EXTRACTED' END AS source, conf AS confidence FROM doc_rows WHERE rf <> 'A' OR qty <> 3""")
def a03(spark, sf):
    return GR.graph_edge_rows(_docs(spark, sf))[0].select("repo", "id", "from_id", "to_id", "source", "confidence")


@query("A03_read_graph_rejects", using("doc_rows") + "SELECT repo, NULL AS edge_id, 'missing_endpoint' AS reason, '' AS from_id, concat('s:', sk) AS to_id FROM doc_rows WHERE rf = 'A' AND qty = 3")
def a03b(spark, sf):
    return GR.graph_edge_rows(_docs(spark, sf))[1]


@query("A03_read_graph_nodes", using("doc_rows") + """SELECT repo, CASE WHEN qty <> 7 THEN concat('p:', pk) END AS id, CASE rf WHEN 'R' THEN 'CLASS' ELSE 'FUNCTION' END AS kind,
   CASE WHEN qty > 5 THEN concat('part ', pk) WHEN qty <> 7 THEN concat('p:', pk) END AS name FROM doc_rows""")
def a03c(spark, sf):
    return GR.graph_nodes(_docs(spark, sf)).select("repo", "id", "kind", "name")


@query("A05_normalize_external_edges", using("doc_rows") + """SELECT repo, concat('e', ln, '-', pk, '-', sk) AS id, concat('p:', pk) AS from_id, concat('s:', sk) AS to_id, 'EXTERNAL_TOOL' AS source, conf AS confidence
   FROM doc_rows WHERE qty > 10 AND rf <> 'A'""")
def a05(spark, sf):
    return GR.normalize_external_graph(_docs(spark, sf))[1].select("repo", "id", "from_id", "to_id", "source", "confidence")


@query("A05_normalize_external_skipped", using("doc_rows") + """SELECT repo, count(*) FILTER (qty = 7 OR qty <= 5) AS skipped_nodes, count(*) FILTER (qty <= 10 OR rf = 'A') AS skipped_edges FROM doc_rows GROUP BY repo""")
def a05b(spark, sf):
    return GR.normalize_external_graph(_docs(spark, sf))[2]


@query("A06_adapt_links_graph", using("doc_rows") + """SELECT repo, 'CALLS' AS kind, concat('edge_p:', pk, '_s:', sk, '_CALLS') AS id, CASE ln WHEN 1 THEN 0.6 WHEN 2 THEN 0.55 WHEN 3 THEN 0.35 WHEN 4 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
   CASE rf WHEN 'A' THEN 'calls' WHEN 'N' THEN 'weird' END AS external_relation, 'dangling_external_reference' AS quality_warning FROM doc_rows""")
def a06(spark, sf):
    return GR.adapt_links_graph(_docs(spark, sf)).select("repo", "kind", "id", "confidence", "external_relation", "quality_warning")


_LOG = """SELECT concat('run_', user_id, '_', event_type) AS run_id, ts, concat('/projects/', user_id) AS project_path, event_type AS status, CAST(event_id AS BIGINT) AS nodes,
   CAST(event_id * 2 AS BIGINT) AS edges, props AS metadata FROM @events"""


@query("A09_list_runs", f"SELECT run_id, ts, status, nodes FROM (SELECT DISTINCT ON (run_id) * FROM ({_LOG}) ORDER BY run_id, ts DESC) ORDER BY ts DESC, run_id LIMIT 100")
def a09(spark, sf):
    return GR.list_runs(P.run(spark, sf, _LOG), 100).select("run_id", "ts", "status", "nodes")


# --- profile -----------------------------------------------------------------------------------

_SUFFIX_LANG = "CASE lang WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'go' ELSE 'java' END"
define("langs", f"""SELECT DISTINCT repo, {_SUFFIX_LANG} AS language FROM src
  UNION SELECT repo, unnest(['javascript', 'typescript']) FROM sup UNION SELECT repo, 'python' FROM sup WHERE k % 3 IN (0, 1) OR k % 2 = 0
  UNION SELECT repo, 'go' FROM sup WHERE k % 2 = 0 UNION SELECT repo, 'java' FROM sup WHERE k % 4 IN (1, 3)""", ["src", "sup"])


@query("B01_detect_languages", using("langs") + "SELECT * FROM langs")
def b01(spark, sf):
    return PR.detect_languages(_files(spark, sf))


@query("B02_inventory_counts", using("src", "sup") + f"""SELECT repo, language, count(*) AS files, sum(loc)::BIGINT AS loc, sum(classes)::BIGINT AS classes, sum(methods)::BIGINT AS methods FROM (
   SELECT repo, {_SUFFIX_LANG} AS language, CASE lang WHEN 0 THEN 11 WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 9 END AS loc,
     CASE lang WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS classes, CASE lang WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 1 END AS methods FROM src
   UNION ALL SELECT repo, 'other', 0, 0, 0 FROM sup, unnest(list_concat(CASE WHEN k % 3 IN (0, 1) THEN [1] ELSE [] END, [2], CASE WHEN k % 2 = 0 THEN [3] ELSE [] END, CASE WHEN k % 4 IN (1, 3) THEN [4] ELSE [] END, CASE WHEN k % 2 = 1 THEN [5] ELSE [] END))
   UNION ALL SELECT repo, 'typescript', 1, 0, 0 FROM sup WHERE k % 5 = 2 UNION ALL SELECT repo, 'python', 1, 0, 0 FROM sup WHERE k % 2 = 0) GROUP BY ALL""")
def b02(spark, sf):
    return PR.inventory_counts(_files(spark, sf))


define("declared", """SELECT repo, 'python' AS ecosystem, 'runtime' AS role, unnest(['requests', 'lib_economy', 'pytest', 'Mystery-Lib']) AS name FROM sup WHERE k % 3 = 0
  UNION ALL SELECT repo, 'typescript', 'runtime', unnest(['react', 'lib-small']) FROM sup UNION ALL SELECT repo, 'typescript', 'dev', unnest(['vitest', '@scopeeconomy/pkg']) FROM sup
  UNION ALL SELECT repo, 'go', 'runtime', unnest(['github.com/acme/economy', 'gopkg.in/yaml.v3']) FROM sup WHERE k % 2 = 0 UNION ALL SELECT repo, 'go', 'transitive', 'github.com/x/indirect' FROM sup WHERE k % 2 = 0
  UNION ALL SELECT repo, 'java', 'runtime', unnest(['io.grpc:grpc-core', 'com.lone']) FROM sup WHERE k % 4 = 1 UNION ALL SELECT repo, 'java', 'runtime', 'io.grpc:grpc-netty' FROM sup WHERE k % 4 = 3
  UNION ALL SELECT repo, 'python', 'runtime', unnest(['fastapi', 'lib_small', 'boto3']) FROM sup WHERE k % 3 = 1 UNION ALL SELECT repo, 'python', 'dev', 'pytest' FROM sup WHERE k % 3 = 1""", ["sup"])


@query("B03_declared_dependencies", using("declared") + "SELECT * FROM declared")
def b03(spark, sf):
    return PR.declared_dependencies(_files(spark, sf))


define("locals", f"""SELECT DISTINCT repo, {_SUFFIX_LANG} AS ecosystem, CASE lang WHEN 0 THEN 'src' WHEN 1 THEN 'web' WHEN 2 THEN 'app' WHEN 3 THEN 'svc' ELSE 'java' END AS name FROM src
  UNION SELECT repo, 'python', t FROM src WHERE lang = 0 UNION SELECT repo, 'java', unnest(['com.acme', concat('com.acme.r', no)]) FROM src WHERE lang = 4
  UNION SELECT repo, 'python', unnest(['src', 'tools']) FROM sup WHERE k % 2 = 0 UNION SELECT repo, 'typescript', '#app' FROM sup
  UNION SELECT repo, unnest(['typescript', 'javascript']), '@app' FROM sup WHERE k % 2 = 1 UNION SELECT repo, unnest(['typescript', 'javascript']), '@ui' FROM sup WHERE k % 5 = 2
  UNION SELECT repo, 'typescript', 'vite.config' FROM sup WHERE k % 5 = 2 UNION SELECT repo, 'go', concat('github.com/acme/repo', k) FROM sup WHERE k % 2 = 0
  UNION SELECT DISTINCT repo, '*', CASE lang WHEN 0 THEN 'src' WHEN 1 THEN 'web' WHEN 2 THEN 'app' WHEN 3 THEN 'svc' ELSE 'java' END FROM src
  UNION SELECT repo, '*', unnest(list_concat(['package.json'], CASE WHEN k % 3 = 0 THEN ['requirements.txt'] ELSE [] END, CASE WHEN k % 2 = 0 THEN ['go.mod', 'src'] ELSE ['tsconfig.json'] END,
    CASE WHEN k % 4 = 1 THEN ['pom.xml'] WHEN k % 4 = 3 THEN ['build.gradle'] ELSE [] END, CASE WHEN k % 3 = 1 THEN ['pyproject.toml'] ELSE [] END, CASE WHEN k % 5 = 2 THEN ['vite.config'] ELSE [] END)) FROM sup""", ["src", "sup"])


@query("B05_local_modules", using("locals") + "SELECT * FROM locals")
def b05(spark, sf):
    return PR.local_modules(_files(spark, sf))


define("imported", """SELECT DISTINCT repo, ecosystem, name FROM (
    SELECT repo, 'python' AS ecosystem, unnest(['requests', 'numpy', 'flask', 'lib_' || t, 'web']) AS name FROM src WHERE lang = 0
    UNION ALL SELECT repo, 'typescript', unnest(['react', '@scope' || t || '/pkg', 'lib-' || t]) FROM src WHERE lang = 1
    UNION ALL SELECT repo, 'javascript', unnest(['lodash', 'left-' || t]) FROM src WHERE lang = 2
    UNION ALL SELECT repo, 'go', unnest(['github.com/acme/' || t || '/v2', 'gopkg.in/yaml.v3']) FROM src WHERE lang = 3
    UNION ALL SELECT repo, 'java', unnest(['org.springframework.web.X', 'io.grpc.' || t || '.Server']) FROM src WHERE lang = 4) i
  WHERE NOT (name = 'web' AND ecosystem = 'python' AND EXISTS (SELECT 1 FROM src s WHERE s.repo = i.repo AND s.lang = 1))""", ["src"])


@query("B04_external_imports", using("imported") + "SELECT * FROM imported")
def b04(spark, sf):
    return PR.external_imports(_files(spark, sf))


_COMMON = ("(ecosystem = 'python' AND name IN ('requests', 'flask', 'fastapi', 'pytest')) OR (ecosystem IN ('typescript', 'javascript') AND name IN ('react', 'lodash', 'vitest')) "
           "OR (ecosystem = 'java' AND name LIKE 'org.springframework%')")
_SAME = """(d.name = i.name OR (i.ecosystem = 'python' AND lower(replace(d.name, '-', '_')) = lower(replace(i.name, '-', '_'))) OR (i.ecosystem IN ('go', 'typescript', 'javascript') AND starts_with(i.name, d.name || '/'))
    OR (i.ecosystem = 'java' AND (starts_with(i.name, d.name || '.') OR array_to_string(string_split(i.name, '.')[1:2], '.') = array_to_string(string_split(d.name, '.')[1:2], '.'))))"""
define("flagged", f"""SELECT i.repo, i.ecosystem, i.name, EXISTS (SELECT 1 FROM declared d WHERE d.repo = i.repo AND d.ecosystem = i.ecosystem AND d.role <> 'transitive' AND {_SAME}) AS is_declared,
    EXISTS (SELECT 1 FROM declared d WHERE d.repo = i.repo AND d.ecosystem = i.ecosystem AND d.role = 'dev' AND {_SAME}) AS is_dev, {_COMMON} AS is_common FROM imported i""", ["imported", "declared"])
define("classified", """SELECT *, CASE WHEN is_dev THEN 'DEV_ONLY' WHEN is_declared THEN 'DECLARED_THIRD_PARTY' WHEN is_common THEN 'KNOWN_COMMON_THIRD_PARTY' ELSE 'UNKNOWN_THIRD_PARTY' END AS kind FROM flagged""", ["flagged"])


def _deps(spark, sf):
    """The inventory, stored once: its frames feed several joins."""
    files = _files(spark, sf)
    declared = cut(PR.declared_dependencies(files))
    direct, dev = declared.where("role <> 'transitive'"), declared.where("role = 'dev'")
    return cut(PR.external_imports(files)), direct, cut(PR.local_modules(files).where("ecosystem <> '*'")), dev


def _classified(spark, sf):
    imports, declared, local, dev = _deps(spark, sf)
    return DP.classify_dependencies(imports, local, declared, dev)


@query("B06_classify_dependencies", using("classified") + """SELECT repo, ecosystem, name, kind, CASE kind WHEN 'DEV_ONLY' THEN 0.92 WHEN 'DECLARED_THIRD_PARTY' THEN 0.94 WHEN 'KNOWN_COMMON_THIRD_PARTY' THEN 0.86 ELSE 0.7 END::DOUBLE AS confidence,
   kind = 'UNKNOWN_THIRD_PARTY' AS requires_research FROM classified""")
def b06(spark, sf):
    return _classified(spark, sf).select("repo", "ecosystem", "name", "kind", "confidence", "requires_research")


_RAW_NAMES = """SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'typescript' WHEN 4 THEN 'java' WHEN 5 THEN 'java' WHEN 6 THEN 'java' WHEN 7 THEN 'go' WHEN 8 THEN 'java' ELSE 'ruby' END AS ecosystem,
  CASE p_size % 10 WHEN 0 THEN concat('My-Lib', p_partkey, '.core') WHEN 1 THEN ' Plain ' WHEN 2 THEN concat('node:fs', p_partkey, '/promises') WHEN 3 THEN concat('@scope/pkg', p_partkey, '/deep/er') WHEN 4 THEN 'java.util.List'
    WHEN 5 THEN 'org.springframework.web.Rest' WHEN 6 THEN concat('com.acme.p', p_partkey) WHEN 7 THEN concat('github.com/x/', p_partkey, '/v2') WHEN 8 THEN 'javax.inject.Inject' ELSE 'rails.core' END AS name FROM @part"""


@query("B07_normalize_dep_name", f"""SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN concat('my_lib', p_partkey) WHEN 1 THEN 'plain' WHEN 2 THEN concat('fs', p_partkey) WHEN 3 THEN concat('@scope/pkg', p_partkey) WHEN 4 THEN 'java'
    WHEN 5 THEN 'org.springframework' WHEN 6 THEN 'com.acme' WHEN 7 THEN concat('github.com/x/', p_partkey, '/v2') WHEN 8 THEN 'javax' ELSE 'rails' END AS normalized FROM @part""")
def b07(spark, sf):
    return P.run(spark, sf, _RAW_NAMES).select("p_partkey", DP.normalize_dep_name("name", "ecosystem").alias("normalized"))


# (path, header line, expected role, confidence, expected tags): one of these per part size.
_ROLES = [
    ("web/node_modules/x/i.js", "", "VENDOR", 0.98, ""), ("./dist/app.js", "", "BUILD_ARTIFACT", 0.96, ""), ("src/gen/model.ts", "", "GENERATED", 0.95, ""),
    ("src/user_pb2.py", "", "GENERATED", 0.96, ""), ("src/a.go", "// Code generated by x", "GENERATED", 0.94, ""), ("pkg/tests/a.py", "", "TEST", 0.94, ""),
    ("pkg/test_a.py", "", "TEST", 0.93, ""), ("pkg/FooTest.java", "", "TEST", 0.93, ""), ("pkg/a.spec.tsx", "", "TEST", 0.93, ""), ("api/openapi.yaml", "", "CONTRACT", 0.95, ""),
    ("api/schemas/u.json", "", "CONTRACT", 0.92, ""), ("api/u.schema.json", "", "CONTRACT", 0.94, ""), ("db/migrate/x.rb", "", "MIGRATION", 0.92, ""), ("sql/20240101_init.sql", "", "MIGRATION", 0.88, ""),
    ("alembic/env.py", "", "MIGRATION", 0.92, ""), ("samples/a.py", "", "FIXTURE", 0.90, ""), ("Dockerfile", "", "CONFIG", 0.95, ""), ("web/vite.config.ts", "", "CONFIG", 0.90, ""),
    (".env.example", "", "UNKNOWN", 0.30, ""), ("README.md", "", "DOCS", 0.95, ""), ("docs/a.txt", "", "DOCS", 0.91, ""), ("notes/a.rst", "", "DOCS", 0.90, ""),
    ("src/legacy/unused_x.py", "", "SOURCE", 0.65, "legacy_candidate|unused_candidate"), ("src/dead.kt", "", "SOURCE", 0.65, "dead_candidate"), ("bin/tool", "", "UNKNOWN", 0.30, ""),
    ("src/main.go", "package x", "SOURCE", 0.65, ""), ("src/order_service.ts", "", "SOURCE", 0.65, ""), ("custom/vendored.py", "", "SOURCE", 0.65, ""),
]
_pick = lambda i: "CASE p_size % 28 " + " ".join(f"WHEN {k} THEN {repr(r[i]) if isinstance(r[i], str) else r[i]}" for k, r in enumerate(_ROLES)) + " END"
_prefixed = "CASE WHEN p_size % 28 IN (1, 16, 18, 19) THEN {p} ELSE concat('r', p_partkey, '/', {p}) END".format(p=_pick(0))
ROLE_FILES = f"SELECT p_partkey, {_prefixed} AS path, {_pick(1)} AS content FROM @part"
define("role_rows", f"SELECT p_partkey, {_prefixed} AS path, {_pick(2)} AS role, CAST({_pick(3)} AS DOUBLE) AS conf, {_pick(4)} AS tags, p_size % 28 AS i FROM @part")


def _roles(spark, sf):
    return H.classify_file_roles(P.run(spark, sf, ROLE_FILES))


@query("B08_classify_file_roles", using("role_rows") + "SELECT p_partkey, role, conf AS role_confidence, tags FROM role_rows")
def b08(spark, sf):
    return _roles(spark, sf).select("p_partkey", "role", "role_confidence", F.array_join("tags", "|").alias("tags"))


@query("B09_apply_role_overrides", using("role_rows") + "SELECT p_partkey, CASE WHEN i = 27 THEN 'VENDOR' ELSE role END AS role, CASE WHEN i = 27 THEN 0.88 ELSE conf END AS role_confidence FROM role_rows")
def b09(spark, sf):
    rules = spark.createDataFrame([(0, "VENDOR", "*/custom/*"), (1, "SOURCE", "README.md"), (2, "NOPE", "*")], "seq int, role string, pattern string")
    return H.apply_role_overrides(_roles(spark, sf), rules).select("p_partkey", "role", "role_confidence")


# A node per part in its role file, some found only through their id, some in no known file; a call to the next part.
_ANN_NODES = """SELECT CASE WHEN p_partkey % 11 = 3 THEN concat('file:', path) WHEN p_partkey % 11 = 4 THEN concat(path, '::f', p_partkey) ELSE concat('n:', p_partkey) END AS id,
   CASE WHEN p_partkey % 13 = 5 THEN 'ROUTE' ELSE 'FUNCTION' END AS kind, CASE WHEN p_partkey % 17 = 2 THEN concat('GET /x', p_partkey) ELSE concat('fn', p_partkey) END AS name,
   CASE WHEN p_partkey % 11 IN (3, 4) THEN NULL WHEN p_partkey % 11 = 5 THEN 'nowhere/x.py' ELSE path END AS file, p_partkey AS k FROM ({rows}) r"""
define("ann_src", _ANN_NODES.format(rows="SELECT * FROM role_rows"), ["role_rows"])
define("ann", """SELECT a.id, a.kind, a.name, a.file, a.k, CASE WHEN lost THEN NULL ELSE r.role END AS file_role, r.i, (kind = 'ROUTE' OR name LIKE 'GET %') AS route,
   CASE WHEN lost THEN 'UNKNOWN' WHEN role = 'TEST' THEN 'TEST_ONLY' WHEN role = 'GENERATED' THEN 'GENERATED_ONLY' WHEN role = 'CONTRACT' THEN 'RUNTIME' WHEN i IN (22, 23) THEN 'UNREACHABLE_CANDIDATE' WHEN role = 'SOURCE' THEN 'RUNTIME' ELSE 'UNKNOWN' END AS reachability,
   CASE WHEN lost THEN 0.35 WHEN role = 'TEST' THEN 0.9 WHEN role = 'GENERATED' THEN 0.92 WHEN role = 'CONTRACT' THEN 0.82 WHEN i IN (22, 23) THEN 0.76 WHEN role = 'SOURCE' THEN 0.86 WHEN role = 'UNKNOWN' THEN 0.35 ELSE 0.72 END AS conf
   FROM (SELECT *, k % 11 = 5 OR id LIKE 'Dockerfile::%' AS lost FROM ann_src) a JOIN role_rows r ON r.p_partkey = a.k""", ["ann_src", "role_rows"])


def _annotated(spark, sf):
    return H.annotate_nodes(P.run(spark, sf, _ANN_NODES.format(rows=ROLE_FILES)), _roles(spark, sf))


@query("B10_annotate_nodes", using("ann") + "SELECT id, file_role, reachability, conf::DOUBLE AS hygiene_confidence, route AS is_route FROM ann")
def b10(spark, sf):
    return _annotated(spark, sf).select("id", "file_role", "reachability", "hygiene_confidence", F.array_contains("tags", "route").alias("is_route"))


_ANN_EDGES = "SELECT concat('e', p_partkey) AS id, concat('n:', p_partkey) AS from_id, concat('n:', p_partkey + 1) AS to_id, CASE WHEN p_size % 9 = 0 THEN 'TESTS' ELSE 'CALLS' END AS kind FROM @part"
define("ann_edges", _ANN_EDGES)
define("ann_e", """SELECT e.id, CASE WHEN l.reachability = 'GENERATED_ONLY' OR r.reachability = 'GENERATED_ONLY' THEN 1
     WHEN e.kind = 'TESTS' OR ((l.id IS NOT NULL OR r.id IS NOT NULL) AND coalesce(l.reachability = 'TEST_ONLY', true) AND coalesce(r.reachability = 'TEST_ONLY', true)) THEN 2
     WHEN (l.i IN (22, 23) AND l.file_role IS NOT NULL) OR (r.i IN (22, 23) AND r.file_role IS NOT NULL) THEN 3 ELSE 4 END AS c, l.id IS NOT NULL OR r.id IS NOT NULL AS known
   FROM ann_edges e LEFT JOIN ann l ON l.id = e.from_id LEFT JOIN ann r ON r.id = e.to_id""", ["ann_edges", "ann"])


def _ann_edges(spark, sf):
    return H.annotate_edges(P.run(spark, sf, _ANN_EDGES), _annotated(spark, sf))


@query("B11_annotate_edges", using("ann_e") + """SELECT id, CASE c WHEN 1 THEN 'GENERATED_ONLY' WHEN 2 THEN 'TEST_ONLY' WHEN 3 THEN 'UNREACHABLE_CANDIDATE' ELSE 'RUNTIME' END AS reachability,
   CASE c WHEN 1 THEN 0.9 WHEN 2 THEN 0.4 WHEN 3 THEN 0.7 ELSE 0.1 END::DOUBLE AS noise_score, CASE c WHEN 1 THEN 0.88 WHEN 2 THEN 0.86 WHEN 3 THEN 0.76 ELSE CASE WHEN known THEN 0.75 ELSE 0.45 END END::DOUBLE AS hygiene_confidence FROM ann_e""")
def b11(spark, sf):
    return _ann_edges(spark, sf).select("id", "reachability", "noise_score", "hygiene_confidence")


@query("B12_filter_by_mode", using("ann") + """SELECT 'main' AS mode, count(*) AS n FROM ann WHERE reachability IN ('RUNTIME', 'TEST_ONLY', 'UNKNOWN') UNION ALL SELECT 'runtime', count(*) FROM ann WHERE reachability = 'RUNTIME'
   UNION ALL SELECT 'tests', count(*) FROM ann WHERE reachability = 'TEST_ONLY' UNION ALL SELECT 'noise', count(*) FROM ann WHERE reachability IN ('GENERATED_ONLY', 'UNREACHABLE_CANDIDATE') UNION ALL SELECT 'all', count(*) FROM ann""")
def b12(spark, sf):
    nodes, ann = P.run(spark, sf, _ANN_NODES.format(rows=ROLE_FILES)), _annotated(spark, sf)
    out = None
    for mode in ("main", "runtime", "tests", "noise", "all"):
        one = H.filter_by_mode(nodes, ann, mode).agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query("B13_semantic_role", using("ann") + """SELECT id, CASE WHEN route THEN 'routes' WHEN file_role = 'TEST' THEN 'tests' WHEN file_role = 'CONTRACT' THEN 'contracts' WHEN file_role = 'GENERATED' THEN 'generated'
   WHEN file_role = 'CONFIG' THEN 'configs' WHEN file_role = 'DOCS' THEN 'docs' WHEN contains(concat(coalesce(file, ''), id), 'service') THEN 'services' ELSE 'unknown' END AS semantic_role FROM ann""")
def b13(spark, sf):
    return H.semantic_role(_annotated(spark, sf)).select("id", "semantic_role")


@query("B14_hygiene_summary", using("ann", "ann_e", "classified") + """SELECT 'files.' || role AS metric, count(*) AS n FROM role_rows GROUP BY role UNION ALL SELECT 'files.total', count(*) FROM role_rows
  UNION ALL SELECT 'dependencies.' || kind, count(*) FROM classified GROUP BY kind UNION ALL SELECT 'dependencies.total', count(*) FROM classified
  UNION ALL SELECT 'nodes.' || reachability, count(*) FROM ann GROUP BY reachability UNION ALL SELECT 'nodes.total', count(*) FROM ann
  UNION ALL SELECT 'edges.' || CASE c WHEN 1 THEN 'GENERATED_ONLY' WHEN 2 THEN 'TEST_ONLY' WHEN 3 THEN 'UNREACHABLE_CANDIDATE' ELSE 'RUNTIME' END, count(*) FROM ann_e GROUP BY c UNION ALL SELECT 'edges.total', count(*) FROM ann_e
  UNION ALL SELECT 'dependencies.requires_research', count(*) FROM classified WHERE kind = 'UNKNOWN_THIRD_PARTY' UNION ALL SELECT 'files.dead_candidates', count(*) FROM role_rows WHERE i IN (22, 23)""")
def b14(spark, sf):
    # Every part is stored: the summary reads it more than once, and fewer joins are then planned and broadcast at a time.
    roles = cut(_roles(spark, sf).select("path", "role", "tags"))
    deps = cut(_classified(spark, sf).select("kind", "requires_research"))
    nodes = cut(H.annotate_nodes(P.run(spark, sf, _ANN_NODES.format(rows=ROLE_FILES)), roles).select("id", "reachability", "tags"))
    return H.hygiene_summary(roles, deps, nodes, H.annotate_edges(P.run(spark, sf, _ANN_EDGES), nodes))


_PACKS = "SELECT library FROM (VALUES ('numpy'), ('lib-small')) AS v(library)"
define("open_deps", f"""SELECT i.*, EXISTS (SELECT 1 FROM declared d WHERE d.repo = i.repo AND d.ecosystem = i.ecosystem AND d.role = 'dev' AND {_SAME}) AS is_dev2, {_COMMON} AS is_common2 FROM (
    SELECT repo, ecosystem, name FROM imported UNION SELECT repo, ecosystem, name FROM declared WHERE role <> 'transitive') i
    WHERE name NOT IN ('numpy', 'lib-small', 'lib_small')""", ["imported", "declared"])


@query("B15_unknown_libraries", using("open_deps") + """, named AS (SELECT i.repo, coalesce((SELECT min(d.name) FROM declared d WHERE d.repo = i.repo AND d.ecosystem = i.ecosystem AND d.role <> 'transitive'
    AND ((i.ecosystem = 'python' AND lower(replace(d.name, '-', '_')) = lower(replace(i.name, '-', '_'))) OR (i.ecosystem <> 'python' AND (i.name = d.name OR starts_with(i.name, d.name || '/')))
      OR (i.ecosystem = 'java' AND (i.name = split_part(d.name, ':', 1) OR starts_with(i.name, split_part(d.name, ':', 1) || '.'))))), i.name) AS c
   FROM open_deps i WHERE NOT is_dev2 AND NOT is_common2) SELECT repo, min(c) AS library FROM named GROUP BY repo, lower(c)""")
def b15(spark, sf):
    imports, declared, local, dev = _deps(spark, sf)
    return DP.unknown_libraries(imports, declared, local, dev, spark.sql(_PACKS))


@query("B16_library_coverage", using("imported", "declared") + """SELECT repo, ecosystem, name, min(source) AS source, max(CASE name WHEN 'react' THEN 'verified' WHEN 'requests' THEN 'trusted' END) AS trust_level FROM (
   SELECT repo, ecosystem, name, 'declared' AS source FROM declared WHERE role <> 'transitive' UNION ALL SELECT repo, ecosystem, name, 'external_import' FROM imported) GROUP BY repo, ecosystem, name""")
def b16(spark, sf):
    imports, declared, _, _ = _deps(spark, sf)
    context = spark.sql("SELECT * FROM (VALUES ('react', 'verified'), ('requests', 'trusted')) AS v(library, trust_level)")
    return DP.library_coverage(declared, imports, context).select("repo", "ecosystem", "name", "source", "trust_level")


@query("B17_language_capabilities", using("langs") + """SELECT repo, language, CASE language WHEN 'python' THEN 'python_ast_precision' WHEN 'go' THEN 'go_tree_sitter_structural' WHEN 'java' THEN 'java_tree_sitter_structural'
   WHEN 'typescript' THEN 'typescript_tree_sitter_endpoint_provider' ELSE 'javascript_tree_sitter_endpoint_provider' END AS provider_id, CASE language WHEN 'python' THEN 'semantic' ELSE 'limited' END AS call_resolution,
   language NOT IN ('go', 'java') AS endpoint_resolution, language = 'python' AS production_semantic_baseline FROM langs""")
def b17(spark, sf):
    return PR.language_capabilities(PR.detect_languages(_files(spark, sf))).select("repo", "language", "provider_id", "call_resolution", "endpoint_resolution", "production_semantic_baseline")


_REGISTRY = "SELECT ecosystem, library FROM (VALUES ('python', 'boto3'), ('go', 'gopkg.in/yaml.v3'), ('java', 'com.lone')) AS v(ecosystem, library)"


@query("B18_registry_sync", using("imported", "declared") + f""", chosen AS (SELECT repo, ecosystem, name FROM declared WHERE role <> 'transitive'
    UNION SELECT repo, ecosystem, name FROM imported i WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.repo = i.repo AND d.ecosystem = i.ecosystem AND d.role <> 'transitive')),
  third AS (SELECT i.* FROM chosen i WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.repo = i.repo AND d.ecosystem = i.ecosystem AND d.role = 'dev' AND {_SAME})
    AND (EXISTS (SELECT 1 FROM declared d WHERE d.repo = i.repo AND d.ecosystem = i.ecosystem AND d.role <> 'transitive' AND {_SAME}) OR NOT ({_COMMON})))
  SELECT DISTINCT t.repo, t.ecosystem, lower(name) AS library, CASE WHEN r.library IS NOT NULL THEN 'pulled' ELSE 'missing' END AS outcome FROM third t
  LEFT JOIN ({_REGISTRY}) r ON r.ecosystem = t.ecosystem AND r.library = lower(name) WHERE lower(name) NOT IN ('numpy', 'lib-small', 'lib_small')""")
def b18(spark, sf):
    imports, declared, local, dev = _deps(spark, sf)
    return DP.registry_sync(imports, declared, local, dev, spark.sql(_PACKS), spark.sql(_REGISTRY))
