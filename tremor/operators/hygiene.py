"""Roles of files, and what those roles say about nodes and edges."""
from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import columns as X

# Folder names, file names, markers and priorities of the role rules.
CODE_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".java", ".cs", ".rb", ".php", ".rs", ".kt", ".swift")
VENDOR_DIRS = ("node_modules", ".venv", "venv", "site-packages")
BUILD_DIRS = ("dist", "build", "target", ".next", "coverage")
GENERATED_DIRS = ("generated", "__generated__", "gen", "autogen", "proto")
GENERATED_NAMES = (".generated.", "_generated.", ".gen.", "_pb2.py", "_pb2_grpc.py", ".g.dart", ".designer.cs", ".min.js", ".bundle.js")
GENERATED_MARKERS = ("Code generated", "AUTO-GENERATED", "This file was generated", "DO NOT EDIT", "@generated")
TEST_DIRS = ("tests", "test", "__tests__", "spec")
TEST_NAMES = r"^(test_.*\.py|.*_test\.py|.*\.test\.tsx?|.*\.spec\.tsx?|.*_test\.go)$"
TEST_NAMES_CASED = r"^(.*Test\.java|.*Tests\.cs)$"
CONTRACT_DIRS = ("contracts", "schemas", "openapi", "proto")
CONTRACT_NAMES = ("openapi.json", "openapi.yaml", "openapi.yml", "swagger.json", "swagger.yaml", "swagger.yml", "graphql.schema")
MIGRATION_DIRS = ("migrations", "alembic")
MIGRATION_NAMES = r"^(\d{8,14}|\d{4}_\d{2}_\d{2})[_-].*\.(py|sql|js|ts)$"
FIXTURE_DIRS = ("fixtures", "samples", "examples", "testdata")
CONFIG_NAMES = ("pyproject.toml", "package.json", "tsconfig.json", "go.mod", "pom.xml", "build.gradle", "dockerfile",
                "docker-compose.yml", "docker-compose.yaml", ".env.example")
CONFIG_TOKENS = ("eslint", "prettier", "vite", "webpack")
LIFECYCLE_TAGS = (("dead", "dead_candidate"), ("unused", "unused_candidate"), ("orphan", "unused_candidate"),
                  ("legacy", "legacy_candidate"), ("deprecated", "legacy_candidate"))
ROLE_PRIORITY = {"VENDOR": 0, "BUILD_ARTIFACT": 0, "GENERATED": 1, "TEST": 2, "CONTRACT": 3, "MIGRATION": 4, "FIXTURE": 5,
                 "CONFIG": 6, "DOCS": 7, "SOURCE": 8, "UNKNOWN": 9}
HEADER_LINES = 20


def classify_file_roles(files: DataFrame) -> DataFrame:
    """Add ``role``, ``role_confidence`` and ``tags``; the first rule that fits decides.

    Needs ``path`` and, for generated headers, ``content``.
    """
    lines = F.split(F.coalesce("content", F.lit("")), "\r\n|\n|\r", HEADER_LINES + 1) if "content" in files.columns else F.array(F.lit(""))
    work = files.withColumns({
        "_path": X.strip_dot_slash("path"), "_header": F.lower(F.array_join(F.slice(lines, 1, HEADER_LINES), "\n"))})
    work = work.withColumns({"_low": F.lower("_path"), "_raw": X.last_part("_path")})
    work = work.withColumns({"_dirs": F.filter(F.split("_low", "/"), lambda s: s != ""), "_name": F.lower("_raw")})
    name, low = F.col("_name"), F.col("_low")
    inside = lambda dirs: F.arrays_overlap("_dirs", F.array(*[F.lit(d) for d in dirs]))
    named = lambda tokens: X.any_contains(name, tokens)
    ends = lambda suffixes: name.rlike("[^.](" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    tooling = named(CONFIG_TOKENS) & (F.contains(name, F.lit("config")) | name.rlike(r"\.(js|ts|cjs|mjs|json)$"))
    rules = [
        (inside(VENDOR_DIRS), "VENDOR", 0.98), (inside(BUILD_DIRS), "BUILD_ARTIFACT", 0.96),
        (inside(GENERATED_DIRS), "GENERATED", 0.95), (named(GENERATED_NAMES), "GENERATED", 0.96),
        (X.any_contains(F.col("_header"), [m.lower() for m in GENERATED_MARKERS]), "GENERATED", 0.94),
        (inside(TEST_DIRS), "TEST", 0.94), (name.rlike(TEST_NAMES) | F.col("_raw").rlike(TEST_NAMES_CASED), "TEST", 0.93),
        (inside(CONTRACT_DIRS), "CONTRACT", 0.92), (name.isin(*CONTRACT_NAMES), "CONTRACT", 0.95),
        (name.rlike(r"(\.schema\.json|\.contract\.json|\.proto)$"), "CONTRACT", 0.94),
        (inside(MIGRATION_DIRS) | F.contains(F.concat(F.lit("/"), low, F.lit("/")), F.lit("/db/migrate/")), "MIGRATION", 0.92),
        (name.rlike(MIGRATION_NAMES), "MIGRATION", 0.88), (inside(FIXTURE_DIRS), "FIXTURE", 0.90),
        (name.isin(*CONFIG_NAMES), "CONFIG", 0.95), (tooling, "CONFIG", 0.90),
        (name == "readme.md", "DOCS", 0.95), (inside(("docs",)), "DOCS", 0.91), (ends((".md", ".rst")), "DOCS", 0.90),
        (ends(CODE_SUFFIXES), "SOURCE", 0.65), (F.lit(True), "UNKNOWN", 0.30),
    ]
    work = work.withColumn("_rule", first_rule([c for c, _, _ in rules]))
    tags = F.array_sort(F.array_distinct(X.present([(F.contains(low, F.lit(t)), tag) for t, tag in LIFECYCLE_TAGS])))
    return work.withColumns({
        "role": value_of("_rule", [r for _, r, _ in rules]), "role_confidence": value_of("_rule", [k for _, _, k in rules]), "tags": tags,
    }).drop("_path", "_header", "_low", "_raw", "_dirs", "_name", "_rule")


def first_rule(conditions: list[Column]) -> Column:
    """Number of the first condition that holds, from 1; the rule is decided once and then looked up."""
    return X.labels_when([(c, i) for i, c in enumerate(conditions, start=1)])


def value_of(rule: str, values: list) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), F.col(rule))


def glob_regex(pattern: str) -> str:
    """File glob as an anchored Java pattern."""
    body = fnmatch.translate(pattern)
    return "(?s)^" + body.removeprefix("(?s:").replace(")\\Z", "").replace(")\\z", "") + "$"


def apply_role_overrides(classified: DataFrame, patterns: DataFrame) -> DataFrame:
    """Custom (role, pattern) rules, used only where their role outranks the built-in one.

    Patterns are grouped by role on the driver: they are rules a person writes, not data.
    """
    path = X.strip_dot_slash("path")
    name = X.last_part(path)
    out = classified.withColumn("_own", F.lit(None).cast("string"))
    rules = [(r["role"], glob_regex(r["pattern"])) for r in patterns.orderBy("seq").select("role", "pattern").collect()]
    first = X.labels_when([(path.rlike(p) | name.rlike(p), role) for role, p in rules if role in ROLE_PRIORITY]) if rules else F.lit(None)
    out = out.withColumn("_own", first)
    better = X.lookup("_own", ROLE_PRIORITY) < X.lookup("role", ROLE_PRIORITY)
    return out.withColumns({
        "role_confidence": F.when(better, 0.88).otherwise(F.col("role_confidence")),
        "role": F.when(better, F.col("_own")).otherwise(F.col("role"))}).drop("_own")


def is_route() -> Column:
    kind, name, node = F.upper("kind"), F.upper(F.coalesce("name", F.lit(""))), F.upper("id")
    verbs = r"^(GET|POST|PUT|PATCH|DELETE) "
    return kind.endswith("ROUTE") | name.rlike(verbs) | node.rlike("^(HTTP|GET |POST )")


def annotate_nodes(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Add ``file_role``, ``reachability``, ``tags`` and ``hygiene_confidence`` from the node's file.

    roles: (path, role, tags). The file of a node without one is read from its id.
    """
    from_id = F.when(F.startswith("id", F.lit("file:")), F.substr("id", F.lit(6))).when(
        F.contains("id", F.lit("::")) & F.substring_index("id", "::", 1).rlike("[/.]"), F.substring_index("id", "::", 1))
    at = X.strip_dot_slash(F.coalesce(F.nullif("file", F.lit("")), from_id))
    known = roles.groupBy(X.strip_dot_slash("path").alias("_p")).agg(F.max(F.struct("role", "tags")).alias("_r"))
    out = nodes.withColumn("_p", at).join(known, "_p", "left")
    role, tags = F.col("_r.role"), F.coalesce("_r.tags", X.no_strings())
    dead = F.arrays_overlap(tags, F.array(F.lit("dead_candidate"), F.lit("unused_candidate")))
    other = role.isin("CONFIG", "DOCS", "FIXTURE", "MIGRATION", "VENDOR", "BUILD_ARTIFACT")
    none = F.lit(None).cast("string")
    cases = [  # condition, reachability, confidence, tag
        (role.isNull(), "UNKNOWN", 0.35, none), (role == "TEST", "TEST_ONLY", 0.90, F.lit("test")),
        (role == "GENERATED", "GENERATED_ONLY", 0.92, F.lit("generated")), (role == "CONTRACT", "RUNTIME", 0.82, F.lit("contract")),
        (dead, "UNREACHABLE_CANDIDATE", 0.76, none), (role == "SOURCE", "RUNTIME", 0.86, none),
        (other, "UNKNOWN", 0.72, F.lower(role)), (F.lit(True), "UNKNOWN", 0.35, none),
    ]
    out = out.withColumn("_rule", first_rule([c for c, _, _, _ in cases]))
    own = F.when(is_route(), F.lit("route"))
    return out.withColumns({
        "file_role": role, "reachability": value_of("_rule", [r for _, r, _, _ in cases]),
        "hygiene_confidence": value_of("_rule", [k for _, _, k, _ in cases]),
        "tags": F.array_sort(F.array_distinct(F.concat(tags, F.array_compact(F.array(own, value_of("_rule", [t for _, _, _, t in cases])))))),
    }).drop("_p", "_r", "_rule")


def annotate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``reachability``, ``noise_score`` and ``hygiene_confidence`` from both ends' annotations."""
    dead = F.arrays_overlap("tags", F.array(F.lit("dead_candidate"), F.lit("unused_candidate")))
    side = nodes.select("id", F.struct((F.col("reachability") == "GENERATED_ONLY").alias("gen"), (F.col("reachability") == "TEST_ONLY").alias("test"),
                                       (dead | (F.col("reachability") == "UNREACHABLE_CANDIDATE")).alias("dead")).alias("s"))
    out = (edges.join(side.select(F.col("id").alias("from_id"), F.col("s").alias("_l")), "from_id", "left")
           .join(side.select(F.col("id").alias("to_id"), F.col("s").alias("_r")), "to_id", "left"))
    some = lambda f: F.coalesce(F.col(f"_l.{f}"), F.lit(False)) | F.coalesce(F.col(f"_r.{f}"), F.lit(False))
    known = F.col("_l").isNotNull() | F.col("_r").isNotNull()
    all_test = known & F.coalesce(F.col("_l.test"), F.lit(True)) & F.coalesce(F.col("_r.test"), F.lit(True))
    cases = [(some("gen"), "GENERATED_ONLY", 0.90, 0.88), ((F.upper("kind") == "TESTS") | all_test, "TEST_ONLY", 0.40, 0.86),
             (some("dead"), "UNREACHABLE_CANDIDATE", 0.70, 0.76), (known, "RUNTIME", 0.10, 0.75), (F.lit(True), "RUNTIME", 0.10, 0.45)]
    return out.withColumn("_rule", first_rule([c for c, _, _, _ in cases])).withColumns({
        "reachability": value_of("_rule", [r for _, r, _, _ in cases]), "noise_score": value_of("_rule", [n for _, _, n, _ in cases]),
        "hygiene_confidence": value_of("_rule", [k for _, _, _, k in cases])}).drop("_l", "_r", "_rule")


# What each view of an impact result shows.
MODES = {"main": ("RUNTIME", "TEST_ONLY", "UNKNOWN"), "runtime": ("RUNTIME",), "tests": ("TEST_ONLY",),
         "noise": ("GENERATED_ONLY", "UNREACHABLE_CANDIDATE")}


def filter_by_mode(nodes: DataFrame, annotations: DataFrame, mode: str = "main") -> DataFrame:
    mode = mode.lower()
    if mode == "all":
        return nodes
    if mode not in MODES:
        raise ValueError(f"unknown impact filter mode: {mode}")
    reach = annotations.groupBy("id").agg(F.max("reachability").alias("_reach"))
    return nodes.join(reach, "id", "left").where(F.coalesce("_reach", F.lit("UNKNOWN")).isin(*MODES[mode])).drop("_reach")


# Parts of paths and names that tell a node's role.
FRONTEND_PLACES = ("frontend/", "/src/components/", "/components/", "/hooks/", "/api/", "/routes/")
STORE_TOKENS = ("repository", "/repo", " repo", "/dao", " dao", "/store", " store")


def semantic_role(annotated: DataFrame) -> DataFrame:
    """Add ``semantic_role``, one of eleven report groups."""
    low = F.lower(F.concat_ws(" ", F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), "kind", "id"))
    kind, name, node = F.upper("kind"), F.upper(F.coalesce("name", F.lit(""))), F.upper("id")
    route = (kind == "ROUTE") | name.rlike(r"^(GET|POST|PUT|PATCH|DELETE) ") | node.startswith("HTTP") | F.array_contains("tags", "route")
    role = F.col("file_role")
    front = X.any_contains(low, (".ts", ".tsx", ".js", ".jsx")) & X.any_contains(low, FRONTEND_PLACES)
    return annotated.withColumn("semantic_role", X.labels_when([
        (route, "routes"), (role == "TEST", "tests"), (role == "CONTRACT", "contracts"),
        ((role == "GENERATED") | (F.col("reachability") == "GENERATED_ONLY"), "generated"), (role == "CONFIG", "configs"), (role == "DOCS", "docs"),
        (kind.isin("EXTERNAL", "DEPENDENCY", "LIBRARY", "IMPORT") | F.contains(low, F.lit("external")), "external_libraries"),
        (F.contains(low, F.lit("service")), "services"), (X.any_contains(low, STORE_TOKENS), "repositories"), (front, "frontend"),
    ], "unknown"))


def hygiene_summary(files: DataFrame, deps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, n): counts by role, dependency kind and reachability, with totals."""
    def counts(df, group, col):
        return df.rollup(col).agg(F.count(F.lit(1)).alias("n"), F.grouping(col).alias("_g")).select(
            F.concat(F.lit(f"{group}."), F.when(F.col("_g") == 1, "total").otherwise(F.col(col))).alias("metric"), "n")

    dead = F.arrays_overlap("tags", F.array(F.lit("dead_candidate"), F.lit("unused_candidate")))
    single = lambda df, cond, metric: df.agg(F.count_if(cond).alias("n")).select(F.lit(metric).alias("metric"), "n")
    parts = [counts(files, "files", "role"), counts(deps, "dependencies", "kind"), counts(nodes, "nodes", "reachability"),
             counts(edges, "edges", "reachability"), single(deps, F.col("requires_research"), "dependencies.requires_research"),
             single(files, dead, "files.dead_candidates")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
