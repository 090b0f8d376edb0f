"""Dependencies of many repositories: naming, classification, research candidates, pack coverage."""
from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import columns as X
from tremor.plans.loops import cut

# Ecosystem aliases, runtime modules and widely known libraries per ecosystem.
ECOSYSTEM_ALIASES = {
    "js": "javascript", "node": "javascript", "nodejs": "javascript", "npm": "javascript",
    "ts": "typescript", "tsx": "typescript", "py": "python", "golang": "go", "jvm": "java",
}
_JS_RUNTIME = ["fs", "path", "url", "crypto", "http", "https", "stream", "events", "child_process", "util", "os", "buffer"]
_JS_COMMON = [
    "react", "react-dom", "react-router-dom", "@vitejs/plugin-react", "vite", "vitest", "typescript",
    "axios", "next", "express", "zod", "lodash",
]
RUNTIME_MODULES = {
    "javascript": _JS_RUNTIME, "typescript": _JS_RUNTIME,
    "go": ["fmt", "net/http", "context", "encoding/json", "strings", "errors", "time", "os", "log", "testing"],
    "java": ["java", "javax"],
}
KNOWN_COMMON = {
    "python": [
        "fastapi", "pydantic", "sqlalchemy", "pytest", "celery", "django", "flask", "requests",
        "httpx", "uvicorn", "dependency_injector",
    ],
    "javascript": _JS_COMMON, "typescript": _JS_COMMON,
    "go": ["github.com/gin-gonic/gin", "github.com/stretchr/testify"],
    "java": ["org.springframework", "junit", "org.junit", "org.mockito"],
}
CONFIDENCE = {
    "LOCAL": 0.97, "STDLIB": 0.96, "BUILTIN_RUNTIME": 0.95, "TYPE_ONLY": 0.90, "DEV_ONLY": 0.92,
    "DECLARED_THIRD_PARTY": 0.94, "KNOWN_COMMON_THIRD_PARTY": 0.86, "UNKNOWN_THIRD_PARTY": 0.70,
}
SEPARATOR = {"go": "/", "java": ".", "javascript": "/", "typescript": "/"}


def python_stdlib() -> list[str]:
    return sorted(sys.stdlib_module_names)


def normalize_ecosystem(eco: Column | str) -> Column:
    e = F.lower(F.trim(X.col(eco)))
    return F.coalesce(X.lookup(e, ECOSYSTEM_ALIASES), e)


def clean_name(name: Column | str) -> Column:
    return F.regexp_replace(F.trim(X.col(name)), "^[\"']+|[\"']+$", "")


def normalize_dep_name(name: Column | str, eco: Column | str) -> Column:
    """The part of an import or requirement that names the library."""
    n, e = F.trim(X.col(name)), X.col(eco)
    js = F.regexp_replace(n, "^node:", "")
    return X.labels_when([
        (e == "python", F.lower(F.replace(F.substring_index(n, ".", 1), F.lit("-"), F.lit("_")))),
        (e.isin("javascript", "typescript") & js.startswith("@"), F.substring_index(js, "/", 2)),
        (e.isin("javascript", "typescript"), F.substring_index(js, "/", 1)),
        ((e == "java") & n.startswith("java."), "java"),
        ((e == "java") & n.startswith("javax."), "javax"),
        ((e == "java") & n.startswith("org.springframework"), "org.springframework"),
        (e == "java", F.substring_index(n, ".", 2)),
        (e == "go", n),
    ], F.substring_index(n, ".", 1))


def _prefixes(name: Column, sep: str) -> Column:
    """The name itself and everything before each separator."""
    parts = F.split(name, "\\" + sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def _prefix_keys(name: Column, eco: Column) -> Column:
    chain = None
    for e, sep in SEPARATOR.items():
        chain = F.when(eco == e, _prefixes(name, sep)) if chain is None else chain.when(eco == e, _prefixes(name, sep))
    return F.transform(F.coalesce(chain, X.no_strings()), lambda p: F.concat(F.lit("p:"), p))


def match_names(deps: DataFrame, **candidates: DataFrame) -> DataFrame:
    """(repo, ecosystem, name) with one flag per candidate set: the name equals a candidate, raw or
    normalised, or lies below one.

    "Below" is an equality between the candidate and an exploded prefix of the name, and all
    candidate sets share one join and one aggregate.
    """
    eco = F.col("ecosystem")
    norm = F.concat(F.lit("n:"), normalize_dep_name("name", "ecosystem"))
    raw = F.concat(F.lit("r:"), F.trim("name"))
    left = deps.select("repo", "ecosystem", "name", F.explode(F.array_distinct(F.concat(F.array(norm, raw), _prefix_keys(F.trim("name"), eco)))).alias("_k"))
    tagged = None
    for flag, frame in candidates.items():
        one = frame.select("repo", normalize_ecosystem("ecosystem").alias("ecosystem"), "name", F.lit(flag).alias("_tag"))
        tagged = one if tagged is None else tagged.unionByName(one)
    base = X.labels_when([(eco == e, F.rtrim(F.trim("name"), F.lit(sep))) for e, sep in SEPARATOR.items()])
    right = tagged.select("repo", "ecosystem", "_tag", F.explode(F.array_compact(F.array(norm, raw, F.concat(F.lit("p:"), base)))).alias("_k")).distinct()
    return left.join(right, ["repo", "ecosystem", "_k"]).groupBy("repo", "ecosystem", "name").agg(
        *[F.max(F.col("_tag") == flag).alias(flag) for flag in candidates])


def _starts_below(norm: Column, items: list[str], sep: str) -> Column:
    hit = norm.isin(*items)
    for i in items:
        hit = hit | norm.startswith(i + sep)
    return hit


def is_stdlib(norm: Column, eco: Column) -> Column:
    dotless = ~F.contains(F.substring_index(norm, "/", 1), F.lit("."))
    return (((eco == "python") & norm.isin(*python_stdlib())) | ((eco == "go") & _starts_below(norm, RUNTIME_MODULES["go"], "/") & dotless)
            | ((eco == "java") & norm.isin(*RUNTIME_MODULES["java"])))


def is_runtime(norm: Column, eco: Column) -> Column:
    return eco.isin("javascript", "typescript") & norm.isin(*_JS_RUNTIME)


def is_known_common(norm: Column, eco: Column) -> Column:
    js = (eco.isin("javascript", "typescript")) & norm.isin(*_JS_COMMON)
    return (((eco == "python") & norm.isin(*KNOWN_COMMON["python"])) | js | ((eco == "go") & _starts_below(norm, KNOWN_COMMON["go"], "/"))
            | ((eco == "java") & _starts_below(norm, KNOWN_COMMON["java"], ".")))


def classify_dependencies(deps: DataFrame, local: DataFrame, declared: DataFrame, dev: DataFrame) -> DataFrame:
    """Add ``kind``, ``confidence``, ``declared``, ``requires_research`` and the single tests behind them.

    All frames are (repo, ecosystem, name); ``deps`` may carry ``type_only``.
    """
    if "type_only" not in deps.columns:
        deps = deps.withColumn("type_only", F.lit(False))
    keyed = deps.withColumns({"ecosystem": normalize_ecosystem("ecosystem"), "name": clean_name("name")})
    names = keyed.select("repo", "ecosystem", "name").distinct()
    out = keyed.join(match_names(names, is_local=local, is_dev=dev, is_declared=declared), ["repo", "ecosystem", "name"], "left")
    norm, eco = F.col("_norm"), F.col("ecosystem")
    out = out.fillna(False, ["is_local", "is_dev", "is_declared"]).withColumn("_norm", normalize_dep_name("name", "ecosystem"))
    out = out.withColumns({
        "is_stdlib": is_stdlib(norm, eco), "is_runtime": is_runtime(norm, eco), "is_common": is_known_common(norm, eco)}).drop("_norm")
    kind = X.labels_when([
        (F.col("is_local"), "LOCAL"), (F.col("is_stdlib"), "STDLIB"), (F.col("is_runtime"), "BUILTIN_RUNTIME"), (F.col("type_only"), "TYPE_ONLY"),
        (F.col("is_dev"), "DEV_ONLY"), (F.col("is_declared"), "DECLARED_THIRD_PARTY"), (F.col("is_common"), "KNOWN_COMMON_THIRD_PARTY"),
    ], "UNKNOWN_THIRD_PARTY")
    out = out.withColumn("kind", kind)
    return out.withColumns({
        "confidence": X.lookup("kind", CONFIDENCE), "requires_research": F.col("kind") == "UNKNOWN_THIRD_PARTY",
        "declared": F.col("kind").isin("DEV_ONLY", "DECLARED_THIRD_PARTY") | ((F.col("kind") == "TYPE_ONLY") & F.col("is_declared"))})


def without_pack(deps: DataFrame, packs: DataFrame) -> DataFrame:
    """Drop dependencies a rule pack covers, under any spelling of the name. packs: (library)."""
    dashed, scored = F.replace("name", F.lit("_"), F.lit("-")), F.replace("name", F.lit("-"), F.lit("_"))
    spellings = F.array_distinct(F.array("name", normalize_dep_name("name", "ecosystem"), dashed, scored))
    covered = deps.select("repo", "ecosystem", "name", F.explode(spellings).alias("library")).join(
        packs.select("library").distinct(), "library", "left_semi").select("repo", "ecosystem", "name").distinct()
    return deps.join(covered, ["repo", "ecosystem", "name"], "left_anti")


def candidate_names(deps: DataFrame, declared: DataFrame) -> DataFrame:
    """Add ``candidate``: the declared name an import belongs to, else the import itself."""
    eco = F.col("ecosystem")
    spelled = F.concat(F.lit("n:"), F.lower(F.replace("name", F.lit("-"), F.lit("_"))))
    keys = F.when(eco == "python", F.array(spelled)).otherwise(_prefix_keys(F.col("name"), eco))
    own = F.when(eco == "python", spelled).otherwise(F.concat(F.lit("p:"), X.labels_when([
        (eco == "java", F.rtrim(F.substring_index("name", ":", 1), F.lit(".")))], F.rtrim("name", F.lit("/")))))
    names = deps.select("repo", "ecosystem", "name").distinct().select("repo", "ecosystem", "name", F.explode(keys).alias("_k"))
    sources = declared.select("repo", "ecosystem", F.col("name").alias("_d"), own.alias("_k"))
    # Longest declared name first; Python spellings are equal, so the smallest wins.
    best = names.join(sources, ["repo", "ecosystem", "_k"]).groupBy("repo", "ecosystem", "name").agg(
        F.min_by("_d", F.struct(F.when(eco == "python", 0).otherwise(-F.length("_d")), "_d")).alias("_c"))
    return deps.join(best, ["repo", "ecosystem", "name"], "left").withColumn("candidate", F.coalesce("_c", "name")).drop("_c")


def unknown_libraries(imports: DataFrame, declared: DataFrame, local: DataFrame, dev: DataFrame, packs: DataFrame) -> DataFrame:
    """(repo, library) worth researching: no pack, not local, runtime, development or widely known."""
    cols = ["repo", "ecosystem", "name"]
    names = cut(without_pack(cut(imports.select(*cols).unionByName(declared.select(*cols)).distinct()), packs))
    open_ = cut(classify_dependencies(names, local, declared, dev).where(
        ~(F.col("is_local") | F.col("is_stdlib") | F.col("is_runtime") | F.col("is_dev") | F.col("is_common"))).select(*cols))
    found = candidate_names(open_, declared)
    return found.groupBy("repo", F.lower("candidate").alias("_l")).agg(F.min("candidate").alias("library")).select("repo", "library")


def library_coverage(declared: DataFrame, imports: DataFrame, context: DataFrame) -> DataFrame:
    """Every dependency once with where it was seen first and its pack's trust. context: (library, trust_level)."""
    rows = declared.select("repo", "ecosystem", "name", F.lit("declared").alias("source")).unionByName(
        imports.select("repo", "ecosystem", "name", F.lit("external_import").alias("source")))
    one = rows.groupBy("repo", "ecosystem", "name").agg(F.min("source").alias("source"))
    trust = context.groupBy(F.col("library").alias("name")).agg(F.max("trust_level").alias("trust_level"))
    return one.join(trust, "name", "left")


def registry_sync(imports: DataFrame, declared: DataFrame, local: DataFrame, dev: DataFrame, packs: DataFrame, registry: DataFrame) -> DataFrame:
    """(repo, ecosystem, library, outcome) for third-party names without a pack: pulled or missing.

    A repository's declared names replace its imports in the same ecosystem. registry: (ecosystem, library).
    """
    cols = ["repo", "ecosystem", "name"]
    only_imports = imports.select(*cols).join(declared.select("repo", "ecosystem").distinct(), ["repo", "ecosystem"], "left_anti")
    names = only_imports.unionByName(declared.select(*cols)).distinct()
    third = classify_dependencies(names, local, declared, dev).where("kind IN ('UNKNOWN_THIRD_PARTY', 'DECLARED_THIRD_PARTY')")
    found = candidate_names(third, declared).select("repo", "ecosystem", F.lower("candidate").alias("name")).distinct()
    known = registry.select("ecosystem", F.lower("library").alias("name"), F.lit(True).alias("_hit")).distinct()
    return without_pack(found, packs).join(known, ["ecosystem", "name"], "left").select(
        "repo", "ecosystem", F.col("name").alias("library"), F.when(F.col("_hit"), "pulled").otherwise("missing").alias("outcome"))
