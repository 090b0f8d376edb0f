"""Rule packs applied as joins, and the registry tables that manage them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor import constants as C
from tremor.functions import columns as X

# Trust levels, their confidence caps and the levels not used in analysis.
TRUST_LEVELS = ("draft", "staged", "experimental", "verified_on_fixture", "verified_on_real_project", "trusted")
TRUST_CAPS = {"experimental": 0.65, "verified_on_fixture": 0.80, "verified_on_real_project": 0.90, "trusted": 0.95}
INACTIVE_TRUST = ("draft", "staged")
PACK_SOURCES = ("project", "shared", "registry", "cache")
DEFAULT_CONFIDENCE = {"decorator_entrypoint": 0.90, "task_entrypoint": 0.80, "constructor_injection": 0.85, "method_call_alias": 0.80,
                      "framework_route": 0.85, "test_target_pattern": 0.95}


def trust(status: str = "status", level: str = "trust_level") -> Column:
    v = F.trim(F.coalesce(F.nullif(F.col(level), F.lit("")), F.col(status), F.lit("")))
    return F.when(v == "verified", "verified_on_real_project").when(v == "official", "trusted").when(v == "", "experimental").otherwise(v)


def active_rules(rules: DataFrame) -> DataFrame:
    """Rules of packs in use, with normalised trust and capped confidence. Needs status, trust_level, emit_confidence."""
    out = rules.withColumn("trust_level", trust()).where(~F.col("trust_level").isin(*INACTIVE_TRUST))
    cap = X.lookup("trust_level", TRUST_CAPS)
    return out.withColumns({"confidence_cap": cap, "emit_confidence": F.least("emit_confidence", cap)})


def pick_packs(packs: DataFrame) -> DataFrame:
    """The pack of the nearest source per (language, library). packs: (pack, language, library, origin)."""
    rank = X.lookup("origin", {s: i for i, s in enumerate(PACK_SOURCES)}, len(PACK_SOURCES))
    rest = [c for c in packs.columns if c not in ("language", "library")]
    best = packs.groupBy(F.lower("language").alias("language"), F.lower("library").alias("library")).agg(F.min_by(F.struct(*rest), F.struct(rank, "pack")).alias("p"))
    return best.select("language", "library", "p.*")


def rule_scope(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """Add the ``rule_language`` and ``module`` a rule is limited by. modules: (scope, module, file)."""
    lang = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "go": "go", "java": "java"}
    out = nodes.join(modules.select("scope", "module", F.col("file").alias("_mf")), "scope", "left")
    return out.withColumn("rule_language", X.lookup(F.lower(X.last_part(F.coalesce("file", "_mf", F.lit("")), r"\.")), lang, "")).drop("_mf")


def _confidence(rule_type: str) -> Column:
    return F.coalesce("emit_confidence", F.lit(DEFAULT_CONFIDENCE[rule_type]))


def _emit(hits: DataFrame, from_id: Column, to_id: Column, kind: str, rule_type: str) -> DataFrame:
    """Edges of matched rules, with provenance, each (library, rule, from, to) once."""
    out = hits.select(from_id.alias("from_id"), to_id.alias("to_id"), F.coalesce("emit_kind", F.lit(kind)).alias("kind"), F.lit("SUPPORT_PACK").alias("source"),
                      _confidence(rule_type).alias("confidence"), "library", "rule_id", "trust_level", F.lit(rule_type).alias("resolver_hook"))
    return out.dropDuplicates(["library", "rule_id", "from_id", "to_id"])


def _scope() -> Column:
    return F.coalesce(F.nullif("scope", F.lit("")), "id")


def _decorated(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes whose decorator begins with a rule's pattern, first matching decorator per (node, rule).

    Decorators are cut to the lengths of the patterns, which are rules a person writes, and joined by
    equality.
    """
    wanted = rules.withColumn("_p", F.regexp_replace("match_decorator", "^@+", "")).where("_p <> ''")
    lengths = sorted(r[0] for r in wanted.select(F.length("_p")).distinct().collect())
    if not lengths:
        return nodes.join(wanted, F.lit(False))
    heads = F.array(*[F.when(F.length("_d") >= n, F.substr("_d", F.lit(1), F.lit(n))) for n in lengths])
    dec = nodes.select("*", F.posexplode("decorators").alias("_pos", "_dec")).withColumn("_d", F.regexp_replace("_dec", "^@+", ""))
    hit = dec.withColumn("_p", F.explode(F.array_compact(heads))).join(wanted, "_p")
    first = hit.groupBy("id", "library", "rule_id").agg(F.min_by(F.struct(*[c for c in hit.columns if c not in ("id", "library", "rule_id")]), "_pos").alias("h"))
    return first.select("id", "library", "rule_id", "h.*")


def rule_decorator(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Entry points: the path inside the decorator names the route, the node's scope is its handler."""
    hits = _decorated(nodes, rules.where("rule_type = 'decorator_entrypoint'"))
    path = F.regexp_extract("_dec", r"""\((["'])(.*?)\1\)""", 2)
    return _emit(hits, F.replace(F.coalesce("emit_from", F.lit("HTTP GET {path}")), F.lit("{path}"), path),
                 F.replace(F.coalesce("emit_to", F.lit("{scope}")), F.lit("{scope}"), _scope()), "CALLS", "decorator_entrypoint")


def rule_task(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    hits = _decorated(nodes, rules.where("rule_type = 'task_entrypoint'"))
    default = F.concat(F.lit("external:"), "library", F.lit(".task:{scope}"))
    return _emit(hits, _scope(), F.replace(F.coalesce("emit_to", default), F.lit("{scope}"), _scope()), "DEPENDS_ON", "task_entrypoint")


def rule_injection(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes with a parameter or receiver of the rule's type."""
    types = F.array_distinct(F.array_compact(F.array_append(F.coalesce(F.map_values("param_types"), X.no_strings()), F.col("receiver_type"))))
    typed = nodes.withColumn("match_parameter_type", F.explode(types))
    hits = typed.join(rules.where("rule_type = 'constructor_injection'"), "match_parameter_type")
    return _emit(hits, _scope(), F.coalesce("emit_to", "match_parameter_type"), "CALLS", "constructor_injection")


def _imports_library(hits: DataFrame, imports: DataFrame, exact: bool = False) -> DataFrame:
    """Keep hits whose rule names no library or whose module imports it (or, unless exact, something below it)."""
    free = hits.where("match_imported_library IS NULL")
    parts = F.split("imported", r"\.")
    below = F.array("imported") if exact else F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    has = imports.select("module", F.explode(below).alias("match_imported_library")).distinct()
    return free.unionByName(hits.where("match_imported_library IS NOT NULL").join(has, ["module", "match_imported_library"], "left_semi").select(*free.columns))


def rule_method_alias(nodes: DataFrame, rules: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls of a named method, optionally on a receiver, receiver type and imported library."""
    calls = nodes.where("kind = 'CALL_EXPR'").withColumn("_m", F.coalesce("method_name", X.last_part("call_name", r"\.")))
    wanted = rules.where("rule_type = 'method_call_alias'").withColumn("_m", F.explode("match_methods"))
    hits = calls.join(wanted, "_m")
    same = lambda rule, node: F.col(rule).isNull() | (F.col(rule) == F.col(node))
    hits = _imports_library(hits.where(same("match_receiver", "receiver") & same("match_receiver_type", "receiver_type")), imports)
    return _emit(hits, _scope(), F.coalesce("emit_to", F.concat(F.lit("external:"), "library", F.lit("."), "_m")), "CALLS", "method_call_alias")


def rule_framework_route(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    hits = nodes.where("kind = 'CALL_EXPR'").join(rules.where("rule_type = 'framework_route'").withColumnRenamed("match_call_name", "call_name"), "call_name")
    return _emit(hits, _scope(), F.col("emit_to"), "DEPENDS_ON", "framework_route")


def rule_test_target(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Test classes to the class their name points at.

    The rules' patterns travel as one row that holds them all; a table of rules is small beside the nodes.
    """
    wanted = rules.where("rule_type = 'test_target_pattern'")
    held = wanted.groupBy().agg(F.collect_list(F.struct("library", "rule_id", "match_test_class_name")).alias("_rules"))
    classes = nodes.where("kind = 'CLASS'").select("id", "name").join(held)
    fits = F.filter("_rules", lambda r: F.regexp_like(F.col("name"), F.concat(F.lit("^(?:"), r["match_test_class_name"], F.lit(")"))))
    hits = classes.select("id", "name", F.explode(fits).alias("m")).select("id", "name", "m.library", "m.rule_id").join(rules, ["library", "rule_id"])
    target = F.coalesce("emit_to", F.replace(F.replace("name", F.lit("Test"), F.lit("")), F.lit("test_"), F.lit("")))
    known = nodes.select(F.explode(F.array("id", "name")).alias("_t"), F.col("id").alias("_tid")).groupBy("_t").agg(F.min("_tid").alias("_tid"))
    return _emit(hits.withColumn("_t", target).join(known, "_t"), F.col("id"), F.col("_tid"), "TESTS", "test_target_pattern")


STANDARD_FIELDS = ("kind", "call_name", "receiver", "receiver_type", "method_name")


def rule_standard(nodes: DataFrame, rules: DataFrame, imports: DataFrame) -> DataFrame:
    """Rules whose given fields must all match. Rules that use the same fields share one equality join."""
    wanted = rules.where("rule_type = 'standard'").withColumn("_mask", F.concat(*[F.when(F.col(f"match_{f}").isNotNull(), "1").otherwise("0") for f in STANDARD_FIELDS]))
    masks = sorted(r[0] for r in wanted.select("_mask").distinct().collect())
    if not masks:
        none = {c: F.lit(None).cast(t) for c, t in (("id", "string"), ("scope", "string"))}
        out = wanted.withColumns(none).select("id", "scope", "library", "rule_id", "trust_level", "emit_to", "emit_kind", "emit_confidence")
    for k, mask in enumerate(masks):
        used = [f for f, bit in zip(STANDARD_FIELDS, mask) if bit == "1"]
        group = wanted.where(F.col("_mask") == mask).drop(*[f"match_{f}" for f in STANDARD_FIELDS if f not in used]).withColumnsRenamed({f"match_{f}": f for f in used})
        if not used:
            raise ValueError("a standard rule needs at least one match field")
        hits = _imports_library(nodes.join(group, used), imports, exact=True).select("id", "scope", "library", "rule_id", "trust_level", "emit_to", "emit_kind", "emit_confidence")
        out = out.unionByName(hits) if k else hits
    done = out.select(_scope().alias("from_id"), F.col("emit_to").alias("to_id"), F.col("emit_kind").alias("kind"), F.lit("SUPPORT_PACK").alias("source"),
                      F.coalesce("emit_confidence", F.lit(0.8)).alias("confidence"), "library", "rule_id", "trust_level", F.lit("standard").alias("resolver_hook"))
    return done.dropDuplicates(["library", "rule_id", "from_id", "to_id", "kind"])


def annotate_rule_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with capped confidence and provenance, edges without an endpoint)."""
    blank = (F.trim(F.coalesce("from_id", F.lit(""))) == "") | (F.trim(F.coalesce("to_id", F.lit(""))) == "")
    capped = edges.withColumns({
        "confidence": F.least("confidence", X.lookup("trust_level", TRUST_CAPS)),
        "provenance": F.struct("library", "rule_id", "trust_level", "resolver_hook")})
    return capped.where(~blank), capped.where(blank).select("library", "rule_id", "from_id", "to_id", F.lit("missing_endpoint").alias("reason"))


STRONG_KEYS = ("decorator", "receiver", "receiver_type", "imported_library", "parameter_type", "call_name", "test_class_name")


def validate_rules(rules: DataFrame) -> DataFrame:
    """(library, rule_id, error). rules: (library, rule_id, rule_type, match map, emit_to, emit_kind, emit_confidence)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    errors = X.present([
        (blank("rule_id"), "Missing rule id"),
        (F.coalesce(F.size("match"), F.lit(0)) < 1, "Missing 'match' configuration"),
        (blank("emit_to") & ~F.col("rule_type").isin("decorator_entrypoint", "task_entrypoint", "constructor_injection", "method_call_alias", "test_target_pattern"), "Emit missing 'to' field"),
        (blank("emit_kind"), "Emit missing 'kind' field"),
        (~blank("emit_kind") & ~F.col("emit_kind").isin(*C.EDGE_KINDS), "Unknown edge kind"),
        ((F.col("emit_confidence") < 0) | (F.col("emit_confidence") > 1), "Confidence outside [0, 1]"),
    ])
    return rules.select("library", "rule_id", F.explode(errors).alias("error"))


def validate_project_rules(rules: DataFrame) -> DataFrame:
    """(library, rule_id, error): project rules need a strong match key, no name-only match, and are never trusted."""
    keys = F.coalesce(F.map_keys("match"), X.no_strings())
    strong = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in STRONG_KEYS]))
    errors = X.present([(~strong, "rule needs a strong match key"), (F.col("trust_level") == "trusted", "project rules cannot be trusted")])
    return rules.select("library", "rule_id", F.explode(errors).alias("error"))


# --- registry ----------------------------------------------------------------------------------

def registry_upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], replace: list[str]) -> DataFrame:
    """Merge rows by key: ``keep`` columns stay unless the new value is given, ``replace`` columns always follow the new row."""
    tag = lambda df, p: df.select(*keys, F.struct(*keep, *replace).alias(p))
    both = tag(old, "o").join(tag(new, "n"), keys, "full_outer")
    here = F.col("n").isNotNull()
    return both.select(*keys, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep],
                       *[F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in replace])


def registry_latest(versions: DataFrame) -> DataFrame:
    """Newest active version per pack. versions: (pack_key, version, trust_level, status, created_at)."""
    rest = [c for c in versions.columns if c != "pack_key"]
    best = versions.where("status = 'active'").groupBy("pack_key").agg(F.max_by(F.struct(*rest), F.struct("created_at", "version")).alias("v"))
    return best.select("pack_key", "v.*")


def registry_overview(libraries: DataFrame, versions: DataFrame, requests: DataFrame, docs: DataFrame) -> DataFrame:
    active = F.col("status") == "active"
    v = versions.agg(F.count_if(active & (F.col("trust_level") == "trusted")).alias("trusted_packs_count"),
                     F.count_if(active & (F.col("trust_level") == "experimental")).alias("experimental_packs_count"))
    return (libraries.agg(F.count(F.lit(1)).alias("libraries_count")).join(v, F.lit(True))
            .join(requests.agg(F.count_if(F.col("status").isin("queued", "researching")).alias("pending_research_count")), F.lit(True))
            .join(docs.agg(F.count_if(F.col("last_changed_at").isNotNull()).alias("revalidation_candidates_count")), F.lit(True)))


def registry_transition(versions: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply trust changes. moves: (pack_id, trust_level, reviewer)."""
    m = moves.select("pack_id", F.col("trust_level").alias("_t"), F.col("reviewer").alias("approved_by"))
    return versions.join(m, "pack_id", "left").withColumn("trust_level", F.coalesce("_t", "trust_level")).drop("_t")


def doc_changes(known: DataFrame, checked: DataFrame) -> DataFrame:
    """Outcome of checking documentation pages: new, changed or same. known: (url, content_hash, last_changed_at); checked: (url, content_hash, checked_at)."""
    old = known.select("url", F.col("content_hash").alias("_old"), F.col("last_changed_at").alias("_when"))
    out = checked.join(old, "url", "left")
    changed = F.col("_old").isNotNull() & (F.col("_old") != F.col("content_hash"))
    return out.select("url", "content_hash", F.when(F.col("_old").isNull(), "new").when(changed, "changed").otherwise("same").alias("outcome"),
                      F.when(changed, F.col("checked_at")).otherwise(F.col("_when")).alias("last_changed_at"))


def revalidation_list(docs: DataFrame) -> DataFrame:
    return docs.where("last_changed_at IS NOT NULL").orderBy(F.desc("last_changed_at"), "url")


def registry_search(libraries: DataFrame, ecosystem: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    out = libraries
    if ecosystem:
        out = out.where(F.col("ecosystem") == ecosystem.lower())
    if status:
        out = out.where(F.col("status") == status)
    if text:
        out = out.where(F.contains(F.lower("name"), F.lit(text.lower())))
    return out
