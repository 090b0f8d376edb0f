"""Fixed values of the data model: vocabularies, priorities, thresholds and caps."""

# The closed vocabularies of the graph model.
NODE_KINDS = (
    "PROJECT", "FILE", "MODULE", "CLASS", "FUNCTION", "METHOD", "PARAMETER", "ATTRIBUTE",
    "CALL_EXPR", "ASSIGNMENT", "ROUTE", "TEST", "EXTERNAL_LIBRARY", "SUPPORT_PACK",
)
EDGE_KINDS = (
    "CONTAINS", "IMPORTS", "DECLARES", "ASSIGNS", "READS", "WRITES", "CREATES", "INSTANCE_OF",
    "PARAM_BINDS_TO", "FIELD_BINDS_TO", "RESOLVES_TO", "CALLS", "MAY_CALL", "DEPENDS_ON",
    "ROUTE_HANDLES", "HTTP_CALLS", "MATCHES_ENDPOINT", "TESTS", "AFFECTS",
    "PROVIDED_BY_SUPPORT_PACK", "USES_COMPONENT",
)
EDGE_SOURCES = (
    "EXTRACTED", "INFERRED", "RUNTIME_CONFIRMED", "EXTERNAL_TOOL", "SUPPORT_PACK",
    "AI_PROPOSED", "MANUAL",
)

# Which provenance wins when one edge is observed twice.
SOURCE_PRIORITY = {
    "RUNTIME_CONFIRMED": 60, "INFERRED": 50, "SUPPORT_PACK": 40, "EXTRACTED": 30,
    "EXTERNAL_TOOL": 20, "MANUAL": 10, "AI_PROPOSED": 5,
}

# Edge quality ranks, thresholds and the warning words that make an edge suspicious.
QUALITY_NAMES = ("rejected", "suspicious", "weak", "likely", "confirmed")
QUALITY_THRESHOLDS = (("confirmed", 0.84), ("likely", 0.70), ("weak", 0.55))
ACTIVE_QUALITIES = ("confirmed", "likely", "weak")
BUCKETS = ("confirmed", "likely", "weak", "suspicious", "rejected", "not_resolved")
SUSPICIOUS_MARKERS = (
    "method mismatch", "prefix differs", "suffix", "ambiguous", "unresolved", "name similarity",
    "missing receiver", "route/module mismatch", "dangling", "missing endpoint",
)

# Provenance class per edge source.
EVIDENCE_CLASS = {
    "EXTRACTED": "static_proven", "INFERRED": "static_inferred", "SUPPORT_PACK": "support_pack_rule",
    "EXTERNAL_TOOL": "external_observation", "RUNTIME_CONFIRMED": "static_inferred",
    "AI_PROPOSED": "ai_proposed", "MANUAL": "manual",
}

# Scoring model.
DECAY = 0.85
DEFAULT_CRITICALITY = 1.0
CRITICALITY_BY_KIND = {
    "ROUTE": 1.40, "HTTP_ROUTE": 1.40, "CLASS": 1.20, "METHOD": 1.10, "FUNCTION": 1.00,
    "TEST": 0.70, "EXTERNAL_LIBRARY": 0.80,
}
CHAIN_THRESHOLDS = (("confirmed", 0.90), ("high_probability", 0.75), ("needs_review", 0.55))
CHAIN_LABELS = {
    "en": {"confirmed": "confirmed", "high_probability": "high_probability",
           "needs_review": "needs_review", "ambiguous": "ambiguous"},
    "ru": {"confirmed": "Подтверждена", "high_probability": "Высокая вероятность",
           "needs_review": "Требует проверки", "ambiguous": "Неоднозначна"},
}

# Language of a file by its suffix, as used for facts and identities.
FACT_LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "go": "go", "java": "java",
}
