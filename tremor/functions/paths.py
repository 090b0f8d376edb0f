"""URL path and route-expression normalisation as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremor.functions import columns as X


def _split_url(raw: Column) -> tuple[Column, Column]:
    """(path, query) of an absolute or relative URL; only absolute URLs lose host and fragment."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    absolute = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    bare = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#[\\s\\S]*$", "")
    local = F.when(absolute, F.when((bare == "") | bare.startswith("?"), F.concat(F.lit("/"), bare)).otherwise(bare)).otherwise(text)
    return F.substring_index(local, "?", 1), F.when(F.contains(local, F.lit("?")), F.regexp_replace(local, r"^[^?]*\?", "")).otherwise("")


def canonical_path(raw: Column | str) -> Column:
    """``/a/{param}``: no host, query, double or trailing slash; every parameter style becomes {param}."""
    path, _ = _split_url(X.col(raw))
    p = F.trim(path)
    p = F.regexp_replace(F.concat(F.lit("/"), p), "/{2,}", "/")
    for style in (r"\$\{[^}/]+\}", "<[^>/]+>", r"(?<=/):[^/?#]+", r"\{[^}/]+\}"):
        p = F.regexp_replace(p, style, "{param}")
    p = F.when(p != "/", F.rtrim(p, F.lit("/"))).otherwise(p)
    return F.when(F.trim(F.coalesce(X.col(raw), F.lit(""))) == "", "").otherwise(p)


def canonical_query(raw: Column | str) -> Column:
    """Query parameters sorted by name and value."""
    _, query = _split_url(X.col(raw))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(
        F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    quote = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: F.concat(quote(s["k"]), F.lit("="), quote(s["v"]))), "&")


def dynamic_segments(path: Column | str) -> Column:
    return F.size(F.filter(F.split(X.col(path), "/"), lambda s: s == "{param}"))


def join_paths(*parts: Column) -> Column:
    """Parts glued with single slashes; empty and root parts vanish."""
    tokens = F.filter(F.array(*[F.btrim(F.coalesce(p, F.lit("")), F.lit("/")) for p in parts]), lambda t: t != "")
    return F.concat(F.lit("/"), F.array_join(tokens, "/"))


def _unquote(text: Column) -> Column:
    """Drop up to three layers of matching quotes around the text."""
    out = F.trim(text)
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, r"""^(["'`])([\s\S]*)\1$""", "$2"))
    return out


def _clean_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.btrim(F.trim(name), F.lit("{}$()[] ")), "[^A-Za-z0-9_]+", "_"), F.lit("_"))


def route_expression(raw: Column | str) -> Column:
    """struct(path, names, confidence) of a route literal, template or concatenation."""
    text = F.substring_index(_unquote(X.col(raw)), "?", 1)
    glued = F.contains(text, F.lit("+"))

    def piece(part: Column) -> Column:
        quoted = part.rlike(r"""^(["'`])[\s\S]*\1$""")
        encoded = F.regexp_extract(part, r"^encodeURIComponent\(([^)]+)\)", 1)
        name = F.when(encoded != "", F.trim(encoded)).when(part.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), part).otherwise(
            F.coalesce(F.nullif(_clean_name(part), F.lit("")), F.lit("expr")))
        return F.when(quoted, F.struct(_unquote(part).alias("text"), F.lit(None).cast("string").alias("name"))).otherwise(
            F.struct(F.lit("{param}").alias("text"), name.alias("name")))

    parts = F.transform(F.filter(F.transform(F.split(text, r"\+"), lambda p: F.trim(p)), lambda p: p != ""), piece)
    joined = F.when(glued, F.array_join(F.transform(parts, lambda s: s["text"]), "")).otherwise(text)
    names = [F.when(glued, F.filter(F.transform(parts, lambda s: s["name"]), lambda n: n.isNotNull())).otherwise(X.no_strings())]
    confidence = (F.when(glued, 0.65).when(F.contains(text, F.lit("${")), 0.85).when(text.rlike("[{:<]") | text.startswith("/"), 0.95).otherwise(0.30))
    path = joined
    for pattern, replacement in ((r"\$\{\s*([^}]+?)\s*\}", "{param}"), (r"\{\s*([^}/]+?)\s*\}", "{param}"),
                                 (r"/<\s*([^>/]+?)\s*>", "/{param}"), (r"/:([A-Za-z_][A-Za-z0-9_]*)", "/{param}")):
        found = F.regexp_extract_all(path, F.lit(pattern), F.lit(1))
        if pattern.startswith(r"\{"):
            found = F.filter(found, lambda n: n != "param")
        names.append(found)
        path = F.regexp_replace(path, pattern, replacement)
    path = F.regexp_replace(X.slashes(path), "/{2,}", "/")
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.rtrim(path, F.lit("/"))).otherwise(path)
    path = F.when(path == "", "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    clean = F.array_distinct(F.filter(F.transform(F.concat(*names), _clean_name), lambda n: n != ""))
    confidence = F.when(F.trim(X.col(raw)) == "", 0.30).when(path == "/", F.least(confidence, F.lit(0.80))).otherwise(confidence)
    return F.struct(path.alias("path"), clean.alias("names"), confidence.alias("confidence"))


def endpoint_parts(parts: Column | str) -> Column:
    """Path of an ordered list of struct(kind, text): literals are kept, anything else is a parameter.

    Null when the result is not rooted at a slash.
    """
    def add(acc, part):
        hole = F.when((acc != "") & ~acc.endswith("/"), "/{param}").otherwise("{param}")
        literal = F.regexp_replace(part["text"], r"\$\{[^}]+\}", "{param}")
        return F.concat(acc, F.when(part["kind"] == "literal", literal).otherwise(hole))

    joined = F.aggregate(X.col(parts), F.lit(""), add)
    path = F.regexp_replace(F.regexp_replace(joined, r"\?[\s\S]*$", ""), "/{2,}", "/")
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(joined.startswith("/"), path)
