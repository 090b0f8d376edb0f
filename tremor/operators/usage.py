"""Texts that show how a library is used, and the readable text of web pages."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.textjoin import contains_join

# Tags whose content is not text.
SILENT_TAGS = ("script", "style", "head", "meta", "link", "noscript")


def usage_examples(files: DataFrame, libraries: DataFrame, key: str = "path", limit: int | None = None, max_line: int | None = None) -> DataFrame:
    """The lines that name a library. libraries: (library).

    ``limit`` keeps the first of each library and ``max_line`` drops lines of so many characters or more; both are
    off unless given. The rank filter is applied before the shuffle too, so a popular library sends few rows.
    """
    lines = files.select(key, F.posexplode(F.split("content", "\r\n|\n|\r")).alias("pos", "line"))
    if max_line is not None:
        lines = lines.where(F.length("line") < max_line)
    hits = contains_join(lines, "line", libraries, "library").select("library", key, "pos", F.trim("line").alias("line"))
    if limit is None:
        return hits
    w = Window.partitionBy("library").orderBy(key, "pos")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def page_text(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Visible text of each page, trimmed pieces joined by spaces; its first ``limit`` characters if that is given.

    A silent tag mutes everything up to the next closing silent tag, whichever it is.
    """
    names = "|".join(SILENT_TAGS)
    body = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, rf"(?is)<({names})\b[^>]*>.*?(</({names})\s*>|$)", "\u0001")
    body = F.regexp_replace(body, r"(?s)<[A-Za-z/!][^>]*>", "\u0001")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    pieces = F.filter(F.transform(F.split(body, "\u0001"), lambda s: F.regexp_replace(s, r"^[\s ]+|[\s ]+$", "")), lambda s: s != "")
    text = F.array_join(pieces, " ")
    return pages.withColumn("text", text if limit is None else F.substr(text, F.lit(1), F.lit(limit))).drop("html")
