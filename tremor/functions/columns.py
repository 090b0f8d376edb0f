"""Column expressions shared by the operators. All run inside Catalyst."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremor import constants as C


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(value: Column | str, table: dict, default=None) -> Column:
    """Constant map as a map literal; unknown keys give ``default``."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    hit = F.element_at(F.create_map(*entries), col(value))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def canonical_order(prefix: str = "") -> Column:
    """One sortable string per edge: (from, to, kind, source, rule, id).

    The separator sorts below every printable character, so string order is tuple order.
    """
    parts = ["from_id", "to_id", "kind", "source", "rule_id", "id"]
    return F.concat_ws("\u0001", *[F.coalesce(F.col(prefix + p), F.lit("")) for p in parts])


def slashes(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def strip_dot_slash(path: Column | str) -> Column:
    """Forward slashes, leading ``.`` and ``/`` characters removed."""
    return F.regexp_replace(slashes(path), r"^[./]+", "")


def last_part(path: Column | str, sep: str = "/") -> Column:
    return F.element_at(F.split(col(path), sep, -1), -1)


def suffix_language(path: Column | str) -> Column:
    p = F.coalesce(col(path), F.lit(""))
    suffix = F.when(F.contains(p, F.lit(".")), F.lower(F.element_at(F.split(p, r"\."), -1)))
    return lookup(F.coalesce(suffix, F.lit("")), C.FACT_LANGUAGES, "unknown")


def any_contains(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def labels_when(pairs: list[tuple[Column, Column | str]], otherwise=None) -> Column:
    """First matching condition wins."""
    chain = None
    for cond, value in pairs:
        v = F.lit(value) if not isinstance(value, Column) else value
        chain = F.when(cond, v) if chain is None else chain.when(cond, v)
    return chain if otherwise is None else chain.otherwise(
        otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def present(pairs: list[tuple[Column, str | Column]]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[
        F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in pairs
    ]))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def row_digest(*cols: Column | str) -> Column:
    """md5 of the values joined by a separator; nulls are told apart from empty text."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(col(c).cast("string"), F.lit("\u0002")) for c in cols]))
