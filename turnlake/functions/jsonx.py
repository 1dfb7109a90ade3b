"""Typed, lenient access to VARIANT documents.

Logs drift, so a field only counts when it has the expected JSON type: a
quoted number is not a number, a number is not text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _typed(doc: Column, path: str, json_type: str, sql_type: str) -> Column:
    return F.when(F.schema_of_variant(field(doc, path)) == json_type, F.try_variant_get(doc, path, sql_type))


def text(doc: Column, path: str) -> Column:
    return _typed(doc, path, "STRING", "string")


def integer(doc: Column, path: str) -> Column:
    return _typed(doc, path, "BIGINT", "bigint")


def count(doc: Column, path: str) -> Column:
    """A non-negative integer, else NULL."""
    n = integer(doc, path)
    return F.when(n >= 0, n)


def is_true(doc: Column, path: str) -> Column:
    return F.coalesce(_typed(doc, path, "BOOLEAN", "boolean"), F.lit(False))


def items(doc: Column, path: str) -> Column:
    """The elements of an array, NULL when the field is not one."""
    return F.try_variant_get(doc, path, "array<variant>")


def present(doc: Column, path: str) -> Column:
    """The key exists (a JSON null counts)."""
    return field(doc, path).isNotNull()


def first_text(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[text(doc, p) for p in paths])


def first_integer(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[integer(doc, p) for p in paths])


def content_chars(doc: Column, keys: list[str], stop_kind: str | None = None) -> Column:
    """Characters of all strings reachable through ``keys``, arrays and bare
    strings, at any depth.

    A breadth-first walk: each step measures the strings of the frontier and
    replaces it by its children.  With ``stop_kind`` the objects whose ``kind``
    equals it are not entered (their text belongs to another bucket).
    """
    zero = F.lit(0).cast("bigint")
    nothing = F.filter(F.array(doc), lambda x: x.isNull() & x.isNotNull())

    def size(x: Column) -> Column:
        is_text = F.schema_of_variant(x) == "STRING"
        return F.coalesce(F.when(is_text, F.length(F.try_variant_get(x, "$", "string"))), F.lit(0)).cast("bigint")

    def children(x: Column) -> Column:
        found = F.concat(
            F.coalesce(F.try_variant_get(x, "$", "array<variant>"), nothing),
            F.array(*[field(x, f"$.{key}") for key in keys]),
        )
        found = F.filter(found, lambda y: y.isNotNull())
        if stop_kind is not None:
            found = F.when(F.coalesce(text(x, "$.kind"), F.lit("")) == stop_kind, nothing).otherwise(found)
        return found

    def step(acc: Column, _: Column) -> Column:
        frontier = acc.getField("frontier")
        return F.struct(
            F.flatten(F.transform(frontier, children)).alias("frontier"),
            (acc.getField("total") + F.aggregate(frontier, zero, lambda n, x: n + size(x))).alias("total"),
        )

    openers = F.length(F.regexp_replace(F.to_json(doc), r"[^\[{]", ""))
    levels = F.sequence(F.lit(0), openers)
    start = F.struct(F.filter(F.array(doc), lambda x: x.isNotNull()).alias("frontier"), zero.alias("total"))
    walked = F.aggregate(levels, start, step, lambda acc: acc.getField("total"))
    return F.when(doc.isNotNull(), F.coalesce(walked, zero)).otherwise(zero)
