"""String, path and time expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_unicode(x: str | Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` only strips blanks)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def rtrim_unicode(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\s+\z", "")


def blank_to_null(x: str | Column) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(trim_unicode(x), F.lit(""))


def rfc3339_ms(x: str | Column) -> Column:
    """Epoch milliseconds of an RFC 3339 string, NULL when it is not one."""
    return F.when(_c(x).rlike(RFC3339), F.unix_millis(F.try_to_timestamp(_c(x))))


def comparable_path(x: str | Column, case_insensitive: bool = False) -> Column:
    """Path spelling used for equality: forward slashes, no ``\\\\?\\`` prefix,
    no trailing slash; lower case where the file system ignores case."""
    p = F.replace(_c(x), F.lit("\\"), F.lit("/"))
    p = F.when(p.startswith("//?/UNC/"), F.concat(F.lit("//"), F.substr(p, F.lit(9))))\
        .when(p.startswith("//?/"), F.substr(p, F.lit(5)))\
        .otherwise(p)
    p = F.regexp_replace(p, r"(?<=.)/+$", "")
    return F.lower(p) if case_insensitive else p


def log_folder_name(x: str | Column) -> Column:
    """Per-project log folder of a path: every non-alphanumeric becomes ``-``.
    Distinct paths collide, so this is never a join key."""
    return F.regexp_replace(_c(x), r"[^A-Za-z0-9]", "-")


def relative_path(x: str | Column) -> Column:
    """Forward slashes, without leading ``./`` runs and then ``/`` runs."""
    p = F.replace(_c(x), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(p, r"^(?:\./)+", ""), r"^/+", "")


def percent_decode(x: str | Column) -> Column:
    """Decode every ``%XX``; a percent sign without two digits stays,
    bytes that are not UTF-8 become replacement characters."""
    kept = F.regexp_replace(F.replace(_c(x), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), _c(x))


#: Pieces of a glob: folder wildcards, wildcards, classes, single characters.
_GLOB_PIECES = r"(?s)/\*\*/|/\*\*\z|\*|\?|\[!?\]?[^\]]*\]|."


def glob_to_regex_column(pattern: str | Column) -> Column:
    """Regular expression of a path glob; NULL for a malformed one.

    ``*`` also crosses ``/``, ``**/`` in front matches any leading folders or
    none, a final ``/**`` any non-empty subtree; ``[a-z]``, ``[!a]`` and
    ``{a,b}`` (nested too) are classes and alternatives.  Malformed are unclosed
    classes, braces that do not pair and descending ranges.
    """
    p = _c(pattern)
    leading = p.startswith("**/")
    pieces = F.regexp_extract_all(F.when(leading, F.substr(p, F.lit(4))).otherwise(p), F.lit(_GLOB_PIECES), F.lit(0))
    state = F.struct(F.when(leading, "(?:.*/)?").otherwise("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        is_class = x.startswith("[") & (F.length(x) > 1)
        negated = x.startswith("[!")
        body = F.substr(x, F.when(negated, 3).otherwise(2), F.length(x) - F.when(negated, 3).otherwise(2))
        ranges = F.regexp_extract_all(body, F.lit("(?s)(.)-(.)"), F.lit(1)), F.regexp_extract_all(body, F.lit("(?s)(.)-(.)"), F.lit(2))
        descends = F.exists(F.zip_with(*ranges, lambda low, high: low > high), lambda b: b)
        inner = F.concat(F.when(negated, "[^").otherwise("["), F.regexp_replace(body, r"([\\\[\]^&])", r"\\$1"), F.lit("]"))
        written = (
            F.when(x == "/**/", "(?:/|/.*/)")
            .when(x == "/**", "/.+")
            .when(x == "*", ".*")
            .when(x == "?", ".")
            .when(is_class, inner)
            .when(x == "{", "(?:")
            .when(x == "}", ")")
            .when((x == ",") & (acc["depth"] > 0), "|")
            .otherwise(F.regexp_replace(x, r"([.+^$()|\\\]])", r"\\$1"))
        )
        depth = acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        bad = acc["bad"] | (x == "[") | (depth < 0) | (is_class & ((F.length(body) == 0) | descends))
        return F.struct(F.concat(acc["out"], written).alias("out"), depth.alias("depth"), bad.alias("bad"))

    return F.aggregate(pieces, state, step, lambda acc: F.when(~acc["bad"] & (acc["depth"] == 0), F.concat(F.lit("(?s)^(?:"), acc["out"], F.lit(")$"))))


def file_name(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def file_stem(path: str | Column) -> Column:
    """Final path segment without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def lexical_path(x: str | Column) -> Column:
    """Forward-slash path with ``.`` and ``..`` resolved by text alone."""
    parts = F.split(comparable_path(x), "/")
    start = F.filter(parts, lambda p: p.isNull())
    kept = F.aggregate(
        parts,
        start,
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, p)),
    )
    absolute = F.when(comparable_path(x).startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(absolute, F.array_join(kept, "/"))
