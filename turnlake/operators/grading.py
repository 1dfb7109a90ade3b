"""Grading of recorded outputs, verdicts and pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.text import rtrim_unicode, trim_unicode

# Verdict statuses and how much of an error is shown.
ERROR_LINES = 3
ERROR_CHARS = 200


def _tokens(x: Column) -> Column:
    t = trim_unicode(x)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def grade_outputs(df: DataFrame) -> DataFrame:
    """Add ``passed`` to rows of ``actual, expected, tolerance``.

    Without a tolerance the outputs must be equal up to trailing white space.
    With one they must have the same number of tokens, each equal or - when
    both are numbers - no further apart than the tolerance.
    """
    exact = rtrim_unicode("actual") == rtrim_unicode("expected")
    a, e = _tokens(F.col("actual")), _tokens(F.col("expected"))
    apart = lambda x, y: F.abs(x.try_cast("double") - y.try_cast("double"))
    near = lambda x, y: (x == y) | F.coalesce(apart(x, y) <= F.col("tolerance"), F.lit(False))
    close = (F.size(a) == F.size(e)) & F.forall(F.zip_with(a, e, near), lambda ok: F.coalesce(ok, F.lit(False)))
    return df.withColumn("passed", F.when(F.col("tolerance").isNull(), exact).otherwise(close))


def output_detail(df: DataFrame) -> DataFrame:
    """Add ``detail``: byte lengths only, never the expected text."""
    size = lambda c: F.octet_length(rtrim_unicode(c)).cast("string")
    text = F.concat(F.lit("expected "), size("expected"), F.lit(" byte(s) of output, got "), size("actual"))
    return df.withColumn("detail", F.when(~F.col("passed"), text))


def error_head(stderr: str | Column, stdout: str | Column) -> Column:
    """The first lines of an error on one line, shortened."""
    err = F.col(stderr) if isinstance(stderr, str) else stderr
    out = F.col(stdout) if isinstance(stdout, str) else stdout
    source = F.when(trim_unicode(err) == "", out).otherwise(err)
    lines = F.split(F.regexp_replace(F.regexp_replace(source, r"\n\z", ""), r"\r(?=\n|\z)", ""), "\n")
    head = F.array_join(F.slice(lines, 1, ERROR_LINES), " / ")
    return F.when(F.length(head) <= ERROR_CHARS, head).otherwise(
        F.concat(F.substring(head, 1, ERROR_CHARS), F.lit("…"))
    )


def normalize_verdicts(cases: DataFrame) -> DataFrame:
    """Map case verdicts onto passed / failed / errored, with a detail.

    Anything that is not a definite pass or fail is an error; a missing verdict
    says so when it carries no message.
    """
    status = F.when(F.col("status").isin("passed", "failed"), F.col("status")).otherwise("errored")
    detail = F.coalesce("message", F.when(F.col("status") == "missing", F.lit("no verdict returned")))
    return cases.withColumn("detail", detail).withColumn("status", F.coalesce(status, F.lit("errored")))


def pass_rate(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Passed and total cases per key; all passed needs at least one case."""
    per = cases.groupBy(*keys).agg(
        F.count_if(F.col("status") == "passed").alias("passed"), F.count("status").alias("total")
    )
    return per.withColumns(
        {
            "ratio": F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)),
            "all_passed": (F.col("passed") == F.col("total")) & (F.col("total") > 0),
        }
    )


def first_case_file(files: DataFrame, keys: list[str], folder: str = "tests/public/") -> DataFrame:
    """The public test file of a workspace: ``cases.json``, else the first name."""
    name = F.substring_index("path", "/", -1)
    there = files.where((F.col("path") == F.concat(F.lit(folder), name)) & name.endswith(".json"))
    rank = F.struct((name != "cases.json").alias("other"), name.alias("name"))
    return there.groupBy(*keys).agg(F.min_by("path", rank).alias("case_file"))
