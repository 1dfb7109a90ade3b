"""Secret redaction as a chain of regular-expression columns.

The rules are applied in order to whole texts.  Every rule's replacement differs
from what it matches, so a category fired exactly when its step changed the
text: no second match is needed.  ``(?U)`` gives the Unicode ``\\b`` and ``\\s``
of the catalog's dialect, ``(?d)`` keeps line ends to ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rule catalog and its version.
CATALOG_VERSION = 1
PLACEHOLDER = "[REDACTED:"
PEM_BEGIN = r"-----BEGIN(?: [A-Z0-9]+)* PRIVATE KEY-----"
WHOLE_SPAN_RULES = [
    ("private_key", PEM_BEGIN + r"[\s\S]*?-----END(?: [A-Z0-9]+)* PRIVATE KEY-----"),
    ("provider_key", r"\bsk-ant-[A-Za-z0-9_-]{16,}"),
    ("provider_key", r"\bsk-[A-Za-z0-9_-]{20,}"),
    ("provider_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("provider_key", r"\bAIza[0-9A-Za-z_-]{20,}"),
    ("provider_key", r"\bgithub_pat_[A-Za-z0-9_]{22,}"),
    ("provider_key", r"\bgh[oprsu]_[A-Za-z0-9]{36,}"),
    ("provider_key", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("bearer_token", r"\bBearer\s+[A-Za-z0-9._~+/-]{16,}=*"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
SECRET_KEY = (
    r"[A-Za-z0-9_.\-]{0,40}(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key|client[_-]?secret|database_url)"
)
URL_PASSWORD = r"\b([a-z][a-z0-9+.\-]*://[^\s:@/]*):([^\s:@/]+)@"
ENV_LINE = r"^([ \t]*(?:export[ \t]+)?" + SECRET_KEY + r"[ \t]*=[ \t]*)([A-Za-z0-9_+/=~\-]{12,})[ \t]*$"
ASSIGNMENT_HEAD = r"""(["']?""" + SECRET_KEY + r"""["']?[ \t]*[:=][ \t]*)"""

# What a text must contain for a rule to match at all: literals are found much
# faster than patterns, so most texts skip most patterns.
NEEDS = [
    ("private_key", "-----BEGIN"),
    ("provider_key", "sk-ant-"),
    ("provider_key", "sk-"),
    ("provider_key", "AKIA"),
    ("provider_key", "AIza"),
    ("provider_key", "github_pat_"),
    ("provider_key", "gh"),
    ("provider_key", "xox"),
    ("bearer_token", "Bearer"),
    ("jwt", "eyJ"),
    ("url_credentials", "://"),
]
NEEDS_ASSIGNMENT = "(?iU)" + SECRET_KEY.removeprefix(r"[A-Za-z0-9_.\-]{0,40}") + r"""["']?[ \t]*[:=]"""

# A quoted value that already holds a placeholder is matched and put back; any
# other value is replaced.  A replacement cannot choose its text by branch, so
# the placeholder is appended to the text once and captured by a look-ahead in
# the replacing branches only.
_TAIL = "\u0000" + PLACEHOLDER + "env_secret]"
_CAPTURE = r"(?=[\s\S]*\u0000(\[REDACTED:env_secret\])\z)"
_ASSIGNMENT = (
    "(?iU)"
    + ASSIGNMENT_HEAD
    + r"""(?:("[^"\r\n]*\[REDACTED:[^"\r\n]*"|'[^'\r\n]*\[REDACTED:[^'\r\n]*')"""
    + r"""|(")[^"\r\n]{8,}\""""
    + _CAPTURE
    + r"""|(')[^'\r\n]{8,}'"""
    + _CAPTURE
    + ")"
)
_ASSIGNMENT_TEXT = "$1$2$3$4$3$5$6$5"


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``redacted_text, categories, catalog_version, uncleanable``.

    ``uncleanable`` marks a private key whose end is missing: its extent is
    unknown, so the text must not be published at all (``redacted_text`` NULL).
    """
    source = [F.col(c) for c in df.columns]
    steps = [(cat, "(?U)" + rx, PLACEHOLDER + cat + "]") for cat, rx in WHOLE_SPAN_RULES]
    n_whole = len(steps)
    steps.append(("url_credentials", "(?iU)" + URL_PASSWORD, r"$1:" + PLACEHOLDER + "url_credentials]@"))
    steps.append(("env_secret", "(?imdU)" + ENV_LINE, "$1" + PLACEHOLDER + "env_secret]"))

    out = df.withColumn("_t0", F.col(text_col)).withColumn("_assigns", F.col("_t0").rlike(NEEDS_ASSIGNMENT))
    for i, (_, pattern, replacement) in enumerate(steps):
        # Replacements add no assignment, so one test serves both of its rules.
        may = F.col(f"_t{i}").contains(NEEDS[i][1]) if i < len(NEEDS) else F.col("_assigns")
        step = F.when(may, F.regexp_replace(f"_t{i}", pattern, replacement)).otherwise(F.col(f"_t{i}"))
        out = out.withColumn(f"_t{i + 1}", step)
    n = len(steps)
    marked = F.regexp_replace(F.concat(F.col(f"_t{n}"), F.lit(_TAIL)), _ASSIGNMENT, _ASSIGNMENT_TEXT)
    out = out.withColumn("_marked", F.when(F.col("_assigns"), marked))
    rest = F.expr(f"substring(_marked, 1, length(_marked) - {len(_TAIL)})")
    out = out.withColumn(f"_t{n + 1}", F.when(F.col("_assigns"), rest).otherwise(F.col(f"_t{n}")))
    categories = [c for c, _, _ in steps] + ["env_secret"]
    fired = [F.when(F.col(f"_t{i + 1}") != F.col(f"_t{i}"), F.lit(c)) for i, c in enumerate(categories)]
    uncleanable = F.coalesce(F.col(f"_t{n_whole}").rlike(PEM_BEGIN), F.lit(False))
    done = F.struct(
        *source,
        F.when(~uncleanable, F.col(f"_t{n + 1}")).alias("redacted_text"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*fired)))).alias("categories"),
        F.lit(CATALOG_VERSION).alias("catalog_version"),
        uncleanable.alias("uncleanable"),
    )
    # A caller's filter must stay above: pushed down, it would unfold the whole
    # chain of steps into one expression.
    return out.select(F.inline(F.array(done)))


def redact_bundles(files: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Redact the text files of bundles; ``files``: keys, ``path, content``.

    Returns the cleaned files and one summary row per bundle.  Files that are
    not UTF-8 pass through; one uncleanable file rejects its whole bundle, so
    rejected bundles have a summary row but no files.
    """
    is_text = F.is_valid_utf8(F.col("content").cast("string"))
    text = files.withColumn("_text", F.when(is_text, F.col("content").cast("string")))
    done = redact(text, "_text")
    clean = F.coalesce(F.col("redacted_text").cast("binary"), F.when(F.col("_text").isNull(), F.col("content")))
    done = done.withColumn("content", clean)
    summary = done.groupBy(*keys).agg(
        F.count("*").alias("files"),
        F.sum(F.length("content")).cast("bigint").alias("total_bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
        F.bool_or("uncleanable").alias("rejected"),
    )
    rejected = summary.where("rejected").select(*keys)
    kept = done.select(*keys, "path", "content").join(rejected, keys, "left_anti")
    return kept, summary.withColumn("total_bytes", F.when(~F.col("rejected"), F.col("total_bytes")))
