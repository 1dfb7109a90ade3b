"""Small and structured inputs: manifests, sessions, dimensions, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions.text import glob_to_regex_column, trim_unicode

SUPPORTED_MANIFEST = 1
SUPPORTED_MARKER = 1

MANIFEST = (
    "schema_version bigint, kit_version bigint, level_id string, slug string, stage_num bigint, level_num bigint, "
    "title string, language string, runtime_version string, execution_harness string, file_allowlist array<string>, "
    "entry_points array<string>, challenge_type string, token_weight_overrides map<string,double>, baseline_hash string, "
    "_corrupt string"
)
SESSION = (
    "version bigint, session_id string, workspace string, level_id string, slug string, started_at_ms bigint, "
    "stopped_at_ms bigint, attempt_nonce string, nonce_origin string, file_allowlist array<string>, "
    "code_reset_count bigint, bootstrap string, otlp_token string, baseline_attested boolean, _corrupt string"
)
ECONOMICS = (
    "model_identifier string, input_cost double, output_cost double, base_effort_multiplier double, is_baseline_floor boolean"
)
WEIGHTS = "challenge_type string, w_in double, w_out double, w_think double"
CASES = "suite string, cases array<struct<name:string,stdin:string,expected_stdout:string,tolerance:double>>"
VERDICTS = "submission_id string, cases array<struct<name:string,status:string,message:string>>"
GRADES = "submission_id string, status string, score double, correctness_pct double, recognized boolean"


def parse_manifests(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid manifests and rejected ones with the reason; ``docs`` has ``doc``.

    Adds ``allow_regexes``, the allowlist globs translated once per level.
    """
    parsed = docs.withColumn("_m", F.from_json("doc", MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    blank = lambda c: F.coalesce(trim_unicode(c) == "", F.lit(True))
    reason = (
        F.when(F.col("_m").isNull() | F.col("_m._corrupt").isNotNull() | F.col("_m.schema_version").isNull(), "malformed")
        .when(F.col("_m.schema_version") > SUPPORTED_MANIFEST, "unsupported_schema")
        .when(blank(F.col("_m.level_id")), "missing_level_id")
        .when(blank(F.col("_m.baseline_hash")), "missing_baseline_hash")
    )
    judged = parsed.withColumn("reason", reason)
    keep = [c for c in docs.columns if c != "doc"]
    empty = F.array().cast("array<string>")
    ok = judged.where(F.col("reason").isNull()).select(*keep, "_m.*").drop("_corrupt")
    ok = ok.withColumns(
        {
            "kit_version": F.coalesce("kit_version", F.lit(0).cast("bigint")),
            "slug": F.coalesce("slug", F.lit("")),
            "challenge_type": F.coalesce("challenge_type", F.lit("")),
            "file_allowlist": F.coalesce("file_allowlist", empty),
            "entry_points": F.coalesce("entry_points", empty),
        }
    )
    ok = ok.withColumn("allow_regexes", F.transform("file_allowlist", glob_to_regex_column))
    return ok, judged.where(F.col("reason").isNotNull()).select(*keep, "doc", "reason")


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.text(path, wholetext=True)
    return parse_manifests(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc")))


def read_sessions(spark: SparkSession, live: str, archive: str | None = None) -> DataFrame:
    """Live and archived session rows of a supported version."""
    read = lambda p: spark.read.schema(SESSION).option("columnNameOfCorruptRecord", "_corrupt").json(p, multiLine=True)
    df = read(live).withColumn("archived", F.lit(False))
    if archive:
        df = df.unionByName(read(archive).withColumn("archived", F.lit(True)))
    good = F.col("_corrupt").isNull() & F.col("session_id").isNotNull() & (F.col("version") <= SUPPORTED_MARKER)
    return df.where(good).drop("_corrupt")


def read_dims(spark: SparkSession, economics: str, weights: str) -> tuple[DataFrame, DataFrame]:
    """Economics and token weights; each must be usable or this fails."""
    eco = spark.read.schema(ECONOMICS).json(economics)
    eco = eco.withColumn("is_baseline_floor", F.coalesce("is_baseline_floor", F.lit(False)))
    if eco.where("is_baseline_floor").limit(1).count() == 0:
        raise ValueError("the economics table has no baseline floor row")
    return eco, spark.read.schema(WEIGHTS).json(weights)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).json(path, multiLine=True).select("suite", F.posexplode("cases").alias("case_no", "c")).select("suite", "case_no", "c.*")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERDICTS).json(path).select("submission_id", F.explode("cases").alias("c")).select("submission_id", "c.*")


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRADES).json(path).where(F.col("status") == "graded")
