"""OTLP/JSON log exports: one turn per ``api_request`` log record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions.numbers import as_count, saturating_add
from turnlake.schemas import conform_raw
from turnlake.sources.lines import read_documents

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
ENVELOPE = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,"
    f"scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,body:{_VALUE},attributes:{_ATTRS}>>>>>>,"
    "_corrupt string"
)
# The event that carries usage and the spellings of its fields.
USAGE_EVENT = "api_request"
EVENT_NAME = ["event.name", "event_name", "name"]
CACHE_READ = ["cache_read_tokens", "cache_read_input_tokens"]
CACHE_WRITE = ["cache_creation_tokens", "cache_creation_input_tokens"]
PROMPT = ["prompt.id", "prompt_id"]
SESSION = ["session.id", "session_id"]
FOLDER = ["cwd", "workspace", "terminal.cwd"]


def _find(attrs: Column, keys: list[str]) -> Column:
    """First attribute that has a value, in the order of the spellings."""

    def first(key: str) -> Column:
        same = F.filter(attrs, lambda a: a.getField("key") == key)
        return F.try_element_at(same, F.lit(1)).getField("value")

    return F.coalesce(*[first(k) for k in keys])


def _count(v: Column) -> Column:
    whole = v.getField("doubleValue")
    from_double = F.when(whole >= 0, F.least(F.floor(whole), F.lit(9223372036854775807)).cast("bigint"))
    signed = v.getField("intValue").try_cast("bigint")
    return F.when(signed.isNotNull(), F.when(signed >= 0, signed)).otherwise(
        F.coalesce(from_double, as_count(v.getField("stringValue")))
    )


def _number(v: Column) -> Column:
    return F.coalesce(
        v.getField("doubleValue"), v.getField("intValue").try_cast("bigint").cast("double"), v.getField("stringValue").try_cast("double")
    )


def parse_otlp(exports: DataFrame, fallback_ms: Column | int = 0) -> tuple[DataFrame, DataFrame]:
    """Turns and rejected payloads of log exports.

    ``exports``: ``capture_id, doc`` and optionally ``arrival_ms``.  A malformed
    payload is rejected as a whole; one without log records (metrics) is fine
    and yields nothing.  Record attributes win over resource attributes.
    """
    arrival = F.col("arrival_ms") if "arrival_ms" in exports.columns else F.lit(None).cast("bigint")
    parsed = exports.withColumn(
        "_e", F.from_json("doc", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    bad = F.col("_e").isNull() | F.col("_e._corrupt").isNotNull()
    rejected = parsed.where(bad).drop("_e")
    # A filter on the parsed column would be pushed below the parse and run it
    # again; an empty explode drops the rejected payloads just as well.
    accepted = F.when(F.col("_e._corrupt").isNull(), F.col("_e.resourceLogs"))
    records = (
        parsed.select("capture_id", arrival.alias("arrival_ms"), F.explode(accepted).alias("_rl"))
        .select("capture_id", "arrival_ms", F.col("_rl.resource.attributes").alias("_ra"), F.explode("_rl.scopeLogs").alias("_sl"))
        .select("capture_id", "arrival_ms", "_ra", F.posexplode("_sl.logRecords").alias("_n", "_r"))
    )
    own = F.col("_r.attributes")
    named = (F.col("_r.body.stringValue") == USAGE_EVENT) | (_find(own, EVENT_NAME).getField("stringValue") == USAGE_EVENT)
    records = records.where(F.coalesce(named, F.col("_r.body.stringValue") == USAGE_EVENT, F.lit(False)))

    def attr(keys: list[str]) -> Column:
        return F.coalesce(_find(own, keys), _find(F.col("_ra"), keys))

    fallback = F.lit(fallback_ms) if isinstance(fallback_ms, int) else fallback_ms
    # Every attribute is looked up once, in a step of its own.
    wanted = {
        "_model": ["model"],
        "_input": ["input_tokens"],
        "_output": ["output_tokens"],
        "_read": CACHE_READ,
        "_write": CACHE_WRITE,
        "_prompt": PROMPT,
        "_cost": ["cost_usd"],
        "_duration": ["duration_ms"],
        "_session": SESSION,
        "_folder": FOLDER,
    }
    looked = records.select(
        "capture_id",
        "arrival_ms",
        "_n",
        F.coalesce(F.expr("try_cast(_r.timeUnixNano AS bigint) div 1000000"), fallback).alias("timestamp_ms"),
        *[attr(keys).alias(name) for name, keys in wanted.items()],
    )
    tokens = lambda c: F.coalesce(_count(F.col(c)), F.lit(0).cast("bigint"))
    text = lambda c: F.col(f"{c}.stringValue")
    turns = conform_raw(
        looked,
        source=F.lit("otel"),
        harness=F.lit("claude_code_cli"),
        model=text("_model"),
        tokens_input=tokens("_input"),
        tokens_output=tokens("_output"),
        tokens_thinking=F.lit(0),
        tokens_cache=saturating_add(tokens("_read"), tokens("_write")),
        prompt_id=text("_prompt"),
        cost_usd=_number(F.col("_cost")),
        duration_ms=_count(F.col("_duration")),
        session_id=text("_session"),
        workspace=text("_folder"),
        counts_estimated=F.lit(False),
        event_id=F.lit(None),
        arrival_ms=F.coalesce("arrival_ms", "timestamp_ms"),
        arrival_seq=F.col("_n"),
    )
    return turns, rejected


def read_otlp_logs(spark: SparkSession, path: str, fallback_ms: int = 0, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """Read landed exports: one document per file, or one per line."""
    if whole_files:
        docs = read_documents(spark, path)
    else:
        raw = spark.read.text(path)
        tenant = F.col("capture_id") if "capture_id" in raw.columns else F.lit("local")
        docs = raw.where(F.trim("value") != "").select(tenant.cast("string").alias("capture_id"), F.col("value").alias("doc"))
    return parse_otlp(docs, fallback_ms)
