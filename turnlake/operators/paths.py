"""Path and prefix joins as equi-joins, and conversation membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.text import comparable_path, glob_to_regex_column, lexical_path, percent_decode

EMPTY_WINDOW = "empty-window"


def folder_of_uri(uri: str | Column) -> Column:
    """Folder named by a ``file://`` URI; other text is a literal path."""
    u = F.col(uri) if isinstance(uri, str) else uri
    plain = percent_decode(F.substr(u, F.lit(8)))
    local = F.regexp_replace(plain, r"^/(?=[A-Za-z]:)", "")
    return F.when(u.startswith("file://"), F.nullif(local, F.lit(""))).otherwise(u)


def workspace_index(rows: DataFrame) -> DataFrame:
    """Folder of every storage entry; ``rows``: ``workspace_json`` and any keys.

    A multi-root entry has no single folder: NULL.
    """
    folder = F.get_json_object("workspace_json", "$.folder")
    return rows.withColumn("folder", folder_of_uri(folder)).drop("workspace_json")


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it."""
    parts = F.split(path, "/")
    n = F.size(parts)
    lengths = F.sequence(F.lit(1), n)
    return F.filter(F.transform(lengths, lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda p: p != "")


def related_paths(left: DataFrame, left_path: str, right: DataFrame, right_path: str, keys: list[str]) -> DataFrame:
    """Pairs of the same keys whose paths are equal or one inside the other.

    Each side joins on equality with the other side's ancestors, so the join
    shuffles on whole paths; equal paths are taken from one direction only.
    """
    a = left.withColumn("_a", comparable_path(left_path))
    b = right.withColumn("_b", comparable_path(right_path))
    above_a = a.withColumn("_up", F.explode(ancestors(F.col("_a"))))
    above_b = b.withColumn("_up", F.explode(ancestors(F.col("_b")))).where(F.col("_up") != F.col("_b"))
    b_key = b.withColumnRenamed("_b", "_up").withColumn("_b", F.col("_up"))
    a_key = a.withColumnRenamed("_a", "_up").withColumn("_a", F.col("_up"))
    down = above_a.join(b_key, [*keys, "_up"])
    up = a_key.join(above_b, [*keys, "_up"])
    out = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    return down.select(*out).unionByName(up.select(*out))


def prefix_completions(names: DataFrame, name: str, catalog: DataFrame, model: str = "model_id") -> DataFrame:
    """Complete less specific names against a catalog table.

    Every catalog id is exploded into its shorter dash prefixes, so completion
    is an equi-join on distinct names.  Adds ``completions`` (how many ids
    extend the name), ``completed`` (the only one) and ``latest`` (the largest).
    """
    parts = F.split(F.col(model), "-")
    shorter = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    prefixes = (
        catalog.select(F.col(model).alias("_id"), F.explode(F.when(F.size(parts) > 1, shorter)).alias(name))
        .groupBy(name)
        .agg(F.count("*").alias("completions"), F.min("_id").alias("_only"), F.max("_id").alias("latest"))
    )
    joined = names.join(prefixes, name, "left")
    return joined.select(
        *names.columns,
        F.coalesce("completions", F.lit(0)).cast("bigint").alias("completions"),
        F.when(F.col("completions") == 1, F.col("_only")).alias("completed"),
        "latest",
    )


def conversation_members(
    composers: DataFrame, storages: DataFrame, stubs: DataFrame, workspaces: DataFrame
) -> DataFrame:
    """Conversations that belong to each workspace.

    ``composers``: ``store_id, composer_id, root_path, storage_id``; ``storages``:
    ``store_id, storage_id, folder``; ``stubs``: ``store_id, storage_id,
    composer_id``; ``workspaces``: ``store_id, capture_id, workspace``.  A
    conversation is a member when its root is related to the workspace, when its
    storage is (``empty-window`` never is), or when a related storage names it.
    """
    bound = workspaces.select("store_id", "capture_id", "workspace")
    near = related_paths(bound, "workspace", storages.select("store_id", "storage_id", "folder"), "folder", ["store_id"])
    near = near.select("store_id", "capture_id", "storage_id").distinct()
    rooted = composers.where(F.col("root_path").isNotNull()).select("store_id", "composer_id", "root_path")
    by_root = related_paths(bound, "workspace", rooted, "root_path", ["store_id"])
    by_storage = composers.where(F.col("storage_id") != EMPTY_WINDOW).join(near, ["store_id", "storage_id"])
    by_stub = stubs.join(near, ["store_id", "storage_id"])
    keep = ["store_id", "capture_id", "composer_id"]
    return by_root.select(*keep).unionByName(by_storage.select(*keep)).unionByName(by_stub.select(*keep)).distinct()


def watched_changes(changes: DataFrame, roots: DataFrame, ignores: DataFrame, builtin: list[str]) -> DataFrame:
    """File changes inside their root that no ignore rule covers.

    ``changes``: ``capture_id, path`` (absolute, or relative to the root; ``..``
    is resolved by text) and more; ``roots``:
    ``capture_id, root``; ``ignores``: ``capture_id, pattern`` lines as written.
    Each pattern counts at the root and at any depth, for files and subtrees;
    a capture's patterns form one expression, compiled once per run of rows.
    Adds ``rel_path``.
    """
    lines = F.regexp_replace(F.regexp_replace(F.trim("pattern"), r"^(?:\./)+", ""), "/+$", "")
    user = ignores.select("capture_id", lines.alias("p")).where((F.col("p") != "") & ~F.col("p").startswith("#"))
    per = user.groupBy("capture_id").agg(F.collect_set("p").alias("_user"))
    known = roots.join(per, "capture_id", "left").withColumn(
        "_patterns", F.array_union(F.coalesce("_user", F.array().cast("array<string>")), F.array(*[F.lit(b) for b in builtin]))
    )
    forms = F.flatten(
        F.transform(
            "_patterns",
            lambda p: F.array(p, F.concat(F.lit("**/"), p), F.concat(p, F.lit("/**")), F.concat(F.lit("**/"), p, F.lit("/**"))),
        )
    )
    rules = known.select(
        "capture_id", comparable_path("root").alias("_root"), F.array_join(F.transform(forms, glob_to_regex_column), "|").alias("_rule")
    )
    joined = changes.join(rules, "capture_id")
    full = F.when(comparable_path("path").rlike("^(?:/|[A-Za-z]:)"), F.col("path")).otherwise(
        F.concat("_root", F.lit("/"), F.col("path"))
    )
    joined = joined.withColumn("_path", lexical_path(full))
    inside = joined.where((F.col("_path") == F.col("_root")) | F.col("_path").startswith(F.concat("_root", F.lit("/"))))
    rel = inside.withColumn("rel_path", F.substr("_path", F.length("_root") + 2))
    ignored = (F.col("rel_path") != "") & F.regexp_like("rel_path", F.col("_rule"))
    return rel.where(~F.coalesce(ignored, F.lit(False))).drop("_path", "_root", "_rule")
