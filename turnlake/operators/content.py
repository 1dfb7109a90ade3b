"""Workspace content: canonical files, hashes, bundles, entry points."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.text import relative_path, trim_unicode

# The payload bound and the file-like entry-point extensions.
MAX_BUNDLE_BYTES = 8 * 1024 * 1024
SOURCE_EXTENSIONS = [
    "go", "rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx",
]
GENERATED_README = "README.md"
PRUNED_DIRS = [".git", ".claude"]


def is_generated(path: str | Column, meta_dir: str) -> Column:
    """The tool's own folder and the generated top-level README."""
    p = relative_path(path)
    return (p == GENERATED_README) | (p == meta_dir) | p.startswith(meta_dir + "/")


def is_pruned(path: str | Column, meta_dir: str, any_depth: bool = True) -> Column:
    """Below a folder that never belongs to a workspace, or the top README.

    Snapshots prune these folders at any depth, bundles at the root only.
    """
    p = relative_path(path)
    hit = p == GENERATED_README
    for d in [meta_dir, *PRUNED_DIRS]:
        inside = p.startswith(d + "/") | (p == d)
        if any_depth:
            inside = inside | p.contains(f"/{d}/") | p.endswith(f"/{d}")
        hit = hit | inside
    return hit


def _hash_sorted(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Digest runs of equal keys; rows arrive sorted by key and path."""
    current, digest, n, before = None, None, 0, None

    def row() -> pa.RecordBatch:
        values = [pa.array([v], pa.string()) for v in (*current, digest.hexdigest())] + [pa.array([n], pa.int64())]
        return pa.RecordBatch.from_arrays(values, names=[f"c{i}" for i in range(n_keys + 2)])

    for batch in batches:
        cols = batch.columns
        for i in range(batch.num_rows):
            key = tuple(cols[k][i].as_py() for k in range(n_keys))
            if key != current:
                if current is not None:
                    yield row()
                current, digest, n, before = key, hashlib.sha256(), 0, None
            path = cols[n_keys][i].as_py()
            if path == before:
                raise ValueError(f"duplicate path {path!r} in workspace {current!r}")
            before = path
            digest.update(path.encode() + b"\0")
            digest.update(cols[n_keys + 1][i].as_buffer())
            n += 1
    if current is not None:
        yield row()


def content_hashes(files: DataFrame, keys: list[str], meta_dir: str) -> DataFrame:
    """SHA-256 of each workspace over its canonical files in path order.

    Per file: path, NUL, content without BOM and with LF line ends.  A digest
    runs through its bytes in order, so a workspace is streamed through one
    sorted partition with constant state - its files are never gathered into a
    row.  Result: keys (strings), ``content_hash, files``.  A path that occurs
    twice is an error.
    """
    latin = F.decode("content", "ISO-8859-1")
    body = F.regexp_replace(latin, "^\u00ef\u00bb\u00bf", "")
    body = F.encode(F.regexp_replace(body, "\r\n?", "\n"), "ISO-8859-1")
    n = len(keys)
    ordered = (
        files.where(~is_generated("path", meta_dir))
        .select(*[F.col(k).cast("string").alias(k) for k in keys], relative_path("path").alias("_path"), body.alias("_body"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "_path")
    )
    schema = ", ".join([f"c{i} string" for i in range(n + 1)] + [f"c{n + 1} bigint"])
    return ordered.mapInArrow(lambda it: _hash_sorted(it, n), schema).toDF(*keys, "content_hash", "files")


def verify_baseline(hashes: DataFrame, pinned: DataFrame, keys: list[str]) -> DataFrame:
    """Compare computed hashes with the pinned and the authoritative ones.

    ``pinned``: keys, ``baseline_hash`` and a nullable ``authoritative_hash``.
    """
    joined = pinned.join(hashes, keys, "left")
    same = F.coalesce(F.col("content_hash") == trim_unicode("baseline_hash"), F.lit(False))
    attested = (
        F.when(F.col("authoritative_hash").isNull(), "unattested")
        .when(F.col("authoritative_hash") == F.col("baseline_hash"), "attested")
        .otherwise("refused")
    )
    return joined.withColumns(
        {"status": F.when(same, "match").otherwise("mismatch"), "attestation": attested}
    )


def allowlisted(files: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Files matched by a glob of their level.

    ``levels``: keys and ``allow_regexes ARRAY<STRING>``, translated once per
    level with :func:`turnlake.functions.text.glob_to_regex_column`.
    """
    joined = files.join(levels.select(*keys, "allow_regexes"), keys)
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    return joined.where(F.exists("allow_regexes", lambda rx: F.regexp_like(path, rx))).select(*files.columns)


def missing_entry_points(levels: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """File-like entry points that are not among the workspace files.

    An entry point names a file when its extension is a source extension;
    others are symbols and are not checked.
    """
    entries = levels.select(*keys, F.explode("entry_points").alias("entry_point"))
    has_ext = F.col("entry_point").contains(".")
    ext = F.lower(F.substring_index("entry_point", ".", -1))
    named = entries.where(has_ext & ext.isin(*SOURCE_EXTENSIONS))
    there = files.select(*keys, relative_path("path").alias("entry_point"))
    return named.join(there, [*keys, "entry_point"], "left_anti")


def validate_bundles(
    files: DataFrame, levels: DataFrame, keys: list[str], max_bytes: int = MAX_BUNDLE_BYTES
) -> DataFrame:
    """One verdict per level row: ok, invalid_glob, no_files, too_large or
    missing_entry_point (in that order)."""
    kept = allowlisted(files, levels, keys)
    sizes = kept.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum(F.length("content")).cast("bigint").alias("total_bytes")
    )
    missing = missing_entry_points(levels, files, keys).groupBy(*keys).agg(F.min("entry_point").alias("missing_entry"))
    joined = levels.select(*keys, "allow_regexes").join(sizes, keys, "left").join(missing, keys, "left")
    zero = F.lit(0).cast("bigint")
    n, size = F.coalesce("files", zero), F.coalesce("total_bytes", zero)
    verdict = (
        F.when(F.exists("allow_regexes", lambda rx: rx.isNull()), "invalid_glob")
        .when(n == 0, "no_files")
        .when(size > max_bytes, "too_large")
        .when(F.col("missing_entry").isNotNull(), "missing_entry_point")
        .otherwise("ok")
    )
    return joined.select(*keys, n.alias("files"), size.alias("total_bytes"), "missing_entry", verdict.alias("verdict"))
