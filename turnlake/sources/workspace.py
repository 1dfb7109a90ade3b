"""Workspaces on disk, read in parallel, with links told from files.

Each folder below the root is a workspace.  The driver lists these names only;
tasks walk them and hand on one file after the other.  A symbolic link is never
followed: code could hide behind it without changing the workspace's hash, and
it may lead outside.  It comes as a row of its own, and refuses its workspace.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from turnlake.operators.content import GENERATED_README, PRUNED_DIRS
from turnlake.streaming.tail import open_folder

#: Workspaces of a task, bytes of a batch of files.
TASK_WORKSPACES, BATCH_BYTES = 100, 8 << 20
SCHEMA = "workspace string, path string, kind string, content binary"
_ARROW = pa.schema([("workspace", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("content", pa.binary())])


@dataclass
class Workspaces(InputPartition):
    names: tuple[str, ...]


def walk(system, top: str, pruned: frozenset[str]) -> Iterator[tuple[str, str]]:
    """Path below ``top`` and kind (file or link) of everything but pruned folders; stores without links have files only."""
    from pyarrow import fs

    local, waiting = isinstance(system, fs.LocalFileSystem), [""]
    while waiting:
        inner = waiting.pop()
        where = f"{top}/{inner}".rstrip("/")
        if local:
            with os.scandir(where) as entries:
                found = [(e.name, "link" if e.is_symlink() else "folder" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else "other") for e in entries]
        else:
            kinds = {fs.FileType.Directory: "folder", fs.FileType.File: "file"}
            found = [(i.base_name, kinds.get(i.type, "other")) for i in system.get_file_info(fs.FileSelector(where))]
        for name, kind in found:
            path = f"{inner}/{name}" if inner else name
            if name in pruned or kind == "other":
                continue
            if kind == "folder":
                waiting.append(path)
            elif kind == "link" or path != GENERATED_README:
                yield path, kind


class WorkspaceReader(DataSourceReader):
    def __init__(self, path: str, meta_dir: str) -> None:
        self.path, self.pruned = path, frozenset([meta_dir, *PRUNED_DIRS])

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, folder = open_folder(self.path)
        names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.Directory)
        return [Workspaces(tuple(names[i : i + TASK_WORKSPACES])) for i in range(0, len(names), TASK_WORKSPACES)]

    def read(self, partition: Workspaces | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no workspace at all
            return
        system, folder = open_folder(self.path)
        rows, size = [], 0
        for workspace in partition.names:
            for path, kind in walk(system, f"{folder}/{workspace}", self.pruned):
                content = None
                if kind == "file":
                    with system.open_input_stream(f"{folder}/{workspace}/{path}") as f:
                        content = f.read()
                    size += len(content)
                rows.append((workspace, path, kind, content))
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class WorkspaceSource(DataSource):
    """Format ``workspaces`` with options ``path`` and ``metaDir``."""

    @classmethod
    def name(cls) -> str:
        return "workspaces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options["path"], self.options["metaDir"])


def read_workspace(spark: SparkSession, path: str, meta_dir: str) -> DataFrame:
    """Everything in the workspaces below ``path``: ``workspace``, ``path`` in it, ``kind`` (file or link), ``content``.

    Generated folders and the top README are left out.  Contents are read by
    the tasks that walk; a file lies in memory whole.
    """
    spark.dataSource.register(WorkspaceSource)
    return spark.read.format("workspaces").option("path", path.rstrip("/")).option("metaDir", meta_dir).load()


def without_links(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of the workspaces that hold no link, and ``workspace, reason`` of those that are refused."""
    links = entries.where("kind = 'link'").groupBy("workspace").agg(F.min("path").alias("_link"))
    refused = links.select("workspace", F.concat(F.lit("symlink is not allowed in a workspace: "), "_link").alias("reason"))
    return entries.where("kind = 'file'").drop("kind").join(refused, "workspace", "left_anti"), refused
