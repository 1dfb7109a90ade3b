"""A Merkle manifest of a dataset: checkpoint and recompute.

Rows are leaves.  Those of a group, in order, form a tree: every ``fanout``
consecutive nodes of a level (the last run may be shorter, even one) become
their digest, until one is left, the group's subroot.  The subroots, in the
order of their groups, form one more tree, whose last node is the root.

Only every ``every``-th level is kept.  The nodes between two kept levels form
*aligned subtrees* of at most ``fanout ** every`` nodes, so one subtree is all
that a step holds at a time, however many rows a group has.  Proofs go down
from the root: a subtree's missing nodes are computed again from the kept ones
below it, its siblings are handed out together with those further up, and the
nodes are forgotten.

Digests are lower-case hexadecimal SHA-256 of the inputs one after another;
digests of nodes go in as their hexadecimal text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from turnlake.llm.common import cut
from turnlake.llm.positions import numbered

FANOUT = 3
#: Levels from one kept level to the next: 81 nodes in a subtree, one in 80 nodes kept.
EVERY = 4
DIGEST_CHARS = 64
BATCH_ROWS = 2000


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: ``-`` for each NULL, else the value's UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """The kept levels of all trees; every table is in the shared folder.

    ``levels[r]`` are the kept nodes ``(grp, height, position, digest)`` of the
    groups' trees at level ``r * every`` (or at their top, if lower); those of
    level 0 have the caller's columns too.  ``top`` is the same for the tree
    over the groups, its leaves with the group in ``member``.  ``root`` is
    None if there are no rows.
    """

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    fanout: int
    every: int


def build_manifest(rows: DataFrame, group: str, order: list[str], digest: str, fanout: int = FANOUT, every: int = EVERY) -> Manifest:
    """Trees over ``rows``, whose leaf digests are in column ``digest``.

    Rows of a group ascend by ``order`` (NULL first, ties by digest, so that
    repeated rows stay apart and in a defined order); groups ascend too, NULL
    first, strings by their UTF-8 bytes.  All columns of ``rows`` travel with
    the leaves and may have any names; leave long texts out, the digest stands
    for them.  A digest may not be NULL; :func:`leaf_digest` never is.
    """
    if not 2 <= fanout <= 10:
        raise ValueError("fanout must be 2 to 10")  # a digit counts the siblings on one side
    leaves = rows.select(F.col(group).alias("grp"), F.struct(*[F.col(c) for c in order]).alias("place"), F.col(digest).alias("digest"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    leaves = numbered(cut(leaves, "digests"), ["grp"], ["place", "digest"], total="n")  # what digests are made of is read once
    leaves = cut(leaves.select("grp", _height(fanout).alias("height"), "position", "digest", "row"), "leaves")
    levels, subroots = _grow(leaves, fanout, every)
    tops = numbered(subroots.select(F.lit(0).alias("grp"), F.struct(F.col("grp").alias("member"), F.col("height").alias("tall")).alias("row"), "digest"), ["grp"], ["row.member"], total="n")
    tops = cut(tops.select("grp", _height(fanout).alias("height"), "position", "digest", "row"), "subroots")
    top, root = _grow(tops, fanout, every)
    last = root.select("digest").first()
    return Manifest(levels, top, last and last.digest, fanout, every)


def proofs(manifest: Manifest) -> DataFrame:
    """``(row, leaf, subroot, siblings, turns)`` for every leaf; ``row`` holds the caller's columns.

    ``siblings`` is the text of all siblings' digests, level by level from the
    leaf through the subroot to the root, left to right; ``turns`` has two
    digits for each level, the siblings on the left and on the right (a node
    that is a run of its own has ``00`` and is still digested again).
    """
    none = F.lit("")
    whole = manifest.top[0].select("grp", "height").limit(1).select("grp", "height", none.alias("siblings"), none.alias("turns"), none.alias("subroot"))
    tops = _descend(manifest.top, whole, manifest.fanout, manifest.every)
    ends = tops.select(F.col("row.member").alias("grp"), F.col("row.tall").alias("height"), "siblings", "turns", F.col("leaf").alias("subroot"))
    return _descend(manifest.levels, cut(ends, "subroot-proofs"), manifest.fanout, manifest.every)


def folded(leaf: Column, siblings: Column, turns: Column) -> Column:
    """The root that follows from a leaf and its proof."""

    def step(state: Column, i: Column) -> Column:
        left, right = (F.substr(turns, 2 * i + F.lit(k), F.lit(1)).cast("int") * DIGEST_CHARS for k in (1, 2))
        run = F.concat(F.substr(siblings, state["at"], left), state["digest"], F.substr(siblings, state["at"] + left, right))
        return F.struct(F.sha2(run.cast("binary"), 256).alias("digest"), (state["at"] + left + right).alias("at"))

    steps = F.when(F.length(turns) > 0, F.sequence(F.lit(0), (F.length(turns) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(leaf.alias("digest"), F.lit(1).alias("at")), step, lambda s: s["digest"])


def _height(fanout: int) -> Column:
    """Levels above ``n`` leaves: the least h with fanout ** h >= n."""
    powers = []
    while not powers or powers[-1] < 1 << 62:
        powers.append(fanout ** len(powers))
    return sum((F.when(F.col("n") > p, 1).otherwise(0) for p in powers[:-1]), F.lit(0))


def _grow(leaves: DataFrame, fanout: int, every: int) -> tuple[list[DataFrame], DataFrame]:
    """Kept levels from ``leaves`` upwards, and the last node of each tree."""
    span, levels = fanout**every, [leaves]
    tallest = leaves.agg(F.max("height")).first()[0] or 0

    def climb(low: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found(rows: Iterator[tuple]) -> Iterator[tuple]:
                for (grp, block), nodes in groupby(rows, itemgetter(0, 1)):
                    _, _, heights, _, digests = zip(*nodes, strict=True)
                    yield grp, heights[0], block, _levels(list(digests), min(every, heights[0] - low), fanout)[-1][0]

            yield from _mapped(batches, ["grp", "height", "position", "digest"], [0, 2, 1, 4], found)

        return run

    for low in range(0, tallest, every):
        nodes = levels[-1].where(F.col("height") > low).select("grp", F.expr(f"position div {span}").alias("block"), "height", "position", "digest")
        dealt = nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "position")
        levels.append(cut(dealt.mapInArrow(climb(low), nodes.select("grp", "height", "position", "digest").schema), "nodes"))
    lasts = [x.where(_rounds(every) == r).select("grp", "height", "digest") for r, x in enumerate(levels)]
    return levels, reduce(DataFrame.unionAll, lasts)


def _descend(levels: list[DataFrame], ends: DataFrame, fanout: int, every: int) -> DataFrame:
    """Proofs of the leaves, from those ``(grp, height, siblings, turns, subroot)`` of the trees' last nodes.

    A step streams sorted partitions: the proof of a subtree's upper node
    comes first, then the subtree's kept lower nodes.
    """
    span, paths = fanout**every, None

    def hand_out(low: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found(rows: Iterator[tuple]) -> Iterator[tuple]:
                for (grp, _), members in groupby(rows, itemgetter(0, 1)):
                    above, *nodes = members
                    subtree = _levels([x[4] for x in nodes], max(0, min(every, nodes[0][3] - low)), fanout)
                    known = [(above[6], above[7])]
                    for level in reversed(subtree[:-1]):
                        known = [_step(level, i, known[i // fanout], fanout) for i in range(len(level))]
                    for x, (siblings, turns) in zip(nodes, known, strict=True):
                        yield grp, x[2], x[4], x[5], siblings, turns, above[8]

            yield from _mapped(batches, ["grp", "position", "leaf", "row", "siblings", "turns", "subroot"], [0, 2, 4, 5, 6, 7, 8], found)

        return run

    for r in range(len(levels) - 1, -1, -1):
        row = F.col("row") if r == 0 else F.lit(None).cast("int")
        nodes = levels[r].select("grp", F.expr(f"position div {span}").alias("block"), "position", "height", "digest", row.alias("row"), *[F.lit(None).cast("string").alias(c) for c in ("siblings", "turns", "subroot")])
        kind = nodes.schema["row"].dataType
        above = ends.where(_rounds(every) == r).select("grp", F.lit(0).cast("long").alias("block"), "siblings", "turns", "subroot")
        if paths is not None:
            above = above.unionAll(paths.select("grp", F.col("position").alias("block"), "siblings", "turns", "subroot"))
        above = above.select("grp", "block", F.lit(-1).cast("long").alias("position"), F.lit(0).alias("height"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast(kind).alias("row"), "siblings", "turns", "subroot")
        dealt = nodes.unionAll(above).repartition("grp", "block").sortWithinPartitions("grp", "block", "position")
        shape = nodes.select("grp", "position", F.col("digest").alias("leaf"), "row", "siblings", "turns", "subroot").schema
        paths = dealt.mapInArrow(hand_out(r * every), StructType([StructField(f.name, f.dataType) for f in shape]))
        if r:
            paths = cut(paths.drop("row", "leaf"), "proofs")
    return paths.drop("grp", "position")


def _rounds(every: int) -> Column:
    """The kept level that a tree of ``height`` ends in."""
    return F.expr(f"(height + {every - 1}) div {every}")


def _step(level: list[str], i: int, above: tuple[str, str], fanout: int) -> tuple[str, str]:
    """Siblings and turns of the ``i``-th node of a level, before those further up."""
    first = i - i % fanout
    left, right = level[first:i], level[i + 1 : first + fanout]
    return "".join(left + right) + above[0], f"{len(left)}{len(right)}{above[1]}"


def _digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], count: int, fanout: int) -> list[list[str]]:
    """``nodes`` and the ``count`` levels above them."""
    found = [nodes]
    for _ in range(count):
        found.append([_digest(found[-1][i : i + fanout]) for i in range(0, len(found[-1]), fanout)])
    return found


def _mapped(batches: Iterator[pa.RecordBatch], names: list[str], like: list[int], made: Callable[[Iterator[tuple]], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """Rows that ``made`` yields, in batches; column i has the type of the input's column ``like[i]``."""
    first = next(batches, None)
    if first is None:
        return
    types = [first.schema.types[i] for i in like]
    rows = (row for batch in chain([first], batches) for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    results = made(rows)
    while some := list(islice(results, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)
