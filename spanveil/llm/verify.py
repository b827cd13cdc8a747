"""Exact Jaccard links within groups of sets, in tiles of bounded size, without writing pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.shingles import groups_of

BLOCK_ROWS, BLOCK_MEMBERS = 1024, 2_000_000  # a tile holds two blocks: 32 MB of set members at most
COLUMNS = 2048  # of the 0/1 matrix that is multiplied at once


def blocks(rows: Column, members: Column) -> Column:
    """Into how many blocks a group with so many sets and set members is dealt."""
    return F.ceil(F.greatest(rows / BLOCK_ROWS, members / BLOCK_MEMBERS, F.lit(1.0))).cast("int")


def exact_links(sets: DataFrame, threshold: float) -> DataFrame:
    """``sets``: comp, node, n_blocks and members (sorted array<bigint>). Result: node, links, root, parted for each tile
    in which the node has links: how many other nodes of the tile are similar, the tile component's smallest node, and
    whether its group has further tiles.

    A group is dealt into blocks and every two blocks meet in one tile, so each pair of nodes is compared exactly once,
    and no task holds a group. A node that comes twice counts once.
    """
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    tiled = (
        sets.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(
            "comp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block",
            "members", (F.col("n_blocks") > 1).alias("parted"),
        )
        .repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high", "node")
    )

    def compare(batches):
        for (_, low, high), table in groups_of(batches, 3):
            nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            members = [table.column("members")[int(k)].values.to_numpy() for k in at]
            found = links(members, threshold, None if low == high else table.column("block").to_numpy()[at] == low)
            if found is None:
                continue
            counts, roots = found
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes[some]), pa.array(counts[some]), pa.array(nodes[roots[some]]),
                    pa.array([table.column("parted")[0].as_py()] * len(some), pa.bool_()),
                ],
                names=["node", "links", "root", "parted"],
            )

    return tiled.mapInArrow(compare, "node bigint, links bigint, root bigint, parted boolean")


def links(members: list[np.ndarray], threshold: float, in_first: np.ndarray | None):
    """Link counts and smallest member of each set's component; ``in_first``: only pairs across the two parts."""
    sizes = np.fromiter(map(len, members), np.int64, len(members))
    if not sizes.sum():
        return None
    _, column, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(members)), sizes)
    use = shared[column]
    row, column = row[use], place[column[use]]
    if not len(row):
        return None
    n, common = len(members), np.zeros((len(members), len(members)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1
    for a in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        part = np.zeros((n, min(COLUMNS, width - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        common += part @ part.T
    similar = common - threshold * (sizes[:, None] + sizes[None, :] - common) >= -1e-6
    similar &= common > 0
    np.fill_diagonal(similar, False)
    if in_first is not None:
        similar &= in_first[:, None] != in_first[None, :]
    counts = similar.sum(1).astype(np.int64)
    if not counts.any():
        return None
    return counts, roots_of(similar)


def roots_of(similar: np.ndarray) -> np.ndarray:
    """The smallest index of each vertex's component in a symmetric 0/1 matrix."""
    root = np.full(len(similar), -1, np.int64)
    for k in range(len(similar)):
        if root[k] >= 0:
            continue
        root[k], front = k, np.array([k])
        while len(front):
            reached = similar[front].any(0) & (root < 0)
            front = np.flatnonzero(reached)
            root[front] = k
    return root
