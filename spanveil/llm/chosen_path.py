"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles. Equal sets become one representative. Each representative is embedded in SKETCH
min-wise samples, its tokens. A run starts all sets in one node and splits recursively: at a node each token is chosen
by a hash of (run, path, token) with probability 1 / (threshold * SKETCH), the same for all sets of the node, and a set
goes on to every child whose token it holds. Two sets of the threshold's similarity share one child on average, so they
stay together with a probability that falls only slowly with depth; unlike sets part at once. A node of at most
``small`` sets is compared by brute force on the sketches; so is any node at the last depth, in blocks. Runs repeat
until a pair at the threshold is found with probability ``recall``. The first run goes alone: what it joins gets one label,
and the other runs leave out nodes whose sets have all one label and compare no two sets of one label, so large groups of
near copies cost their comparison once. A membership of the tree is a path, a set and its label; the samples (2 bits of
each) meet it only where it is compared.

The join on sketches keeps what a sketch can tell to be similar (a margin of 4 standard errors below the threshold) and
hands on classes, not pairs. An exact check on the whole sets follows in each class, tile by tile, where every pair of
representatives is compared once; it gives each one's number of links and the final classes. No pair is ever a row, and
no bucket, class or document has a cap.

Nulls and ties: texts without words (null, empty, punctuation) are in no class but their own; rows that repeat id and
text are copies of each other; null ids are allowed and never name a class that has another id. An empty table gives no
rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanveil.llm import shingles as sh
from spanveil.llm.common import column, kept, packed, text_of, unpacked
from spanveil.llm.components import components
from spanveil.llm.verify import blocks, exact_links

THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 3
SMALL = 2048  # sets of a node that is compared at once instead of split further
BLOCK = 4096  # sets of a block when a node of the last depth is compared in blocks
MARGIN = 4.0  # standard errors
BROADCAST_ROWS = 500_000  # candidates that are broadcast (about 40 MB); more are joined by shuffle


def together(depth: int) -> float:
    """The probability that two sets of the threshold's similarity share a node at this depth, in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - together(depth)))


def sketch_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per document: id, key (digest of the text), row, digest of its set (null without words), n and tokens (32 bits of each
    sample)."""

    def work(batches):
        for whole in batches:
            for batch in sh.slices(whole, 2):
                words, _, _, firsts = sh.hashed_words(batch.column(2))
                members, at = sh.distinct_sets(*sh.shingle_runs(words, firsts))
                tokens = sh.short_sketches(sh.sketches(members, at))
                sizes = np.diff(at)
                digests = [sh.set_digest(members[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes),
                        pa.array([t.tobytes() for t in tokens], pa.binary()),
                    ],
                    names=["id", "key", "digest", "n", "tokens"],
                )

    narrow = docs.select(column(id_column).cast("bigint").alias("id"), text_of(text_column).alias("text")).select(
        "id", F.xxhash64("text").alias("key"), "text"
    )
    made = narrow.mapInArrow(work, "id bigint, key bigint, digest binary, n bigint, tokens binary")
    return kept(made.withColumn("row", F.monotonically_increasing_id()))


def marks_of(sets: DataFrame) -> DataFrame:
    """node and the last 2 bits of each of its tokens, SKETCH / 4 bytes, to compare by."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, sh.SKETCH)
            bits = np.packbits(np.stack([tokens >> 1 & 1, tokens & 1], 2).astype(np.uint8).reshape(len(tokens), -1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in bits], pa.binary())], names=["node", "marks"])

    return sets.select("node", "tokens").mapInArrow(work, "node bigint, marks binary")


def chosen_children(rows: DataFrame, runs: range, threshold: float, depth: int) -> DataFrame:
    """(path, node, comp, tokens) to the children each set chooses: (path, node, comp). At depth 0 ``path`` is unused
    and every run makes its own children."""
    limit = np.uint64(min(1.0, 1 / (threshold * sh.SKETCH)) * 2.0**64)
    place = sh.mix(np.arange(sh.SKETCH, dtype=np.uint64) + np.uint64(1))

    def choose(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, sh.SKETCH)
            mixed = sh.mix(tokens.astype(np.uint64) ^ place)
            path = batch.column("path").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for run in runs if depth == 0 else (0,):
                seed = sh.mix(np.array([run * 64 + depth + 1], np.uint64))[0]
                chance = sh.mix(mixed ^ (path[:, None] + seed if depth else seed))
                row, at = np.nonzero(chance < limit)
                child = sh.mix(mixed[row, at] + sh.mix(path[row] + seed if depth else np.full(len(row), seed)))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), batch.column("node").take(taken), batch.column("comp").take(taken)],
                    names=["path", "node", "comp"],
                )

    return rows.select("path", "node", "comp", "tokens").mapInArrow(choose, "path bigint, node bigint, comp bigint")


def sketch_links(leaves: DataFrame, threshold: float) -> DataFrame:
    """(path, low, high, node, comp, marks) to edges (a, b): in each tile, what the sketches hold similar is joined, label by
    label; a group of labels has one edge from each of them to the group's smallest node."""
    agree = threshold + (1 - threshold) / 4  # the chance that 2 bits of a sample agree
    least = math.ceil(sh.SKETCH * (agree - MARGIN * math.sqrt(agree * (1 - agree) / sh.SKETCH)))
    pairs = np.uint64(0x5555555555555555)

    def compare(batches):
        for _, table in sh.groups_of(batches, 3):
            nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint64).reshape(-1, sh.SKETCH // 32)[at]
            labels = np.unique(table.column("comp").to_numpy()[at], return_inverse=True)[1]
            comp = labels.copy()
            for k in range(len(nodes) - 1):
                rest = k + 1 + np.flatnonzero(comp[k + 1 :] != comp[k])
                if not len(rest):
                    continue
                apart = marks[rest] ^ marks[k]
                apart = np.bitwise_count((apart | apart >> np.uint64(1)) & pairs).sum(1)
                near = rest[sh.SKETCH - apart >= least]
                if len(near):
                    comp[np.isin(comp, comp[near])] = comp[k]
            first = np.unique(labels, return_index=True)[1]  # one node of each label, the smallest
            root = np.full(len(first), len(nodes))
            np.minimum.at(root, comp[first], first)
            a, b = nodes[first], nodes[root[comp[first]]]
            if (a != b).any():
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    ordered = leaves.repartition("path", "low", "high").sortWithinPartitions("path", "low", "high", "node")
    return ordered.select("path", "low", "high", "node", "comp", "marks").mapInArrow(compare, "a bigint, b bigint")


def chosen_path_wave(sets: DataFrame, runs: range, threshold: float, depth: int, small: int) -> DataFrame:
    """Edges (a, b) found in these runs. ``sets``: node, comp (the label that earlier runs gave), tokens."""
    source, leaves = sets.withColumn("path", F.lit(0).cast("bigint")), None
    for level in range(depth):
        nodes = chosen_children(source, runs, threshold, level)
        open_nodes = (
            nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
            .where("c1 <> c2").select("path", "size")
        )
        rows = kept(nodes.join(open_nodes, "path"))
        last = level == depth - 1
        here = rows if last else rows.where(F.col("size") <= small)
        leaves = here if leaves is None else leaves.union(here)
        larger = rows.where(F.col("size") > small)
        if last or larger.isEmpty():
            break
        source = larger.select("path", "node", "comp").join(sets.select("node", "tokens"), "node")
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), n).cast("int")
    tiled = (
        leaves.join(marks_of(sets), "node")
        .withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )
    return sketch_links(tiled, threshold)


def labels_of(edges: DataFrame) -> DataFrame:
    """(node, comp): a first guess at the components, by two steps to smaller nodes. Nodes of one label are connected."""
    one = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    further = one.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
    return one.join(further, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))


def near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    depth: int = DEPTH,
    small: int = SMALL,
) -> DataFrame:
    """Per document: id, key, class_id (smallest id of its class), n_links (other texts it is similar to), n_copies
    (documents with its set of shingles, itself included), class_size, kept (one document of each class)."""
    rows = sketch_rows(docs, id_column, text_column)
    sets = kept(
        rows.where(F.col("digest").isNotNull()).groupBy("digest")
        .agg(
            F.min(F.struct("row", "id", "key")).alias("at"), F.count(F.lit(1)).alias("n_copies"),
            F.first("n").alias("n"), F.first("tokens").alias("tokens"),
        )
        .select("digest", F.col("at.row").alias("node"), "at.id", "at.key", "n_copies", "n", "tokens")
    )
    total = runs_for(recall, depth)
    nodes = sets.select("node", F.col("node").alias("comp"), "tokens")
    edges = kept(chosen_path_wave(nodes, range(1), threshold, depth, small))
    if total > 1:
        labelled = sets.select("node", "tokens").join(labels_of(edges), "node", "left")
        nodes = labelled.select("node", F.coalesce("comp", "node").alias("comp"), "tokens")
        edges = edges.union(kept(chosen_path_wave(nodes, range(1, total), threshold, depth, small)))
    classes = components(edges)
    members = classes.select("node", F.col("root").alias("comp")).join(sets.select("node", "id", "key", "n"), "node")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("members"))
    sizes = sizes.select("comp", blocks(F.col("rows"), F.col("members")).alias("n_blocks"))
    candidates = members.join(sizes, "comp").select("node", "comp", "n_blocks", "id", "key")
    found = kept(exact_links(shingle_sets(docs, candidates, id_column, text_column), threshold))
    degrees = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    in_one = found.where("not parted").select("node", "root")  # the class was one tile: its roots are final
    parted = found.where("parted").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = in_one.union(components(parted))
    of_set = kept(
        sets.select("digest", "node", "n_copies").join(degrees, "node", "left").join(roots, "node", "left")
        .select(
            "digest", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root")
        )
    )
    labelled = rows.select("id", "key", "row", "digest").join(of_set, "digest", "left").select(
        "id", "key", "row", F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )
    best = labelled.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"), F.count(F.lit(1)).alias("class_size")
    )
    return labelled.join(best, "root").select(
        "id", "key", F.col("best.id").alias("class_id"), "n_links", "n_copies", "class_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def shingle_sets(docs: DataFrame, candidates: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The candidates' sets of shingles, from their texts: comp, node, n_blocks, members."""

    def work(batches):
        for whole in batches:
            for batch in sh.slices(whole, 3):
                words, _, _, firsts = sh.hashed_words(batch.column(3))
                members, at = sh.distinct_sets(*sh.shingle_runs(words, firsts))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(members.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["comp", "node", "n_blocks", "members"])

    texts = docs.select(column(id_column).cast("bigint").alias("__id"), text_of(text_column).alias("text")).select(
        "__id", F.xxhash64("text").alias("__key"), "text"
    )
    own = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key"))
    if candidates.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    return texts.join(candidates, own).select("comp", "node", "n_blocks", "text").mapInArrow(
        work, "comp bigint, node bigint, n_blocks int, members array<bigint>"
    )


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that stay: one of each class, whole rows, columns unchanged.

    Rows are told to go by id and text digest, so whole rows move only where these keys are too many to be broadcast. Where
    rows repeat both, one of them may stay: such rows, if there are any, are taken apart by a number per key.
    """
    found = kept(near_copies(docs, id_column, text_column, **options).select("id", "key", "kept"))
    goes = found.where("not kept").select("id", "key").distinct()
    own = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key"))
    rows = docs.select(
        packed(docs), column(id_column).cast("bigint").alias("own_id"), F.xxhash64(text_of(text_column)).alias("own_key")
    )
    few = found.where("not kept").count() <= BROADCAST_ROWS
    stay = unpacked(rows.join(F.broadcast(goes) if few else goes, own, "left_anti"), docs.columns)
    both = goes.select(F.col("id").alias("own_id"), F.col("key").alias("own_key"))
    repeats = kept(found.where("kept").select("id", "key").join(both, own, "left_semi"))
    if repeats.isEmpty():
        return stay
    one = F.row_number().over(W.partitionBy("own_id", "own_key").orderBy(F.lit(0)))
    again = rows.join(repeats, own, "left_semi").withColumn("one", one).where("one = 1")
    return stay.unionByName(unpacked(again, docs.columns))
