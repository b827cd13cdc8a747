"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Seeds are the n-grams of words of the test items. One pass finds the seeds in every whole text, gathers those of one item
that lie within an item's length, and aligns the item with that stretch of the text: local alignment of words, +2 for a
match, -1 for another word or a gap, divided by the best possible score. Edited or paraphrased copies keep some seeds and
most of the score. Every seed starts an alignment, however many documents hold it, so nothing depends on how often an item
or a version of it occurs; a stretch that holds too few of the item's words for the threshold is not aligned.

The seeds are broadcast in blocks of at most ``BLOCK_WORDS`` words of test items (about 40 MB); a larger benchmark takes
more passes, never a larger broadcast. Nothing of the corpus but the found rows leaves its partition.

Nulls and ties: null and empty texts and items match nothing; an item shorter than a seed is found only in
documents of exactly its words, not inside longer ones; items with a null
id are matched and reported with it; repeated items and documents are each reported. An empty benchmark or corpus gives
no rows. Columns of any other name are carried along by ``without_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm import shingles as sh
from spanveil.llm.common import column, text_of

SEED = 4
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
MATCH, MISS = 2.0, -1.0
_BITS = 22


class Items:
    """A block of test items: word hashes, and the places of every distinct seed."""

    def __init__(self, ids: list, texts: list[str], seed: int):
        self.ids, self.seed = ids, seed
        words, _, _, self.firsts = sh.hashed_words(pa.array(texts, pa.string()))
        self.words = words
        seeds, at = sh.shingle_runs(words, self.firsts, seed)
        item = np.repeat(np.arange(len(ids)), np.diff(at))
        order = np.argsort(seeds, kind="stable")
        self.seeds, first, self.times = np.unique(seeds[order], return_index=True, return_counts=True)
        self.first, self.item = first, item[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose seed is looked for, and the seeds' numbers."""
        at = np.flatnonzero(self.bitmap[(seeds >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.seeds, seeds[at]), len(self.seeds) - 1)
        hit = self.seeds[k] == seeds[at]
        return at[hit], k[hit]

    def matches(self, words: np.ndarray, seeds: np.ndarray, threshold: float) -> list[tuple]:
        """(item, score, first word, last word + 1, seeds) of one text's aligned items."""
        at, which = self.find(seeds)
        if not len(at):
            return []
        times = self.times[which]
        position = np.repeat(at, times)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[which], times)
        item = self.item[place]
        order = np.lexsort((position, item))
        position, item = position[order], item[order]
        length = np.diff(self.firsts)[item]
        edge = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (position[1:] - position[:-1] > length[1:])))
        best: dict[int, tuple] = {}
        for a, b in zip(edge, np.append(edge[1:], len(item)), strict=True):
            k = int(item[a])
            own = self.words[self.firsts[k] : self.firsts[k + 1]]
            low, high = max(0, int(position[a]) - len(own)), min(len(words), int(position[b - 1]) + self.seed + len(own))
            stretch = words[low:high]
            if np.isin(own, stretch).sum() < threshold * len(own):
                continue
            score, end, start = align(own, stretch)
            if score >= threshold and (k not in best or score > best[k][0]):
                best[k] = (score, low + start, low + end, int(b - a))
        return [(k, *v) for k, v in best.items()]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words, row by row: (score / best possible, end, start) of the best local alignment in text."""
    n = len(text)
    steps = np.arange(n + 1) * -MISS
    row, origin = np.zeros(n + 1), np.arange(n + 1)
    best, best_end, best_start = 0.0, 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(text == word, MATCH, MISS)
        up = row[1:] + MISS
        new = np.zeros(n + 1)
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start = np.arange(n + 1)
        start[1:] = np.where(new[1:] <= 0, start[1:], np.where(diagonal >= up, origin[:-1], origin[1:]))
        reach = np.maximum.accumulate(new + steps)
        came = np.maximum.accumulate(np.where(new + steps == reach, np.arange(n + 1), 0))
        row, origin = reach - steps, start[came]
        top = int(row.argmax())
        if row[top] > best:
            best, best_end, best_start = float(row[top]), top, int(origin[top])
    return best / (MATCH * max(1, len(item))), best_end, best_start


def item_blocks(benchmark: DataFrame, item_column: str, text_column: str, seed: int):
    """The items in blocks of bounded size, each brought to the driver in its turn."""
    items = benchmark.select(column(item_column).alias("id"), text_of(text_column).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(total) // (BLOCK_WORDS * 5)) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id", "text").collect()
        if rows:
            yield Items([r["id"] for r in rows], [r["text"] for r in rows], seed)


def seeds_of(texts: pa.Array, seed: int):
    """Of a batch of texts: word hashes, each text's first word, seeds, each text's first seed."""
    words, _, _, firsts = sh.hashed_words(texts)
    return words, firsts, *sh.shingle_runs(words, firsts, seed)


def prepared(docs: DataFrame, benchmark: DataFrame, item_column, item_text, seed):
    """Broadcasts of all blocks."""
    for items in item_blocks(benchmark, item_column, item_text, seed):
        yield docs.sparkSession.sparkContext.broadcast(items)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    seed: int = SEED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """A row for each document and test item it holds: id, item_id, score, start, end (words), n_seeds."""
    kinds = dict(docs.dtypes)[id_column], dict(benchmark.dtypes)[item_column]
    schema = f"id {kinds[0]}, item_id {kinds[1]}, score double, start bigint, end bigint, n_seeds bigint"
    narrow = docs.select(column(id_column).alias("id"), text_of(text_column).alias("text"))
    found = None
    for shared in prepared(docs, benchmark, item_column, item_text, seed):
        part = narrow.mapInArrow(_pairs(shared, threshold), schema)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _pairs(shared, threshold):
    def work(batches):
        items = shared.value
        for whole in batches:
            for batch in sh.slices(whole, 1):
                words, firsts, seeds, at = seeds_of(batch.column(1), items.seed)
                position, _ = items.find(seeds)
                rows, found = [], []
                for t in np.unique(np.searchsorted(at, position, side="right") - 1):
                    for m in items.matches(words[firsts[t] : firsts[t + 1]], seeds[at[t] : at[t + 1]], threshold):
                        rows.append(int(t))
                        found.append(m)
                if found:
                    item, *rest = zip(*found, strict=True)
                    yield pa.Table.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array([items.ids[k] for k in item]), *map(pa.array, rest)],
                        names=["id", "item_id", "score", "start", "end", "n_seeds"],
                    ).to_batches()[0]

    return work


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    seed: int = SEED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that hold no test item, with the columns of ``docs``."""
    def holds(shared):
        def work(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            items = shared.value
            for part in parts:
                out = []
                for batch in sh.slices(pa.RecordBatch.from_arrays([part], names=["text"]), 0):
                    words, firsts, seeds, at = seeds_of(batch.column(0), items.seed)
                    flags = np.zeros(batch.num_rows, bool)
                    position, _ = items.find(seeds)
                    for t in np.unique(np.searchsorted(at, position, side="right") - 1):
                        own = words[firsts[t] : firsts[t + 1]], seeds[at[t] : at[t + 1]]
                        flags[t] = bool(items.matches(*own, threshold))
                    out.append(flags)
                yield pa.array(np.concatenate(out) if out else np.zeros(0, bool))

        return F.arrow_udf(work, "boolean")

    rows = docs
    for shared in prepared(docs, benchmark, item_column, item_text, seed):
        rows = rows.where(~holds(shared)(text_of(text_column)))
    return rows
