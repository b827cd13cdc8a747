"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text becomes counts of hashed byte 4-grams and of 3-grams of character classes (lower case, capital, digit, blank, each
sign), as log counts times inverse document frequency. The frequencies count every document of the corpus. The space is
the truncated SVD of a labelled sample of at most ``per_class`` documents of each label (a documented bound; labels
count by their share of all labelled rows, so the sample's balance doesn't shift the votes). The labelled vectors are
broadcast: their number is bounded by the sample. Every document then meets all of them in blocked matrix products of
unit vectors, exactly; its ``neighbours`` nearest ones vote, weighted by a power of their cosine.

Learning uses only rows whose crc32(id as text) mod 4 is not 2. The score reads the text alone.

Nulls and ties: null and empty texts have no direction and get the share of label 1; null labels and ids are left out of
learning, a document labelled twice counts with its smaller label; equal cosines at the edge of the neighbourhood are
settled by the order of the sample. Without labelled rows every score is 0.5. An empty table gives no rows. Columns of
any other name are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm import shingles as sh
from spanveil.llm.common import column, packed, text_of, unpacked

GRAMS, SHAPES = 2048, 1024
FEATURES = GRAMS + SHAPES
PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 25
POWER = 16
REJECT_BELOW = 0.7
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3


def counts(texts: pa.Array) -> np.ndarray:
    """Feature counts, one row per text (null is empty)."""
    texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros((0, FEATURES), np.float32)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    out = np.zeros((n, FEATURES), np.float32)
    if offsets[-1] - offsets[0] < 4:
        return out
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    inside = owner[3:] == owner[:-3]
    row = owner[:-3][inside]
    x = raw.astype(np.uint32)
    gram = x[:-3] | (x[1:-2] << 8) | (x[2:-1] << 16) | (x[3:] << 24)
    gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(21))[inside]
    c = _CLASS[raw].astype(np.uint32)
    shape = c[:-3] | (c[1:-2] << 8) | (c[2:-1] << 16)
    shape = ((shape * np.uint32(0x85EBCA77)) >> np.uint32(22))[inside]
    out[:, :GRAMS] = np.bincount(row * GRAMS + gram, minlength=n * GRAMS).reshape(n, GRAMS)
    out[:, GRAMS:] = np.bincount(row * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    return out


def weighted(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times idf; both groups of features have length 1 in every row."""
    x = np.log1p(table) * idf
    for part in (x[:, :GRAMS], x[:, GRAMS:]):
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        part /= np.where(norm > 0, norm, 1)
    return x


def document_frequency(docs: DataFrame, text_column: str) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents. Every partition gives one short row."""

    def work(batches):
        found, n = np.zeros(FEATURES, np.int64), 0
        for whole in batches:
            for batch in sh.slices(whole, 0, rows=256, chars=2 << 20):
                found += (counts(batch.column(0)) > 0).sum(0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, FEATURES)), pa.array(np.append(n, found))], names=["feature", "n"]
        )

    parts = docs.select(text_of(text_column).alias("text")).mapInArrow(work, "feature bigint, n bigint")
    total = np.zeros(FEATURES + 1, np.int64)
    for r in parts.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows
        total[r["feature"] + 1] = r["n"]
    return total[1:], int(total[0])


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs, labels, id_column, text_column, label_column, label_id, per_class):
    """(texts' counts, labels, weights) of the sample; at most ``per_class`` rows of each label reach the driver."""
    known = (
        labels.select(column(label_id).alias("__id"), column(label_column).cast("int").alias("__label"))
        .where("__id is not null and __label in (0, 1)").where(~held_out(F.col("__id")))
        .groupBy("__id").agg(F.min("__label").alias("__label"))
    )
    totals = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = known.where(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    rows = docs.select(column(id_column).alias("__doc"), text_of(text_column).alias("text")).join(
        F.broadcast(picked), F.col("__doc") == F.col("__id")
    )
    one = rows.groupBy("__id").agg(F.first("__label").alias("label"), F.min("text").alias("text"))

    def work(batches):
        for whole in batches:
            for batch in sh.slices(whole, 2, rows=256, chars=2 << 20):
                table = counts(batch.column(2))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([t.astype(np.float32).tobytes() for t in table], pa.binary())],
                    names=["id", "label", "counts"],
                )

    kind = dict(one.dtypes)["__id"]
    got = one.select("__id", "label", "text").mapInArrow(work, f"id {kind}, label int, counts binary").orderBy("id").collect()
    table = np.frombuffer(b"".join(r["counts"] for r in got), np.float32).reshape(-1, FEATURES)
    labels_ = np.array([r["label"] for r in got], np.float32)
    weights = np.array([totals.get(int(x), 0) / max(1, (labels_ == x).sum()) for x in labels_], np.float32)
    return table, labels_, weights / max(weights.sum(), 1e-9)


class Model:
    """idf, the projection, and the labelled vectors: a few MB, whatever the corpus holds."""

    def __init__(self, idf, basis, vectors, labels, weights, neighbours, power):
        self.idf, self.basis, self.vectors, self.labels, self.weights = idf, basis, vectors, labels, weights
        self.neighbours, self.power = min(neighbours, len(labels)), power
        self.prior = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5

    def scores(self, table: np.ndarray) -> np.ndarray:
        if not len(self.labels) or not len(table):
            return np.full(len(table), self.prior)
        x = weighted(table, self.idf) @ self.basis
        norm = np.linalg.norm(x, axis=1)
        cosine = (x / np.where(norm > 0, norm, 1)[:, None]) @ self.vectors.T
        near = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, : self.neighbours]
        close = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** self.power * self.weights[near]
        total = close.sum(1)
        votes = (close * self.labels[near]).sum(1)
        score = np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)
        return np.clip(np.where(norm > 0, score, self.prior), 0.0, 1.0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    label_id: str = "doc_id",
    per_class: int = PER_CLASS,
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
    power: int = POWER,
) -> Model:
    table, own, weights = labelled_sample(docs, labels, id_column, text_column, label_column, label_id, per_class)
    found, n = document_frequency(docs, text_column)
    idf = np.log((1 + n) / (1 + found)).astype(np.float32)
    return fitted(table, own, weights, idf, dimensions, neighbours, power)


def fitted(table, own, weights, idf, dimensions, neighbours, power) -> Model:
    x = weighted(table, idf)
    rng, basis = np.random.default_rng(7), np.zeros((FEATURES, 1), np.float32)
    if len(own):
        k = min(dimensions + 16, *x.shape)
        q = rng.standard_normal((FEATURES, k)).astype(np.float32)
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        basis = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :dimensions].astype(np.float32)
    vectors = x @ basis
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Model(idf, basis, vectors / np.where(norm > 0, norm, 1), own, weights, neighbours, power)


def scored(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], names=["text"])
            found = [model.scores(counts(b.column(0))) for b in sh.slices(batch, 0, rows=256, chars=2 << 20)]
            yield pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())

    score = F.arrow_udf(work, "double")
    return docs.withColumn(name, score(text_of(text_column)))


def accepted(docs: DataFrame, labels: DataFrame, least: float = REJECT_BELOW, **options) -> DataFrame:
    """The documents whose score is not below ``least``, with the columns of ``docs``."""
    model = fit(docs, labels, **options)
    text = options.get("text_column", "text")
    rows = scored(docs.select(packed(docs), column(text).alias("text")), model, "text")
    return unpacked(rows.where(F.col("score") >= least), docs.columns)
