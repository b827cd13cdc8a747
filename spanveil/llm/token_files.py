"""Token ids in ORC files: run-length encoded integers, row indexes, and Bloom filters on the document id.

Documents are dealt by ranges of (id, text digest) and sorted, encoded where they lie, and written in that order; part
numbers follow the ranges. ORC encodes the ids with its integer run-length encoding, keeps minima and maxima for every
stripe and every ``row_stride`` rows, and a Bloom filter on ``doc_id``, so a reader takes stripes in parallel and a
lookup by id skips the stripes and row groups that can't hold it. Each row also holds its part and the ids before it in
that part; with one sum per part this gives the place of a document among all ids without sorting anything again.

Encoding is the tokenizers library's. The split before its merges never crosses the place before a run of blanks and line
feeds, nor that between an ASCII letter and another ASCII character, so texts are cut there; each distinct piece of a
batch is encoded once, and pieces' ids are remembered (a bounded table per worker). Texts with other white space, and
those with the end token's name in them, go to the library whole.

Nulls and ties: a null text is empty and has the end id only; null ids come first and are written as null; repeated ids
are ordered by their text's digest, equal rows are interchangeable. An empty table gives empty files and no rows.
"""

from __future__ import annotations

import array
import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.llm.common import column, setting, text_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CACHED_PIECES, CACHED_CHARS = 340_000, 48  # remembered by a worker, and their longest
ROWS_AT_ONCE, CHARS_AT_ONCE = 1000, 2 << 20
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
_ENCODED = T.StructType([SCHEMA["doc_id"], SCHEMA["part"], SCHEMA["before"], SCHEMA["n_tokens"], SCHEMA["ids"]])
# texts with other blanks than " " and "\n", or perhaps with the end token's name, aren't cut
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<[|]")
_BYTES = np.arange(256)
_BLANK, _LETTER = np.isin(_BYTES, (10, 32)), np.isin(_BYTES | 32, range(97, 123)) & (_BYTES < 128)
_OTHER = (_BYTES < 128) & ~_LETTER


class Encoder:
    """Ids of whole texts, the library's own, with a bounded table of the pieces met so far."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        split, tokenize = regex.compile(public_tokenizers.PATTERN).findall, self.tokenizer.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in set(plain))
        shown = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}  # the byte-level alphabet
        blank = chr(shown[32])

        def ids_of(piece: str) -> bytes:
            word = piece[1:] if piece[0] == " " else piece
            if word.isascii() and word.isalpha():  # one word for the split too
                return array.array("I", [t.id for t in tokenize(word if word is piece else blank + word)]).tobytes()
            if _ODD.search(piece):
                return array.array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
            found = array.array("I")
            for word in split(piece):
                found.extend([t.id for t in tokenize(word.encode().decode("latin-1").translate(shown))])
            return found.tobytes()

        self.ids_of, self.young, self.old = ids_of, {}, {}

    def pieces_ids(self, pieces: np.ndarray) -> list[bytes]:
        """Ids of each piece. The table has two generations: when the young one is full it replaces the old one, so what
        is met often stays. Long pieces are not remembered."""
        young, old, found = self.young, self.old, []
        for piece in pieces:
            ids = young.get(piece)
            if ids is None:
                ids = old.get(piece) or self.ids_of(piece)
                if len(piece) <= CACHED_CHARS:
                    if len(young) >= CACHED_PIECES // 2:
                        self.old, self.young = old, young = young, {}
                    young[piece] = ids
            found.append(ids)
        return found

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id behind, and the number of ids up to and with each text."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets - offsets[0]
        at = np.flatnonzero(cuts(raw, starts, pc.match_substring_regex(texts, _ODD.pattern).to_numpy(zero_copy_only=False)))
        edges = pa.py_buffer(np.append(at, len(raw)).astype(np.int32))
        pieces = pa.StringArray.from_buffers(len(at), edges, data.slice(int(offsets[0]), len(raw))).dictionary_encode()
        found = self.pieces_ids(pieces.dictionary.to_numpy(zero_copy_only=False))
        found.append(np.uint32(end_id).tobytes())
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        firsts = np.cumsum(sizes, dtype=np.int32) - sizes
        last = np.searchsorted(at, starts[1:])  # the end id goes before the first piece of the next text
        which = np.insert(pieces.indices.to_numpy(), last, len(found) - 1)
        n_ids = sizes[which]
        ends = np.cumsum(n_ids, dtype=np.int32)
        place = np.repeat(firsts[which] - ends + n_ids, n_ids)
        place += np.arange(len(place), dtype=np.int32)
        values = np.frombuffer(b"".join(found), np.int32)[place]
        return values, ends[last + np.arange(n)]


def cuts(raw: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte. ``starts``: first byte of each text and the end; ``whole``: texts left uncut."""
    blank, letter = _BLANK[raw], _LETTER[raw]
    begins = np.zeros(len(raw), bool)
    begins[1:] = (blank[1:] & ~blank[:-1]) | (letter[:-1] & _OTHER[raw[1:]])
    for k in np.flatnonzero(whole):
        begins[starts[k] : starts[k + 1]] = False
    begins[starts[:-1][starts[:-1] < starts[1:]]] = True
    return begins


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process, kept between its tasks."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch, text_at: int):
    """Pieces of a batch with a bounded number of rows and characters (a longer text comes alone)."""
    lengths = pc.utf8_length(batch.column(text_at)).to_numpy(zero_copy_only=False)
    start, chars = 0, 0
    for k, n in enumerate(lengths):
        if k > start and (k - start >= ROWS_AT_ONCE or chars + n > CHARS_AT_ONCE):
            yield batch.slice(start, k - start)
            start, chars = k, 0
        chars += n
    if len(lengths) > start:
        yield batch.slice(start)


def encoded(docs: DataFrame, id_column: str, text_column: str, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of the files, in order within each partition."""
    path = public_tokenizers.path(tokenizer)

    def encode(batches):
        coder, before = encoder(path), 0
        pa.default_memory_pool().release_unused()  # what earlier steps left to a reused worker
        for whole in batches:
            for batch in _slices(whole, 2):
                values, ends = coder.ids(batch.column(2), end_id)
                sizes = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(before + ends - sizes), pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values)),
                    ],
                    names=_ENCODED.names,
                )
                before += int(ends[-1])

    ordered = (
        docs.select(column(id_column).cast("bigint").alias("doc_id"), text_of(text_column).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .select("doc_id", F.spark_partition_id().alias("part"), "text")
    )
    return ordered.mapInArrow(encode, _ENCODED)


def write_token_files(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    stripe_bytes: int = 64 << 20,
    row_stride: int = 10_000,
    bloom_fpp: float = 0.01,
) -> None:
    # few rows at once: a batch of whole texts stands in the executor's and the worker's memory at the same time
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE)):
        (
            encoded(docs, id_column, text_column, tokenizer, end_id)
            .write.mode("errorifexists")
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", str(bloom_fpp))
            .option("orc.create.index", "true")
            .option("orc.row.index.stride", str(row_stride))
            .option("orc.stripe.size", str(stripe_bytes))
            .option("orc.encoding.strategy", "COMPRESSION")
            .option("compression", "zstd")
            .orc(path)
        )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids`` the filter reaches the ORC reader, which prunes by its metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Checksums are computed where the ids are read. Only one row per part crosses the network.
    """
    rows = read_token_files(spark, path)
    from pyspark.sql import Window as W

    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))

    def checksums(batches):
        for batch in batches:
            lists = batch.column(4)
            values, at = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in itertools.pairwise(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sums, pa.int64())], names=[*batch.schema.names[:4], "ids_crc32"]
            )

    fields = T.StructType([*SCHEMA.fields[:4], T.StructField("ids_crc32", T.LongType())])
    return (
        rows.mapInArrow(checksums, fields).join(bases, "part")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
