"""Word shingles, their sets and min-wise sketches for whole Arrow batches, in numpy, inside Python workers.

Words are those of ``common.words_of``; they are found and hashed in the UTF-8 bytes of a batch without a Python loop
over words. A text with fewer words than a shingle has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SHINGLE = 5
SKETCH = 128  # positions of a sketch
ROUNDS = 16
_rng = np.random.default_rng(20240501)
_BYTES = _rng.integers(0, 1 << 64, (256, 256), dtype=np.uint64)  # one random number for each byte and place in a word
_PLACES = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
HASHED_BYTES = 256 << 10  # hashed at once, about 32 bytes of memory for each
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications with xor shifts)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text_at: int, rows: int = 2048, chars: int = 2 << 20):
    """Pieces of a batch with bounded rows and text (a longer text comes alone)."""
    column = batch.column(text_at)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    start = 0
    for k in range(1, len(column) + 1):
        if k == len(column) or k - start >= rows or offsets[k + 1] - offsets[start] > chars:
            yield batch.slice(start, k - start)
            start = k


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of non-null strings: every word's hash, its first and last byte + 1 in the array's data, and each
    text's first word (one more entry at the end)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    none = np.empty(0, np.int64)
    if n == 0 or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), none, none, np.zeros(n + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    found, lo = [], 0
    while lo < len(raw):
        hi = _word_end(raw, lo + HASHED_BYTES)
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi)] - lo
        found.append([part + lo if k else part for k, part in enumerate(_hashed(_LOWER[raw[lo:hi]], inner))])
        lo = hi
    hashes, starts, ends = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def _word_end(raw: np.ndarray, at: int) -> int:
    """The first byte from ``at`` on that is in no word, or the end."""
    while at < len(raw):
        outside = np.flatnonzero(~_IS_WORD[_LOWER[raw[at : at + 4096]]])
        if len(outside):
            return at + int(outside[0])
        at += 4096
    return len(raw)


def _hashed(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last byte + 1 of the words of these lower-case bytes; texts begin at 0 and at ``cuts``."""
    word = _IS_WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[cuts] = word[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    inside = np.flatnonzero(word)
    first = np.flatnonzero(begins[inside])
    sizes = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    values = _BYTES[raw[inside], place & 255]
    if sizes.max() > 256:
        values = values * (2 * (place >> 8) + 1).astype(np.uint64)
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64)), starts, starts + sizes


def shingle_runs(words: np.ndarray, firsts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and each text's first one (one more entry at the end)."""
    counts = np.diff(firsts)
    n = len(words)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : n - width + 1 + k] * _PLACES[k]
        rolled = mix(rolled)
    else:
        rolled = np.empty(0, np.uint64)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    out_first = np.append(0, ends)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    text = np.repeat(np.arange(len(counts)), sizes)
    source = np.arange(len(out)) - out_first[text] + firsts[text]
    long = counts[text] >= width
    out[long] = rolled[source[long]]
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[firsts[t] : firsts[t + 1]]
        out[out_first[t]] = mix(np.array([(own * _PLACES[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
    return out, out_first


def distinct_sets(shingles: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, and where each text begins."""
    sets = [np.unique(shingles[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else shingles[:0]), np.append(0, np.cumsum(sizes))


def sketches(members: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One min-wise sample per position for every set, as an n x SKETCH matrix (all NOTHING for an empty set).

    Round by round each member falls into one position, and a position keeps its smallest member of the first round
    that reached it; positions that no round reached take the minimum over all members. Two sets agree at a position
    with the probability of their Jaccard similarity, whatever their sizes, at one pass over large sets.
    """
    n = len(firsts) - 1
    out = np.full(n * SKETCH, NOTHING)
    owner = np.repeat(np.arange(n), np.diff(firsts))
    active, own = members, owner
    for r in range(ROUNDS):
        x = mix(active + np.uint64((r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        np.minimum.at(out, own * SKETCH + (x & np.uint64(SKETCH - 1)).astype(np.int64), (np.uint64(r) << np.uint64(58)) | (x >> np.uint64(7)))
        open_sets = (out.reshape(n, SKETCH) == NOTHING).any(1) if n else np.zeros(0, bool)
        keep = open_sets[own]
        active, own = active[keep], own[keep]
        if not len(active):
            break
    table = out.reshape(n, SKETCH)
    for t in np.unique(own):
        holes = np.flatnonzero(table[t] == NOTHING)
        own_members = members[firsts[t] : firsts[t + 1]]
        x = mix(own_members[:, None] ^ mix(holes.astype(np.uint64) + np.uint64(1 << 40))[None, :])
        table[t, holes] = (np.uint64(ROUNDS) << np.uint64(58)) | (x.min(0) >> np.uint64(6))
    return table


def short_sketches(table: np.ndarray) -> np.ndarray:
    """32 bits of each sample."""
    return (mix(table) >> np.uint64(32)).astype(np.uint32)


def set_digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def groups_of(batches, keys: int):
    """Rows of sorted batches by their first ``keys`` integer columns: (key, record batches of the group)."""
    pending, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            changed |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(int(c[a]) for c in cols)
            if key != last and pending:
                yield last, pa.Table.from_batches(pending)
                pending = []
            last = key
            pending.append(batch.slice(a, b - a))
    if pending:
        yield last, pa.Table.from_batches(pending)
