"""Word-shingle sets of documents or lines, hashed for whole batches with numpy; and fixed-size sums over all tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered. A set is the distinct five-word shingles of an element
(or shingles of another width that the caller asks for); an element of fewer words has its whole sequence as its one shingle. Shingles are 58-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BASE, mix, span_hashes

U = np.uint64
SHINGLE_WORDS = 5
TOKEN_BITS = 58
TOKEN_MASK = U((1 << TOKEN_BITS) - 1)
#: Counters of the rarity sketch, and the blocks it is merged in: fixed, whatever the input's size.
SKETCH, BLOCKS = 1 << 20, 64
#: Bytes of text hashed at once.
CHUNK = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES = mix((np.arange(256, dtype=U) + U(1)) * BASE)[_LOWER]
_LOWERED = bytes(_LOWER.tolist())
#: The lower bytes of a word of 64 bits, by their number; the most pieces of eight bytes that a word is hashed by.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
PIECES = 16


class Elements(NamedTuple):
    """Sets of the elements of some texts: row of each element's text, its line, its tokens from starts[i] on."""

    row: np.ndarray
    line: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    owner: np.ndarray

    def keys(self, salt: int = 0) -> np.ndarray:
        """A 64-bit digest of each set."""
        if not len(self.starts):
            return np.empty(0, U)
        return mix(np.add.reduceat(mix((self.tokens & TOKEN_MASK) + U(salt)), self.starts) + self.sizes.astype(U))


def _word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], eight bytes at a time; behind the last word lie eight bytes more."""
    at = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))  # eight bytes from every place on
    size = end - start
    h = mix(at[start] & _FIRST[np.minimum(size, 8)]) + size.astype(U)
    on = np.flatnonzero(size > 8)
    for k in range(1, PIECES):
        if not len(on):
            break
        h[on] = mix(h[on] + (at[start[on] + 8 * k] & _FIRST[np.minimum(size[on] - 8 * k, 8)]))
        on = on[size[on] > 8 * (k + 1)]
    if len(on):  # longer words byte by byte
        stop = np.cumsum(size[on])
        h[on] = span_hashes(_BYTES[np.frombuffer(b"".join(data[s:e] for s, e in zip(start[on].tolist(), end[on].tolist(), strict=True)), np.uint8)], stop - size[on], stop)
    return mix(h)


def _after(start: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the ascending cuts lie before each of the ascending starts."""
    return np.repeat(np.arange(len(cuts) + 1), np.diff(np.concatenate([[0], np.searchsorted(start, cuts), [len(start)]])))


def elements(texts: list[str], lines: bool, levels: np.ndarray | None = None, width: int = SHINGLE_WORDS) -> Elements:
    """The sets, tokens ascending; with levels (of the sketch's counters) rare tokens come first, then by hash.

    lines: an element is a line, else a whole text, of one word or more. width: words of a shingle.
    """
    parts = [t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = b"\n".join([*parts, bytes(8)]).translate(_LOWERED)
    raw = np.frombuffer(data, np.uint8)[:-8]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = (raw != 32) & (raw - np.uint8(9) > 4)
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    w = _word_hashes(data, start, end)
    breaks = np.flatnonzero(raw == 10) if lines else ends
    of = _after(start, breaks)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(of)))
    name = of[first]
    n = np.where(count >= width, count - width + 1, 1)
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    a = np.repeat(first - (stop - n), n) + np.arange(total)
    h = span_hashes(w, a, a + np.repeat(np.minimum(count, width), n))
    owner = np.repeat(np.arange(len(first)), n)
    token = h >> U(64 - TOKEN_BITS)
    if levels is not None:
        token |= levels[(token & U(SKETCH - 1)).astype(np.int64)].astype(U) << U(TOKEN_BITS)
    # sorted by element and the token's upper bits at once; where these leave tokens of an element in doubt, by the whole token
    bits = U(max(len(first) - 1, 1).bit_length())
    key = (owner.astype(U) << (U(64) - bits)) | (token >> bits)
    order = np.argsort(key)
    near, apart = np.diff(key[order]) == 0, np.diff(token[order]) != 0
    if (near & apart).any():
        order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    keep = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]) if total else np.empty(0, bool)
    token, owner = token[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(first))
    starts = np.cumsum(sizes) - sizes
    if lines:
        at = start[first]
        row = np.searchsorted(ends, at, side="right")
        base = np.concatenate([[0], ends])[row]
        line = name - np.searchsorted(breaks, base)
    else:
        row, line = name, np.zeros(len(name), np.int64)
    return Elements(row, line, starts, sizes, token, owner)


def chunks(batches: Iterator[pa.RecordBatch], chars: int = CHUNK) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``chars`` characters from batches of (doc_id, text), a few rows of a batch at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            part = batch.slice(s, 64)
            new = [x or "" for x in part.column(1).to_pylist()]
            ids += part.column(0).to_pylist()
            texts += new
            size += sum(map(len, new))
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def parts_of(counts: np.ndarray, task: int) -> pa.RecordBatch:
    """A task's counters as BLOCKS compressed rows (block, salt, data)."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    data = [press.compress(x.tobytes()) for x in np.split(counts, BLOCKS)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(BLOCKS), pa.int32()), pa.array([task % 64] * BLOCKS, pa.int32()), pa.array(data, pa.binary())], ["block", "salt", "data"])


def merged(parts: DataFrame, kind: type, how: Callable) -> np.ndarray:
    """Element-wise ``how`` of all tasks' counters: by (block, salt), then by block; the result's size is fixed."""
    import zstandard

    def combine(key, table):
        open_, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        total = None
        for x in table["data"]:
            one = np.frombuffer(open_.decompress(x.as_py()), kind)
            total = one.copy() if total is None else how(total, one, out=total)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "data": pa.array([press.compress(total.tobytes())], pa.binary())})

    schema = "block int, salt int, data binary"
    rows = parts.select("block", "salt", "data").groupBy("block", "salt").applyInArrow(combine, schema).groupBy("block").applyInArrow(combine, schema)
    data = {r["block"]: r["data"] for r in rows.collect()}
    open_ = zstandard.ZstdDecompressor()
    return np.concatenate([np.frombuffer(open_.decompress(bytes(data[b])), kind) for b in range(BLOCKS)]) if data else np.empty(0, kind)


def rarity_levels(counts: np.ndarray) -> np.ndarray:
    """Level of each counter: 0 up to what chance puts into a counter, then four levels for each doubling above."""
    if not len(counts):
        return np.zeros(SKETCH, np.uint8)
    usual = float(np.median(counts))
    above = np.maximum(counts - (usual + 4 * np.sqrt(usual) + 2), 0)
    return np.minimum(62, np.ceil(4 * np.log2(1 + above))).astype(np.uint8)


def level_weights() -> np.ndarray:
    """About how many other elements share a token, by level."""
    return np.exp2(np.arange(64) / 4) - 1


def members(ids: list, lines: np.ndarray | None = None) -> np.ndarray:
    """64-bit numbers for a Bloom filter: of documents, or of their lines."""
    x = mix(np.array([0 if i is None else i for i in ids], np.int64).astype(U))
    return x if lines is None else mix(x + lines.astype(U) + U(1))


class Bloom:
    """A Bloom filter of 2^k bits. False positives cost work, never results."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.last = U(len(bits) * 8 - 1)

    @classmethod
    def of_size(cls, bits: int) -> Bloom:
        return cls(np.zeros(bits // 8, np.uint8))

    def _places(self, x: np.ndarray) -> list[np.ndarray]:
        again = mix(x + U(1)) | U(1)
        return [((x + U(i) * again) & self.last).astype(np.int64) for i in range(4)]

    def add(self, x: np.ndarray) -> None:
        for p in self._places(x):
            np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for p in self._places(x):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


#: Bits a member, the smallest filter, and the largest that is sent to every task (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def bloom_bits(members_: int) -> int:
    """The filter's size for so many members: a power of two."""
    return max(LEAST_BITS, 1 << (BITS_EACH * max(members_, 1) - 1).bit_length())


def bloom_of(ids: DataFrame, per_line: bool, bits: int) -> np.ndarray:
    """The bits of all (doc, line) rows: their documents, and with per_line their lines too."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Bloom.of_size(bits)
        for b in batches:
            docs = b.column(0).to_pylist()
            filter_.add(members(docs))
            if per_line:
                filter_.add(members(docs, b.column(1).to_numpy()))
        yield parts_of(filter_.bits, TaskContext.get().partitionId())

    found = merged(ids.select("doc", F.col("line").cast("long")).mapInArrow(run, "block int, salt int, data binary"), np.uint8, np.bitwise_or)
    return found if len(found) else np.zeros(bits // 8, np.uint8)


def id_filter(rows: DataFrame, wanted: DataFrame, per_line: bool = False) -> tuple[DataFrame, Callable[[np.ndarray], np.ndarray]]:
    """Rows (doc, ...) that may hold a wanted (doc, line), and a test of members() for use within tasks.

    A Bloom filter sized by the number of wanted rows is sent to the tasks; where it would be larger than MOST_BITS, the rows
    are joined with the wanted documents instead and the test lets everything through.
    """
    wanted = wanted.select("doc", "line" if per_line else F.lit(0).alias("line"))
    bits = bloom_bits(wanted.count() * (2 if per_line else 1))
    if bits > MOST_BITS:
        return rows.join(wanted.select("doc").distinct(), "doc", "left_semi"), lambda x: np.ones(len(x), bool)
    sent = rows.sparkSession.sparkContext.broadcast(bloom_of(wanted, per_line, bits))
    return rows, lambda x: Bloom(sent.value).has(x)
