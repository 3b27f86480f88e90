"""Sets that can match at all: those of whose tokens enough are in some other set too.

A set of n tokens shares needed(n) of them with any partner, so each of these is in two different sets at least. Tasks
deal their tokens, as 32 bits within a range of tokens, to these ranges; there the tokens of two or more sets are known,
and each set is credited with its own. A token that a task has itself met in two sets is credited at once and dealt as one
number without its sets, so no token gathers its sets in one task. Ranges are worked through one at a time.
Chance agreement of the 32 bits, and copies of a set in several tasks, can only credit a set with too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import partitions
from .text_sets import TOKEN_MASK, U, chunks, elements

#: Tokens that a task holds before it deals them out, and tokens of one range.
FLUSH, RANGE = 400_000, 2_000_000
_LOW = U(0xFFFFFFFF)


def _slots(token: np.ndarray, ranges: int) -> np.ndarray:
    return (((token >> U(32)) * U(0x9E3779B97F4A7C15)) >> U(32)) % U(ranges)


def _runs(x: np.ndarray) -> np.ndarray:
    """First places of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _met_twice(token: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For tokens side by side: whether sets of different keys have the token."""
    if not len(token):
        return np.empty(0, bool)
    first = _runs(token)
    other = np.concatenate([[False], (key[1:] != key[:-1]) & (token[1:] == token[:-1])])
    return np.repeat(np.logical_or.reduceat(other, first), np.diff(np.append(first, len(token))))


def _credits(token: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and how many different tokens each has."""
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])]) if len(token) else np.empty(0, bool)
    return np.unique(key[new], return_counts=True)


def _blocks(token: np.ndarray, key: np.ndarray, known: np.ndarray, ranges: int) -> tuple[np.ndarray, list[bytes]]:
    """By range: keys, tokens of each key, tokens; then tokens that two sets are known to have."""
    slot, known_slot = _slots(token, ranges), _slots(known, ranges)
    order = np.lexsort((key, slot))
    token, key, slot = (token[order] & _LOW).astype(np.uint32), key[order], slot[order]
    order = np.argsort(known_slot, kind="stable")
    known, known_slot = (known[order] & _LOW).astype(np.uint32), known_slot[order]
    names = np.unique(np.concatenate([slot, known_slot]))
    cut, known_cut = np.append(np.searchsorted(slot, names), len(slot)), np.append(np.searchsorted(known_slot, names), len(known))
    data = []
    for i in range(len(names)):
        part = slice(cut[i], cut[i + 1])
        head = _runs(key[part])
        counts = np.diff(np.append(head, cut[i + 1] - cut[i])).astype(np.uint32)
        sizes = np.array([len(head), cut[i + 1] - cut[i]], np.uint32)
        data.append(b"".join(x.tobytes() for x in (sizes, key[part][head], counts, token[part], known[known_cut[i] : known_cut[i + 1]])))
    return names.astype(np.int64), data


def _meet(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The credits of one range."""
    tokens, keys, seen = [], [], []
    for x in blobs:
        sets, n = np.frombuffer(x, np.uint32, 2).tolist()
        keys.append(np.repeat(np.frombuffer(x, U, sets, 8), np.frombuffer(x, np.uint32, sets, 8 + 8 * sets)))
        tokens.append(np.frombuffer(x, np.uint32, n, 8 + 12 * sets))
        seen.append(np.frombuffer(x[8 + 12 * sets + 4 * n :], np.uint32))
    token, key, known = np.concatenate(tokens), np.concatenate(keys), np.unique(np.concatenate(seen))
    order = np.argsort(token)
    token, key = token[order], key[order]
    on = _met_twice(token, key)
    if len(known) and len(token):
        on |= known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token
    return _credits(token[on], key[on])


def _pair(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, U, n), np.frombuffer(data, np.uint32, n, 8 * n)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys once each, and the sums of their numbers."""
    key, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(of, weights=np.concatenate([h for _, h in parts]), minlength=len(key)).astype(np.int64)


def shared_counts(rows: DataFrame, lines: bool, n_tokens: int) -> DataFrame:
    """(key, hits) of sets by digest: at least as many of a set's tokens as other sets have too. Sets without any are left out."""
    tasks = partitions(rows.sparkSession)
    ranges = max(tasks, -(-n_tokens // RANGE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, turn = 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            token, key = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(token)
            token, key = token[order], key[order]
            twice = _met_twice(token, key)
            known, credited = token[twice], _credits(token[twice], key[twice])
            token, key = token[~twice], key[~twice]
            fresh = _runs(token)  # copies of a set
            names, data = _blocks(token[fresh], key[fresh], known[_runs(known)], ranges)
            # credits have no range: they go to any task, behind the ranges
            names = np.append(names, ranges + turn % ranges)
            data.append(credited[0].tobytes() + credited[1].astype(np.uint32).tobytes())
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], ["slot", "data"])

        for _, texts in chunks(batches):
            e = elements(texts, lines)
            held.append((e.tokens & TOKEN_MASK, e.keys()[e.owner]))
            size += len(e.tokens)
            if size >= FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Credits of this task's ranges, added up as far as memory goes and dealt by key."""
        credited: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def dealt_out() -> pa.RecordBatch:
            key, hits = _added(credited)
            credited.clear()
            slot = ((key * U(0x9E3779B97F4A7C15)) >> U(32)) % U(tasks)
            order = np.argsort(slot, kind="stable")
            key, hits, slot = key[order], hits[order].astype(np.uint32), slot[order]
            first = _runs(slot)
            data = [k.tobytes() + h.tobytes() for k, h in zip(np.split(key, first[1:]), np.split(hits, first[1:]), strict=True)] if len(key) else []
            return pa.RecordBatch.from_arrays([pa.array(slot[first].astype(np.int64)), pa.array(data, pa.binary())], ["slot", "data"])

        at, held = None, []
        for b in batches:
            for slot, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if slot != at and held:
                    credited.append(_meet(held))
                    size += len(credited[-1][0])
                    held = []
                at = slot
                if slot >= ranges:
                    credited.append(_pair(data))
                    size += len(credited[-1][0])
                else:
                    held.append(data)
                if size >= FLUSH:
                    yield dealt_out()
                    size = 0
        if held:
            credited.append(_meet(held))
        if credited:
            yield dealt_out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_pair(data) for b in batches for data in b.column(1).to_pylist()]
        if parts:
            key, hits = _added(parts)
            for s in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[s : s + 100_000].view(np.int64)), pa.array(hits[s : s + 100_000])], ["key", "hits"])

    block = "slot long, data binary"
    dealt = rows.filter("doc is not null").mapInArrow(deal, block)
    met = dealt.repartition(tasks, "slot").sortWithinPartitions("slot").mapInArrow(meet, block)
    return met.repartition(tasks, "slot").mapInArrow(total, "key long, hits long")
