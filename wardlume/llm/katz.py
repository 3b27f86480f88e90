"""Katz backoff language model over word bigrams, trained on part of the corpus and scored over all of it.

Counts C(v, w) and c(w) are Good-Turing discounted up to K_MAX. Every context reserves one count, so for a word seen
after v:  P(w | v) = d(C) C / (c(v) + 1),  and otherwise  P(w | v) = alpha(v) P(w),  with
alpha(v) = A(v) / (c(v) + 1),  A(v) = (1 + sum of C (1 - d(C)) over seen w) / (1 - sum of P(w) over seen w).
P(w) = d1(c) c / (N + 1); unseen words are one type that has the rest. Each distribution sums to one exactly.

How it runs. A fixed number of frequent words get short codes and exact counts (small dense arrays, summed over
tasks). Every token goes once, with its predecessor and document, to the range of its word (of its word pair, for
frequent words, so that no word gathers in one task). There its pair's count and its word's count are known, and
logarithms and counts-of-counts are added up per document, since a score is linear in the logarithms of the few discounts.
Contexts' statistics are summed densely for frequent words and dealt by context for the others. Only the
totals of pairs' counts (a few numbers), the dense tables and the discounts ever reach the driver.

Tables in the shared folder: ``katz-parts`` (a column kind: document sums, pending contexts, context types); none of discounted counts or backoff weights.

Defined results: a null text counts as empty, so its document is the end token alone; a null doc_id trains; repeated rows
count and score one by one; an empty table gives an empty result; words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Lookup, mix, span_hashes
from .shared import release, written
from .text_sets import _BYTES, _SPACE, U, chunks, merged, parts_of

K_MAX = 4
#: Frequent words with a code; the last code says that the hash follows. Fixed, whatever the input's size.
CODES = (1 << 16) - 1
RARE = np.uint16(CODES)
START, END = U(0x5354415254), U(0x454E44)
#: Tokens of one chunk of documents and of one range of words.
CHUNK_TOKENS, RANGE_TOKENS = 500_000, 2_500_000
SUMS = np.dtype([("chunk", "<u8"), ("doc", "<u2"), ("known", "<u4"), ("l1", "<f8"), ("s", "<f8"), ("m", "<u4", K_MAX), ("b", "<u4", K_MAX + 1), ("large", "<u4")])
FIELDS = 2 * K_MAX + 1
#: A partition numbers its chunks in so many bits of 64: more than it can hold.
CHUNK_BITS = 33


def _home(chunk: np.ndarray, ranges: int) -> np.ndarray:
    """The slot where all that belongs to a chunk of documents meets."""
    return (mix(chunk.astype(U)) % U(ranges)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each compressed, columns of records apart."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    flat = []
    for a in arrays:
        flat += [np.ascontiguousarray(a[n]) for n in a.dtype.names] if a.dtype.names else [a]
    parts = [press.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()) if len(x) else b"" for x in flat]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack(data: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    import zstandard

    open_, at, out = zstandard.ZstdDecompressor(), 0, []

    def one(kind: np.dtype) -> np.ndarray:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "little")
        raw = np.frombuffer(open_.decompress(data[at + 4 : at + 4 + size]) if size else b"", np.uint8)
        at += 4 + size
        return np.ascontiguousarray(raw.reshape(kind.base.itemsize, -1).T).view(kind.base).reshape(-1, *kind.shape)

    for kind in map(np.dtype, kinds):
        if kind.names:
            columns = {n: one(kind[n]) for n in kind.names}
            record = np.empty(len(columns[kind.names[0]]), kind)
            for n, x in columns.items():
                record[n] = x.reshape(record[n].shape)
            out.append(record)
        else:
            x = one(kind)
            out.append(x.reshape(-1))
    return out


def _held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in turn: words' hashes and an end each; the text of every token; tokens of every text."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    word = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    w = span_hashes(_BYTES[raw], edges[::2], edges[1::2])
    of = np.searchsorted(ends, edges[::2], side="right")
    n = np.bincount(of, minlength=len(texts)) + 1
    token = np.empty(int(n.sum()), U)
    token[np.arange(len(w)) + of] = w
    token[np.cumsum(n) - 1] = END
    return token, np.repeat(np.arange(len(texts)), n), n


def _frequent(rows: DataFrame) -> np.ndarray:
    """Hashes of the CODES words that tasks report most often; any choice is right, a good one is short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            word, n = word[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for _, texts in chunks(batches):
            token, _, _ = _tokens(texts)
            held.append(token)
            size += len(token)
            if size > RANGE_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    top = rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(CODES - 2)
    words = np.array([r["word"] for r in top.select("word").collect()], np.int64).view(U)
    return np.concatenate([[START, END], words[(words != END) & (words != START)]]).astype(U)


def _counted(rows: DataFrame, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Exact training counts of the frequent words (START: training documents), and all tokens of the corpus."""
    common = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = len(common.value), Lookup(common.value, np.arange(len(common.value)))
        counts = np.zeros(CODES + 1, np.int64)
        for ids, texts in chunks(batches):
            token, doc, _ = _tokens(texts)
            train = ~_held_out(ids)
            code = codes(token[train[doc]])
            counts += np.bincount(code[code < known], minlength=CODES + 1)
            counts[0] += train.sum()
            counts[CODES] += len(token)
        yield parts_of(counts, TaskContext.get().partitionId())

    counts = merged(rows.mapInArrow(run, "block int, salt int, data binary"), np.int64, np.add)
    return (counts[:CODES].copy(), int(counts[CODES])) if len(counts) else (np.zeros(CODES, np.int64), 0)


_DEALT = "kind int, slot long, chunk long, n_train int, data binary, doc_ids array<long>, n_tokens array<long>"


def _dealt(rows: DataFrame, frequent: np.ndarray, ranges: int) -> DataFrame:
    """Every token with its predecessor and document, by range of words (kind 0); each chunk's documents (kind 1)."""
    common = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, chunk = Lookup(common.value, np.arange(len(common.value))), TaskContext.get().partitionId() << CHUNK_BITS

        def deal(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            held = _held_out(ids)
            order = np.argsort(held, kind="stable")  # training documents first
            ids, texts, n_train = [ids[i] for i in order], [texts[i] for i in order], int((~held).sum())
            token, doc, n = _tokens(texts)
            before = np.concatenate([[START], token[:-1]])
            before[np.cumsum(n) - n] = START
            code, code_before = (np.minimum(codes(x), CODES).astype(np.uint16) for x in (token, before))
            slot = (mix(np.where(code == RARE, token, token ^ mix(before))) % U(ranges)).astype(np.int64)
            by = np.argsort(slot.astype(np.uint16) if ranges < 1 << 16 else slot, kind="stable")
            token, before, code, code_before, doc, slot = (x[by] for x in (token, before, code, code_before, doc.astype(np.uint16), slot))
            cut = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
            slots, data = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = slice(a, b)
                slots.append(int(slot[a]))
                data.append(_pack(code[part], token[part][code[part] == RARE], code_before[part], before[part][code_before[part] == RARE], doc[part]))
            k = len(slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * k + [1], pa.int32()), pa.array([*slots, int(_home(np.array([chunk]), ranges)[0])], pa.int64()), pa.array([chunk] * (k + 1), pa.int64()), pa.array([n_train] * (k + 1), pa.int32()),
                 pa.array([*data, None], pa.binary()), pa.array([None] * k + [ids], pa.list_(pa.int64())), pa.array([None] * k + [n.tolist()], pa.list_(pa.int64()))],
                ["kind", "slot", "chunk", "n_train", "data", "doc_ids", "n_tokens"])

        for ids, texts in chunks(batches, CHUNK_TOKENS * 6):
            for s in range(0, len(ids), 50_000):
                yield from deal(ids[s : s + 50_000], texts[s : s + 50_000])
                chunk += 1

    return rows.mapInArrow(run, _DEALT)


# kinds of the parts table
DOCS, DOC_SUMS, TOTALS, DENSE, PENDING, TYPES, RARE_PENDING = range(7)
_PARTS = "kind int, slot long, chunk long, n_train int, data binary, doc_ids array<long>, n_tokens array<long>"


def _met(dealt: DataFrame, frequent: np.ndarray, counts: np.ndarray, ranges: int) -> DataFrame:
    """Written parts of all ranges: sums of documents by home slot, contexts' statistics, counts of counts."""
    spark = dealt.sparkSession
    common = spark.sparkContext.broadcast((frequent, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known_counts = common.value
        held: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([DOCS], pa.int32()), pa.array([r["slot"]]), pa.array([r["chunk"]]), pa.array([r["n_train"]], pa.int32()), pa.nulls(1, pa.binary()),
                         pa.array([r["doc_ids"]], pa.list_(pa.int64())), pa.array([r["n_tokens"]], pa.list_(pa.int64()))], _PARTS_NAMES)
                else:
                    held.setdefault(r["slot"], []).append((r["chunk"], r["n_train"], r["data"]))
        dense = np.zeros((CODES, FIELDS), np.int64)
        # totals: pairs with count r = 1..K+1, rare words with count r = 1..K+1, rare words that were seen
        totals = np.zeros(2 * (K_MAX + 1) + 1, np.int64)
        for slot in sorted(held):
            for kind, home, data in _range_parts(sorted(held.pop(slot), key=lambda x: x[0]), words, known_counts, dense, totals, ranges):
                yield _part(kind, home, data)
        if totals.any() or dense.any():
            used = np.flatnonzero(dense.any(1))
            yield _part(TOTALS, 0, totals.tobytes())
            yield _part(DENSE, TaskContext.get().partitionId() % 64, _pack(used.astype(np.uint32), *[dense[used, k] for k in range(FIELDS)]))

    met = dealt.repartition(ranges, "slot").mapInArrow(run, _PARTS)
    parts = written(met, "katz-parts")
    release(spark)
    return parts


_PARTS_NAMES = ["kind", "slot", "chunk", "n_train", "data", "doc_ids", "n_tokens"]


def _part(kind: int, slot: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([slot], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([data], pa.binary()),
         pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], _PARTS_NAMES)


def _by_slot(kind: int, slot: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    cut = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield kind, int(slot[a]), _pack(*[x[order[a:b]] for x in arrays])


def _range_parts(blobs: list, words: np.ndarray, counts: np.ndarray, dense: np.ndarray, totals: np.ndarray, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    """One range of words: every occurrence of its pairs, and of its words unless they are frequent."""
    cols: list[list] = [[], [], [], [], [], [], [], []]
    for chunk, n_train, data in blobs:
        code, rare, code_before, rare_before, doc = _unpack(data, "<u2", "<u8", "<u2", "<u8", "<u2")
        w, v = words[np.minimum(code, len(words) - 1)], words[np.minimum(code_before, len(words) - 1)]
        w[code == RARE], v[code_before == RARE] = rare, rare_before
        for k, x in enumerate((mix(w ^ mix(v)), code, code_before, doc, np.full(len(doc), chunk, U), doc < n_train, rare, rare_before)):
            cols[k].append(x)
    del w, v, blobs

    def whole() -> np.ndarray:
        return np.concatenate(cols.pop(0))

    pair, code, code_before, doc, chunk, train, rare_w, rare_v = (whole() for _ in range(8))
    # occurrences of a pair side by side; its count is the same for all of them
    order = np.argsort(pair)
    pair = pair[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    del pair
    pair_count = np.add.reduceat(train[order].astype(np.int32), first)
    big = np.empty(len(order), np.int32)
    big[order] = np.repeat(pair_count, np.diff(np.append(first, len(order))))
    first = order[first]
    del order
    c = counts[np.minimum(code, CODES - 1)]
    is_rare = code == RARE
    rare, rare_of = np.unique(rare_w, return_inverse=True)
    del rare_w
    rare_count = np.bincount(rare_of, weights=train[is_rare], minlength=len(rare)).astype(np.int64)
    c[is_rare] = rare_count[rare_of]
    del rare, rare_of, is_rare, train
    totals[: K_MAX + 1] += np.bincount(np.minimum(pair_count, K_MAX + 2), minlength=K_MAX + 3)[1 : K_MAX + 2]
    totals[K_MAX + 1 : -1] += np.bincount(np.minimum(rare_count, K_MAX + 2), minlength=K_MAX + 3)[1 : K_MAX + 2]
    totals[-1] += (rare_count > 0).sum()
    seen = big > 0
    # sums of documents: occurrences lie in the order of chunk and document
    begin = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])]))
    sums = np.zeros(len(begin), SUMS)
    add = functools.partial(np.add.reduceat, indices=begin)
    sums["chunk"], sums["doc"] = chunk[begin], doc[begin]
    sums["known"] = add((c > 0).astype(np.uint32))
    sums["l1"] = add(np.log10(c + 1.0))
    sums["s"] = add(np.log10(np.maximum(np.where(seen, big, c), 1)))
    for r in range(K_MAX + 1):
        if r:
            sums["m"][:, r - 1] = add((seen & (big == r)).astype(np.uint32))
        sums["b"][:, r] = add((~seen & (c == r)).astype(np.uint32))
    sums["large"] = add((~seen & (c > K_MAX)).astype(np.uint32))
    yield from _by_slot(DOC_SUMS, _home(sums["chunk"], ranges), sums)
    del sums
    # statistics of contexts, one type per seen pair: by pair count, by word count, sum of larger word counts
    known = first[pair_count > 0]
    n, cw, tc = np.minimum(pair_count[pair_count > 0], K_MAX + 1), c[known], code_before[known]
    common = tc != RARE
    for r in range(1, K_MAX + 1):
        dense[:, r - 1] += np.bincount(tc[common & (n == r)], minlength=CODES)[:CODES]
        dense[:, K_MAX + r - 1] += np.bincount(tc[common & (cw == r)], minlength=CODES)[:CODES]
    large = common & (cw > K_MAX)
    dense[:, -1] += np.bincount(tc[large], weights=cw[large], minlength=CODES)[:CODES].astype(np.int64)
    at_rare = np.cumsum(code_before == RARE, dtype=np.int32) - 1
    tv = rare_v[at_rare[known[~common]]]
    yield from _by_slot(TYPES, (mix(tv) % U(ranges)).astype(np.int64), tv, n[~common].astype(np.uint8), cw[~common].astype(np.uint64))
    # occurrences that back off wait for their contexts
    p = np.flatnonzero(~seen)
    f, q = p[code_before[p] != RARE], p[code_before[p] == RARE]
    yield from _by_slot(PENDING, _home(chunk[f], ranges), chunk[f], doc[f], code_before[f])
    qv = rare_v[at_rare[q]]
    yield from _by_slot(RARE_PENDING, (mix(qv) % U(ranges)).astype(np.int64), qv, chunk[q], doc[q])


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 1..K_MAX from the counts of counts 1..K_MAX + 1.

    Where the counts of counts give nothing between 0 and 1, half a count is taken off instead.
    """
    k, out = K_MAX, np.empty(K_MAX)
    common = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out[r - 1] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def backoff_weights(stats: np.ndarray, d: np.ndarray, d1: np.ndarray, total: int) -> np.ndarray:
    """A(v) of contexts from their statistics: pairs by count, successors by count, sum of larger counts."""
    r = np.arange(1, K_MAX + 1)
    left = 1 + (stats[:, :K_MAX] * r * (1 - d)).sum(1)
    seen = ((stats[:, K_MAX : 2 * K_MAX] * r * d1).sum(1) + stats[:, -1]) / (total + 1)
    return left / (1 - seen)


def _context_sums(parts: DataFrame, d: np.ndarray, d1: np.ndarray, total: int, ranges: int) -> DataFrame:
    """Rows kind DOC_SUMS with log A(v) of every backed-off token whose context is no frequent word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, waits = {}, {}
        for b in batches:
            for r in b.to_pylist():
                (types if r["kind"] == TYPES else waits).setdefault(r["slot"], []).append(r["data"])
        for slot, data in waits.items():
            wv, chunk, doc = (np.concatenate(x) for x in zip(*[_unpack(x, "<u8", "<u8", "<u2") for x in data], strict=True))
            a = np.ones(len(wv))
            if slot in types:
                v, n, cw = (np.concatenate(x) for x in zip(*[_unpack(x, "<u8", "<u1", "<u8") for x in types[slot]], strict=True))
                context, of = np.unique(v, return_inverse=True)
                stats = np.zeros((len(context), FIELDS))
                for r in range(1, K_MAX + 1):
                    stats[:, r - 1] = np.bincount(of[n == r], minlength=len(context))
                    stats[:, K_MAX + r - 1] = np.bincount(of[cw == r], minlength=len(context))
                stats[:, -1] = np.bincount(of, weights=np.where(cw > K_MAX, cw, 0), minlength=len(context))
                weight = backoff_weights(stats, d, d1, total)
                at = np.minimum(np.searchsorted(context, wv), len(context) - 1)
                a = np.where(context[at] == wv, weight[at], 1.0)
            sums = np.zeros(len(wv), SUMS)
            sums["chunk"], sums["doc"], sums["s"] = chunk, doc, np.log10(a)
            for kind, home, blob in _by_slot(DOC_SUMS, _home(chunk, ranges), sums):
                yield _part(kind, home, blob)

    some = parts.filter(F.col("kind").isin(TYPES, RARE_PENDING)).select("kind", "slot", "data")
    return some.repartition(ranges, "slot").mapInArrow(run, _PARTS)


def katz_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    frequent = _frequent(rows)
    counts, corpus_tokens = _counted(rows, frequent)
    ranges = max(1, -(-corpus_tokens // RANGE_TOKENS))
    parts = _met(_dealt(rows, frequent, ranges), frequent, counts, ranges)

    totals = np.zeros(2 * (K_MAX + 1) + 1, np.int64)
    sums = parts.filter(F.col("kind") == TOTALS).select("data").mapInArrow(_add_totals, "data binary").collect()
    for r in sums:
        totals += np.frombuffer(bytes(r["data"]), np.int64)
    dense = np.zeros((CODES, FIELDS), np.int64)
    for r in parts.filter(F.col("kind") == DENSE).select("slot", "data").groupBy("slot").applyInArrow(_add_dense, "slot long, data binary").toLocalIterator():
        used, *fields = _unpack(bytes(r["data"]), "<u4", *["<i8"] * FIELDS)
        for k, x in enumerate(fields):
            dense[used, k] += x
    words = counts[1:]  # START is no token
    n1 = np.array([int(totals[K_MAX + r] + (words == r).sum()) for r in range(1, K_MAX + 2)])
    train_docs, vocabulary = int(counts[0]), int(totals[-1] + (words > 0).sum())
    train_tokens = _train_tokens(parts)
    d, d1 = discounts(totals[: K_MAX + 1]), discounts(n1)
    weights = spark.sparkContext.broadcast(np.log10(backoff_weights(dense, d, d1, train_tokens)))
    r = np.arange(1, K_MAX + 1)
    unseen = (1 + float((n1[:K_MAX] * r * (1 - d1)).sum())) / (train_tokens + 1)
    log_d, log_b = np.log10(d), np.concatenate([[math.log10(unseen)], np.log10(d1) - math.log10(train_tokens + 1)])
    log_total, log_end, log_start = math.log10(train_tokens + 1), math.log10(train_docs + 1), math.log10(train_docs + 1)
    base_each = math.log10(train_tokens + vocabulary + 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_docs, parts_of_chunk = {}, {}
        for b in batches:
            for x in b.to_pylist():
                if x["kind"] == DOCS:
                    chunk_docs[x["chunk"]] = (x["n_train"], x["doc_ids"], x["n_tokens"])
                elif x["kind"] == DOC_SUMS:
                    (s,) = _unpack(x["data"], SUMS)
                    parts_of_chunk.setdefault("sums", []).append(s)
                else:
                    c, doc, code = _unpack(x["data"], "<u8", "<u2", "<u2")
                    s = np.zeros(len(c), SUMS)
                    s["chunk"], s["doc"], s["s"] = c, doc, weights.value[code]
                    parts_of_chunk.setdefault("sums", []).append(s)
        if not chunk_docs:
            return
        s = np.concatenate(parts_of_chunk["sums"])
        s = s[np.argsort(s["chunk"], kind="stable")]
        for name, (n_train, ids, n_tokens) in chunk_docs.items():
            a, b = np.searchsorted(s["chunk"], np.array([name, name + 1], U))
            own, size = s[a:b], len(ids)
            add = functools.partial(np.bincount, own["doc"], minlength=size)
            n = np.array(n_tokens, np.int64)
            known, l1, score = add(weights=own["known"]).astype(np.int64), add(weights=own["l1"]), add(weights=own["s"])
            for k in range(K_MAX + 1):
                if k:
                    score += add(weights=own["m"][:, k - 1]) * log_d[k - 1]
                score += add(weights=own["b"][:, k]) * log_b[k]
            # words backed off with larger counts have c / (N + 1): the logarithm of c is in the sum already
            score -= add(weights=own["large"]) * log_total
            # every token but the end is a context once, and so is the start
            score -= l1 - log_end + log_start
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.arange(size) >= n_train), pa.array(n), pa.array(known), pa.array(np.full(size, train_tokens)),
                 pa.array(l1 - n * base_each), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    homes = parts.filter(F.col("kind").isin(DOCS, DOC_SUMS, PENDING)).unionByName(_context_sums(parts, d, d1, train_tokens, ranges))
    return homes.repartition(ranges, "slot").mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _add_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(x.as_py(), np.int64) for b in batches for x in b.column(0))
    if not isinstance(total, int):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])


def _add_dense(key, table):
    dense = np.zeros((CODES, FIELDS), np.int64)
    for x in table["data"]:
        used, *fields = _unpack(x.as_py(), "<u4", *["<i8"] * FIELDS)
        for k, f in enumerate(fields):
            dense[used, k] += f
    used = np.flatnonzero(dense.any(1))
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([_pack(used.astype(np.uint32), *[dense[used, k] for k in range(FIELDS)])], pa.binary())})


def _train_tokens(parts: DataFrame) -> int:
    """Tokens of the training documents: a chunk's first n_train ones."""
    one = F.aggregate(F.slice("n_tokens", 1, F.greatest(F.col("n_train"), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return parts.filter(F.col("kind") == DOCS).agg(F.sum(one)).first()[0] or 0
