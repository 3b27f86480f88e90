"""Cost-balanced packing of documents into fixed-length training sequences.

A document of n tokens costs n linear units and n * n / capacity attention units. Whole stretches of ``capacity``
tokens become sequences of their own where the text is tokenised; the rests are dealt evenly into groups of
about ``group_chars`` bytes' worth, and each group is packed by itself, a task going through its groups one at a time: rests in descending length, each to
the sequence of lowest cost that has room for it; a rest that fits nowhere whole is cut into the rooms left, cheapest
sequence first. A group opens as few sequences as its tokens need, so it pads less than one sequence.

Defined results: a null text counts as empty, and a document of no text is its end id alone; repeated rows are
packed as rows of their own; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import text_slices
from .shared import partitions

#: Characters of text in one packing group: it bounds a task's memory at every size of input.
GROUP_CHARS = 16_000_000


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in the item, length, sequence, offset) of items in descending order of length."""
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    count = -(-int(lengths.sum()) // capacity)
    cost, used = np.zeros(count), np.zeros(count, np.int64)
    pieces = []
    for item, left in enumerate(lengths.tolist()):
        start = 0
        while left:
            fits = np.where(used + left <= capacity, cost, np.inf)
            s = int(fits.argmin())
            size = left
            if fits[s] == np.inf:
                s = int(np.where(used < capacity, cost, np.inf).argmin())
                size = capacity - int(used[s])
            pieces.append((item, start, size, s, int(used[s])))
            used[s] += size
            cost[s] += linear * size + quadratic * size * size
            start, left = start + size, left - size
    return pieces


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Each group's rows, from batches in the order of the column group."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        group = b.column("group").to_numpy()
        cut = np.append(np.flatnonzero(np.diff(group, prepend=group[:1] - 1)), len(group)) if len(group) else []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if group[s] != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(group[s])
            held.append(b.slice(s, e - s))
    if held:
        yield at, pa.Table.from_batches(held)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, group_chars: int = GROUP_CHARS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, cost."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-total // group_chars))
    tasks = min(groups, partitions(docs.sparkSession))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import bpe

        coder = bpe.load(tokenizer)
        wide = np.uint16 if max(len(coder.strings), end_id + 1) <= 1 << 16 else np.uint32
        serial = TaskContext.get().partitionId() << 33
        for part, texts in text_slices(batches):
            flat, counts = coder.encode(texts)
            source, start, length, crc, whole, rest = [], [], [], [], [], []
            at = 0
            for row, n in enumerate(counts.tolist()):
                ids = np.append(flat[at : at + n], end_id).astype("<u4")
                at += n
                cut = (n + 1) // capacity * capacity
                for s in range(0, cut, capacity):
                    source.append(row), start.append(s), length.append(capacity), whole.append(n + 1), rest.append(None)
                    crc.append(zlib.crc32(ids[s : s + capacity].tobytes()))
                if cut < n + 1:
                    source.append(row), start.append(cut), length.append(n + 1 - cut), whole.append(n + 1), crc.append(None)
                    rest.append(ids[cut:].astype(wide).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(serial, serial + len(source))), part.column(0).take(pa.array(source, pa.int32())),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(whole, pa.int64()), pa.array(crc, pa.int64()), pa.array(rest, pa.binary())],
                ["serial", "doc_id", "start", "length", "doc_tokens", "crc", "rest"])
            serial += len(source)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import bpe

        wide = np.uint16 if max(len(bpe.load(tokenizer).strings), end_id + 1) <= 1 << 16 else np.uint32
        for group, table in _groups(batches):
            # the order rows arrive in is not fixed; the order of packing is
            table = table.sort_by([("length", "descending"), ("serial", "ascending")])
            length = table["length"].to_numpy()
            full = int((length == capacity).sum())
            start, rest = table["start"].to_numpy(), table["rest"]
            out = [(i, 0, capacity, i, 0) for i in range(full)]
            out += [(i + full, s, n, q + full, o) for i, s, n, q, o in assign(length[full:], capacity)]
            crc = table["crc"].slice(0, full).to_pylist()
            ids: dict[int, np.ndarray] = {}
            for i, s, n, _, _ in out[full:]:
                if s == 0:
                    ids = {i: np.frombuffer(rest[i].as_py(), wide).astype("<u4")}
                crc.append(zlib.crc32(ids[i][s : s + n].tobytes()))
            item, inner, size, sequence, offset = (np.array(x, np.int64) for x in zip(*out, strict=True))
            take = pa.array(item)
            result = pa.table({
                "doc_id": table["doc_id"].take(take), "start": start[item] + inner, "length": size,
                "doc_tokens": table["doc_tokens"].take(take), "sequence_id": sequence + (group << 32), "offset": offset,
                "ids_crc32": pa.array(crc, pa.int64()), "cost": size + size * size / capacity,
            })
            yield from result.to_batches(max_chunksize=10_000)

    pieces = rows.mapInArrow(tokenised, f"serial long, doc_id {kind}, start long, length long, doc_tokens long, crc long, rest binary")
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("serial"), F.lit(groups)))
    return dealt.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(
        packed, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, cost double")
