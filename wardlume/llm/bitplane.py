"""Token-ID files by plane shuffling.

Rows go into ascending doc_id order by a range partition, each partition being a shard. A shard is cut into segments
of whole documents; a segment's ids are cut into fixed-size blocks, each block is transposed into byte planes (all
lowest bytes, all second bytes, ...) or bit planes, each plane is compressed with zstandard, and the segment's
chunk index tells where every block and plane lies. Segments are rows of a Parquet table written by Spark's committer,
so a lost executor costs a task and nothing else; a second small table holds each shard's first id.

Layout of ``out``: ``segments/`` (shard, segment, first_in_shard, n_ids, doc_ids, doc_lengths, planes, blocks, payload)
and ``shards/`` (shard, first_id, n_ids).

Defined results: a null text counts as empty, so its document is the end id alone; null doc_ids come first;
repeated rows are written one after the other; an empty table writes empty files and reads back empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_codec import text_slices
from .shared import partitions

BLOCK_IDS, SEGMENT_IDS, LEVEL = 1 << 15, 1 << 20, 3
_BLOCK = pa.struct([("offset", pa.int64()), ("ids", pa.int32()), ("sizes", pa.list_(pa.int32()))])


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first; trailing planes of zeros are left out."""
    raw = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == "byte":
        out = [p.tobytes() for p in raw]
    else:
        bits = np.unpackbits(raw[:, :, None], axis=2, bitorder="little")  # byte, id, bit
        out = [np.packbits(bits[b, :, k]).tobytes() for b in range(4) for k in range(8)]
    while out and not any(out[-1]):
        out.pop()
    return out


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    raw = np.zeros((4, n), np.uint8)
    if planes == "byte":
        for k, p in enumerate(parts):
            raw[k] = np.frombuffer(p, np.uint8)
    else:
        for k, p in enumerate(parts):
            raw[k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def pack_segment(ids: np.ndarray, planes: str, block_ids: int = BLOCK_IDS) -> tuple[list[dict], bytes]:
    """The chunk index and payload of a segment."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    blocks, payload, at = [], [], 0
    for start in range(0, len(ids), block_ids):
        block = ids[start : start + block_ids]
        parts = [press.compress(p) for p in to_planes(block, planes)]
        blocks.append({"offset": at, "ids": len(block), "sizes": [len(p) for p in parts]})
        payload += parts
        at += sum(map(len, parts))
    return blocks, b"".join(payload)


def unpack_segment(blocks: list[dict], payload: bytes, planes: str) -> np.ndarray:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    out = []
    for b in blocks:
        at, parts = b["offset"], []
        for size in b["sizes"]:
            parts.append(open_.decompress(payload[at : at + size]))
            at += size
        out.append(from_planes(parts, b["ids"], planes))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def write_planes(
    docs: DataFrame, out: str, tokenizer: str, end_id: int, planes: str = "byte", doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Encode every text, append ``end_id`` to each, and write the files in ascending doc_id order."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import bpe

        coder = bpe.load(tokenizer)
        shard = TaskContext.get().partitionId()
        segment, first = 0, 0
        names: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, first, names, lengths, held
            ids = np.concatenate(held)
            blocks, payload = pack_segment(ids, planes)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([planes]),
                 pa.array([blocks], pa.list_(_BLOCK)), pa.array([payload], pa.binary())],
                ["shard", "segment", "first_in_shard", "n_ids", "doc_ids", "doc_lengths", "planes", "blocks", "payload"])
            segment, first, names, lengths, held = segment + 1, first + len(ids), [], [], []
            return row

        size = 0
        for part, texts in text_slices(batches):
            flat, counts = coder.encode(texts)
            at = 0
            for name, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                names.append(name), lengths.append(n + 1)
                held += [flat[at : at + n].astype("<u4"), np.array([end_id], "<u4")]
                at, size = at + n, size + n + 1
                if size >= SEGMENT_IDS:
                    yield flush()
                    size = 0
        if names:
            yield flush()

    ordered.mapInArrow(
        run, "shard int, segment int, first_in_shard long, n_ids long, doc_ids array<long>, doc_lengths array<long>, planes string, "
             "blocks array<struct<offset:long,ids:int,sizes:array<int>>>, payload binary",
    ).write.parquet(f"{out}/segments")
    # one row per shard, as many as the shuffle has partitions
    totals = docs.sparkSession.read.parquet(f"{out}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"), "n_ids").write.parquet(f"{out}/shards")


def read_planes(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) from the files."""
    shards = spark.read.parquet(f"{out}/shards").select("shard", "first_id")
    segments = spark.read.parquet(f"{out}/segments").join(F.broadcast(shards), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_segment(row["blocks"], row["payload"], row["planes"])
                n = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(n)
                start = row["first_id"] + row["first_in_shard"] + ends - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n),
                     pa.array([ids[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return segments.select("doc_ids", "doc_lengths", "planes", "blocks", "payload", "first_id", "first_in_shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")
