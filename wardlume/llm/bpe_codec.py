"""BPE encoding and decoding of whole tables: tasks run the speculate-and-verify encoder over Arrow batches.

Defined results: a null text counts as empty and encodes to no ids; texts of any length are encoded whole; rows
are independent of each other, so repeated rows repeat and an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text turned into one output batch.
BATCH_CHARS = 4_000_000


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about BATCH_CHARS characters each (one row at least), and their texts."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BATCH_CHARS):
                size += len(texts[stop])
                stop += 1
            yield batch.slice(start, stop - start), texts[start:stop]
            start = stop


def encode_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text those ids give back) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import bpe

        coder = bpe.load(tokenizer)
        for part, texts in text_slices(batches):
            flat, counts = coder.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            decoded = [coder.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string")
