"""Writing results: all rows of a document's phase replaced at once, and evidence bundles as zip files with digests, both safe to repeat."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged

CHUNK = 1 << 20
PHASE = ["doc_id", "phase"]


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(buckets)).cast("int")


def read_phases(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``replace_phases`` has written to a folder."""
    return spark.read.parquet(folder).filter("doc_id is not null").drop("bucket")


def replace_phases(rows: DataFrame, folder: str, audited: DataFrame | None = None, buckets: int = 256) -> None:
    """Write ``rows`` (doc_id, phase, ...) in place of all that the folder has for their documents and phases, and for those of ``audited`` (doc_id, phase) which may have none now.

    The folder is partitioned by (bucket of doc_id, phase). Only the partitions that are touched are read and overwritten, each as a whole, so a write that failed
    half-way is mended by repeating it, and repeating one changes nothing. ``buckets`` belongs to the folder: keep it. Rows without doc_id or phase are left out.
    An emptied partition keeps one row without doc_id, which ``read_phases`` leaves out. One writer at a time.
    """
    spark = rows.sparkSession
    new = staged(rows.filter("doc_id is not null and phase is not null").withColumn("bucket", _bucket(buckets)), "phases")
    keys = new.select(*PHASE)
    if audited is not None:
        keys = keys.unionByName(audited.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) for c in PHASE]).filter("doc_id is not null and phase is not null"))
    keys = staged(keys.distinct().withColumn("bucket", _bucket(buckets)), "phase-keys")
    touched = keys.select("bucket", "phase").distinct()
    out = new
    try:
        old = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        # at most buckets x phases rows, so the folder's other partitions are pruned while it is planned or run
        old = old.withColumn("phase", F.col("phase").cast(new.schema["phase"].dataType)).filter("doc_id is not null").join(F.broadcast(touched), ["bucket", "phase"], "left_semi")
        out = new.unionByName(old.join(keys.select(*PHASE), PHASE, "left_anti"), allowMissingColumns=True)
    marks = touched.select("bucket", "phase", F.lit(None).cast(new.schema["doc_id"].dataType).alias("doc_id"))
    out = staged(out.unionByName(marks, allowMissingColumns=True), "phases")  # nothing is read from what is overwritten
    out.repartition("bucket", "phase").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "phase").parquet(folder)


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, read piece by piece: a file may be larger than any one value. Spark lists no files of no bytes."""
    # without its content a file is only listed
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                digest = hashlib.sha256()
                with system.open_input_stream(name) as f:
                    while piece := f.read(CHUNK):
                        digest.update(piece)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], ["path", "bytes", "sha256"])

    return files.mapInArrow(run, "path string, bytes long, sha256 string")


class _Counted(io.RawIOBase):
    """A stream for zip files that can't be sought in; counts and hashes what goes through."""

    def __init__(self, out) -> None:
        self.out, self.size, self.digest = out, 0, hashlib.sha256()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.size += len(data)
        self.digest.update(data)
        return len(data)


def bundle_lines(findings: DataFrame) -> DataFrame:
    """(doc_id, entry, pos, line): the lines of each document's findings.jsonl and checks.csv, ordered by rule, place and the line itself."""
    order = [F.col(c).cast("string") for c in ("rule_id", "node_id") if c in findings.columns]
    names = [c for c in findings.columns if c != "doc_id"]

    def cell(c: str):
        kind = findings.schema[c].dataType.typeName()
        text = F.coalesce(F.to_json(c) if kind in ("array", "map", "struct") else F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    x = findings.select("doc_id", F.to_json(F.struct(*names)).alias("json"), F.concat_ws(",", *[cell(c) for c in names]).alias("csv"), F.array(*order).cast("array<string>").alias("by"))
    lines = x.select("doc_id", "by", F.explode(F.array(F.struct(F.lit("findings.jsonl").alias("entry"), F.col("json").alias("line")), F.struct(F.lit("checks.csv").alias("entry"), F.col("csv").alias("line")))).alias("e"))
    heads = findings.select("doc_id").distinct().select("doc_id", F.lit("checks.csv").alias("entry"), F.lit(None).cast("array<string>").alias("by"), F.lit(",".join(names)).alias("line"))
    return lines.select("doc_id", "e.entry", "by", "e.line").unionByName(heads)


def write_bundles(findings: DataFrame, folder: str) -> DataFrame:
    """One zip file <doc_id>.zip per document with its findings.jsonl and checks.csv; returns the written manifest (doc_id, file, entry, bytes, sha256), whose rows with entry null are the zip files.

    A document's lines go through one task in order, line by line, so its size doesn't matter to memory. A file is written beside its place and then moved there, so
    a task that runs again leaves one whole file, byte for byte the same. doc_id must be a number or a safe name (``document_id``); findings without one are left out.
    ``folder`` is an address that pyarrow can write to and all executors share.
    """
    lines = bundle_lines(findings.filter("doc_id is not null")).withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, file string, entry string, bytes long, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        doc = entry = raw = sink = zipped = inner = None
        size, digest, made = 0, None, []

        def end_entry() -> None:
            nonlocal inner
            if inner is not None:
                inner.close()
                made.append((doc, f"{doc}.zip", entry, size, digest.hexdigest()))
                inner = None

        def end_doc() -> None:
            nonlocal zipped
            end_entry()
            if zipped is not None:
                zipped.close()
                raw.close()
                system.move(f"{base}/.{doc}-{attempt}", f"{base}/{doc}.zip")
                made.append((doc, f"{doc}.zip", None, sink.size, sink.digest.hexdigest()))
                zipped = None

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [pa.string()] * 3 + [pa.int64(), pa.string()], strict=True)], ["doc_id", "file", "entry", "bytes", "sha256"])
            made.clear()
            return out

        for batch in batches:
            for d, e, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if d != doc:
                    end_doc()
                    doc, entry = d, None
                    raw = system.open_output_stream(f"{base}/.{doc}-{attempt}")
                    sink = _Counted(raw)
                    zipped = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                if e != entry:
                    end_entry()
                    # a fixed time, so that equal findings make equal files
                    entry, size, digest, inner = e, 0, hashlib.sha256(), zipped.open(zipfile.ZipInfo(e, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
                data = (line + "\n").encode()
                inner.write(data)
                size += len(data)
                digest.update(data)
            if made:
                yield rows()
        end_doc()
        if made:
            yield rows()

    ordered = lines.repartition("doc_id").sortWithinPartitions("doc_id", "entry", F.col("by").asc_nulls_first(), "line").select("doc_id", "entry", "line")
    return staged(ordered.mapInArrow(run, schema), "manifest")
