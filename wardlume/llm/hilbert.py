"""Sharding along a Hilbert curve, in DataFrame operations only.

Several metadata columns are quantised to ``bits`` bits each by their own quantiles, the cells are numbered
along a Hilbert curve, rows are sorted by that number, and the sorted sequence is cut into runs of equal row
count (law ``rows``) or near equal bytes (law ``bytes``). Each run then covers a small box in every dimension, so the
minimum and maximum of each column in a shard's files let readers skip it. Cells are spread over the whole range of
every axis, so a column of few values counts as much along the curve as one of many.

Defined results: null metadata counts as the smallest value; a null text has size 1; equal rows take consecutive
places; an empty table gives an empty result. Columns that clash with the operator's own are not carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, text_or_empty, written

LAWS = ("rows", "bytes")


def ordered_number(df: DataFrame, name: str) -> Column:
    """A double that keeps the order of a column of numbers, dates or booleans; null counts as the smallest."""
    kind = df.schema[name].dataType
    x = F.unix_micros(F.col(name).cast("timestamp")) if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else F.col(name)
    return F.coalesce(x.cast("double"), F.lit(float("-inf")))


def string_cells(df: DataFrame, name: str, bits: int) -> DataFrame:
    """(value, cell): each distinct string's cell, by the share of rows whose string is smaller. Null counts as the empty string.

    Strings are compared whole. Their counts are range partitioned, places are summed within partitions and offset by partition totals.
    """
    counts = df.groupBy(F.coalesce(F.col(name), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(partitions(df.sparkSession), "value").sortWithinPartitions("value")
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "values").withColumn("part", F.shiftright("at", 33))
    totals = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    whole = totals.agg(F.sum("rows")).first()[0] or 1
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    x = placed.join(F.broadcast(offsets), "part").withColumn("smaller", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return x.select("value", F.floor(F.col("smaller") * (1 << bits) / whole).cast("int").alias("cell"))


def quantised(df: DataFrame, columns: list[str], bits: int, most_bytes: int = 1 << 20, salts: int = 64) -> tuple[DataFrame, list[Column]]:
    """The table with what the cells need, and for each column its cell, spread over 0 to 2**bits - 1.

    A number's cell is the share of the column's quantile bounds below it; the bounds are one row of mergeable summaries over all rows,
    2**bits - 1 numbers a column. Cells of strings rise with the strings, so the first string of each cell, 2**bits a column at most, is all that a row
    needs; no row is shuffled for its cell. Where these few are longer than ``most_bytes`` in all, cells are joined by whole values, dealt to ``salts`` tasks each.
    """
    top = (1 << bits) - 1
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [c for c in columns if not isinstance(df.schema[c].dataType, T.StringType)]
    row = df.agg(*[F.percentile_approx(ordered_number(df, c), cuts, 10_000).alias(f"q{columns.index(c)}") for c in numbers]).first() if numbers else {}
    joined, out = {}, []
    for k, c in enumerate(columns):
        if c in numbers:
            bounds = sorted(set(row[f"q{k}"] or []))
            x = ordered_number(df, c)
            below = reduce(lambda s, b: s + (x > F.lit(b)).cast("int"), bounds, F.lit(0))
            out.append(F.floor(below * top / max(1, len(bounds))).cast("int"))
            continue
        cells = string_cells(df, c, bits)
        first = cells.groupBy("cell").agg(F.min("value").alias("first"))
        if (first.agg(F.sum(F.octet_length("first"))).first()[0] or 0) <= most_bytes:
            value = F.coalesce(F.col(c), F.lit(""))
            starts = sorted(first.collect(), key=lambda r: r["cell"])  # a row a cell
            out.append(reduce(lambda s, r: F.when(value >= F.lit(r["first"]), F.lit(r["cell"])).otherwise(s), starts, F.lit(0)).cast("int"))
        else:
            joined[c] = cells.select(F.col("value").alias(f"_value{k}"), F.col("cell").alias(f"_cell{k}"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(f"_salt{k}"))
            out.append(F.col(f"_cell{k}"))
    for k, c in enumerate(columns):
        if c in joined:
            salt = F.pmod(F.xxhash64(*[x for x in df.columns]), F.lit(salts)).cast("int")
            df = df.withColumn("_salt", salt)
            df = df.join(joined[c], (F.coalesce(df[c], F.lit("")) == F.col(f"_value{k}")) & (df["_salt"] == F.col(f"_salt{k}"))).drop("_salt", f"_value{k}", f"_salt{k}")
    return df, out


def hilbert_index(axes: list[str], bits: int) -> list[tuple[str, Column]]:
    """Projections, to be applied in order, that leave the curve's number in column ``curve``.

    The usual transform between axes and the transposed index: from the highest bit down, inversions and
    exchanges are undone, then the Gray code is taken. Each step is one named column, so the plan stays linear.
    """
    steps: list[tuple[str, Column]] = []
    top, n = 1 << (bits - 1), len(axes)
    q = top
    while q > 1:
        p = q - 1
        for i, a in enumerate(axes):
            hit = F.col(a).bitwiseAND(q) != 0
            first = F.col(axes[0])
            if i == 0:
                steps.append((a, F.when(hit, first.bitwiseXOR(p)).otherwise(first)))
                continue
            swap = first.bitwiseXOR(F.col(a)).bitwiseAND(p)
            steps.append(("_swap", F.when(hit, F.lit(0)).otherwise(swap)))
            steps.append((axes[0], F.when(hit, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(F.col("_swap")))))
            steps.append((a, F.col(a).bitwiseXOR(F.col("_swap"))))
        q >>= 1
    for before, a in zip(axes, axes[1:], strict=False):
        steps.append((a, F.col(a).bitwiseXOR(F.col(before))))
    flips = F.lit(0)
    for b in range(1, bits):
        flips = flips.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    steps.append(("_flips", flips))
    steps += [(a, F.col(a).bitwiseXOR(F.col("_flips"))) for a in axes]
    curve = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for a in axes:
            curve = F.shiftleft(curve, 1).bitwiseOR(F.shiftright(F.col(a), b).bitwiseAND(1).cast("long"))
    assert n * bits < 63
    return [*steps, ("curve", curve)]


def hilbert_shards(
    docs: DataFrame, columns: list[str], shards: int = 8, bits: int = 4, law: str = "rows",
    doc_id: str = "doc_id", text: str = "text", most_bytes: int = 1 << 20,
) -> DataFrame:
    """doc_id, size, text_crc32, law, curve, shard, slot (gapless from 0 in its shard), grown_shard (null).

    Rows are shuffled once, by a range partition by (curve, doc_id) of narrow rows; before that the distinct values of each string column are counted and put in
    order. Places are counted within partitions, and partition totals (one row each) give the offsets. No row number runs over all rows in one task.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    axes = [f"_axis{k}" for k in range(len(columns))]
    body = text_or_empty(text)
    named = [f"_column{k}" for k in range(len(columns))]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        *[F.col(c).alias(n) for c, n in zip(columns, named, strict=True)])
    rows, cells = quantised(rows, named, bits, most_bytes)
    df = rows.select("doc_id", "size", "text_crc32", *[q.alias(a) for q, a in zip(cells, axes, strict=True)])
    for name, step in hilbert_index(axes, bits):
        df = df.withColumn(name, step)
    df = df.select("doc_id", "size", "text_crc32", "curve")
    keys = ["curve", "doc_id", "size", "text_crc32"]
    ranged = df.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "curve-order").withColumns({
        "_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1),
    })
    # one row per partition: bounded by the number of shuffle partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    offsets = totals.select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_bytes0"),
    )
    whole = totals.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    n, total = whole["n"] or 0, whole["b"] or 0
    out = placed.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_rows0") + F.col("_place"))
    if law == "rows":
        # integer arithmetic: the shard's first rank is the least r with r * shards >= shard * n
        out = out.withColumn("shard", F.expr(f"int((_rank * {shards}L) div {max(n, 1)}L)"))
        out = out.withColumn("slot", F.expr(f"_rank - ((shard * {n}L + {shards - 1}L) div {shards}L)"))
    else:
        run = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_start", F.col("_bytes0") + F.coalesce(F.sum("size").over(run), F.lit(0)))
        out = out.withColumn("shard", F.expr(f"int((_start * {shards}L) div {max(total, 1)}L)"))
        first = out.groupBy("shard").agg(F.min("_rank").alias("_first"))
        out = out.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "curve", "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
