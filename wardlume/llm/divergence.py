"""Source divergence audit: how far the words of each source are from those of other sources of its language.

Three Spark steps with vectorised SQL (DuckDB, in memory) inside their tasks:

1. Each task counts its documents' terms by (lang, source, term), with the number of documents that have them.
2. The counts are hashed to shards by (lang, term); a shard sums them up and keeps the terms that enough documents of the language have.
   Spark adds up the kept terms of each language and the occurrences of each group.
3. Each shard spreads its terms over all sources of their language, and sums the differences of all pairs of sources and the largest excesses
   over the language; Spark merges sums and rankings.

A term that is in every document reaches its shard as one number a task and group. Memory is bounded by ``Limits``;
pairs of sources are the result itself and the only thing that grows with their square.

Defined results: null text, lang and source count as empty strings; rows count one by one, whatever their ids; a document without terms
still makes its (lang, source) a group; a language without kept terms has its pairs with value 0 and no terms; a language of one
source has no pairs; an empty table gives an empty result; other columns are not read. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written



class Limits(NamedTuple):
    """What a task holds at a time: bytes of text counted at once, rows of counts before they are merged, cells of terms x sources; and the most
    (lang, source) groups that are sent to every task (about 50 bytes each), beyond which they are joined."""

    chunk: int = 4_000_000
    held: int = 400_000
    cells: int = 500_000
    groups: int = 200_000


#: Probabilities are in units of 10^-9, with so many occurrences added to each term.
UNIT, ADDED = 1_000_000_000, 5
#: Fixed value: the characters of terms, as all but the ASCII characters that are no letters.
TERM_CLASS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COUNT_SQL = f"""
INSERT INTO held
SELECT lang, source, term, sum(n)::BIGINT, count(*)
FROM (SELECT i, lang, source, term, count(*) AS n
      FROM (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_CLASS}')) AS term FROM chunk)
      GROUP BY ALL)
GROUP BY ALL
"""

MERGE_SQL = """
CREATE OR REPLACE TABLE held AS
SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL
"""

KEPT_SQL = """
SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts
FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL)
GROUP BY lang, term HAVING sum(docs) >= ?
"""

#: A share of all occurrences, in UNIT, rounded down, plus 1.
_SHARE = f"1 + (({UNIT}::HUGEINT * ({{n}} + {ADDED})) // ({{total}} + {ADDED} * terms))::BIGINT"

CELLS_SQL = f"""
CREATE OR REPLACE TABLE cells AS
WITH t AS (SELECT row_number() OVER () AS k, * FROM part),
every AS (
  SELECT k, lang, term, terms, unnest(groups).source AS source, unnest(groups).total AS total,
         list_sum(counts) AS n_lang, list_sum(list_transform(groups, lambda g: g.total)) AS total_lang
  FROM t),
met AS (SELECT k, unnest(sources) AS source, unnest(counts) AS n FROM t)
SELECT k, lang, term, source, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", total="total")} AS p, {_SHARE.format(n="n_lang", total="total_lang")} AS q
FROM every LEFT JOIN met USING (k, source)
"""

PAIRS_SQL = """
INSERT INTO pairs
SELECT a.lang, a.source, b.source, sum(abs(a.p - b.p))::BIGINT
FROM cells a JOIN cells b ON a.k = b.k AND a.source < b.source GROUP BY ALL
"""

TOP_SQL = """
CREATE OR REPLACE TABLE top AS
SELECT lang, source, term, value FROM (SELECT lang, source, term, p - q AS value FROM cells WHERE n > 0 AND p > q UNION ALL SELECT * FROM top)
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {most}
"""


def _session():
    """A database in this task's memory, on one thread, that never writes to a disk."""
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '1GB'")
    con.execute("SET temp_directory = ''")
    return con


_HELD = "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)"


def _rows(con, sql: str, schema: pa.Schema, given: list | None = None) -> Iterator[pa.RecordBatch]:
    for b in con.execute(sql, given or []).to_arrow_table().cast(schema).to_batches(max_chunksize=20_000):
        if b.num_rows:
            yield b


def _held_rows(con) -> int:
    return con.execute("SELECT count(*) FROM held").fetchone()[0]


def term_counts(docs: DataFrame, limits: Limits) -> DataFrame:
    """(lang, source, term, n, docs) of each task: occurrences, and documents that have the term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, parts, size, at = _session(), [], 0, 0
        con.execute(_HELD)

        def count() -> None:
            chunk = pa.Table.from_batches(parts)
            con.register("chunk", chunk.append_column("i", pa.array(range(chunk.num_rows), pa.int64())))
            con.execute(COUNT_SQL)
            con.unregister("chunk")

        for b in batches:
            for s in range(0, b.num_rows, 256):
                parts.append(b.slice(s, 256))
                size += parts[-1].column(0).nbytes
                if size > limits.chunk:
                    count()
                    parts, size, at = [], 0, at + 1
                    if at % 4 == 0 and _held_rows(con) > limits.held:
                        con.execute(MERGE_SQL)
                        if _held_rows(con) > limits.held:  # as many are different: others get the rest
                            yield from _rows(con, "SELECT * FROM held", schema)
                            con.execute("DELETE FROM held")
        if parts:
            count()
        con.execute(MERGE_SQL)
        yield from _rows(con, "SELECT * FROM held", schema)

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least: int, limits: Limits) -> DataFrame:
    """(lang, term, sources, counts) of the terms that at least so many documents of the language have: shards by lang and term."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, size = _session(), 0
        con.execute(_HELD)
        for b in batches:
            con.register("chunk", b)
            con.execute("INSERT INTO held SELECT lang, source, term, n, docs FROM chunk")
            con.unregister("chunk")
            size += b.num_rows
            if size > limits.held:
                con.execute(MERGE_SQL)
                size = 0
        yield from _rows(con, KEPT_SQL, schema, [least])

    shards = counts.repartition(partitions(counts.sparkSession), "lang", "term")
    return shards.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>")


def shard_sums(cells: DataFrame, most: int, limits: Limits) -> DataFrame:
    """(lang, source, part, item, value) of each shard: partial sums of pairs (each once), and its own first ``most`` terms of each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, sums = _session(), 0
        con.execute("CREATE TABLE pairs (lang VARCHAR, source VARCHAR, item VARCHAR, value BIGINT)")
        con.execute("CREATE TABLE top (lang VARCHAR, source VARCHAR, term VARCHAR, value BIGINT)")
        for b in batches:
            widest = max((len(x) for x in b.column(b.schema.get_field_index("groups"))), default=1)
            step = max(1, limits.cells // max(1, widest))
            for s in range(0, b.num_rows, step):
                con.register("part", pa.Table.from_batches([b.slice(s, step)]))
                con.execute(CELLS_SQL)
                con.execute(PAIRS_SQL)
                con.execute(TOP_SQL.format(most=most))
                con.unregister("part")
                sums += 1
                if sums % 8 == 0:
                    con.execute("CREATE OR REPLACE TABLE pairs AS SELECT lang, source, item, sum(value)::BIGINT AS value FROM pairs GROUP BY ALL")
        yield from _rows(con, "SELECT lang, source, 'pair' AS part, item, sum(value)::BIGINT AS value FROM pairs GROUP BY ALL", schema)
        yield from _rows(con, "SELECT lang, source, 'term' AS part, term AS item, value FROM top", schema)

    return cells.mapInArrow(run, "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text: str = "text", lang: str = "lang", source: str = "source",
               limits: Limits = Limits()) -> DataFrame:
    """One row per (lang, source), part and item: lang, source, part, item, value, rank."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    kept = written(kept_terms(term_counts(rows, limits), least_docs, limits), "kept-terms")
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    groups = written(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total")),
        "groups")
    langs = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("groups"))
    sized = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    # a join by language alone would leave the shards' work to as many tasks as there are languages
    few = groups.count() <= limits.groups
    spread = kept.join(F.broadcast(sized), "lang") if few else kept.join(sized, "lang").repartition(partitions(docs.sparkSession), "lang", "term")
    sums = shard_sums(spread.select("lang", "term", "sources", "counts", "terms", "groups"), most_terms, limits)
    sums = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one shard, a pair in all of them
    sums = written(sums, "divergence-sums")
    pairs = sums.filter("part = 'pair'")
    # languages without kept terms: every pair is 0
    bare = groups.join(kept.select("lang").distinct(), "lang", "left_anti")
    zero = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    both = sums.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")).unionByName(
        zero.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= most_terms)).select("lang", "source", "part", "item", "value", "rank")
