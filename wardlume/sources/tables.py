"""Reading: the tables of a folder, files by extension and page bytes, sitemaps, scan payloads."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import document_id, trimmed
from ..functions.urls import origin

#: File extensions that can be audited.
FORMATS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "html": "html", "htm": "html"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that a task is to sort or gather at most, where keys are many.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: DataFrame, *keys: str, each: int = 1) -> DataFrame:
    """``df`` dealt by keys over as many tasks as its source ``rows`` (counted from file footers) need, so a task's memory doesn't grow with the table.

    Aggregates and windows by these keys, or more, then work where the rows lie. ``each``: rows that become of a row there.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows.count() * each // TASK_ROWS)), *keys)


def numbered(df: DataFrame, rows: DataFrame, keys: list[str], part: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, each row's number from 0 within keys in the order given; ``part`` never falls in that order.

    Rows are numbered within parts, and only the sizes of parts are summed over whole keys: so a key may hold more rows than a task is to sort.
    """
    x = df.withColumn("_part", part)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = x.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return dealt(x, rows, *keys, "_part").join(sizes, [*keys, "_part"]).withColumn(name, (F.col("_before") + place).cast("int")).drop("_part", "_before")


def format_of(path: Column) -> Column:
    """pdf, docx, pptx or html by extension; null for what can't be audited."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), ext)


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, format, doc_id, content of every file under a folder that can be audited; folders that start with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.filter(~F.col("path").rlike(r"/\.[^/]")).select("path", format_of(F.col("path")).alias("format"), document_id(stem).alias("doc_id"), "content").filter("format is not null")


@F.pandas_udf(StringType())
def _in_charset(content: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c).decode(n, "replace") for c, n in zip(content, charset, strict=True)], dtype=object)


def _codec(name: str | None) -> str | None:
    try:
        b"a".decode(name or "", "replace")  # a charset, not a compression
        return codecs.lookup(name).name
    except (LookupError, ValueError):
        return None


@F.pandas_udf(StringType())
def _known_charset(names: pd.Series) -> pd.Series:
    known = {n: _codec(n) for n in names.dropna().unique()}
    return names.map(lambda n: known.get(n)).astype(object).where(names.notna(), None)


def decoded_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``charset`` and ``html``, the text of each page's bytes; null bytes give nulls.

    A UTF-8 mark decides; else a known charset declared in the first 1,024 bytes (bytes that don't fit it become replacement characters); else pages that are
    valid UTF-8 are, and others are ISO-8859-1. Only pages in a charset other than these two go through Python.
    """
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    said = F.nullif(F.lower(F.regexp_extract(head, r"(?i)(?:charset|encoding)\s*=\s*[\"']?\s*([a-z0-9_.:\-]+)", 1)), F.lit(""))
    mark = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    body = F.when(mark, F.expr(f"substring({content}, 4)")).otherwise(F.col(content))
    x = files.withColumns({"_body": body, "_mark": F.coalesce(mark, F.lit(False)), "_said": said})
    plain = F.when(F.col("_said").isin("utf-8", "utf8"), "utf-8").when(F.col("_said").isin("iso-8859-1", "latin1", "latin-1"), "iso8859-1")
    x = x.withColumn("_declared", F.when(F.col("_mark"), "utf-8").otherwise(F.coalesce(plain, _known_charset(F.when(plain.isNull(), F.col("_said"))))))
    guess = F.when(F.is_valid_utf8(F.col("_body").cast("string")), "utf-8").otherwise("iso8859-1")
    x = x.withColumn("charset", F.when(F.col("_body").isNotNull(), F.coalesce("_declared", guess)))
    other = ~F.col("charset").isin("utf-8", "iso8859-1")
    html = (F.when(F.col("charset") == "utf-8", F.make_valid_utf8(F.col("_body").cast("string"))).when(F.col("charset") == "iso8859-1", F.decode("_body", "ISO-8859-1"))
            .otherwise(_in_charset(F.when(other, F.col("_body")), F.col("charset"))))
    return x.withColumn("html", html).drop("_body", "_mark", "_said", "_declared")


def _addresses(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s][^<]*?)\s*</loc>"), 1)


def discovered_urls(seeds: DataFrame, sitemaps: DataFrame, most: int = 50) -> DataFrame:
    """(seed, pos, url): each ``seed`` first, then the addresses of its origin in its sitemap, once each up to last slashes, ``most`` at most.

    ``sitemaps`` (url, xml) are the files that were fetched. Where a site's sitemap.xml is an index, the sitemaps that it names are read in its order, one level down.
    Seeds without a scheme are https; blank ones are left out, and a site without a sitemap has its seed alone.
    """
    seed = F.when(F.contains(trimmed(F.col("seed")), F.lit("://")), trimmed(F.col("seed"))).otherwise(F.concat(F.lit("https://"), trimmed(F.col("seed"))))
    s = seeds.filter(trimmed(F.col("seed")) != "").select(seed.alias("seed")).distinct()
    files = sitemaps.filter("xml is not null").groupBy("url").agg(F.min("xml").alias("xml"))
    here = origin(F.col("loc")) == origin(F.col("seed"))
    top = s.withColumn("url", F.concat(F.regexp_extract("seed", r"^([^:]+://[^/?#]*)", 1), F.lit("/sitemap.xml"))).join(files, "url")
    top = top.select("seed", F.contains(F.lower(F.substring("xml", 1, 4096)), F.lit("<sitemapindex")).alias("index"), F.posexplode(_addresses(F.col("xml"))).alias("i", "loc"))
    top = top.filter(F.contains("loc", F.lit("://")) & here)
    below = top.filter("index").select("seed", "i", F.col("loc").alias("url")).join(files, "url").select("seed", "i", F.posexplode(_addresses(F.col("xml"))).alias("j", "loc"))
    below = below.filter(F.contains("loc", F.lit("://")) & here)
    none = F.lit(-1)
    found = s.select("seed", none.alias("i"), none.alias("j"), F.col("seed").alias("loc")).unionByName(top.filter("not index").select("seed", "i", none.alias("j"), "loc")).unionByName(below.select("seed", "i", "j", "loc"))
    first = found.groupBy("seed", F.regexp_replace("loc", "/+$", "").alias("key")).agg(F.min(F.struct("i", "j", F.col("loc").alias("url"))).alias("x"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy("x.i", "x.j"))
    return first.select("seed", place.alias("pos"), "x.url").filter(F.col("pos") <= most)


SCAN_PAYLOAD = "struct<title:string,images:array<struct<alt_text:string,decorative:boolean>>,headings:array<struct<id:string,level:int,text:string>>>"


def scan_payload_nodes(payloads: DataFrame, doc_id: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(doc_id, node_type, pos, level, text, alt_text, is_decorative) of JSON payloads: levels held to 1..6, an empty heading reads Heading."""
    p = payloads.select(F.col(doc_id).alias("doc_id"), F.from_json(payload, SCAN_PAYLOAD).alias("p"))
    none = {"level": F.lit(None).cast("int"), "text": F.lit(None).cast("string"), "alt_text": F.lit(None).cast("string"), "is_decorative": F.lit(None).cast("boolean")}
    images = p.select("doc_id", F.posexplode("p.images").alias("pos", "x")).select(
        "doc_id", F.lit("image").alias("node_type"), "pos", none["level"].alias("level"), none["text"].alias("text"), F.col("x.alt_text").alias("alt_text"),
        F.coalesce("x.decorative", F.lit(False)).alias("is_decorative"))
    label = trimmed(F.coalesce(F.col("x.text"), F.lit("")))
    headings = p.select("doc_id", F.posexplode("p.headings").alias("pos", "x")).select(
        "doc_id", F.lit("heading").alias("node_type"), "pos", F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("x.level", F.lit(1)))).alias("level"),
        F.when(label == "", "Heading").otherwise(label).alias("text"), none["alt_text"].alias("alt_text"), none["is_decorative"].alias("is_decorative"))
    return images.unionByName(headings)
