"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, bpe_codec, divergence, exact_dedup, hilbert, html_blocks, katz, line_dedup, minhash_forest, ngram_join, packing, quality_rules, whitening
from .shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(_table(spark, sf_dir, "documents"), ["n_chars", "source", "lang"], shards=8, law="rows")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return line_dedup.line_dedup(docs.select("doc_id", "text", lines.alias("n_lines"))).select(
        "doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_blocks.extract(_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


def _tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, capacity=4096)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost")


def op7_bitplane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
    bitplane.write_planes(_table(spark, sf_dir, "documents"), out, _tokenizer("byte_bpe_50k.json"), end_id=0)
    return bitplane.read_planes(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "n_stop_words", "n_lines", "n_shout_lines", "base_failed", "kept")


def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), scale=256, most=4)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_dedup(_table(spark, sf_dir, "documents"), percent=85, width=3)


QUERIES = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_blocks": op3_html_blocks,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_packing": op5_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bitplane_output": op7_bitplane_output,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_katz_backoff": op10_katz_backoff,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_minhash_forest": op13_minhash_forest,
}

# DuckDB's RE2 has no lone surrogates and splits as Java does here: the class is plain ASCII.
_SEP = r"[ \t\n\x0B\x0C\r]"

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '{_SEP}', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws}))


def _rule_sql(r: quality_rules.Rule) -> str:
    parts = ([f"1000 * {r.numerator} >= {r.lower} * {r.denominator}"] if r.lower is not None else []) + (
        [f"1000 * {r.numerator} <= {r.upper} * {r.denominator}"] if r.upper is not None else [])
    return f"({r.denominator} = 0 OR ({' AND '.join(parts)}))"


OP9_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SEP}+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\x0C\r]')) AS lines
  FROM documents),
t AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(lines, lambda x: upper(x) = x AND lower(x) <> x))::BIGINT AS n_shout_lines,
         1 AS one
  FROM w LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, n_shout_lines,
       NOT ({' AND '.join(_rule_sql(r) for r in quality_rules.RULES if r.name in quality_rules.BASE_RULES)}) AS base_failed,
       {' AND '.join(_rule_sql(r) for r in quality_rules.RULES)} AS kept
FROM m
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
df AS (SELECT lang, term FROM (SELECT DISTINCT i, lang, term FROM w) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN df USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
l AS (SELECT lang, sum(total) AS total FROM s GROUP BY ALL),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, df.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (lc.n + 5)) // (l.total + 5 * v.v) AS q
  FROM g JOIN df USING (lang) JOIN v USING (lang) JOIN l USING (lang) JOIN lc ON lc.lang = g.lang AND lc.term = df.term
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = df.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, abs(a.p - b.p) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
items AS (
  SELECT lang, source, part, item, sum(value)::BIGINT AS value FROM pairs GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM items)
WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {"op6_exact_dedup": OP6_SQL, "op9_quality_rules": OP9_SQL, "op12_source_divergence": OP12_SQL}
