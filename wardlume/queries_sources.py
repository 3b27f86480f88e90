"""Registered queries of sources and sinks: sitemaps and findings derived from whole shipped tables; what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Derived, pick, query
from .sources import sinks, tables
from .sources.staging import new_path

_SITE = "concat('https://s', c_custkey, '.org')"


def _map(*places: str) -> str:
    """An expression of a sitemap's text that names places of a customer's site, or whole addresses."""
    parts = [f"'<loc> ', {'' if p.startswith('http') else _SITE + ', '}'{p}', ' </loc>'" for p in places]
    return f"concat({', '.join(parts)})"


_ROOT = (f"CASE c_custkey % 4 WHEN 0 THEN concat('<sitemapindex>', {_map('/m1.xml', 'https://other.org/m0.xml', '/m0.xml', '/gone.xml')}) "
         f"WHEN 1 THEN {_map('/a', '/b/', '', '/a/', 'https://other.org/a', '/c')} WHEN 2 THEN 'no sitemap' END")
_FILES = {
    "sitemap.xml": _ROOT, "m0.xml": _map("/a", "/m1.xml", "/z/"),
    "m1.xml": f"CASE c_custkey % 3 WHEN 0 THEN concat('<sitemapindex>', {_map('/m0.xml', '/x')}) ELSE {_map('/z', '/y', 'https://other.org/q', '/w', '/v')} END"}
_SITES = Derived("customer", {"k": "c_custkey", "seed": f"CASE c_custkey % 5 WHEN 0 THEN concat(' s', c_custkey, '.org/') WHEN 1 THEN concat({_SITE}, '/a') ELSE {_SITE} END"})
_MAPS = [Derived("customer", {"url": f"concat({_SITE}, '/{name}')", "xml": xml}) for name, xml in _FILES.items()]


@query(rf"""WITH s AS (SELECT k, concat('https://s', k, '.org') AS site, CASE WHEN contains(seed, '://') THEN trim(seed) ELSE concat('https://', trim(seed)) END AS seed FROM {_SITES.sql}),
m AS ({" UNION ALL ".join(f"SELECT * FROM {x.sql}" for x in _MAPS)}), l AS (SELECT url, contains(xml, '<sitemapindex') AS nested, regexp_extract_all(xml, '<loc>\s*([^<\s][^<]*?)\s*</loc>', 1) AS locs FROM m WHERE xml IS NOT NULL),
t AS (SELECT seed, site, nested, unnest(locs) AS loc, generate_subscripts(locs, 1) AS i FROM s JOIN l ON l.url = concat(site, '/sitemap.xml')), h AS (SELECT * FROM t WHERE loc = site OR starts_with(loc, concat(site, '/'))),
b AS (SELECT seed, site, i, unnest(locs) AS loc, generate_subscripts(locs, 1) AS j FROM h JOIN l ON l.url = h.loc WHERE h.nested),
f AS (SELECT seed, 0 AS i, 0 AS j, seed AS url FROM s UNION ALL SELECT seed, i, 0, loc FROM h WHERE NOT nested UNION ALL SELECT seed, i, j, loc FROM b WHERE loc = site OR starts_with(loc, concat(site, '/'))),
d AS (SELECT *, row_number() OVER (PARTITION BY seed, rtrim(url, '/') ORDER BY i, j) AS nth FROM f), o AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY i, j) AS pos, url FROM d WHERE nth = 1)
SELECT seed, pos::INT AS pos, url FROM o WHERE pos <= 5""")
def site_addresses(spark, sf):
    maps = _MAPS[0].df(spark, sf)
    for x in _MAPS[1:]:
        maps = maps.unionByName(x.df(spark, sf))
    return tables.discovered_urls(_SITES.df(spark, sf), maps, most=5)


_ISSUES = Derived("lineitem", {"doc_id": "l_orderkey", "phase": "CASE WHEN l_linenumber % 2 = 0 THEN 'after' ELSE 'before' END", "rule": "l_partkey"})


@query(f"""WITH i AS (SELECT * FROM {_ISSUES.sql}), n AS (SELECT doc_id, phase, rule + 1000000 AS rule FROM i WHERE doc_id % 3 = 0 AND phase = 'after')
SELECT * FROM n UNION ALL SELECT * FROM i WHERE NOT (phase = 'after' AND doc_id % 3 = 0) AND NOT (phase = 'before' AND doc_id % 5 = 0)""")
def replaced_phases(spark, sf):
    """A first write of all, then, twice, of a third of the documents after, with a fifth audited anew before and found clean."""
    i, folder = _ISSUES.df(spark, sf), new_path(spark, "issues")
    sinks.replace_phases(i, folder, buckets=16)
    new = i.filter("doc_id % 3 = 0 and phase = 'after'").withColumn("rule", F.col("rule") + 1000000)
    clean = i.filter("doc_id % 5 = 0").select("doc_id", F.lit("before").alias("phase")).distinct()
    for _ in range(2):
        sinks.replace_phases(new, folder, audited=clean, buckets=16)
    return sinks.read_phases(spark, folder).select("doc_id", "phase", "rule")


_FOUND = Derived("lineitem", {"doc_id": "l_suppkey", "rule_id": pick("l_partkey", "LINK_NAME_MISSING", "TABLE_NESTED", "MISSING_ALT_TEXT"), "node_id": "concat('n', l_orderkey)",
                              "note": "CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN concat('a, b ', l_partkey) ELSE concat('p', l_partkey) END"})


@query(f"""WITH f AS (SELECT *, concat('{{"rule_id":"', rule_id, '","node_id":"', node_id, '"', CASE WHEN note IS NULL THEN '' ELSE concat(',"note":"', note, '"') END, '}}') AS json,
 concat(rule_id, ',', node_id, ',', CASE WHEN note IS NULL THEN '' WHEN contains(note, ',') THEN concat('"', note, '"') ELSE note END) AS csv FROM {_FOUND.sql}),
t AS (SELECT doc_id, string_agg(concat(json, chr(10)), '' ORDER BY rule_id, node_id, json) AS json, concat('rule_id,node_id,note', chr(10), string_agg(concat(csv, chr(10)), '' ORDER BY rule_id, node_id, csv)) AS csv FROM f GROUP BY 1)
SELECT doc_id::VARCHAR AS doc_id, concat(doc_id, '.zip') AS file, 'findings.jsonl' AS entry, strlen(json) AS bytes, sha256(json) AS sha256 FROM t UNION ALL SELECT doc_id::VARCHAR, concat(doc_id, '.zip'), 'checks.csv', strlen(csv), sha256(csv) FROM t""")
def bundle_manifest(spark, sf):
    return sinks.write_bundles(_FOUND.df(spark, sf), new_path(spark, "bundles")).filter("entry is not null")
