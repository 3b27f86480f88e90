import hashlib
import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from wardlume.sources import sinks, tables

ROWS = "doc_id long, phase string, rule string"


def _phases(spark, folder):
    return sorted(tuple(r) for r in sinks.read_phases(spark, folder).select("doc_id", "phase", "rule").collect())


def test_phases_are_replaced_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/issues"
    first = [(1, "before", "a"), (1, "before", "b"), (1, "after", "c"), (2, "before", "a"), (3, "before", "a"), (None, "before", "x"), (4, None, "x")]
    sinks.replace_phases(spark.createDataFrame(first, ROWS), folder, buckets=2)
    assert _phases(spark, folder) == sorted(r for r in first if None not in r)
    again = spark.createDataFrame([(1, "before", "z")], ROWS)
    clean = spark.createDataFrame([(3, "before"), (9, "after")], "doc_id long, phase string")
    for _ in range(2):
        sinks.replace_phases(again, folder, audited=clean, buckets=2)
        assert _phases(spark, folder) == [(1, "after", "c"), (1, "before", "z"), (2, "before", "a")]
    empty = spark.createDataFrame([], ROWS)
    sinks.replace_phases(empty, folder, audited=spark.createDataFrame([(1, "before"), (1, "after"), (2, "before")], "doc_id long, phase string"), buckets=2)
    assert _phases(spark, folder) == []
    # a new column, and an untouched partition stays as it is
    sinks.replace_phases(again.withColumn("severity", F.lit("high")), folder, buckets=2)
    assert _phases(spark, folder) == [(1, "before", "z")]


def test_digests_are_read_in_pieces(spark, tmp_path):
    big = os.urandom(sinks.CHUNK * 2 + 17)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.bin").write_bytes(big)
    (tmp_path / "two.bin").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in sinks.file_digests(spark, f"file://{tmp_path}").collect()}
    assert got == {"one.bin": (len(big), hashlib.sha256(big).hexdigest()), "two.bin": (1, hashlib.sha256(b"x").hexdigest())}


def test_bundles_hold_what_the_manifest_says(spark, tmp_path):
    rows = [(d, f"R{i % 3}", f"n{i:04d}", 'say "x", y\nz' if i % 2 else None, {"k": str(i)}) for d in (1, 2) for i in range(50)] + [(None, "R", "n", None, None)]
    found = spark.createDataFrame(rows, "doc_id long, rule_id string, node_id string, note string, evidence map<string,string>")
    manifest = sinks.write_bundles(found, f"file://{tmp_path}/out").collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["1.zip", "2.zip"] and len(manifest) == 6
    for m in manifest:
        data = (tmp_path / "out" / m.file).read_bytes()
        part = data if m.entry is None else zipfile.ZipFile(io.BytesIO(data)).read(m.entry)
        assert (len(part), hashlib.sha256(part).hexdigest()) == (m.bytes, m.sha256)
    lines = [json.loads(x) for x in zipfile.ZipFile(tmp_path / "out" / "1.zip").read("findings.jsonl").decode().splitlines()]
    assert [(x["rule_id"], x["node_id"]) for x in lines] == sorted((r, n) for d, r, n, *_ in rows if d == 1)
    again = sinks.write_bundles(found.repartition(7), f"file://{tmp_path}/out").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, manifest), key=str)
    assert sinks.write_bundles(found.limit(0), f"file://{tmp_path}/none").count() == 0


def test_declared_charsets(spark):
    pages = {
        "mark": b"\xef\xbb\xbf<p>\xc3\xa9", "plain": "<p>é".encode(), "latin": b"<p>\xe9", "said": "<meta charset='windows-1251'><p>Привет".encode("cp1251"), "xml": "<?xml encoding=\"Shift_JIS\"?><p>日本".encode("shift_jis"),
        "utf": "<meta charset=utf-8><p>é".encode() + b"\xff", "odd": "<meta charset=\"klingon\"><p>é".encode(), "zip": b"<meta charset=zlib><p>a", "none": None, "iso": b"<meta charset=ISO-8859-1><p>\xe9", "empty": b""}
    df = tables.decoded_pages(spark.createDataFrame([(k, v) for k, v in pages.items()], "name string, content binary"))
    got = {r.name: (r.charset, r.html) for r in df.collect()}
    assert got == {
        "mark": ("utf-8", "<p>é"), "plain": ("utf-8", "<p>é"), "latin": ("iso8859-1", "<p>é"), "said": ("cp1251", "<meta charset='windows-1251'><p>Привет"), "xml": ("shift_jis", "<?xml encoding=\"Shift_JIS\"?><p>日本"),
        "utf": ("utf-8", "<meta charset=utf-8><p>é�"), "odd": ("utf-8", "<meta charset=\"klingon\"><p>é"), "zip": ("utf-8", "<meta charset=zlib><p>a"), "none": (None, None),
        "iso": ("iso8859-1", "<meta charset=ISO-8859-1><p>é"), "empty": ("utf-8", "")}


def test_nested_sitemaps(spark):
    loc = lambda *urls: "".join(f"<LOC>\n{u} </loc>" for u in urls)
    files = [("https://a.org/sitemap.xml", "<sitemapindex>" + loc("https://a.org/2.xml", "https://b.org/3.xml", "https://A.org:443/1.xml")), ("https://a.org/2.xml", loc("https://a.org/x", "ftp://a.org/y", "/z", "https://a.org/", "https://a.org/x/")),
             ("https://A.org:443/1.xml", loc("https://a.org/w")), ("https://b.org/3.xml", loc("https://a.org/never")), ("https://c.org/sitemap.xml", loc(*[f"https://c.org/{i}" for i in range(70)]))]
    got = {}
    for r in tables.discovered_urls(spark.createDataFrame([("a.org/",), ("https://c.org",), ("https://d.org/q",), (" ",), (None,)], "seed string"), spark.createDataFrame(files, "url string, xml string")).orderBy("seed", "pos").collect():
        got.setdefault(r.seed, []).append(r.url)
    assert got == {"https://a.org/": ["https://a.org/", "https://a.org/x", "https://a.org/w"], "https://c.org": ["https://c.org"] + [f"https://c.org/{i}" for i in range(49)], "https://d.org/q": ["https://d.org/q"]}
