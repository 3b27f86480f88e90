"""Registered queries of rules, structure and fixes, over node tables derived from whole shipped tables.

The shipped pages trigger few rules, so documents of every kind of fault are derived from the other tables: an order, a part or
a customer becomes a document, its rows the document's nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import color, fixed_values, text
from .operators import executors, layout, rules
from .registry import Derived, pick, query
from .sources.tables import dealt, table


def _values(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


def _hits(nodes: DataFrame, *names: str) -> DataFrame:
    return reduce(DataFrame.union, [rules.RULES[n](nodes).select("doc_id", "node_id", "rule_id") for n in names])


def _props(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumn("props", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]))


def _cases(cases: dict[str, str]) -> str:
    """SQL of (doc_id, node_id, rule_id) for each rule's condition over the table x."""
    return " UNION ALL ".join(f"SELECT doc_id, node_id, '{n}' AS rule_id FROM x WHERE {c}" for n, c in cases.items())


_BLANK = "(trim({0}) = '' OR {0} IS NULL)"

# a part's image
IMAGES = Derived("part", {
    "doc_id": "p_partkey", "node_id": "concat('i', p_partkey)", "node_type": "'image'", "is_decorative": "p_partkey % 5 = 0",
    "alt_text": f"CASE WHEN p_partkey % 13 < 11 THEN {pick('(p_partkey % 13)', None, '  ', 'IMG_1234.png', 'image', 'Figure 12', 'https://x.org/a', '640x480', 'N/A', 'picture shown on page 3', 'DSC_0042', 'Photo: page 2')} ELSE p_name END"})
_JUNK_SQL = rf"""(low IN ({_values(fixed_values.JUNK_ALT)}) OR regexp_matches(low, '\.({'|'.join(fixed_values.IMAGE_EXTENSIONS)})$') OR regexp_matches(low, '^(https?://|www\.|ftp://|file:|data:image/)')
 OR regexp_matches(low, '^[0-9]{{2,5}}\s*[x×*]\s*[0-9]{{2,5}}(\s*px)?$') OR regexp_matches(low, '^({'|'.join(fixed_values.IMAGE_WORDS)})[\s_\-#:]*[0-9]*$')
 OR regexp_matches(low, '^(image|picture|figure|graphic|photo|img)\b.*?\bshown\s+(in|on)\s+(the\s+)?(page|slide|sheet|document|deck|file)(\s*[0-9]+)?\.?$')
 OR regexp_matches(low, '^(image|picture|figure|graphic|photo|img)\b.*?\b(page|slide|sheet)\s*[0-9]+\.?$') OR regexp_matches(low, '^({'|'.join(fixed_values.CAMERA_PREFIXES)})[\s_\-]?[0-9]+'))"""
_IMAGES_SQL = f"WITH x AS (SELECT *, lower(trim(coalesce(alt_text, ''))) AS low FROM {IMAGES.sql})"


@query(f"{_IMAGES_SQL} " + _cases({"MISSING_ALT_TEXT": "NOT is_decorative AND low = ''", "DECORATIVE_IMAGE_WITH_ALT": "is_decorative AND low <> ''", "ALT_TEXT_NOT_DESCRIPTIVE": f"NOT is_decorative AND low <> '' AND {_JUNK_SQL}"}))
def image_findings(spark, sf):
    return _hits(IMAGES.df(spark, sf), "MISSING_ALT_TEXT", "DECORATIVE_IMAGE_WITH_ALT", "ALT_TEXT_NOT_DESCRIPTIVE")


@query(f"{_IMAGES_SQL} SELECT doc_id, node_id, low <> '' AND {_JUNK_SQL} AS nondescriptive FROM x")
def alt_junk(spark, sf):
    return IMAGES.df(spark, sf).select("doc_id", "node_id", text.alt_is_nondescriptive(F.col("alt_text")).alias("nondescriptive"))


@query(f"SELECT doc_id, node_id, CASE WHEN is_decorative THEN NULL ELSE alt_text END AS alt_text FROM {IMAGES.sql} x")
def decorative_alt_removed(spark, sf):
    return executors.without_decorative_alt(IMAGES.df(spark, sf)).select("doc_id", "node_id", "alt_text")


# an order's document node
DOCUMENTS = Derived("orders", {
    "doc_id": "o_orderkey", "node_id": "'root'", "node_type": "'document'", "parent_id": "CAST(NULL AS STRING)", "text": "CAST(NULL AS STRING)", "content_kind": "'none'", "dfs_pos": "0",
    "language": pick("o_orderkey", None, " ", "en", "fr"), "source_format": pick("o_custkey", "pdf", "docx", "pptx", "html", "pdf"),
    "title": f"CASE WHEN o_orderkey % 9 < 7 THEN {pick('(o_orderkey % 9)', None, 'Untitled', 'Document 3', 'Report', ' ', 'Microsoft Word - plan', 'report.docx')} ELSE concat('Annual report ', o_orderkey) END",
    "filename": pick("o_custkey", "report.docx", "annual-plan_2.pdf", None),
    "iframes_missing_title": "o_orderkey % 3", "inputs_missing_autocomplete": "o_custkey % 2", "positive_tabindex_count": "o_orderkey % 4", "label_in_name_mismatches": "o_custkey % 5 - 2",
    "form_fields_unlabeled": "o_orderkey % 7 - 3", "form_fields_derivable": "o_orderkey % 6 - 2", "page_count": "o_orderkey % 6", "image_only_pages": "o_custkey % 6", "total_text_chars": "o_orderkey % 700",
    "pdf_tagged": "o_custkey % 3 = 0", "pages_truncated": "o_orderkey % 10 = 0", "pages_processed": "400", "missing_title": "o_orderkey % 8 = 0",
    "reading_order": pick("o_orderkey", None, "ambiguous", "known", "unknown", "known"), "reading_order_confidence": pick("o_custkey", None, "1.0", "0.7", "sure")})
_PROPS = [c for c in DOCUMENTS.columns if c not in ("doc_id", "node_id", "node_type", "parent_id", "text", "content_kind", "dfs_pos", "language", "source_format")]


def _documents(spark, sf):
    return _props(DOCUMENTS.df(spark, sf), *_PROPS)


_PLACEHOLDER = rf"""(low IN ({_values(fixed_values.GENERIC_TITLES)}) OR regexp_matches(low, '^({'|'.join(fixed_values.NUMBERED_TITLES)})\s*[0-9]+$') OR regexp_matches(low, '^microsoft (word|powerpoint|excel)\s*[-–]\s*')
 OR (coalesce(filename, '') <> '' AND low IN (filename, regexp_replace(filename, '\.[^.]*$', ''))))"""
_SCANNED = "(source_format = 'pdf' AND page_count > 0 AND image_only_pages >= 0.8 * page_count AND total_text_chars::DOUBLE / nullif(page_count, 0) < 50)"
DOCUMENT_RULES = {
    "IFRAME_TITLE_MISSING": "iframes_missing_title > 0", "INPUT_AUTOCOMPLETE_MISSING": "inputs_missing_autocomplete > 0", "POSITIVE_TABINDEX": "positive_tabindex_count > 0",
    "LABEL_IN_NAME_MISMATCH": "label_in_name_mismatches > 0", "FORM_FIELD_UNLABELED": "form_fields_unlabeled > 0", "DOCUMENT_LANGUAGE_MISSING": _BLANK.format("language"),
    "DOCUMENT_TITLE_MISSING": f"low = '' OR {_PLACEHOLDER}", "SCANNED_DOCUMENT_NO_TEXT": _SCANNED,
    "PDF_UNTAGGED": f"source_format = 'pdf' AND NOT pdf_tagged AND page_count > 0 AND NOT coalesce({_SCANNED}, false) AND total_text_chars >= 200", "ANALYSIS_TRUNCATED": "pages_truncated"}
_DOCUMENTS_SQL = f"WITH x AS (SELECT *, lower(trim(coalesce(title, ''))) AS low FROM {DOCUMENTS.sql})"


@query(f"{_DOCUMENTS_SQL} {_cases(DOCUMENT_RULES)}")
def document_findings(spark, sf):
    return _hits(_documents(spark, sf), *DOCUMENT_RULES)


@query(f"""{_DOCUMENTS_SQL}, n AS (SELECT doc_id, 'FILL_FORM_FIELD_LABELS' AS action_code, form_fields_derivable::INT AS n FROM x UNION ALL SELECT doc_id, 'SET_INPUT_AUTOCOMPLETE', inputs_missing_autocomplete::INT FROM x
 UNION ALL SELECT doc_id, 'FIX_POSITIVE_TABINDEX', positive_tabindex_count::INT FROM x) SELECT * FROM n WHERE n > 0""")
def counter_fixes(spark, sf):
    return executors.counter_fixes(_documents(spark, sf))


@query(f"SELECT doc_id, 'root' AS node_id FROM {DOCUMENTS.sql} x WHERE coalesce(reading_order, '') IN ('ambiguous', 'unknown') OR coalesce(try_cast(reading_order_confidence AS DOUBLE), 1.0) < 1 UNION ALL "
       "SELECT l_orderkey, concat('s', l_linenumber) FROM lineitem WHERE l_partkey % 4 = 0 AND l_suppkey % 2 = 0")
def reading_order_findings(spark, sf):
    sections = Derived("lineitem", {"doc_id": "l_orderkey", "node_id": "concat('s', l_linenumber)", "node_type": "'section'", "parent_id": "CASE WHEN l_suppkey % 2 = 0 THEN 'root' ELSE 'other' END", "reading_order_inverted": "l_partkey % 4 = 0"})
    columns = ("doc_id", "node_id", "node_type", "parent_id", "props")
    nodes = _documents(spark, sf).select(*columns).union(_props(sections.df(spark, sf), "reading_order_inverted").select(*columns))
    return _hits(nodes, "READING_ORDER_AMBIGUOUS").select("doc_id", "node_id")


@query(f"""WITH d AS {DOCUMENTS.sql}, s AS (SELECT l_orderkey AS doc_id, concat('s', l_linenumber) AS node_id FROM lineitem WHERE l_partkey % 9 = 0)
SELECT * FROM s UNION ALL SELECT doc_id, node_id FROM d WHERE missing_title AND doc_id NOT IN (SELECT doc_id FROM s)""")
def slide_title_findings(spark, sf):
    slides = Derived("lineitem", {"doc_id": "l_orderkey", "node_id": "concat('s', l_linenumber)", "node_type": "'section'", "missing_title": "l_partkey % 9 = 0"})
    columns = ("doc_id", "node_id", "node_type", "props")
    return _hits(_documents(spark, sf).select(*columns).union(_props(slides.df(spark, sf), "missing_title").select(*columns)), "SLIDE_TITLE_MISSING").select("doc_id", "node_id")


# an order's lines as headings, paragraphs and links
PARTS = Derived("lineitem", {
    "doc_id": "l_orderkey", "node_id": "concat('n', l_linenumber, '-', l_partkey, '-', l_suppkey)", "dfs_pos": "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey", "node_type": pick("l_partkey", "heading", "paragraph", "link", "heading"),
    "content_kind": pick("l_suppkey", "text", "text", "none", "text", "text"), "level": "CAST(l_suppkey % 6 + 1 AS INT)",
    "text": f"CASE WHEN l_suppkey % 11 < 9 THEN {pick('(l_suppkey % 11)', None, ' ', 'Click here!', 'https://example.org/x', 'Read more…', '42', 'example.co/page', 'Our plan for the year', 'here')} ELSE concat('Part ', l_partkey) END",
    "target": f"CASE WHEN l_partkey % 9 < 7 THEN {pick('(l_partkey % 9)', None, ' ', '#', 'HTTP://', 'JavaScript:void(0)', 'https:///x', 'ftp://h/x')} ELSE concat('https://www.site', l_suppkey, '.org/a/', l_partkey) END",
    "looks_like_heading": "l_quantity > 40", "link_nameless": "l_suppkey % 17 = 0", "color": pick("l_partkey", None, "#777", "rgb(200, 200, 0)", "navy", "#FFFFFF80", "nocolour", "#0000ffff"),
    "background": pick("l_suppkey", None, "#EEEEEE", "black"), "size_pt": "8 + l_partkey % 14", "bold": "l_suppkey % 4 = 0"})
_LINK_RE = r"(?i)^(?:https?://\S+|www\.\S+|[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9\-]+)*\.(?:" + fixed_values.LINK_DOMAINS + r"|gov\.uk)(?:/\S*)?)$"
_GENERIC = f"(n = '' OR n IN ({_values(fixed_values.GENERIC_LINK_TEXT)}) OR regexp_matches(trim(coalesce(text, '')), '{_LINK_RE}'))"
_PARTS_SQL = rf"WITH x AS (SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]+', '', 'g'), '\s+', ' ', 'g')) AS n, lag(level) OVER (PARTITION BY doc_id, node_type ORDER BY dfs_pos) AS before FROM {PARTS.sql})"
PART_RULES = {
    "HEADING_LEVEL_JUMP": "node_type = 'heading' AND level > before + 1", "TEXT_STYLED_AS_HEADING": "node_type = 'paragraph' AND looks_like_heading", "HEADING_TEXT_EMPTY": f"node_type = 'heading' AND (content_kind <> 'text' OR {_BLANK.format('text')})",
    "LINK_TEXT_NON_DESCRIPTIVE": f"node_type = 'link' AND content_kind = 'text' AND {_GENERIC}", "LINK_NAME_MISSING": "node_type = 'link' AND link_nameless",
    "LINK_TARGET_BROKEN": "node_type = 'link' AND (target IS NULL OR lower(trim(target)) IN ('', '#', 'http://', 'https://') OR lower(trim(target)) LIKE 'javascript:%')"}


def _parts(spark, sf):
    return _props(PARTS.df(spark, sf), "looks_like_heading", "link_nameless", "color", "background", "size_pt", "bold")


@query(f"{_PARTS_SQL} {_cases(PART_RULES)}")
def node_findings(spark, sf):
    return _hits(_parts(spark, sf), *PART_RULES)


_PLAIN_LINE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


@query(rf"""WITH x AS (SELECT *, trim(coalesce(target, '')) AS v FROM {PARTS.sql}), y AS (SELECT *, lower(regexp_extract(v, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS scheme, regexp_extract(v, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1) AS host FROM x)
SELECT doc_id, node_id, CASE WHEN v = '' THEN 'missing_target' WHEN v LIKE '#%' THEN '' WHEN lower(v) IN ('http://', 'https://', 'www.', 'mailto:') THEN 'placeholder_target' WHEN scheme IN ('http', 'https') AND host = '' THEN 'missing_host'
 WHEN scheme IN ('http', 'https', 'mailto') THEN '' WHEN scheme = '' THEN '' ELSE 'unsupported_scheme' END AS reason FROM y""")
def link_reasons(spark, sf):
    return PARTS.df(spark, sf).select("doc_id", "node_id", text.invalid_link_reason(F.col("target")).alias("reason"))


def _luminance(c: str) -> str:
    part = [f"(('0x' || substr({c}, {i}, 2))::INT / 255.0::DOUBLE)" for i in (1, 3, 5)]
    lin = [f"(CASE WHEN {p} <= 0.03928 THEN {p} / 12.92::DOUBLE ELSE pow(({p} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)" for p in part]
    return f"({lin[0]} * 0.2126::DOUBLE + {lin[1]} * 0.7152::DOUBLE + {lin[2]} * 0.0722::DOUBLE)"


_SEEN = "CASE color WHEN '#777' THEN '777777' WHEN 'rgb(200, 200, 0)' THEN 'C8C800' WHEN 'navy' THEN '000080' WHEN '#0000ffff' THEN '0000FF' END"
_CONTRAST_SQL = f"""WITH p AS (SELECT *, {_SEEN} AS fg, CASE background WHEN '#EEEEEE' THEN 'EEEEEE' WHEN 'black' THEN '000000' ELSE 'FFFFFF' END AS bg, CASE WHEN size_pt >= 18 OR (bold AND size_pt >= 14) THEN 3.0 ELSE 4.5 END::DOUBLE AS need FROM {PARTS.sql}),
l AS (SELECT *, {_luminance('fg')} AS a, {_luminance('bg')} AS b FROM p WHERE fg IS NOT NULL), x AS (SELECT *, (greatest(a, b) + 0.05::DOUBLE) / (least(a, b) + 0.05::DOUBLE) AS ratio FROM l)"""


@query(f"{_CONTRAST_SQL} SELECT doc_id, node_id, 'LOW_CONTRAST_TEXT' AS rule_id FROM x WHERE ratio + 0.05::DOUBLE < need")
def contrast_findings(spark, sf):
    return _hits(_parts(spark, sf), "LOW_CONTRAST_TEXT")


@query(f"SELECT node_id, doc_id, {_SEEN} AS hex FROM {PARTS.sql} x")
def css_colors(spark, sf):
    return PARTS.df(spark, sf).select("node_id", "doc_id", color.css_hex(F.col("color")).alias("hex"))


def passing_sql(x: str, where: str = "") -> str:
    """The nearest passing colour of (id, fg, bg, need): the fewest of 64 steps to black and to white, the smaller change of the two."""
    mixed = " || ".join(f"lpad(upper(to_hex(round_even(c{i} + (goal - c{i}) * (i::DOUBLE / 64), 0)::INT)), 2, '0')" for i in (1, 3, 5))
    far = " + ".join(f"pow((goal - c{i}) * i::DOUBLE / 64, 2)" for i in (1, 3, 5))
    parts = ", ".join(f"('0x' || substr(fg, {i}, 2))::INT::DOUBLE AS c{i}" for i in (1, 3, 5))
    return f"""q AS (SELECT id, fg, bg, need, {parts}, {_luminance('bg')} AS lb, {_luminance('fg')} AS lf FROM {x}), o AS (SELECT * FROM q WHERE (greatest(lf, lb) + 0.05::DOUBLE) / (least(lf, lb) + 0.05::DOUBLE) < need),
t AS (SELECT id, fg, bg, need, lb, i, goal, {mixed} AS hex, {far} AS far FROM o, range(1, 65) r(i), (VALUES (0::DOUBLE), (255::DOUBLE)) g(goal)), u AS (SELECT *, {_luminance('hex')} AS lh FROM t),
ok AS (SELECT * FROM u WHERE (greatest(lh, lb) + 0.05::DOUBLE) / (least(lh, lb) + 0.05::DOUBLE) >= need), f AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY id, goal ORDER BY i) = 1),
best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY far, goal) = 1)"""



@query(f"""{_CONTRAST_SQL}, v AS (SELECT DISTINCT concat(fg, bg, need) AS id, fg, bg, need FROM x WHERE ratio < need), {passing_sql('v')}
SELECT x.doc_id, x.node_id, x.fg, x.bg, best.hex AS new_fg FROM x LEFT JOIN best ON best.id = concat(x.fg, x.bg, x.need) WHERE x.ratio < x.need""")
def contrast_fixes(spark, sf):
    return executors.contrast_fixes(_parts(spark, sf)).select("doc_id", "node_id", "fg", "bg", "new_fg")


@query(rf"""{_PARTS_SQL}, y AS (SELECT *, trim(coalesce(target, '')) AS v, trim(coalesce(text, '')) AS o FROM x WHERE node_type = 'link' AND {_GENERIC}),
h AS (SELECT *, regexp_extract(v, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1) AS host, regexp_extract(v, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?([^?#]*)', 1) AS rest FROM y),
p AS (SELECT *, regexp_replace(CASE WHEN host <> '' THEN host ELSE rest END, '^www\.', '') AS place FROM h), q AS (SELECT *, CASE WHEN place <> '' THEN split_part(place, '/', 1) ELSE v END AS title FROM p),
m AS (SELECT doc_id, node_id, target, CASE WHEN v <> '' AND title <> '' THEN (CASE WHEN o = '' THEN 'Visit ' ELSE 'Read more about ' END) || title WHEN o <> '' THEN 'Read more about ' || o ELSE 'Open linked resource' END AS text FROM q),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]+', '', 'g'), '\s+', ' ', 'g')) AS n FROM m),
c AS (SELECT *, CASE WHEN text LIKE 'Open%' THEN 0.2 WHEN {_BLANK.format('target')} THEN 0.3 ELSE 0.45 END::DOUBLE AS confidence FROM k WHERE NOT {_GENERIC}) SELECT doc_id, node_id, text, confidence, confidence < 0.6 AS needs_review FROM c""")
def link_text_fixes(spark, sf):
    return executors.link_texts(PARTS.df(spark, sf))


@query(f"""WITH x AS {PARTS.sql}, y AS (SELECT *, last_value(CASE WHEN node_type = 'heading' THEN level END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY dfs_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
 first_value(CASE WHEN node_type = 'heading' THEN level END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY dfs_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM x)
SELECT doc_id, node_id, coalesce(b, greatest(1, a - 1), 1)::INT AS level FROM y WHERE node_type = 'paragraph' AND looks_like_heading""")
def promoted_headings(spark, sf):
    return executors.promoted_headings(_parts(spark, sf)).withColumn("level", F.col("level").cast("int"))


@query(rf"""WITH d AS (SELECT *, lower(trim(coalesce(title, ''))) AS low FROM {DOCUMENTS.sql}), p AS (SELECT doc_id, level, dfs_pos, text, filename FROM {PARTS.sql} n JOIN (SELECT doc_id, filename FROM d) USING (doc_id) WHERE node_type = 'heading' AND trim(coalesce(text, '')) <> ''),
h AS (SELECT doc_id, arg_min(text, dfs_pos) FILTER (level = 1) AS h1, arg_min(text, dfs_pos) AS h FROM p GROUP BY 1),
m AS (SELECT d.doc_id, d.filename, unnest([h1, h, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '[-_\s]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ')]) AS c,
 unnest([1, 2, 3]) AS k FROM d LEFT JOIN h USING (doc_id) WHERE low = '' OR {_PLACEHOLDER}), r AS (SELECT doc_id, k, c, '' AS filename, lower(trim(coalesce(c, ''))) AS low FROM m)
SELECT doc_id, arg_min(c, k) AS title FROM r WHERE low <> '' AND NOT {_PLACEHOLDER} GROUP BY 1""")
def document_title_fixes(spark, sf):
    columns = ("doc_id", "node_type", "text", "level", "dfs_pos", "props")
    d = _documents(spark, sf).withColumn("level", F.lit(None).cast("int"))
    return executors.document_titles(d.select(*columns).union(_parts(spark, sf).select(*columns)))


# a document of paragraphs, with headings in some
PLAIN = Derived("lineitem", {
    "doc_id": "l_partkey % 500", "node_id": "concat('p', l_orderkey, '-', l_linenumber, '-', l_suppkey)", "node_type": "CASE WHEN l_partkey % 500 < 200 OR l_orderkey % 50 > 0 THEN 'paragraph' ELSE 'heading' END",
    "text": "CASE WHEN l_linenumber = 2 THEN ' ' ELSE rpad('text', CAST(l_quantity AS INT) + 4, 'x') END"})


@query(f"""WITH n AS {PLAIN.sql}, s AS (SELECT doc_id, count(*) FILTER (node_type = 'heading') AS h, count(*) FILTER (node_type = 'paragraph' AND trim(text) <> '') AS p, coalesce(sum(length(trim(text))) FILTER (node_type = 'paragraph' AND trim(text) <> ''), 0) AS c FROM n GROUP BY 1)
SELECT doc_id, 'root' AS node_id, 'DOCUMENT_NO_HEADINGS' AS rule_id FROM s WHERE h = 0 AND p >= 12 AND c >= 1200 AND doc_id % 3 > 0""")
def no_headings_findings(spark, sf):
    n = PLAIN.df(spark, sf).withColumn("source_format", F.lit(None).cast("string"))
    d = n.select("doc_id").distinct().selectExpr("doc_id", "'root' AS node_id", "'document' AS node_type", "CAST(NULL AS STRING) AS text", "CASE WHEN doc_id % 3 > 0 THEN 'docx' ELSE 'pdf' END AS source_format")
    return _hits(n.unionByName(d), "DOCUMENT_NO_HEADINGS")


# tables: an order's rows, one to four cells each; some tables lie in a cell of another
_TABLES = """r AS (SELECT l_orderkey AS doc_id, concat('r', l_linenumber, '-', l_partkey, '-', l_suppkey) AS row_id, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS pos, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q FROM lineitem),
c AS (SELECT doc_id, row_id, pos, k, CASE WHEN doc_id % 4 = 0 AND l_suppkey % 3 = 0 THEN 'header' ELSE 'data' END AS cell_type, CASE WHEN q % 9 = 0 THEN 2 ELSE 1 END AS col_span, CASE WHEN q % 11 = 0 THEN 3 ELSE 1 END AS row_span FROM (SELECT *, unnest(range(1, CAST(2 + q % 3 AS BIGINT) + 1)) AS k FROM r))"""
_SHAPES = f"""{_TABLES}, w AS (SELECT doc_id, row_id, count(*) AS cells, sum(col_span) AS width, count(*) FILTER (cell_type = 'header') AS headers, count(*) FILTER (cell_type = 'data' AND (row_span > 1 OR col_span > 1)) AS merged FROM c GROUP BY 1, 2),
t AS (SELECT doc_id, count(*) AS n_rows, sum(cells) AS n_cells, max(cells) AS most, max(width) AS width, sum(headers) AS headers, sum(merged) AS merged, CASE WHEN doc_id % 5 = 0 THEN 'A caption' ELSE '' END AS caption,
 CASE WHEN doc_id % 7 = 0 THEN 'Presentation' ELSE '' END AS role, CASE WHEN doc_id % 3 = 0 THEN 'docx' ELSE 'html' END AS fmt, doc_id % 2 = 0 AS introduced FROM w GROUP BY 1)"""


def _tables(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "concat('r', l_linenumber, '-', l_partkey, '-', l_suppkey) AS row_id", "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS pos", "l_suppkey", "CAST(l_quantity AS INT) AS q")
    cells = rows.select("*", F.explode(F.expr("sequence(1, 2 + q % 3)")).alias("k")).selectExpr(
        "doc_id", "concat(row_id, 'c', k) AS node_id", "row_id AS parent_id", "'table_cell' AS node_type", "CAST(pos + k AS BIGINT) AS sibling_pos", "CASE WHEN doc_id % 4 = 0 AND l_suppkey % 3 = 0 THEN 'header' ELSE 'data' END AS cell_type",
        "CASE WHEN q % 9 = 0 THEN 2 ELSE 1 END AS col_span", "CASE WHEN q % 11 = 0 THEN 3 ELSE 1 END AS row_span",
        "CASE k WHEN 1 THEN 'Unit price' WHEN 2 THEN CASE WHEN q % 2 = 0 THEN 'It is so.' ELSE 'Size' END WHEN 3 THEN 'one two three four five six seven eight nine' ELSE '' END AS text")
    docs = rows.select("doc_id").distinct()
    columns = "doc_id node_id parent_id node_type sibling_pos cell_type col_span row_span text caption role source_format".split()
    row = rows.selectExpr("doc_id", "row_id AS node_id", "'t' AS parent_id", "'table_row' AS node_type", "CAST(pos AS BIGINT) AS sibling_pos")
    tables = docs.selectExpr("doc_id", "'t' AS node_id", "'root' AS parent_id", "'table' AS node_type", "2L AS sibling_pos", "CASE WHEN doc_id % 5 = 0 THEN 'A caption' ELSE '' END AS caption",
                             "CASE WHEN doc_id % 7 = 0 THEN 'Presentation' ELSE '' END AS role", "CASE WHEN doc_id % 3 = 0 THEN 'docx' ELSE 'html' END AS source_format")
    intro = docs.selectExpr("doc_id", "'p' AS node_id", "'root' AS parent_id", "'paragraph' AS node_type", "1L AS sibling_pos", "CASE WHEN doc_id % 2 = 0 THEN 'As the table shows' ELSE ' ' END AS text")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [cells, row, tables, intro])
    return _props(every.select(*columns), "caption", "role")


@query(f"""WITH {_SHAPES} SELECT doc_id, 't' AS node_id, 'TABLE_MISSING_HEADERS' AS rule_id FROM t WHERE headers = 0 UNION ALL SELECT doc_id, 't', 'TABLE_CAPTION_MISSING' FROM t WHERE role = '' AND caption = '' AND n_rows >= 3 AND most >= 3 AND (fmt = 'docx' OR NOT introduced)
UNION ALL SELECT doc_id, 't', 'TABLE_COMPLEX_NEEDS_SUMMARY' FROM t WHERE caption = '' AND ((merged > 0 AND n_cells >= 6) OR (width >= 3 AND (n_rows >= 20 OR n_cells >= 120)))""")
def table_findings(spark, sf):
    return _hits(_tables(spark, sf), "TABLE_MISSING_HEADERS", "TABLE_CAPTION_MISSING", "TABLE_COMPLEX_NEEDS_SUMMARY")


@query(f"""WITH {_TABLES}, v AS (SELECT c.*, q, CASE k WHEN 1 THEN 'Unit price' WHEN 2 THEN CASE WHEN q % 2 = 0 THEN 'It is so.' ELSE 'Size' END WHEN 3 THEN 'one two three four five six seven eight nine' ELSE '' END AS text FROM c JOIN r USING (doc_id, row_id)),
w AS (SELECT doc_id, row_id, any_value(pos) AS pos, count(*) AS width, bool_and(text <> '' AND len(string_split(text, ' ')) <= 8 AND NOT contains(text, '.')) AS labels, bool_or(cell_type = 'header') AS head FROM v GROUP BY 1, 2),
n AS (SELECT doc_id, width, count(*) AS k FROM w GROUP BY 1, 2), u AS (SELECT doc_id, width FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, width) = 1),
x AS (SELECT doc_id, bool_or(head) AS head, arg_min(labels, pos) AS labels FROM w GROUP BY 1) SELECT doc_id, 't' AS table_id, CASE WHEN labels THEN 'promote_first_row' ELSE 'add_row' END AS mode, u.width FROM x JOIN u USING (doc_id) WHERE NOT head""")
def table_header_fixes(spark, sf):
    return executors.table_headers(_tables(spark, sf))


@query(f"WITH {_TABLES} SELECT doc_id, row_id || 'c' || k AS node_id, 'column' AS header_scope FROM c WHERE cell_type = 'header' AND doc_id % 8 > 0")
def header_scope_fixes(spark, sf):
    cells = _tables(spark, sf).withColumn("header_scope", F.expr("CASE doc_id % 8 WHEN 0 THEN 'row' WHEN 4 THEN 'none' END"))
    return executors.header_scopes(cells)


@query(f"""WITH {_TABLES}, h AS (SELECT doc_id, row_id, pos, k, CASE k WHEN 1 THEN 'Unit price' WHEN 2 THEN CASE WHEN q % 2 = 0 THEN 'It is so.' ELSE 'Size' END WHEN 3 THEN 'one two three four five six seven eight nine' ELSE '' END AS text
 FROM (SELECT c.*, q FROM c JOIN r USING (doc_id, row_id)) WHERE cell_type = 'header'), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos + k, text) AS i FROM h WHERE text <> '')
SELECT doc_id, 't' AS table_id, left('Table: ' || string_agg(text, ', ' ORDER BY i), 80) AS caption FROM n WHERE i <= 6 GROUP BY 1""")
def table_caption_fixes(spark, sf):
    return executors.table_captions(_tables(spark, sf).withColumn("dfs_pos", F.col("sibling_pos")))


NESTED = Derived("orders", {"doc_id": "o_custkey", "node_id": "concat('t', o_orderkey)", "outer_id": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('t', o_orderkey - o_orderkey % 3) END", "kind": "CASE WHEN o_orderkey % 6 = 3 THEN 'section' ELSE 'table' END"})


@query(f"WITH x AS {NESTED.sql} SELECT a.doc_id, a.node_id FROM x a WHERE a.kind = 'table' AND EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.node_id = a.outer_id AND b.kind = 'table')")
def nested_tables(spark, sf):
    x = NESTED.df(spark, sf).withColumns({"node_type": F.col("kind"), "path": F.filter(F.array(F.lit("root"), "outer_id", "node_id"), lambda n: n.isNotNull())})
    return _hits(x, "TABLE_NESTED").select("doc_id", "node_id")


# lists: a customer's orders are the items of the customer's list
ITEMS = Derived("orders", {"doc_id": "o_custkey", "node_id": "concat('i', o_orderkey)", "parent_id": "'l'", "node_type": "CASE WHEN o_orderkey % 12 = 0 THEN 'paragraph' ELSE 'list_item' END"})
LISTS = Derived("customer", {"doc_id": "c_custkey", "node_id": "'l'", "parent_id": "'root'", "node_type": "CASE WHEN c_custkey % 10 = 0 THEN 'section' ELSE 'list' END", "run_ids": pick("c_custkey", None, None, None, None, None, "a b", None)})


def _lists(spark, sf):
    x = ITEMS.df(spark, sf).withColumn("run_ids", F.lit(None).cast("string")).unionByName(LISTS.df(spark, sf))
    return x.withColumn("props", F.map_filter(F.create_map(F.lit("fake_list_run_ids"), "run_ids"), lambda _, v: v.isNotNull()))


@query(f"""WITH l AS {LISTS.sql}, i AS {ITEMS.sql}, k AS (SELECT doc_id, count(*) FILTER (node_type <> 'list_item') AS strays FROM i GROUP BY 1)
SELECT l.doc_id, l.node_id, 'LIST_STRUCTURE_INVALID' AS rule_id FROM l LEFT JOIN k USING (doc_id) WHERE (node_type = 'list' AND coalesce(strays, 1) > 0) OR (node_type <> 'list' AND run_ids IS NOT NULL)""")
def list_findings(spark, sf):
    return _hits(_lists(spark, sf), "LIST_STRUCTURE_INVALID")


@query(f"SELECT i.doc_id, i.node_id, l.node_id AS list_id FROM {ITEMS.sql} i JOIN {LISTS.sql} l USING (doc_id) WHERE l.node_type = 'list' AND i.node_type <> 'list_item'")
def wrapped_list_children(spark, sf):
    return executors.wrapped_list_children(_lists(spark, sf))


# tags in reading order
TAGS = Derived("lineitem", {"doc_id": "l_orderkey", "node_id": "concat('n', l_linenumber, '-', l_partkey, '-', l_suppkey)", "dfs_pos": "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey", "page": "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_linenumber + l_suppkey % 3 AS INT) END",
                            "tag": pick("l_partkey", "P", "H1", "Figure", "H3", "Span"), "alt": pick("l_suppkey", None, " ", "A view")})


@query(f"""WITH x AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY dfs_pos) AS before FROM {TAGS.sql} t WHERE page IS NOT NULL)
SELECT doc_id, arg_min(node_id, dfs_pos) AS node_id, arg_min(page, dfs_pos) AS page, arg_min(before, dfs_pos) AS before FROM x WHERE page < before GROUP BY 1""")
def backward_pages(spark, sf):
    return layout.backward_pages(TAGS.df(spark, sf))


@query(f"""WITH x AS {TAGS.sql}, n AS (SELECT doc_id, tag, count(*) AS n FROM x GROUP BY 1, 2) SELECT doc_id, count(*) AS nodes, (SELECT string_agg(tag || '=' || n, ',' ORDER BY tag) FROM n WHERE n.doc_id = x.doc_id) AS tags,
 count(*) FILTER (tag = 'Figure') AS figures, count(*) FILTER (tag = 'Figure' AND trim(coalesce(alt, '')) = '') AS bare FROM x GROUP BY 1""")
def tag_summaries(spark, sf):
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tag_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return layout.tag_summary(TAGS.df(spark, sf)).select("doc_id", "nodes", tags.alias("tags"), "figures", F.col("figures_missing_alt").alias("bare"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_partkey % 3 AS slide, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS idx, (l_suppkey * 90000) % 5000000 AS top FROM lineitem),
u AS (SELECT *, top < lag(top) OVER (PARTITION BY doc_id, slide ORDER BY idx) AS up FROM s) SELECT doc_id, slide, count(*) FILTER (up) AS disorder FROM u GROUP BY 1, 2""")
def slide_disorder(spark, sf):
    s = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "l_partkey % 3 as slide", "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey as idx", "(l_suppkey * 90000) % 5000000 as top")
    return layout.slide_disorder(s)


SHAPES = Derived("lineitem", {"doc_id": "l_orderkey", "slide": "l_partkey % 3", "parent_id": "concat('s', l_partkey % 3)", "node_id": "concat(l_partkey, '-', l_suppkey, '-', l_linenumber)", "idx": "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey",
                              "top": "(l_suppkey * 90000) % 5000000", "sibling_pos": "l_linenumber", "hint": "CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_partkey % 50 AS INT) END", "\"left\"": "l_partkey",
                              "text": "CASE l_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN rpad('long', 130, '.') ELSE concat(' Title ', l_partkey) END"})


def _shapes(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n.replace(chr(34), '`')}" for n, e in SHAPES.columns.items()])


@query(f"SELECT doc_id, slide, arg_min(trim(text), top * 1000000000 + idx) AS title FROM {SHAPES.sql} s WHERE trim(text) <> '' AND length(trim(text)) <= 120 GROUP BY 1, 2")
def slide_title_fixes(spark, sf):
    return executors.slide_titles(_shapes(spark, sf))


@query(f"SELECT doc_id, parent_id, node_id, (row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY hint IS NULL, hint, sibling_pos, top, \"left\", node_id) - 1)::INT AS new_pos FROM {SHAPES.sql} s")
def resolved_order(spark, sf):
    # rows that tie in all of the order's columns don't occur: place and part tell them apart
    return executors.resolved_order(_shapes(spark, sf)).withColumn("new_pos", F.col("new_pos").cast("int"))


# typed lists: lines of an order as paragraphs
TYPED = Derived("lineitem", {"doc_id": "l_orderkey", "pos": "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey", "text": f"CASE WHEN l_suppkey % 5 = 0 THEN 'plain text' WHEN l_suppkey % 5 < 3 THEN concat('- item ', l_partkey) ELSE concat(l_linenumber, '. item') END"})
_MARKED = rf"""WITH m AS (SELECT *, CASE WHEN text LIKE '- %' THEN 'bullet' WHEN regexp_matches(text, '^[0-9]+\. ') THEN 'decimal' END AS kind, CASE WHEN text LIKE '- %' THEN '-' WHEN regexp_matches(text, '^[0-9]+\. ') THEN '.' END AS mark,
 try_cast(regexp_extract(text, '^([0-9]+)\. ', 1) AS INT) AS ordinal FROM {TYPED.sql})"""


@query(f"{_MARKED} SELECT doc_id, pos, kind, mark, ordinal FROM m WHERE kind IS NOT NULL")
def list_markers(spark, sf):
    m = text.list_marker(F.col("text"))
    return TYPED.df(spark, sf).select("doc_id", "pos", m.alias("m")).filter("m is not null").select("doc_id", "pos", "m.kind", "m.mark", "m.ordinal")


@query(f"""{_MARKED}, s AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND mark = lag(mark) OVER w AND (ordinal IS NULL OR ordinal = lag(ordinal) OVER w + 1) THEN 0 ELSE 1 END AS f FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT doc_id, min(pos) AS first_pos, any_value(kind) AS kind, count(*) AS items FROM r WHERE kind IS NOT NULL GROUP BY doc_id, run HAVING count(*) >= 2 AND coalesce(min(ordinal), 1) = 1""")
def fake_lists(spark, sf):
    return layout.fake_list_runs(TYPED.df(spark, sf)).select("doc_id", "first_pos", "kind", "items")


STYLED = Derived("lineitem", {"doc_id": "l_orderkey", "pos": "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey", "style": pick("l_partkey", None, "Normal", "Title", "SUBTITLE", "Normal", "Normal"), "all_bold": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 = 1 END",
                              "size_pt": "CAST(10 + l_partkey % 8 AS DOUBLE)", "text": pick("l_suppkey", None, " ", "Our plan", "It ends here.", "one two three four five six seven eight nine", "Short words and more", "A list of things:")})


@query(f"""SELECT doc_id, pos, lower(coalesce(style, '')) IN ('title', 'subtitle') OR (t <> '' AND length(t) <= 60 AND len(string_split(t, ' ')) <= 8 AND right(t, 1) NOT IN ('.', '!', '?', ';', ',', ':') AND coalesce(all_bold, false) AND size_pt >= 14) AS heading FROM (SELECT *, trim(coalesce(text, '')) AS t FROM {STYLED.sql})""")
def styled_headings(spark, sf):
    return STYLED.df(spark, sf).select("doc_id", "pos", layout.looks_like_heading(F.col("style"), F.col("text"), F.col("all_bold"), F.col("size_pt")).alias("heading"))


# positioned blocks: an order's lines on its pages
BLOCKS = Derived("lineitem", {"doc_id": "l_orderkey", "page": "l_partkey % 3", "slot": pick("l_suppkey", "top", "bottom", "body"), "size": "CAST(8 + l_partkey % 9 AS DOUBLE)",
                              "text": "CASE l_suppkey % 4 WHEN 0 THEN concat('Page ', l_linenumber, ' of 9') WHEN 1 THEN 'Annual Report' WHEN 2 THEN ' iv ' ELSE concat('Line ', l_partkey) END"})
_PAGE_NO = r"regexp_matches(lower(trim({0})), '^(page\s+)?[-–]?\s*([0-9]{{1,4}}|[ivxlc]{{1,6}})\s*[-–]?(\s*(of|/)\s*[0-9]{{1,4}})?$')"


@query(f"WITH k AS (SELECT doc_id, slot, page, CASE WHEN {_PAGE_NO.format('text')} THEN '#' ELSE lower(trim(text)) END AS text FROM {BLOCKS.sql} WHERE slot IN ('top', 'bottom')) SELECT doc_id, slot, text, count(DISTINCT page) AS pages FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT page) >= 2")
def running_lines(spark, sf):
    return layout.running_lines(BLOCKS.df(spark, sf))


@query(f"""WITH b AS {BLOCKS.sql}, n AS (SELECT doc_id, size, count(*) AS k FROM b GROUP BY 1, 2), u AS (SELECT doc_id, size AS usual FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, size) = 1), t AS (SELECT doc_id, max(size) AS top FROM b GROUP BY 1),
x AS (SELECT b.doc_id, count(*) AS k, any_value(text) AS title, any_value(top) AS top, any_value(usual) AS usual FROM b JOIN t USING (doc_id) JOIN u USING (doc_id) WHERE size = top GROUP BY 1)
SELECT doc_id, trim(title) AS title FROM x WHERE k = 1 AND top >= 1.25 * usual AND length(title) <= 120 AND NOT {_PAGE_NO.format('title')}""")
def title_candidates(spark, sf):
    return layout.title_candidates(BLOCKS.df(spark, sf))


CELLS = Derived("lineitem", {"doc_id": "l_orderkey", "row": "CAST(l_linenumber AS INT)", "col": "CAST(l_partkey AS INT)", "right_rule": "l_suppkey % 3 > 0",
                             "text": "CASE l_suppkey % 6 WHEN 0 THEN '12,5' WHEN 1 THEN '(3 %)' WHEN 2 THEN 'Name' WHEN 3 THEN 'a b c d e f g h i j k l m' WHEN 4 THEN NULL ELSE concat('$', l_partkey) END"})
_NUMERIC = r"regexp_matches(trim(text), '^[($€£+\-]*[0-9][0-9,.\s]*[%)]?$')"


@query(rf"""WITH c AS (SELECT *, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS words, row = min(row) OVER (PARTITION BY doc_id) AS first, {_NUMERIC} AS num FROM {CELLS.sql}),
x AS (SELECT doc_id, median(words) AS median_words, avg((words > 12)::INT::DOUBLE) AS long_share, avg(num::INT::DOUBLE) FILTER (NOT first) AS numeric_share, coalesce(bool_or(num) FILTER (first), false) AS numeric_head FROM c GROUP BY 1)
SELECT doc_id, median_words <= 3 AND long_share < 0.2 AS is_data, median_words <= 3 AND long_share < 0.2 AND NOT numeric_head AND coalesce(numeric_share, 0) > 0 AS header_row FROM x""")
def data_tables(spark, sf):
    return layout.data_cells(CELLS.df(spark, sf), ["doc_id"]).select("doc_id", "is_data", "header_row")


@query(f"""WITH c AS (SELECT DISTINCT ON (doc_id, row, col) doc_id, row, col, bool_or(right_rule) OVER (PARTITION BY doc_id, row, col) AS right_rule FROM {CELLS.sql}),
s AS (SELECT *, CASE WHEN coalesce(lag(right_rule) OVER (PARTITION BY doc_id, row ORDER BY col), true) THEN 1 ELSE 0 END AS f FROM c), r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, row ORDER BY col ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT doc_id, row, min(col) AS col, count(*)::INT AS col_span FROM r GROUP BY doc_id, row, run""")
def cell_spans(spark, sf):
    cells = dealt(CELLS.df(spark, sf).select("doc_id", "row", "col", "right_rule"), table(spark, sf, "lineitem"), "doc_id", "row")
    return layout.cell_spans(cells.groupBy("doc_id", "row", "col").agg(F.bool_or("right_rule").alias("right_rule")), ["doc_id"])


@query(r"""WITH RECURSIVE i AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, (o_orderkey * 7 % 60)::DOUBLE AS x0 FROM orders),
f AS (SELECT doc_id, pos, [x0] AS stack, 0 AS nesting FROM i WHERE pos = 1 UNION ALL
 SELECT i.doc_id, i.pos, CASE WHEN len(k) = 0 OR i.x0 > k[-1] + 12 THEN list_append(k, i.x0) ELSE k END, CASE WHEN len(k) = 0 OR i.x0 > k[-1] + 12 THEN len(k) ELSE len(k) - 1 END::INT
 FROM (SELECT f.*, list_filter(f.stack, lambda s: j.x0 >= s - 12) AS k FROM f JOIN i j ON j.doc_id = f.doc_id AND j.pos = f.pos + 1) f JOIN i ON i.doc_id = f.doc_id AND i.pos = f.pos + 1)
SELECT doc_id, pos::INT AS pos, nesting::INT AS nesting FROM f""")
def nested_lists(spark, sf):
    i = table(spark, sf, "orders").selectExpr("o_custkey AS doc_id", "'l' AS list_id", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS pos", "CAST(o_orderkey * 7 % 60 AS DOUBLE) AS x0")
    return layout.nested_levels(i).select("doc_id", "pos", "nesting")


LINES = Derived("lineitem", {"doc_id": "l_orderkey % 2000", "page": "l_partkey % 2", "kind": "CASE WHEN l_suppkey % 3 = 0 THEN 'v' ELSE 'h' END", "y0": "CAST(l_partkey * 37 % 3000 AS DOUBLE)", "y1": "CAST(l_partkey * 37 % 3000 + l_suppkey * 5 AS DOUBLE)"})


@query(f"""WITH x AS {LINES.sql}, s AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0) > 200 THEN 1 ELSE 0 END AS f FROM x WHERE kind = 'h'), b AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page ORDER BY y0 ROWS UNBOUNDED PRECEDING) AS band FROM s),
g AS (SELECT doc_id, page, band, min(y0) AS top, max(y0) AS bottom, count(*) AS horizontals FROM b GROUP BY 1, 2, 3)
SELECT g.doc_id, g.page, top, bottom, horizontals, (SELECT count(*) FROM x v WHERE v.kind = 'v' AND v.doc_id = g.doc_id AND v.page = g.page AND v.y0 < g.bottom AND v.y1 > g.top) AS verticals FROM g""")
def ruling_bands(spark, sf):
    return layout.ruling_bands(LINES.df(spark, sf)).drop("band")
