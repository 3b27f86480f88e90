"""Word and slide files made here, read to nodes, audited."""

import io
import zipfile

import pytest

from wardlume.operators import rules
from wardlume.sources import office

W, R = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A, P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
WP = 'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def para(text, style=None, num=None, bold=False, size=None, color=None, inner=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:numId w:val="{num}"/></w:numPr>' if num else "")
    look = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{2 * size}"/>' if size else "") + (f'<w:color w:val="{color}"/>' if color else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{look}</w:rPr><w:t>{text}</w:t></w:r>{inner}</w:p>"


def image(alt):
    return f'<w:r><w:drawing><wp:inline><wp:docPr id="1" descr="{alt}"/><a:graphic><a:blip r:embed="rId9"/></a:graphic></wp:inline></w:drawing></w:r>'


def grid(rows, marked=False):
    head = "<w:trPr><w:tblHeader/></w:trPr>"
    return "<w:tbl>" + "".join(f"<w:tr>{head if marked and i == 0 else ''}" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for i, r in enumerate(rows)) + "</w:tbl>"


def docx(body, title="", lang=None):
    styles = f'<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr>{f"<w:lang w:val={chr(34)}{lang}{chr(34)}/>" if lang else ""}</w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H3"><w:name w:val="heading 3"/></w:style></w:styles>'
    files = {"word/document.xml": f"<w:document {W} {R} {A} {WP}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles,
             "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="https://example.org/a"/></Relationships>',
             "docProps/core.xml": f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></cp:coreProperties>'}
    return packed(**files)


def shape(text, kind=None, top=0, link=False):
    ph = f'<p:ph type="{kind}"/>' if kind else ""
    click = '<a:hlinkClick r:id="rId1"/>' if link else ""
    paragraphs = "".join(f"<a:p><a:r><a:rPr>{click}</a:rPr><a:t>{t}</a:t></a:r></a:p>" for t in text.split("\n"))
    return f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="x"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{top}"/><a:ext cx="1" cy="100000"/></a:xfrm></p:spPr><p:txBody>{paragraphs}</p:txBody></p:sp>'


def pptx(*slides):
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    files = {"ppt/presentation.xml": f"<p:presentation {P} {R}><p:sldIdLst>" + "".join(f'<p:sldId id="{i}" r:id="s{i}"/>' for i in range(len(slides))) + "</p:sldIdLst></p:presentation>",
             "ppt/_rels/presentation.xml.rels": rel + "".join(f'<Relationship Id="s{i}" Target="slides/slide{i}.xml"/>' for i in range(len(slides))) + "</Relationships>"}
    for i, body in enumerate(slides):
        files[f"ppt/slides/slide{i}.xml"] = f"<p:sld {P} {A} {R}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
        files[f"ppt/slides/_rels/slide{i}.xml.rels"] = rel + '<Relationship Id="rId1" Target="https://example.org/b"/></Relationships>'
    return packed(**files)


@pytest.fixture(scope="module")
def audited(spark):
    link = '<w:hyperlink r:id="rId1"><w:r><w:t>click here</w:t></w:r></w:hyperlink>'
    dirty = docx(para("Annual plan", bold=True, size=22) + para("Start", "H1") + para("Deep", "H3") + para("See the picture of our plan", inner=image("")) + para("- one") + para("- two") + para("- three") + para("", inner=link)
                 + para("first", num=4) + para("second", num=4) + para("other", num=5) + para("pale words", color="EEEEEE") + grid([["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"]]))
    clean = docx(para("Start", "H1") + para("Plain words.") + grid([["Name", "Size"], ["a", "1"], ["b", "2"]], marked=True), "A real title", "en-US")
    deck = pptx(shape("Our plan", "title") + shape("- item one\n- item two", top=10) + shape("a link to there", top=20, link=True), shape("A text well below the other", top=4000000) + shape("A text well above the other", top=0))
    files = [(1, "docx", dirty), (2, "docx", clean), (3, "pptx", deck), (4, "docx", b"no zip"), (5, "docx", None), (6, "pdf", b"x")]
    nodes = office.office_nodes(spark.createDataFrame(files, "doc_id long, format string, content binary")).cache()
    return nodes, rules.audit(nodes)


def test_word_files_become_nodes(audited):
    nodes, _ = audited
    rows = nodes.filter("doc_id = 1").orderBy("dfs_pos").collect()
    assert [r["node_type"] for r in rows] == ["document", "section", "paragraph", "heading", "heading", "image", "paragraph", "paragraph", "paragraph", "paragraph", "link", "list", "list_item", "list_item", "list", "list_item",
                                              "paragraph", "table", *["table_row", "table_cell", "table_cell", "table_cell"] * 3]
    assert [r["level"] for r in rows if r["node_type"] == "heading"] == [1, 3]
    by = {r["node_id"]: r for r in rows}
    assert all(r["parent_id"] is None or (by[r["parent_id"]]["dfs_pos"] < r["dfs_pos"] and r["path"] == by[r["parent_id"]]["path"] + [r["node_id"]]) for r in rows)
    assert next(r for r in rows if r["node_type"] == "image")["props"]["caption"] == "See the picture of our plan" and next(r for r in rows if r["node_type"] == "link")["target"] == "https://example.org/a"
    assert [r["props"].get("fake_list_run_ids") for r in rows if (r["text"] or "").startswith("- ")] == ["p-5 p-6 p-7", None, None]
    assert sorted(r["bfs_pos"] for r in rows) == list(range(len(rows)))


def test_rules_fire_on_office_files(audited):
    _, found = audited
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], set()).add(r["rule_id"])
    assert by[1] == {"TEXT_STYLED_AS_HEADING", "HEADING_LEVEL_JUMP", "MISSING_ALT_TEXT", "LIST_STRUCTURE_INVALID", "LINK_TEXT_NON_DESCRIPTIVE", "TABLE_MISSING_HEADERS", "TABLE_CAPTION_MISSING", "DOCUMENT_LANGUAGE_MISSING",
                     "DOCUMENT_TITLE_MISSING", "LOW_CONTRAST_TEXT"}
    assert 2 not in by
    assert {"SLIDE_TITLE_MISSING", "READING_ORDER_AMBIGUOUS", "LIST_STRUCTURE_INVALID"} <= by[3] and 6 not in by


def test_slides_become_sections(audited):
    nodes, _ = audited
    rows = nodes.filter("doc_id = 3").orderBy("dfs_pos").collect()
    assert [(r["node_type"], r["page"]) for r in rows] == [("document", None), ("section", 1), ("heading", 1), ("paragraph", 1), ("paragraph", 1), ("link", 1), ("section", 2), ("paragraph", 2), ("paragraph", 2)]
    assert rows[0]["props"]["slides_missing_titles"] == "1" and rows[6]["props"]["reading_order_inverted"] == "true" and rows[3]["props"]["fake_list_kind"] == "bullet"


def test_files_that_fail_keep_their_document(audited):
    nodes, _ = audited
    assert [(r["doc_id"], r["node_type"], r["props"]["status"]) for r in nodes.filter("doc_id in (4, 5)").orderBy("doc_id").collect()] == [(4, "document", "failed"), (5, "document", "failed")]
