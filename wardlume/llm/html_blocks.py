"""Main-text extraction: flat text blocks with their neighbours' word counts and link densities, and a decision tree.

A page becomes a flat list of text blocks (runs of text between block-level tags). Each block has its own word count
and link density, those of the block before and after it, and flags from the elements around it. A small decision
tree, grown from the labelled table below, says for each block whether it is main text; kept blocks are joined in page order.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (an end tag
that closes nothing is ignored, an unclosed element ends with its parent); repeated pages repeat; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their role in a page.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br picture source".split())
CONTAINERS = set("html body div section article main nav aside header footer form ul ol dl table thead tbody tfoot tr td th figure blockquote fieldset details dialog menu center hgroup address".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
DROPPED = set("noscript template svg math canvas object select audio video map".split())
BOILER_TAGS = set("nav aside footer form dialog menu button fieldset".split())
MAIN_TAGS = {"article", "main"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
#: Words that name page furniture wherever they stand in a name of class, id or role.
BOILER_WORDS = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent "
    "disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter pager pagination popup promo promoted "
    "sidebar sidebars sidenav signup sponsor sponsored subscribe subscription teaser topbar complementary contentinfo".split())
#: Words that name it alone or at the end of a name of two words, and before a word for a place; elsewhere they are ordinary words.
BOILER_HEADS = set(
    "alert copyright dialog disclaimer form header hidden login notice notices overlay popular promotion recommended recommendations related replies reply respond "
    "responses search share sharing shares skip social tags toc toolbar trending widget widgets".split())
PLACES = set("area bar block box buttons container content form group icons inner items links list outer panel posts section widget wrap wrapper".split())
#: Words that name the article.
MAIN_WORDS = set("article content main post entry story body text articlebody maincontent postcontent".split())

# A tag has 400 stretches at most between and within quotes, so that quotes without an end don't send every tag to the page's end.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'){0,400}+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    boiler: bool
    main: bool
    heading: bool


FEATURES = ("furniture", "in_main", "page_has_main", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after")

#: The labelled table: pages whose text blocks begin with + for main text or - for page furniture; {n} stands for n words.
LABELLED = (
    # an article with all that surrounds it, lists of links and sentences full of links in it
    "<nav><a>-{1}</a><ul><li><a>-{1}</a><li><a>-{1}</a></ul></nav><div class=ad>-{8}</div><article><h1>+{9}</h1><p>+{4}<p>+{60}<p>+{25} <a>{5}</a><p><a>+{3}</a><ul><li><a>+{2}</a><li><a>+{4}</a><li>+{9}</ul>"
    "<p>+{2} <a>{6}</a> {1} <a>{5}</a><aside>-{20}</aside><h2>+{2}</h2><p>+{120}<form>-{3}</form></article><section class=comments><h3>-{2}</h3><p>-{70}<p>-{9}</section><footer>-{12}</footer>",
    # an article without a mark of its own in a main element, long furniture
    "<header><a>-{2}</a><p>-{14}</header><main><h1>+{5}</h1><p>+{1}<p>+{300}<p>+{16} <a>{11}</a><blockquote>+{40}</blockquote><div class=related><h4>-{3}</h4><a>-{7}</a><p>-{30}</div><p>+{8}</main><p>-{50}<div class=cookies>-{60}</div><footer><p>-{35}<a>-{2}</a></footer>",
    # articles of short, long and linked blocks, and unmarked blocks of all sizes around them
    "<p>-{6}<p>-{90}<article><p>+{20}<p>+{45}</article><p>-{12}<p><a>-{2}</a><p>-{35}", "<article><p>+{8}</article>", "<div><a>-{1}</a></div><article><h1>+{2}</h1><p>+{14}</article><p>-{20}<p>-{60}",
    "<div>-{40}</div><div>-{3}</div><article><h1>+{6}</h1><ul><li>+{3}<li>+{1}<li><a>+{2}</a><li><a>+{5}</a><li><a>+{1}</a></ul><p>+{2}<p>+{75}<p><a>+{12}</a></article><div>-{25}</div><div>-{7}</div><div>-{110}</div>",
    "<p>-{15}<article><p><a>+{4}</a><p><a>+{30}</a><p>+{55}<h3>+{4}</h3><p>+{6}<table><tr><td>+{1}<td>+{2}<td><a>+{1}</a><tr><td>+{9}<td>+{33}</table></article><p>-{4}<p>-{50}<p>-{17}",
    "<div><a>-{3}</a></div><p>-{28}<article><h2>+{12}</h2><p>+{150}<p>+{35} <a>{30}</a><p>+{5} <a>{5}</a><p>+{11}<p>+{1}<p>+{95}</article><p>-{70}<p>-{22}<div><a>-{2}</a></div>",
    "<article><h1>+{3}</h1><p><a>+{2}</a><p><a>+{2}</a><p><a>+{1}</a><p>+{48}<p>+{7}<div class=share>-{4}</div><div class=tags><a>-{1}</a></div><div class=newsletter>-{40}</div></article><p>-{45}<p>-{9}",
    # no article and no main element: text of low density, headings and short lines beside it, links in rows around
    "<div><a>-{1}</a></div><div><a>-{2}</a></div><div><a>-{1}</a></div><h1>+{8}</h1><p>+{60}<p>+{25}<p>+{3}<p>+{70} <a>{4}</a><p>+{14}<p>+{40}<div><a>-{2}</a></div><div><a>-{3}</a></div><div>-{2} <a>{2}</a></div>",
    "<td><a>-{2}</a><td><a>-{1}</a><td><a>-{4}</a><tr><td>+{90} <a>{9}</a><tr><td>+{80}<tr><td>+{6}<tr><td>+{45}<tr><td><a>-{1}</a> {1}<tr><td><a>-{2}</a>",
    "<div><a>-{1}</a></div><div>-{3}</div><div><a>-{2}</a></div><div>-{1}</div><div><a>-{1}</a></div><h2>+{11}</h2><div>+{30}</div><div>+{21}</div><div>+{24}</div><div><a>-{6}</a></div><div>-{4}</div><div><a>-{1}</a></div>",
    "<p>+{30}", "<h1>+{3}</h1><p>+{22}", "<p>+{20}<p>+{12}<p>+{2}", "<h1>+{5}</h1><p>+{15}<p><a>-{3}</a><p><a>-{1}</a><p><a>-{2}</a>", "<p>+{12}", "<p><a>-{30}</a> {8}<p>+{40}<p>+{22} <a>{9}</a><p>+{25}<p>-{4} <a>{9}</a><p><a>-{2}</a>",
    "<div><a>-{4}</a></div><div>-{2} <a>{3}</a></div><p>+{50}<p>+{45} <a>{6}</a><div><a>-{1}</a></div><div><a>-{2}</a></div><div class=footer>-{15} <a>{2}</a></div>",
    "<div id=menu><a>-{1}</a><a>-{1}</a></div><div class=sidebar><p>-{30}<p>-{9}</div><p>+{100}<p>+{4}<p>+{60}<div id=footer>-{30}</div>",
)


def labelled_rows() -> tuple[tuple[int, ...], ...]:
    """The labelled pages' blocks as rows of FEATURES and the label."""
    rows = []
    for page in LABELLED:
        found = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        rows += [(*x, int(b.text[0] == "+")) for b, x in zip(found, features(found), strict=True)]
    return tuple(rows)


def grow(rows: tuple[tuple[int, ...], ...], depth: int = 6, least: int = 3) -> tuple | int:
    """A binary decision tree by least Gini impurity with ``least`` rows a leaf: (feature, threshold, at most, above), or a label."""
    ones = sum(r[-1] for r in rows)
    best = None
    for f in range(len(FEATURES) if depth and ones not in (0, len(rows)) else 0):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            sides = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            if min(map(len, sides)) < least:
                continue
            cost = 0.0
            for side in sides:
                p = sum(r[-1] for r in side) / len(side)
                cost += len(side) * p * (1 - p)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut, sides)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, (low, high) = best
    low, high = (grow(tuple(x), depth - 1, least) for x in (low, high))
    return low if low == high and isinstance(low, int) else (f, cut, low, high)


@functools.cache
def tree() -> tuple | int:
    return grow(labelled_rows())


def decide(node: tuple | int, x: tuple[int, ...]) -> int:
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def _is_furniture(name: str) -> bool:
    """Whether a name of class, id or role is one of page furniture."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if any(p in BOILER_WORDS for p in parts):
        return True
    heads = [p in BOILER_HEADS for p in parts]
    return any(heads) and (len(parts) == 1 or (len(parts) == 2 and (heads[1] or parts[1] in PLACES)) or all(h or p in PLACES for h, p in zip(heads, parts, strict=True)))


def _flags(name: str, attributes: str) -> tuple[bool, bool]:
    """(page furniture, article) as an element's name and its class, id and role say."""
    furniture, main = name in BOILER_TAGS, name in MAIN_TAGS
    if attributes and name not in ("html", "body"):
        names = [n for found in _NAMES.findall(attributes) for x in found for n in x.split()]
        furniture = furniture or any(map(_is_furniture, names)) or bool(_HIDDEN.search(attributes))
        main = main or (not furniture and any(p.lower() in MAIN_WORDS for n in names for p in _PARTS.findall(n)))
    return furniture, main


def _closings(page: str, name: str) -> dict[int, int]:
    """Where each element of that name that is closed ends, by the end of its start tag: one pass with a stack of those that are open."""
    found, open_ = {}, []
    # behind the last bracket no tag is complete: a search there would go to the page's end time and again
    for m in re.compile(rf"<(/?){re.escape(name)}\b[^>]*>", re.I).finditer(page, 0, page.rfind(">") + 1):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append(m.end())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page."""
    out: list[Block] = []
    # open containers: name, furniture here or above, article here or above, an article element here or above
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    text: list[str] = []
    linked: list[str] = []
    in_link, heading = 0, False
    held, closings = Counter(), {}

    def close() -> None:
        nonlocal text, linked
        words = entities.unescape("".join(text)).split()
        if words:
            out.append(Block(" ".join(words), len(words), len(entities.unescape(" ".join(linked)).split()), stack[-1][1], stack[-1][2], heading))
        text, linked = [], []

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if in_link:
                    linked.append(piece)
            continue
        name, ending, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not ending and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in DROPPED:
            if not ending and not attributes.endswith("/"):
                if name not in closings:
                    closings[name] = _closings(page, name)
                at = closings[name].get(at, at)
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if ending else 1
                linked.append(" ")
            elif name == "br":
                text.append(" ")
            continue
        close()
        if name in HEADINGS:
            heading = not ending
        elif name in CONTAINERS or name in BOILER_TAGS:
            heading, in_link = False, 0
            if not ending:
                furniture, main = _flags(name, attributes)
                _, above, inside = stack[-1]
                if name == "header" and not inside:
                    furniture = True
                stack.append((name, above or furniture, inside or main))
                held[name] += 1
            elif held[name]:
                for k in range(len(stack) - 1, 0, -1):
                    held[stack[k][0]] -= 1
                    if stack.pop()[0] == name:
                        break
        elif name == "p":
            heading = False
    close()
    return out


def features(found: list[Block]) -> list[tuple[int, ...]]:
    """A row of FEATURES for each block of a page."""
    has_main = int(any(b.main and not b.boiler for b in found))
    sizes = [(0, 0), *((b.words, 100 * b.linked // b.words) for b in found), (0, 0)]
    return [(int(b.boiler), int(b.main), has_main, int(b.heading), *sizes[i + 1], *sizes[i], *sizes[i + 2]) for i, b in enumerate(found)]


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text, and how many blocks the page has and how many of them were kept."""
    if not page:
        return "", 0, 0
    found, grown = blocks(page), tree()
    kept = [b.text for b, x in zip(found, features(found), strict=True) if decide(grown, x)]
    return "\n\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_blocks, n_kept for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                text, count, kept = zip(*[main_text(x) for x in part.column(2).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(count, pa.int32()), pa.array(kept, pa.int32())],
                    ["page_id", "url", "text", "n_blocks", "n_kept"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_blocks int, n_kept int")
