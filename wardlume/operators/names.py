"""What elements are called: names and labels worked out from element rows by joins and windows.

An element's rows below it are those with pos up to its ``last``. So "a label wraps this field" is a running maximum of the labels' ends
over the page, "a link holds something with a name" the next named place within its span, and the text of an element is
what the parser noted of it. Labels for fields without one are derived from what stands between the control before and this one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, trimmed

#: Types of fields that need no label, types that are named as a group, elements that end a label's reach.
UNLABELLED_TYPES = ("hidden", "submit", "button", "reset", "image")
GROUPED_TYPES = ("radio", "checkbox")
LABEL_ENDS = ("h1", "h2", "h3", "h4", "h5", "h6", "legend")
CONTROLS = ("input", "select", "textarea")
# Texts that prompt but name nothing, words that are no labels, words that instructions begin with, words that headings begin with.
PROMPTS = ("search", "search…", "search...", "enter text", "type here", "choose an item", "select an item", "choose a date")
NO_LABELS = ("n/a", "na", "tbd", "required", "optional", "yes", "no")
INSTRUCTIONS = ("please", "enter", "type", "select", "choose", "complete", "fill", "provide", "ensure", "upload", "confirm", "kindly", "specify", "all")
HEADING_WORDS = ("section", "part", "chapter", "article", "step", "appendix")
MOST_CHARS, MOST_WORDS = 60, 6


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def given(name: str) -> Column:
    """The attribute is there and says something."""
    return ~blank(attr(name))


def _plain(c: Column) -> Column:
    """A text without marks around it, with single spaces."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s •*\-–—·:]+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s ]+", " "), r"^ | $", "")
    return F.regexp_replace(F.regexp_replace(t, r"[: ]+$", ""), r"[ $€£¥%#*]+$", "")


def with_label(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with ``name``: the text ``c`` as the name of a field, without marks around it; null unless it reads like a short noun phrase.

    Steps are columns of their own, so each is worked out once a row; a null text takes no step.
    """
    t, low, words = F.col("_plain"), F.col("_low"), F.col("_words")
    word = lambda w: F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+$", "")
    wrong = ((t == "") | (F.length(t) > MOST_CHARS) | ~t.rlike(r"\p{L}") | low.isin(*PROMPTS, *NO_LABELS) | word(words[0]).isin(*INSTRUCTIONS) | word(F.element_at(words, -1)).isin("required", "optional")
             | t.rlike(r"[.?!]$") | (t.contains(".") & t.contains(" ")) | low.rlike(rf"^({'|'.join(HEADING_WORDS)})\b") | (F.size(words) > MOST_WORDS))
    x = df.withColumn("_plain", F.when(c != "", _plain(c))).withColumn("_low", F.lower(t)).withColumn("_words", F.split(low, " "))
    return x.withColumn(name, F.when(t.isNotNull() & ~wrong, t)).drop("_plain", "_low", "_words")


def kind_of() -> Column:
    return F.when(F.col("tag") == "input", F.lower(trimmed(F.coalesce(attr("type"), F.lit("text"))))).otherwise(F.col("tag"))


def is_field() -> Column:
    """A control that a person fills in."""
    return F.col("tag").isin(*CONTROLS) & ~kind_of().isin(*UNLABELLED_TYPES)


def _parts(elements: DataFrame) -> DataFrame:
    """What names of fields follow from: ``link`` (the id that a label is for, or a field has), ``free`` (a label that is for nothing), ``lent`` (a name by attributes)."""
    label = F.col("tag") == "label"
    return elements.select(
        "doc_id", "pos", "last", "parent", "tag", "said", "bare", "cell", kind_of().alias("kind"), is_field().alias("is_field"), F.when(label, F.nullif(attr("for"), F.lit(""))).when(is_field(), attr("id")).alias("link"),
        (label & ~given("for")).alias("free"), (is_field() & (given("aria-label") | given("aria-labelledby") | given("title"))).alias("lent"))


def _named(parts: DataFrame) -> DataFrame:
    """``parts`` with ``named``, for fields: whether a name comes from attributes, from a label for the id, or from a label around the field."""
    label = F.col("tag") == "label"
    # a label that is still open here: its end is at this place or behind it
    open_ = F.max(F.when(label, F.col("last"))).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    meant = F.col("link").isNotNull() & F.max(label).over(Window.partitionBy("doc_id", "link"))
    x = parts.withColumn("meant", meant).withColumn("within", F.coalesce(open_ >= F.col("pos"), F.lit(False)))
    return x.withColumn("named", F.when(F.col("is_field"), F.col("lent") | F.col("within") | F.col("meant"))).drop("meant", "within", "lent", "link")


def named_fields(elements: DataFrame) -> DataFrame:
    """(doc_id, pos, parent, cell, kind, named): every field, and whether it has a name: by its own attributes, by a label for its id, or by a label around it."""
    return _named(_parts(elements.filter(F.col("tag").isin(*CONTROLS, "label")))).filter("is_field").select("doc_id", "pos", "parent", "cell", "kind", "named")


def derived_labels(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, pos, label) of fields without a name for which one can be told from what stands before them.

    That is a label of its own without a target, else the text since the control before, both beside the field; neither if the next field
    beside it has no label of its own, as the two share it; else the cell to the left. Boxes and buttons of a group have none.
    """
    return _told(_parts(elements).join(fields.select("doc_id", "pos", "named"), ["doc_id", "pos"], "left"), elements).filter("label is not null").select("doc_id", "pos", "label")


def labelled_fields(elements: DataFrame) -> DataFrame:
    """``named_fields`` with the ``derived_labels`` of those without a name, in one pass: all sorting is within pages, so rows dealt by doc_id are not shuffled."""
    return _told(_named(_parts(elements)), elements)


def _told(x: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, pos, parent, cell, kind, named, label) of the fields among parts that hold ``named``."""
    control = F.col("tag").isin(*CONTROLS)
    ends = control | F.col("tag").isin(*LABEL_ENDS)
    x = x.withColumn("open", F.coalesce(F.col("is_field") & ~F.col("named") & ~F.col("kind").isin(*GROUPED_TYPES), F.lit(False)))
    # whether a control is inside: the next control behind the start
    next_ = F.expr(f"lead(CASE WHEN tag IN {CONTROLS} THEN pos END) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY pos)")
    x = x.withColumn("holds", F.coalesce(next_ <= F.col("last"), F.lit(False)))
    # beside fields without a name: stretches up to a control or heading
    beside = Window.partitionBy("doc_id", "parent").orderBy("pos")
    whole = beside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumns({"asked": F.max("open").over(whole) & F.col("parent").isNotNull(), "reach": F.coalesce(F.sum(ends.cast("int")).over(beside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    x = x.filter(F.col("asked") | F.col("is_field"))
    free = ~ends & (F.col("tag") != "label")
    x = with_label(x.withColumns({"own": F.col("free") & ~F.col("holds"), "said_free": F.when(free, F.col("said")), "long": free & F.col("said").isNull()}),
                   "name", F.when(F.col("asked") & (F.col("own") | free), F.col("said")))
    # of every stretch: its last own label, its text, whether any label or text in it reads like one, and the field that ends it
    stretch = x.groupBy("doc_id", "parent", "reach").agg(
        F.max(F.when(F.col("own") & F.col("name").isNotNull(), F.struct("pos", "name"))).alias("own"), F.collect_list(F.when(F.col("said_free") != "", F.struct("pos", "said_free"))).alias("texts"),
        F.max("long").alias("long"), F.max(F.col("name").isNotNull()).alias("pending"), F.max(F.when(F.col("is_field"), F.struct("pos", "cell", "kind", "named", "open"))).alias("field"))
    # up to the next field, is there a label of its own: else the two share what stands before
    order = Window.partitionBy("doc_id", "parent").orderBy("reach")
    stretch = stretch.withColumn("so_far", F.sum(F.col("pending").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shared = F.coalesce(F.expr("lead(CASE WHEN field IS NOT NULL THEN so_far END) IGNORE NULLS OVER (PARTITION BY doc_id, parent ORDER BY reach)") == F.col("so_far"), F.lit(False))
    near = stretch.withColumn("shared", shared).filter("field is not null").select("doc_id", "parent", "field.*", "shared", F.col("own.name").alias("own"), "texts", "long")
    inline = F.array_join(F.transform(F.sort_array("texts"), lambda t: t["said_free"]), "")
    near = with_label(near, "inline", F.when(F.col("open") & ~F.col("shared") & ~F.col("long") & F.col("own").isNull(), inline))
    fields = near.select("doc_id", "pos", "parent", "cell", "kind", "named", "open", F.when(~F.col("shared"), F.coalesce("own", "inline")).alias("near"))
    # cells of one row lie together, behind the row itself
    is_cell = F.col("tag") != "tr"
    row = Window.partitionBy("doc_id", "row").orderBy("at")
    cells = elements.filter(F.col("tag").isin("td", "th", "tr")).select("doc_id", F.col("pos").alias("at"), F.when(is_cell, F.col("parent")).otherwise(F.col("pos")).alias("row"), is_cell.alias("is_cell"), F.when(is_cell, F.col("bare")).alias("bare"))
    left = cells.withColumns({"left": F.lag("bare").over(row), "in_row": F.max(~F.col("is_cell")).over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).filter("is_cell and in_row")
    left = with_label(left, "left", F.col("left")).select("doc_id", F.col("at").alias("cell"), "left").hint("merge")
    found = fields.join(left, ["doc_id", "cell"], "left")
    return found.select("doc_id", "pos", "parent", "cell", "kind", "named", F.when(F.col("open"), F.coalesce("near", "left")).alias("label"))


def _labelled_by(elements: DataFrame) -> DataFrame:
    """(doc_id, pos) of elements whose aria-labelledby names something that says anything."""
    refs = elements.filter(given("aria-labelledby")).select("doc_id", "pos", F.explode(F.split(trimmed(attr("aria-labelledby")), r"\s+")).alias("id"))
    targets = elements.filter(attr("id").isNotNull() & (F.col("said").isNull() | (F.col("said") != ""))).select("doc_id", attr("id").alias("id")).distinct()
    return refs.join(targets, ["doc_id", "id"], "left_semi").select("doc_id", "pos").distinct()


def nameless_links(elements: DataFrame) -> DataFrame:
    """(doc_id, pos) of links with a target that a person meets and that have no name: none of their own, no text, nothing inside that has one."""
    named = _labelled_by(elements).withColumn("by_id", F.lit(True))
    lends = F.when(F.col("tag") == "img", attr("alt").isNull() | given("alt")).when((F.col("tag") == "input") & kind_of().isin("image", "submit", "button", "reset"), given("alt") | given("value")).otherwise(False)
    x = elements.filter((F.col("tag") == "a") | F.col("tag").isin("img", "input") | given("aria-label") | given("aria-labelledby")).join(named, ["doc_id", "pos"], "left")
    x = x.withColumn("lends", lends | given("aria-label") | F.coalesce("by_id", F.lit(False)))
    next_ = F.min(F.when(F.col("lends"), F.col("pos"))).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    style = F.lower(F.regexp_replace(F.coalesce(attr("style"), F.lit("")), r"\s+", ""))
    met = ~F.col("hidden") & attr("hidden").isNull() & ~style.rlike("display:none|visibility:hidden") & ~F.coalesce(F.lower(trimmed(attr("role"))).isin("presentation", "none"), F.lit(False))
    bare = ~given("aria-label") & ~given("title") & F.col("by_id").isNull() & (F.col("said") == "")
    return x.withColumn("next", next_).filter((F.col("tag") == "a") & attr("href").isNotNull() & met & bare & F.coalesce(F.col("next") > F.col("last"), F.lit(True))).select("doc_id", "pos")


def _untitled_frame() -> Column:
    """A frame of some size that is not hidden and has no title."""
    style = F.lower(F.regexp_replace(F.coalesce(attr("style"), F.lit("")), r"\s+", ""))
    tiny = lambda n: F.coalesce(trimmed(attr(n)).isin("0", "1", "0px", "1px"), F.lit(False))
    gone = F.col("hidden") | attr("hidden").isNotNull() | style.contains("display:none") | tiny("width") | tiny("height")
    return (F.col("tag") == "iframe") & ~gone & ~given("title") & ~given("aria-label")


def _said_not_named() -> Column:
    """A link or button whose visible text of two characters or more is not part of its label."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^\p{L}\p{N}_ ]", "")))
    seen, label = plain(F.col("said")), plain(attr("aria-label"))
    return F.col("tag").isin("a", "button") & given("aria-label") & F.coalesce((F.length(seen) >= 2) & ~label.contains(seen), F.col("said").isNull())


def page_counters(elements: DataFrame, forms: bool = True) -> DataFrame:
    """One row per page: the fields, frames, purposes, places in the tab order and labels that document rules count. forms: whether there are any fields."""
    own = elements.groupBy("doc_id").agg(
        F.count_if(F.col("purpose").isNotNull() & ~given("autocomplete")).alias("inputs_missing_autocomplete"), F.count_if(F.coalesce(attr("tabindex").rlike(r"^\s*\+?0*[1-9]\d*\s*$"), F.lit(False))).alias("positive_tabindex_count"),
        F.count_if(_untitled_frame()).alias("iframes_missing_title"), F.count_if(_said_not_named()).alias("label_in_name_mismatches"))
    counts = ["form_fields_total", "form_fields_unlabeled", "form_fields_derivable"]
    if not forms:
        return own.select("*", *[F.lit(0).cast("long").alias(c) for c in counts])
    per_field = labelled_fields(elements).groupBy("doc_id").agg(
        F.count("*").alias("form_fields_total"), F.count_if(~F.col("named")).alias("form_fields_unlabeled"), F.count_if(F.col("label").isNotNull()).alias("form_fields_derivable"))
    return own.join(per_field, "doc_id", "left").fillna(0, counts)


def node_properties(elements: DataFrame) -> DataFrame:
    """(doc_id, node_id, _more): properties of nodes that follow from names: the counters of each page's document node, a mark of links without a name.

    Where no page has a field, or a link without text, the joins that look for their names are left out.
    """
    bare = (F.col("tag") == "a") & attr("href").isNotNull() & (F.col("said") == "")
    some = elements.agg(F.max(F.col("tag").isin(*CONTROLS)).alias("forms"), F.max(bare).alias("bare")).first()
    counters = page_counters(elements, bool(some["forms"]))
    names = [c for c in counters.columns if c != "doc_id"]
    roots = elements.filter("pos = 0 and node.props['status'] = 'ok'").select("doc_id", "node.node_id")
    out = [counters.join(roots, "doc_id").select("doc_id", "node_id", F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))]).alias("_more"))]
    if some["bare"]:
        links = elements.filter("tag = 'a' and node is not null").select("doc_id", "pos", "node.node_id").join(nameless_links(elements), ["doc_id", "pos"])
        out.append(links.select("doc_id", "node_id", F.create_map(F.lit("link_nameless"), F.lit("true")).alias("_more")))
    return reduce(DataFrame.unionByName, out)
