"""Column expressions over text: link texts, targets, image descriptions, titles, document ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

URL_TEXT = rf"(?i)^(?:https?://\S+|www\.\S+|[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9\-]+)*\.(?:{fixed.LINK_DOMAINS}|gov\.uk)(?:/\S*)?)$"
URL_TEXT_UI = URL_TEXT.replace(r"|gov\.uk", "")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def trimmed(c: Column) -> Column:
    """White space off both ends; null stays null."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def normalized_link_text(c: Column) -> Column:
    """Lower case, letters a-z and digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]+", ""), r"\s+", " "))


def looks_like_url(c: Column, ui: bool = False) -> Column:
    return trimmed(F.coalesce(c, F.lit(""))).rlike(URL_TEXT_UI if ui else URL_TEXT)


def link_text_is_generic(c: Column) -> Column:
    """Link text that is empty once normalised, generic, or the bare address."""
    n = normalized_link_text(c)
    return (n == "") | n.isin(*fixed.GENERIC_LINK_TEXT) | looks_like_url(c)


def link_text_verdict(c: Column) -> Column:
    """The editor's verdict: empty, url, generic, short or ok, in this order."""
    n = normalized_link_text(c)
    return (F.when(n == "", "empty").when(looks_like_url(c, ui=True), "url").when(n.isin(*fixed.GENERIC_LINK_TEXT), "generic")
            .when(F.length(n) <= 2, "short").otherwise("ok"))


def target_is_broken(c: Column) -> Column:
    low = F.lower(trimmed(c))
    return c.isNull() | low.isin(*fixed.BROKEN_TARGETS) | low.startswith("javascript:")


def scheme_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def invalid_link_reason(c: Column) -> Column:
    """missing_target, placeholder_target, missing_host, unsupported_scheme, or '' for a usable target."""
    v = trimmed(F.coalesce(c, F.lit("")))
    scheme = scheme_of(v)
    host = F.regexp_extract(v, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_extract(v, r"^(?://[^/?#]*)?([^?#]*)", 1)
    return (F.when(v == "", "missing_target").when(v.startswith("#"), "").when(F.lower(v).isin(*fixed.PLACEHOLDER_TARGETS), "placeholder_target")
            .when(scheme.isin("http", "https") & (host == ""), "missing_host").when(scheme.isin("http", "https", "mailto"), "")
            .when((scheme == "") & (path != ""), "").otherwise("unsupported_scheme"))


def heuristic_link_text(target: Column, text: Column) -> Column:
    """A readable text for a link, from its host."""
    t, original = trimmed(F.coalesce(target, F.lit(""))), trimmed(F.coalesce(text, F.lit("")))
    host = F.regexp_extract(t, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    place = F.regexp_replace(F.when(host != "", host).otherwise(F.regexp_extract(t, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?([^?#]*)", 1)), r"^www\.", "")
    title = F.when(place != "", F.split_part(place, F.lit("/"), F.lit(1))).otherwise(t)
    return (F.when((t != "") & (title != ""), F.concat(F.when(original == "", "Visit ").otherwise("Read more about "), title))
            .when(original != "", F.concat(F.lit("Read more about "), original)).otherwise("Open linked resource"))


def alt_is_nondescriptive(c: Column) -> Column:
    """A description that is there but describes nothing: filler, a file name, an address, a size, the kind of image."""
    a = trimmed(F.coalesce(c, F.lit("")))
    low = F.lower(a)
    patterns = (*fixed.ALT_PATTERNS, rf"\.({'|'.join(fixed.IMAGE_EXTENSIONS)})$", rf"^({_any(fixed.IMAGE_WORDS)})[\s_\-#:]*\d*$", rf"^({'|'.join(fixed.CAMERA_PREFIXES)})[\s_\-]?\d+")
    return (a != "") & reduce(lambda hit, p: hit | low.rlike(p), patterns, low.isin(*fixed.JUNK_ALT))


def alt_verdict(c: Column) -> Column:
    """empty, too_short, too_long, generic_prefix, generic_value or pass."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    low = F.lower(t)
    return (F.when(t == "", "empty").when(F.length(t) < 4, "too_short").when(F.length(t) > fixed.ALT_MAX_CHARS, "too_long")
            .when(low.rlike(rf"^({'|'.join(fixed.ALT_BANNED_PREFIXES)})"), "generic_prefix").when(low.isin(*fixed.ALT_BANNED_VALUES), "generic_value").otherwise("pass"))


def title_is_placeholder(title: Column, filename: Column | None = None) -> Column:
    low = F.lower(trimmed(F.coalesce(title, F.lit(""))))
    hit = low.isin(*fixed.GENERIC_TITLES) | low.rlike(rf"^({'|'.join(fixed.NUMBERED_TITLES)})\s*\d+$") | low.rlike(r"^microsoft (word|powerpoint|excel)\s*[-–]\s*")
    if filename is not None:
        name = F.lower(trimmed(F.coalesce(filename, F.lit(""))))
        hit = hit | ((name != "") & ((low == name) | (low == F.regexp_replace(name, r"\.[^.]*$", ""))))
    return (low != "") & hit


def title_is_missing(title: Column, filename: Column | None = None) -> Column:
    return blank(title) | title_is_placeholder(title, filename)


def document_id(c: Column) -> Column:
    """A safe label of at most 96 characters from a file name's stem."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r'[/\\:*?"<>|\p{Cc}\p{Cf}\p{Co}\p{Cn}]', "")
    label = F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"^[. ]+", "")
    short = F.trim(F.substring(label, 1, 96))
    return F.when(short == "", "doc").otherwise(short)


def heading_level_of_line(c: Column) -> Column:
    """Level of a line that reads like a heading: numbered, all capitals, or short and ending in a colon; else null."""
    return heading_level_of_trimmed(trimmed(c))


def heading_level_of_trimmed(t: Column) -> Column:
    """``heading_level_of_line`` of a column without white space at its ends, which is read several times."""
    number = F.regexp_extract(t, fixed.NUMBERED_LINE, 1)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (F.when((t == "") | (F.length(t) > 120) | t.contains("\n"), F.lit(None).cast("int"))
            .when(number != "", F.least(F.lit(6), F.regexp_count(number, F.lit(r"\.")) + 1))
            .when((F.length(t) <= 80) & t.rlike(fixed.CAPITAL_LINE), 1).when(t.endswith(":") & (words <= 8), 2))


def list_marker(c: Column) -> Column:
    """Of a paragraph that is typed like a list item: its kind, character and ordinal, else null."""
    bullet = F.regexp_extract(c, r"^\s*([-*•‣◦–—·])\s+\S", 1)
    ordinal = F.regexp_extract(c, r"^\s*(\d{1,3})[.)]\s+\S", 1)
    return (F.when(bullet != "", F.struct(F.lit("bullet").alias("kind"), bullet.alias("mark"), F.lit(None).cast("int").alias("ordinal")))
            .when(ordinal != "", F.struct(F.lit("decimal").alias("kind"), F.regexp_extract(c, r"^\s*\d{1,3}([.)])", 1).alias("mark"), ordinal.cast("int").alias("ordinal"))))


def strip_list_marker(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*(?:[-*•‣◦–—·]|\d{1,3}[.)])\s+", "")


def masked_email(c: Column) -> Column:
    """First letter and domain of an address."""
    return F.when(c.contains("@"), F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))).otherwise(F.lit("***"))


def credit_cost(extension: Column) -> Column:
    pairs = [F.lit(x) for k, v in fixed.CREDIT_COSTS.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_replace(extension, r"^\.", ""))), F.lit(fixed.DEFAULT_CREDIT_COST))


def fuzzy_score(query: str, c: Column) -> Column:
    """How well the query's letters occur in a text in order, 0 for an empty query, null where they don't all.

    Each letter counts 1, in a run 5 and 2 more for each letter of the run so far, 8 more at the start or 6 after a separator; short texts get up to 20.
    """
    q = query.strip().lower()
    if not q:
        return F.lit(0.0)
    t = F.lower(F.coalesce(c, F.lit("")))
    letters, wanted = F.split(t, ""), F.array(*[F.lit(x) for x in q])

    def step(s: Column, x: Column) -> Column:
        hit = (s["at"] < len(q)) & (x["c"] == F.get(wanted, s["at"]))
        streak = F.when(s["last"] == x["i"] - 1, s["streak"] + 1).otherwise(0)
        place = F.when(x["i"] == 0, 8).when(x["before"].rlike(r"[\s._\-/()]"), 6).otherwise(0)
        # a first letter at the start follows place -1, which no letter has: it is a run too
        gain = F.when(s["last"] == x["i"] - 1, 5 + 2 * streak).otherwise(1) + place
        return F.when(hit, F.struct((s["at"] + 1).alias("at"), (s["score"] + gain).alias("score"), x["i"].alias("last"), streak.alias("streak"))).otherwise(s)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(-1).alias("last"), F.lit(0).alias("streak"))
    places = F.transform(letters, lambda x, i: F.struct(x.alias("c"), i.alias("i"), F.coalesce(F.get(letters, i - 1), F.lit("")).alias("before")))
    end = F.aggregate(places, start, step)
    found = F.transform(F.array(end), lambda e: F.when(e["at"] == len(q), e["score"] + F.greatest(F.lit(0.0), 20 - F.length(t) / 4)))[0]
    return F.when(t != "", found)
