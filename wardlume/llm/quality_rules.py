"""Quality rules: a threshold table compiled into one projection, with no user functions.

Every rule is a row (name, numerator, denominator, lower bound, upper bound) over integer counts of a document.
``compile_rules`` turns the table into one boolean column per rule and a verdict by cross-multiplied
integer comparisons, so no division and no rounding is involved.

All counts of a text are one expression that binds what it uses more than once, so a filter or a choice of columns above
it evaluates it once and not once for each use.

Defined results: a null text counts as no text (all counts 0, rejected by the base rule); an empty table gives an
empty result; repeated rows are judged one by one; other columns of the input are carried along untouched unless
they clash with a name this operator makes, in which case the operator's own column wins.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SEPARATOR_CLASS, WORD_CLASS, text_or_empty, unused

#: Very common function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and a to in is that it for was on with as be at by are this from or an".split(),
    "fr": "le la les de des du un une et en est que qui dans pour sur pas au aux par avec il elle".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "el la los las de del un una y en que es por con para se su al lo como no".split(),
}


class Rule(NamedTuple):
    """``lower * denominator <= 1000 * numerator <= upper * denominator``, bounds in thousandths; None: open."""

    name: str
    numerator: str
    denominator: str
    lower: int | None
    upper: int | None


#: The production thresholds. A rule whose denominator is 0 holds.
RULES = (
    Rule("length", "n_words", "one", 50_000, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 500),
    Rule("word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbols", "n_symbols", "n_words", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 60, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("shouting_lines", "n_shout_lines", "n_lines", None, 700),
)
BASE_RULES = ("length", "repeated_words")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_shout_lines", "one")
VERDICTS = ("base_failed", "kept")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.transform(F.array(value), use)[0]


def _covered(windows: Column) -> Column:
    """Words that lie in windows whose hash is there twice or more; a window is the word at its place and two more."""
    in_order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.when(k > 0, F.get(s, k - 1)["h"]) == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def words(p: Column) -> Column:
        new = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))).cast("long"))
        return F.aggregate(new, F.lit(0).cast("long"), lambda total, n: total + n)

    return _let(_let(in_order, places), words)


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text."""
    # Words hold no space, so a window's words joined by spaces identify it; its 64-bit hash stands for it.
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    none = F.lit(0).cast("long")
    return F.when(F.size(words) >= 4, _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(none))).otherwise(none)


def counts(body: Column) -> Column:
    """A struct of the COUNTS of a text that isn't null."""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})

    def of_words(words: Column) -> dict[str, Column]:
        return {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))).cast("long"),
            "n_repeat_words": _repeat_words(words),
        }

    def of_lines(lines: Column) -> dict[str, Column]:
        return {
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_shout_lines": F.size(F.filter(lines, lambda x: (F.upper(x) == x) & (F.lower(x) != x))).cast("long"),
        }

    def struct(made: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(n) for n, c in made.items()])

    words = F.filter(F.split(body, f"{SEPARATOR_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD_CLASS))
    both = F.struct(_let(words, lambda w: struct(of_words(w))).alias("w"), _let(lines, lambda x: struct(of_lines(x))).alias("l"))
    own = {"n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"), "one": F.lit(1).cast("long")}
    return _let(both, lambda b: F.struct(*[(own[n] if n in own else b["l" if n.endswith("_lines") else "w"][n]).alias(n) for n in COUNTS]))


def compile_rules(rules: tuple[Rule, ...] = RULES, count: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """A boolean column for each row of the threshold table: the rule holds."""
    out = {}
    for r in rules:
        top, bottom = count(r.numerator) * 1000, count(r.denominator)
        holds = F.lit(True)
        if r.lower is not None:
            holds = holds & (top >= bottom * r.lower)
        if r.upper is not None:
            holds = holds & (top <= bottom * r.upper)
        out[r.name] = (bottom == 0) | holds
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input, its counts, ``base_failed`` and ``kept`` (every rule of the table holds)."""

    def verdict(c: Column) -> Column:
        made = compile_rules(rules, lambda n: c[n])
        failed, kept = F.lit(False), F.lit(True)
        for n, holds in made.items():
            failed = failed | ~holds if n in BASE_RULES else failed
            kept = kept & holds
        return F.struct(*[c[n].alias(n) for n in COUNTS], failed.alias("base_failed"), kept.alias("kept"))

    carried = [c for c in docs.columns if c not in COUNTS + VERDICTS]
    name = unused(docs, "judged")
    df = docs.select(*[docs[c] for c in carried], _let(counts(text_or_empty(docs[text])), verdict).alias(name))
    # never null: no second look at the counts to see whether they are
    made = [F.coalesce(F.col(name)[c], F.lit(0).cast("long")).alias(c) for c in COUNTS] + [F.coalesce(F.col(name)[c], F.lit(False)).alias(c) for c in VERDICTS]
    return df.select(*[F.col(f"`{c}`") for c in carried], *made)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input and its integer counts, without a shuffle."""
    return judged(docs, text=text).drop(*VERDICTS)


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of the input that hold every rule, with all of the input's columns."""
    kept = _let(counts(text_or_empty(docs[text])), lambda c: F.forall(F.array(*compile_rules(rules, lambda n: c[n]).values()), lambda holds: holds))
    return docs.filter(F.coalesce(kept, F.lit(False)))
