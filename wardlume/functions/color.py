"""Column expressions over colours: parsing, contrast, and the nearest passing text colour."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CSS colour names.
CSS_NAMES = {
    "black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "008000", "blue": "0000FF", "yellow": "FFFF00", "cyan": "00FFFF", "aqua": "00FFFF",
    "magenta": "FF00FF", "fuchsia": "FF00FF", "gray": "808080", "grey": "808080", "silver": "C0C0C0", "maroon": "800000", "olive": "808000", "lime": "00FF00",
    "teal": "008080", "navy": "000080", "purple": "800080", "orange": "FFA500", "pink": "FFC0CB", "brown": "A52A2A", "gold": "FFD700", "lightgray": "D3D3D3",
    "lightgrey": "D3D3D3", "darkgray": "A9A9A9", "darkgrey": "A9A9A9", "dimgray": "696969", "dimgrey": "696969", "whitesmoke": "F5F5F5",
}
#: Contrast asked for, normal and large text, levels AA and AAA.
AA, AA_LARGE, AAA, AAA_LARGE = 4.5, 3.0, 7.0, 4.5


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x evaluated once, however often ``use`` refers to it; keeps generated code small."""
    return F.element_at(F.transform(F.array(x), use), 1)


def hex6(c: Column) -> Column:
    """RRGGBB in capitals from #RGB or #RRGGBB, else null."""
    return bound(F.upper(F.regexp_replace(F.trim(c), "^#", "")), lambda h: F.when(h.rlike("^[0-9A-F]{6}$"), h).when(h.rlike("^[0-9A-F]{3}$"), _doubled(h)))


def _doubled(h: Column) -> Column:
    return F.regexp_replace(h, "([0-9A-F])", "$1$1")


def css_hex(c: Column) -> Column:
    """RRGGBB of a CSS colour: hex of 3, 4, 6 or 8 digits if opaque, rgb(), rgba() with full alpha, or a name."""
    return bound(F.lower(F.trim(c)), _css_hex)


def _css_hex(t: Column) -> Column:
    # what the value begins with decides which of the patterns is tried
    rgb = r"^rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*(?:,\s*([0-9.]+)\s*)?\)$"
    part = [F.lpad(F.hex(F.least(F.lit(255), F.regexp_extract(t, rgb, i).try_cast("int"))), 2, "0") for i in (1, 2, 3)]
    alpha = F.regexp_extract(t, rgb, 4)
    names = F.create_map(*[F.lit(x) for kv in CSS_NAMES.items() for x in kv])
    return (F.when(t.startswith("#"), bound(F.upper(F.regexp_extract(t, "^#([0-9a-f]+)$", 1)), _opaque))
            .when(t.startswith("rgb"), F.when(t.rlike(rgb) & ((alpha == "") | (alpha.try_cast("double") >= 1)), F.concat(*part))).otherwise(F.try_element_at(names, t)))


def _opaque(h: Column) -> Column:
    return (F.when(F.length(h) == 6, h).when(F.length(h) == 3, _doubled(h)).when((F.length(h) == 4) & h.endswith("F"), _doubled(F.substring(h, 1, 3)))
            .when((F.length(h) == 8) & h.endswith("FF"), F.substring(h, 1, 6)))


def channels(hex_color: Column) -> list[Column]:
    return [F.conv(F.substring(hex_color, i, 2), 16, 10).cast("double") for i in (1, 3, 5)]


#: Linear light of a channel from 0 to 255.
_LINEAR = [x / 12.92 if x <= 0.03928 else ((x + 0.055) / 1.055) ** 2.4 for x in (i / 255 for i in range(256))]


def _table() -> Column:
    """``_LINEAR`` as one constant: the planner folds the text into an array."""
    return F.split(F.lit(",".join(map(repr, _LINEAR))), ",").cast("array<double>")


def _light(parts: list[Column]) -> Column:
    """Luminance of channels that are whole numbers from 0 to 255."""
    return sum((F.element_at(_table(), c.cast("int") + 1) * w for c, w in zip(parts, (0.2126, 0.7152, 0.0722), strict=True)), start=F.lit(0.0))


def luminance(hex_color: Column) -> Column:
    return bound(hex_color, lambda h: _light(channels(h)))


def _ratio(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def contrast(fg: Column, bg: Column) -> Column:
    """1 to 21, or null if a colour can't be read."""
    return bound(F.struct(luminance(hex6(fg)).alias("a"), luminance(hex6(bg)).alias("b")), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), _ratio(x["a"], x["b"])))


def is_large(size_pt: Column, bold: Column) -> Column:
    return F.coalesce((size_pt >= 18) | (bold & (size_pt >= 14)), F.lit(False))


def required(size_pt: Column, bold: Column, level: str = "AA") -> Column:
    normal, large = (AAA, AAA_LARGE) if level == "AAA" else (AA, AA_LARGE)
    return F.when(is_large(size_pt, bold), large).otherwise(normal)


def low_contrast(fg: Column, bg: Column, size_pt: Column, bold: Column) -> Column:
    """Contrast below what the size asks for, with a tolerance of 0.05; the background is white if none is given."""
    return F.coalesce(contrast(fg, F.coalesce(hex6(bg), F.lit("FFFFFF"))) + 0.05 < required(size_pt, bold), F.lit(False))


def _toward(base: list[Column], goal: int, t: Column) -> list[Column]:
    return [F.rint(c + (F.lit(float(goal)) - c) * t) for c in base]


def nearest_passing(fg: Column, bg: Column, needed: Column, steps: int = 64) -> Column:
    """The text colour closest to fg, on its way to black or to white in ``steps`` steps, that has the contrast; null if fg has it.

    On the way the luminance only falls, or only rises. So the steps without the contrast come first, all of those with it after them, and halving finds the border.
    """
    halves = [2**k for k in range(steps.bit_length() - 1, -1, -1)]

    def search(x: Column) -> Column:
        base = [x["c"][i] for i in range(3)]

        def first(goal: int) -> Column:
            low = lambda i: _ratio(_light(_toward(base, goal, i.cast("double") / steps)), x["light"]) < x["needed"]
            failing = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda n, s: F.when((n + s <= steps) & low(n + s), n + s).otherwise(n))

            def made(n: Column) -> Column:
                i = (n + 1).cast("double")
                far = reduce(lambda a, b: a + b, [F.pow((F.lit(float(goal)) - c) * i / steps, F.lit(2.0)) for c in base])
                hex_ = F.concat(*[F.lpad(F.hex(c.cast("int")), 2, "0") for c in _toward(base, goal, i / steps)])
                return F.when(n < steps, F.struct(far.alias("far"), F.lit(goal).alias("goal"), hex_.alias("hex")))

            return bound(failing, made)

        # the smaller change wins, black of equals
        best = F.try_element_at(F.sort_array(F.filter(F.array(first(0), first(255)), lambda y: y.isNotNull())), F.lit(1))
        fails = _ratio(_light(base), x["light"]) < x["needed"]
        return F.when(fails, F.try_element_at(F.transform(F.array(best), lambda y: y["hex"]), F.lit(1)))

    read = F.struct(F.array(*channels(hex6(fg))).alias("c"), luminance(hex6(bg)).alias("light"), needed.cast("double").alias("needed"))
    return bound(read, lambda x: F.when(x["c"][0].isNotNull() & x["light"].isNotNull(), search(x)))


def tinted(hex_color: Column, tint: Column) -> Column:
    """A theme colour lightened (tint above 0) or darkened (below 0) by a fraction."""
    return F.concat(*[F.lpad(F.hex(F.rint(F.when(tint < 0, c * (1 + tint)).otherwise(c + (255 - c) * tint)).cast("int")), 2, "0") for c in channels(hex_color)])
