"""Unified diffs of whole texts: shortest edits, hunks with context, and the way back.

Texts are compared line by line, whatever their length. Lines that only one side has can match nothing and are set aside; what is left
is compared by Myers' greedy algorithm while few edits are needed, else by Hirschberg's division with rows of the table of longest common
subsequences kept as bits. So close versions take time in proportion to their length and edits, unlike ones a 64th of the product
of their common lines, and memory stays in proportion to the lines. Either way no shorter edit exists.

A pair is a row and its diff a few rows: no group of pairs meets in a task. A null text has no lines; an empty one has one empty line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits up to which the greedy algorithm is tried: its trace has the square of them in numbers.
GREEDY = 200


def _greedy(a: list[int], b: list[int], most: int) -> list[tuple[int, int]] | None:
    """Matched (i, j) of a shortest edit of at most so many steps, else None."""
    n, m = len(a), len(b)
    far, trace = {1: 0}, []
    for d in range(min(n + m, most) + 1):
        trace.append(far.copy())
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            far[k] = x
            if x >= n and y >= m:
                return _walk_back(trace, n, m)
    return None


def _walk_back(trace: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(trace) - 1, -1, -1):
        far, k = trace[d], x - y
        before = k + 1 if k == -d or (k != d and far[k - 1] < far[k + 1]) else k - 1
        x0 = far[before] if d else 0
        y0 = x0 - before if d else 0
        while x > x0 and y > y0:
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = x0, y0
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Longest common subsequence of a and each prefix of b: a row of the table, 0 bits where it grows."""
    places: dict[int, int] = {}
    for j, s in enumerate(b):
        places[s] = places.get(s, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for s in a:
        hit = row & places.get(s, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _divided(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched (i, j) of a longest common subsequence, by halves of a."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        s, e, t, f = todo.pop()
        if s == e or t == f:
            continue
        if e - s == 1:
            out += [(s, b.index(a[s], t, f))] if a[s] in b[t:f] else []
            continue
        half = (s + e) // 2
        cut = t + int((_lengths(a[s:half], b[t:f]) + _lengths(a[half:e][::-1], b[t:f][::-1])[::-1]).argmax())
        todo += [(s, half, t, cut), (half, e, cut, f)]
    return sorted(out)


def matches(a: list[str], b: list[str], greedy: int = GREEDY) -> list[tuple[int, int]]:
    """(i, j) of the lines that stay, as many as can be, both ascending."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = {s: i for i, s in enumerate(set(x) & set(y))}
    i, j = [p for p, s in enumerate(x) if s in both], [p for p, s in enumerate(y) if s in both]
    u, v = [both[x[p]] for p in i], [both[y[p]] for p in j]
    found = _greedy(u, v, greedy) if u and v else []
    if found is None:
        found = _divided(u, v)
    inner = [(head + i[p], head + j[q]) for p, q in found]
    return [*((p, p) for p in range(head)), *inner, *((len(a) - tail + p, len(b) - tail + p) for p in range(tail))]


def _changes(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(start, end) in a and in b of each stretch that changes."""
    out, i, j = [], 0, 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        if p > i or q > j:
            out.append((i, p, j, q))
        i, j = p + 1, q + 1
    return out


def hunks_of(a: list[str], b: list[str], context: int = 3) -> list[tuple[int, int, int, int, list[str]]]:
    """(start, lines) before and after, counted from 1, and the lines with their marks; a hunk without lines of a side starts at the line before."""
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in _changes(a, b):
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for g in groups:
        s, e = max(0, g[0][0] - context), min(len(a), g[-1][1] + context)
        t, f = g[0][2] - (g[0][0] - s), g[-1][3] + (e - g[-1][1])
        lines, at = [], s
        for i, p, j, q in g:
            lines += [" " + x for x in a[at:i]] + ["-" + x for x in a[i:p]] + ["+" + x for x in b[j:q]]
            at = p
        lines += [" " + x for x in a[at:e]]
        out.append((s + (e > s), e - s, t + (f > t), f - t, lines))
    return out


def hunked(pairs: DataFrame, key: str, before: str = "before", after: str = "after", context: int = 3) -> DataFrame:
    """(key, before, hunks) of rows (key, before, after): a pair's hunks beside its text, an empty array where nothing changed."""
    kind = pairs.schema[key].dataType
    names = ["hunk", "before_start", "before_lines", "after_start", "after_lines"]
    hunk = pa.struct([*((n, pa.int64()) for n in names), ("lines", pa.list_(pa.string()))])

    def split(s: str | None) -> list[str]:
        return [] if s is None else s.split("\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = []
                for x, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    rows.append([dict(zip([*names, "lines"], (n + 1, *h), strict=True)) for n, h in enumerate(hunks_of(split(x), split(y), context))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.list_(hunk))], [key, "before", "hunks"])

    schema = f"`{key}` {kind.simpleString()}, before string, hunks array<struct<{', '.join(f'{n}: bigint' for n in names)}, lines: array<string>>>"
    return pairs.select(key, F.col(before).cast("string").alias("before"), F.col(after).cast("string").alias("after")).mapInArrow(run, schema)


def unified_hunks(pairs: DataFrame, key: str, before: str = "before", after: str = "after", context: int = 3) -> DataFrame:
    """(key, hunk, before_start, before_lines, after_start, after_lines, lines) of rows (key, before, after): no rows where nothing changed."""
    return hunked(pairs, key, before, after, context).select(key, F.inline("hunks"))


def marked_lines(mark: str) -> Column:
    """How many lines of a row's ``hunks`` have the mark."""
    return F.aggregate("hunks", F.lit(0).cast("long"), lambda n, h: n + F.size(F.filter(h["lines"], lambda x: x.startswith(mark))))


def patched_texts(rows: DataFrame) -> DataFrame:
    """Rows of ``hunked`` with ``after``: the text before with its hunks applied, row by row; null where no line is left."""
    x = rows.withColumn("_old", F.coalesce(F.split("before", "\n", -1), F.array().cast("array<string>")))
    start = lambda h: (h["before_start"] - F.when(h["before_lines"] > 0, 1).otherwise(0)).cast("int")
    done = lambda i: F.when(i > 0, start(F.get("hunks", i - 1)) + F.get("hunks", i - 1)["before_lines"].cast("int")).otherwise(0)
    new = lambda h: F.transform(F.filter(h["lines"], lambda x: ~x.startswith("-")), lambda x: x.substr(F.lit(2), F.length(x)))
    changed = F.flatten(F.transform("hunks", lambda h, i: F.concat(F.slice("_old", done(i) + 1, start(h) - done(i)), new(h))))
    last = done(F.size("hunks"))
    x = x.withColumn("_new", F.concat(changed, F.slice("_old", last + 1, F.size("_old") - last)))
    return x.withColumn("after", F.when(F.size("_new") > 0, F.array_join("_new", "\n"))).drop("_old", "_new")


def hunk_header() -> Column:
    """The line over a hunk: places and lengths, a length of 1 left out."""
    side = lambda s: F.concat(F.col(f"{s}_start").cast("string"), F.when(F.col(f"{s}_lines") == 1, "").otherwise(F.concat(F.lit(","), F.col(f"{s}_lines").cast("string"))))
    return F.concat(F.lit("@@ -"), side("before"), F.lit(" +"), side("after"), F.lit(" @@"))


def unified_texts(hunks: DataFrame, key: str) -> DataFrame:
    """(key, diff, removed, added): each diff as text, with the names of its sides."""
    count = lambda mark: F.sum(F.size(F.filter("lines", lambda x: x.startswith(mark)))).cast("long")
    body = F.concat(F.array(hunk_header()), "lines")
    every = F.transform(F.sort_array(F.collect_list(F.struct("hunk", body.alias("body")))), lambda h: F.array_join(h["body"], "\n"))
    return hunks.groupBy(key).agg(F.concat(F.lit("--- before\n+++ after\n"), F.array_join(every, "\n")).alias("diff"), count("-").alias("removed"), count("+").alias("added"))


def patched(pairs: DataFrame, hunks: DataFrame, key: str, before: str = "before") -> DataFrame:
    """(key, after): each text with its hunks applied; null where no line is left. Lines are rows: joins on (key, line) and one grouping by key."""
    own = pairs.select(key, F.posexplode(F.split(before, "\n", -1)).alias("line", "text"))
    rows = hunks.select(key, "before_start", "before_lines", F.posexplode("lines").alias("i", "x"), "lines")
    # how many lines of the text before come before this one in the hunk
    passed = F.size(F.filter(F.slice("lines", 1, F.col("i")), lambda x: ~x.startswith("+")))
    start = F.col("before_start") - F.when(F.col("before_lines") > 0, 1).otherwise(0)
    rows = rows.select(key, (start + passed).alias("line"), "i", F.substring("x", 1, 1).alias("mark"), F.expr("substring(x, 2)").alias("text"))
    gone = rows.filter("mark = '-'").select(key, "line")
    kept = own.join(gone, [key, "line"], "left_anti").select(key, "line", F.lit(1).alias("new"), F.lit(0).alias("i"), "text")
    came = rows.filter("mark = '+'").select(key, "line", F.lit(0).alias("new"), "i", "text")
    # a line that comes stands before the old line that it was met at
    every = kept.unionByName(came).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line", "new", "i", "text"))).alias("all"))
    found = every.select(key, F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("after"))
    return pairs.select(key).join(found, key, "left")
