"""Lists of tokens that are worked through whole or by blocks, and words hashed by pieces."""

import random

import numpy as np

from wardlume.llm import set_join, text_sets


def test_short_lists_need_one_shuffle_and_no_join(spark):
    r = random.Random(3)
    rows = {(r.randrange(40), (r.randrange(90), r.randrange(3))) for _ in range(900)}
    made = [(t, 0, (d, n, 5 + (7 * d + n) % 11), True, d % 4, t % 2 == 0) for t, (d, n) in sorted(rows)]
    entries = spark.createDataFrame(made, "token long, pos int, id struct<doc:long,line:long,n:long>, kept boolean, lead int, many boolean")
    whole, blocks = set_join._before_by_lists(entries), set_join._before_by_blocks(entries)
    assert whole.count() > 100 and not whole.exceptAll(blocks).count() and not blocks.exceptAll(whole).count()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    split = set_join.earlier_pairs(entries, 75)
    every = set_join.earlier_pairs(entries.withColumn("many", entries["lead"] < 0), 75)
    assert split.count() and not split.exceptAll(every).count() and not every.exceptAll(split).count()


def test_words_are_hashed_whole():
    sizes = [1, 7, 8, 9, 15, 16, 17, 127, 128, 129, 130, 1000]
    words = ["x" * n for n in sizes] + ["x" * (n - 1) + "y" for n in sizes] + ["y" + "x" * (n - 1) for n in sizes[1:]] + ["x\0", "\0", "\0\0", "12345678\0", "é", "É"]
    e = text_sets.elements(words, False)
    assert len(set(e.tokens.tolist())) == len(set(words)) == len(words)
    again = text_sets.elements([" \t".join(["a b c d", w.replace("x", "X"), "e f"]) for w in words] + ["a B c\x0bd " + w + " e f\n" for w in words], False)
    half = len(words)
    assert again.sizes.tolist() == [3] * 2 * half and (again.keys()[:half] == again.keys()[half:]).all() and len(np.unique(again.keys())) == half


def test_order_within_an_element_is_that_of_whole_tokens():
    texts = ["\n".join(" ".join(random.Random(i * 50 + k).choices("abcdefgh", k=12)) for k in range(50)) for i in range(20)]
    for levels in (None, np.arange(text_sets.SKETCH).astype(np.uint8) % 63):
        e = text_sets.elements(texts, True, levels)
        assert (np.diff(e.owner) >= 0).all() and (np.diff(e.tokens.astype(object))[np.diff(e.owner) == 0] > 0).all()
