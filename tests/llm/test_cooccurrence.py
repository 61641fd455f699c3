import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftmark.llm import cooccurrence as C


def brute(baskets, least=1):
    single, pair = Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        pair.update(itertools.combinations(sorted(items), 2))
    return {(a, b, single[a], single[b], n) for (a, b), n in pair.items() if n >= least}


@pytest.mark.parametrize("chunk", [2, 3, 256])
def test_counts_equal_brute_force_with_one_huge_basket(spark, chunk):
    rnd = random.Random(1)
    baskets = {i: {f"i{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 6))} for i in range(40)}
    baskets[99] = {f"i{k}" for k in range(12)}
    rows = spark.createDataFrame([(b, i) for b, items in baskets.items() for i in items], "basket long, item string")
    for least in (1, 3):
        got = {tuple(r) for r in C.pair_counts(rows, least, chunk=chunk).select("item_a", "item_b", "n_a", "n_b", "n_ab").collect()}
        assert got == brute(baskets, least)


def test_mentions_are_read_spelling_aside_and_once(spark):
    schema = "id string, mentions array<struct<span_start:int,span_end:int,surface:string,cluster:string>>, id2 string"
    m = lambda *xs: [(0, 1, x, "c") for x in xs]
    rows = [("a", m("New  York", "paris ", None, ""), "x"), ("a", m("New  York", "paris ", None, ""), "x"), ("b", m("new york", "PARIS", "Paris"), "x"), ("c", None, "x"), ("d", [], None), (None, m("new york", "paris"), "x")]
    got = C.pair_counts(C.mention_items(spark.createDataFrame(rows, schema))).collect()
    assert [tuple(r) for r in got] == [("new york", "paris", 2, 2, 2)]


def test_empty_and_scores(spark):
    empty = spark.createDataFrame([], "basket long, item string")
    assert C.pair_counts(empty).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "c")], "basket long, item string")
    got = C.association(C.pair_counts(rows), F.lit(4)).first()
    assert (got["n_ab"], got["expected"], got["lift"], got["pmi"]) == (1, 1.0, 1.0, 0.0)
    assert math.isclose(got["jaccard"], 1 / 3) and abs(got["g2"]) < 1e-9
