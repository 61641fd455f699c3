import itertools

import pytest

from weftmark.llm import lookalike as L

SAME = [
    ("common brass", "cоmmon brаss"), ("common brass", "ＣＯＭＭＯＮ　ＢＲＡＳＳ"), ("common", "com​mon﻿"), ("first", "ﬁrst"), ("café", "café"), ("café", "cаfе́"), ("a-b", "a‑b"), ("a b", "a b"),
    ("вес", "ВЕС"), ("вес", "Bес"), ("bec", "ВЕС"), ("valve", "νalve"), ("ημέρα", "ΗΜΈΡΑ"), ("soft", "so­ft"),
]
OTHER = [("cafe", "café"), ("résumé", "resume"), ("no", "vo"), ("nat", "vat"), ("NAT", "vat"), ("a b", "ab"), ("a-b", "a b"), ("x2", "x²"), ("résumé", "rèsumé"), ("вес", "бес"), ("hat", "нат")]
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ -"
LOOK = L.LookAlikes({ch: 1 for pair in SAME + OTHER for text in pair for ch in text} | dict.fromkeys(LATIN, 10))


@pytest.mark.parametrize("x, y", SAME)
def test_same_look_has_one_key(x, y):
    assert LOOK.same(x, y) and LOOK.same(y, x) and LOOK.key(x) == LOOK.key(y)


@pytest.mark.parametrize("x, y", OTHER)
def test_other_look(x, y):
    assert not LOOK.same(x, y)


def test_key_never_separates_what_looks_the_same():
    words = [w for pair in SAME + OTHER for w in pair]
    for x, y in itertools.combinations(words, 2):
        if LOOK.same(x, y):
            assert LOOK.key(x) == LOOK.key(y), (x, y)


def test_tables(spark):
    concepts = spark.createDataFrame([("c1", "common brass", [1.0]), ("c1", "common brass", [1.0]), ("c2", "résumé", None), ("c3", None, None), ("c4", "", None)], "id string, label string, embedding array<double>")
    rows = [(1, "Common Brass"), (2, "cоmmon brаss"), (2, "cоmmon brаss"), (3, "resume"), (4, None), (5, ""), (6, "résumé"), (7, "x" * 5000)]
    mentions = spark.createDataFrame([(*r, "k") for r in rows], "mention_id long, surface string, label string")
    assert {tuple(r) for r in L.disguised_mentions(mentions, concepts).collect()} == {(2, "c1"), (6, "c2")}
    forms = {(r["text"], r["form"]) for r in L.unified_forms(mentions, concepts).collect() if r["kind"] == "surface"}
    assert dict(forms)["cоmmon brаss"] == dict(forms)["Common Brass"] == "common brass"
    assert L.disguised_mentions(mentions.limit(0), concepts.limit(0)).count() == 0


def test_hot_surface(spark):
    concepts = spark.createDataFrame([("c1", "hot")], "id string, label string")
    mentions = spark.range(5000).selectExpr("id as mention_id", "if(id % 3 = 0, 'hоt', concat('w', id)) as surface")
    assert L.disguised_mentions(mentions, concepts).count() == 1667
