import random
import re

import numpy as np

from weftmark.llm import overlap as O


def brute(rows):
    sets = {}
    for i, split, text in rows:
        if i is None or split is None or text is None:
            continue
        words = frozenset(re.findall("[a-z0-9]+", text.lower()))
        if len(words) >= 8:
            sets[i] = (split.strip().lower(), words)
    return {
        (min(a, b), max(a, b)) for a, (sa, wa) in sets.items() for b, (sb, wb) in sets.items() if sa == "train" and sb != "train" and 5 * len(wa & wb) >= 4 * len(wa | wb)
    }


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, base = [], [rnd.sample(vocabulary, rnd.randint(7, 40)) for _ in range(30)]
    for i in range(260):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((f"r{i:04}", rnd.choice(["train", "TRAIN ", "test", "dev", "Test"]), " ".join(words).title()))
    rows += [rows[0], ("n1", None, rows[0][2]), ("n2", "test", None), ("n3", "test", ""), (None, "test", rows[0][2]), ("n4", "train", "the same stock text")]
    df = spark.createDataFrame([(*r, None) for r in rows], "id string, split string, text string, source string")
    for chunk in (3, 50, O.CHUNK):  # the smaller ones split every block
        members, links = _with(O, df, chunk)
        got = {(r["id_a"], r["id_b"]) for r in O.overlap_pairs(members, links).collect()}
        assert got == brute(rows), chunk
    counted = O.overlap_counts(members, links).collect()
    hit = {b if (rows_of[b] != "train") else a for a, b in brute(rows)} if (rows_of := {r[0]: (r[1] or "").strip().lower() for r in rows}) else set()
    assert sum(r["overlapping"] for r in counted) == len(hit)


def _with(module, df, chunk):
    old = module.similar_sets.__defaults__
    module.similar_sets.__defaults__ = (*old[:2], chunk)
    try:
        return module.split_overlaps({"c": df})
    finally:
        module.similar_sets.__defaults__ = old


def test_empty(spark):
    df = spark.createDataFrame([], "id string, split string, text string, source string")
    members, links = O.split_overlaps({"c": df})
    assert O.overlap_pairs(members, links).count() == 0 and O.overlap_counts(members, links).count() == 0


def test_long_records_have_blocks_in_proportion(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = [("a", "train", words), ("b", "test", words[:4500] + [f"x{i}" for i in range(499)]), ("c", "test", words[:4400] + [f"y{i}" for i in range(600)]), ("d", "test", rnd.sample(words, 4000))]
    df = spark.createDataFrame([(i, s, " ".join(w), None) for i, s, w in rows], "id string, split string, text string, source string")
    members, links = O.split_overlaps({"c": df})
    assert {(r["id_a"], r["id_b"]) for r in O.overlap_pairs(members, links).collect()} == brute([(i, s, " ".join(w)) for i, s, w in rows])
    starts = np.array([0, 5000])
    hashes = np.array([O._hash(w) for w in words], dtype=np.uint64)
    owner, blocks = O.code_blocks(starts, hashes, hashes, np.zeros(1, dtype=np.uint64), O.NUM, O.DEN)
    assert len(owner) == len(blocks) < 2 * 5000


def test_similar_sets_of_any_size_share_a_block():
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    for _ in range(300):
        n = rnd.choice([8, 9, 12, 20, 37, 80, 200, 700])
        a = rnd.sample(vocabulary, n)
        gone, new = rnd.randint(0, n // 5), 0
        while (n - gone) * 5 >= (n + new + 1) * 4:
            new += 1
        b = a[gone:] + [f"x{i}" for i in range(new)]
        words = a + b
        hashes = np.array([O._hash(w) for w in words], dtype=np.uint64)
        owner, blocks = O.code_blocks(np.array([0, len(a), len(words)]), hashes, hashes, np.zeros(2, dtype=np.uint64), O.NUM, O.DEN)
        assert set(blocks[owner == 0]) & set(blocks[owner == 1])


def test_small_vocabulary(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(f"r{i:04}", rnd.choice(["train", "test"]), " ".join(rnd.sample(vocabulary, rnd.randint(8, 30)))) for i in range(600)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "id string, split string, text string, source string")
    members, links = _with(O, df, 16)
    assert {(r["id_a"], r["id_b"]) for r in O.overlap_pairs(members, links).collect()} == brute(rows)
