import random

from weftmark.llm import mixing as M


def best(counts, budget):
    reach = 1
    for length, n in counts.items():
        for _ in range(n):
            reach |= reach << length
    return max(i for i in range(min(budget, sum(a * n for a, n in counts.items())) + 1) if reach >> i & 1)


def test_budget_is_met_as_well_as_can_be():
    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randint(1, 50): rnd.randint(1, 6) for _ in range(rnd.randint(1, 8))}
        budget = rnd.randint(0, 400)
        taken = M.fit_budget(counts, budget)
        assert all(0 <= taken.get(k, 0) <= n for k, n in counts.items())
        assert sum(k * n for k, n in taken.items()) == best(counts, budget)


def test_large_budgets_keep_proportions():
    counts = dict.fromkeys(range(1, 500), 20)
    budget = 1_000_000
    taken = M.fit_budget(counts, budget, slack=5000)
    assert sum(k * n for k, n in taken.items()) == budget
    assert abs(taken[400] - 20 * budget / sum(k * 20 for k in counts)) <= 2


def test_plan():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "none": (0.2, 4)}
    plan = M.plan({"a": 1000, "b": 200}, targets)
    assert plan == {"a": (0, 666), "b": (2, 0)}
    assert M.plan({}, targets) == {}
    assert M.plan({"a": 1000, "b": 200}, targets, 10_000)["b"] == (2, 0)


def test_selection_and_shares(spark):
    docs = [(i, ("big", "small", None, "other")[i % 4], "word " * (i % 9 + (i % 7 == 0) * 50)) for i in range(400)] + [(1000, "big", None), (1001, "big", "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, text string, weight string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, weight double, max_repeats int")
    selection, shares = M.mix(df, targets)
    rows = selection.collect()
    assert {r["source"] for r in rows} == {"big", "small"}
    assert all(1 <= r["copies"] <= {"big": 1, "small": 3}[r["source"]] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    by = {r["source"]: r for r in shares.collect()}
    assert by["absent"]["tokens"] == 0 and abs(by["big"]["share"] - 7 / 9) < 0.01 and abs(by["small"]["share"] - 2 / 9) < 0.01
    again = M.mix(df, targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert M.mix(df, targets, seed=7)[1].count() == 3
    long_windows = M.mix(df, targets, window=8)[1].collect()
    assert abs({r["source"]: r["share"] for r in long_windows}["big"] - 7 / 9) < 0.15


def test_a_budget_of_long_lengths_only():
    counts = dict.fromkeys(range(9000, 30000, 7), 1)
    budget = sum(counts) // 2
    taken = M.fit_budget(counts, budget)
    assert sum(k * n for k, n in taken.items()) == budget and all(n <= 1 for n in taken.values())
    assert abs(sum(k * n for k, n in taken.items() if k > 20000) / budget - sum(k for k in counts if k > 20000) / sum(counts)) < 0.01
    huge = {3_000_000 + 1000 * i: 1 for i in range(40)}
    assert abs(sum(k * n for k, n in M.fit_budget(huge, 60_500_000).items()) - 60_500_000) < 1_000_000


def test_a_source_of_long_documents_reaches_its_share(spark):
    docs = [(i, "books", "word " * (9000 + 37 * i)) for i in range(40)] + [(100 + i, "notes", "word " * (50 + i % 50)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("books", 0.5, 1), ("notes", 0.5, 1)], "source string, weight double, max_repeats int")
    selection, shares = M.mix(df, targets)
    assert min(r["n_tokens"] for r in selection.filter("source = 'books'").collect()) > M.WINDOW
    assert all(abs(r["share"] - 0.5) < 0.02 for r in shares.collect())


def test_repeats_come_as_near_as_can_be():
    rnd = random.Random(6)
    for _ in range(300):
        counts = {rnd.randint(1, 50): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        total, most = sum(k * n for k, n in counts.items()), rnd.randint(1, 6)
        goal = rnd.randint(0, total * most)
        whole, rest = divmod(goal, total)
        more = M.fit_repeats(counts, whole, rest, most)
        assert all(0 <= whole * n + more.get(k, 0) <= most * n for k, n in counts.items())
        assert goal - rest + sum(k * n for k, n in more.items()) == best({k: n * most for k, n in counts.items()}, goal)
        even = M.fit_budget(counts, rest)
        assert sum(k * n for k, n in even.items()) < rest or {k: n for k, n in even.items() if n} == {k: n for k, n in more.items() if n}


def test_a_source_of_few_documents_reaches_its_share_by_repeats(spark):
    docs = [(i, "many", " word" * 30) for i in range(30)] + [(100, "few", " word" * 100), (101, "few", " word" * 900)]
    docs += [(200, "uneven", " word" * 100), (201, "uneven", " word" * 160)]  # 300 of 260 a pass: one document three times
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("many", 0.6, 1), ("few", 0.2, 3), ("uneven", 0.2, 3)], "source string, weight double, max_repeats int")
    selection, shares = M.mix(df, targets)
    assert {r["source"]: (r["tokens"], r["target_tokens"]) for r in shares.collect()} == {"many": (900, 900), "few": (300, 300), "uneven": (300, 300)}
    assert {r["doc_id"]: r["copies"] for r in selection.filter("source <> 'many'").collect()} == {100: 3, 200: 3}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, weight double, max_repeats int")
    selection, shares = M.mix(df, targets)
    assert selection.count() == 0 and shares.first()["tokens"] == 0
