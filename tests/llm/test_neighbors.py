import numpy as np

from weftmark.llm import neighbors as N


def _frame(spark, x, extra=()):
    return spark.createDataFrame([(f"c{i:05}", v, "l") for i, v in enumerate(x.tolist())] + list(extra), "id string, embedding array<double>, label string")


def test_recall_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(150, 64))
    x = np.vstack([centres[rng.integers(0, 150, 900)] + 0.15 * rng.normal(size=(900, 64)), np.tile(rng.normal(size=64), (40, 1))])
    x *= rng.uniform(0.01, 50, size=(len(x), 1))
    x[900:] = x[900]
    extra = [("z0", None, "l"), ("z1", [], "l"), ("z2", [0.0] * 64, "l"), ("z3", [1.0] * 48, "l"), ("z4", [float("nan")] * 64, "l"), ("z5", [None] * 64, "l"), ("c00000", x[0].tolist(), "l")]
    got = N.neighbors(_frame(spark, x, extra), nprobe=8).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r["neighbor_id"], r["cosine"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    hits = total = 0
    for i in range(900):
        want = {f"c{j:05}" for j in np.argsort(-s[i], kind="stable")[:10]}
        mine = {n for _, n, _ in by[f"c{i:05}"]}
        assert len(mine) == 10 and f"c{i:05}" not in mine
        hits, total = hits + len(want & mine), total + 10
    assert hits / total >= 0.9
    for i in range(900, 940):  # copies rank each other by id
        ids = [n for _, n, _ in sorted(by[f"c{i:05}"])]
        assert ids == [f"c{j:05}" for j in range(900, 940) if j != i][:10]
    assert len(by) == 940


def test_least_cosine_and_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    x = np.vstack([base, base + 0.1 * rng.normal(size=base.shape), base + 0.6 * rng.normal(size=base.shape)])
    got = {tuple(r) for r in N.similar_pairs(_frame(spark, x)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(f"c{i:05}", f"c{j:05}") for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.9}
    assert got == want and len(want) >= 60


def test_few_rows_and_none(spark):
    empty = _frame(spark, np.zeros((0, 64)))
    assert N.neighbors(empty).count() == 0 and N.similar_pairs(empty).count() == 0
    one = _frame(spark, np.ones((1, 64)))
    assert N.neighbors(one).count() == 0
    two = _frame(spark, np.ones((2, 64)))
    assert [(r["id"], r["neighbor_id"], r["cosine"]) for r in N.neighbors(two).orderBy("id").collect()] == [("c00000", "c00001", 1.0), ("c00001", "c00000", 1.0)]


def test_chunks_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(N, "CANDIDATES", 50)
    monkeypatch.setattr(N, "QUERIES", 70)
    rng = np.random.default_rng(2)
    x = rng.normal(size=64) + 0.3 * rng.normal(size=(400, 64))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "row long, vector array<double>")
    got = {(r["row"], r["other"]) for r in N.nearest(rows, 64, 5, lists=1).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) / len(want) > 0.97 and len(got) == len(want)
