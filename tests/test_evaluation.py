import hashlib
import random

import pytest

from weftmark.operators import metrics
from weftmark.plans import stats


def test_clustering_textbook(spark):
    rows = [("1", "p1", "a"), ("2", "p1", "a"), ("3", "p1", "b"), ("4", "p2", "b"), ("5", "p2", "b")]
    row = metrics.clustering(spark.createDataFrame(rows, "mention string, predicted string, gold string")).first()
    assert row["b3_precision"] == pytest.approx(11 / 15) and row["b3_recall"] == pytest.approx(11 / 15) and row["ari"] == pytest.approx(1 / 6)
    one = metrics.clustering(spark.createDataFrame([(str(i), "p", g) for i, g in enumerate("abb")], "mention string, predicted string, gold string")).first()
    assert (one["b3_precision"], one["b3_recall"], one["ari"]) == (pytest.approx(5 / 9), 1.0, pytest.approx(0.0))
    assert metrics.clustering(spark.createDataFrame([], "mention string, predicted string, gold string")).first()["ari"] == 1.0


def test_label_and_edge_f1(spark):
    c = spark.createDataFrame([("1", "Oil"), ("2", "fat"), ("3", "x")], "id string, label string")
    row = metrics.label_f1(c, spark.createDataFrame([("oil",), ("FAT",), ("fat",)], "label string")).first()
    assert (row["precision"], row["recall"]) == (pytest.approx(2 / 3), 1.0)
    r = spark.createDataFrame([("IS_A", "1", "2"), ("IS_A", "2", "1"), ("CO_OCCURS", "1", "3")], "type string, source_id string, target_id string")
    e = metrics.edge_f1(c, r, spark.createDataFrame([("oil", "fat"), ("a", "b")], "hypo string, hyper string")).first()
    assert (e["precision"], e["recall"], e["predicted_edges"], e["gold_edges"]) == (0.5, 0.5, 2, 2)
    none = metrics.edge_f1(c, r.limit(0), spark.createDataFrame([], "hypo string, hyper string")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_redundancy_labels_and_vectors(spark):
    names = {"The Beatles": "beatle", "glass": "glass", "gas": "gas", "glas": "gla", "a cat": "cat"}
    df = spark.createDataFrame([(n,) for n in names], "label string")
    assert [r[0] for r in df.select(metrics.normal_label(df["label"])).collect()] == list(names.values())
    rows = [("1", "cat", [1.0, 0.0]), ("2", "the cats", [0.0, 1.0]), ("3", "dog", [1.0, 0.01]), ("4", "fish", None), ("5", "bird", [0.0, 0.0])]
    out = metrics.redundancy(spark.createDataFrame(rows, "id string, label string, embedding array<double>"), 0.9, 2).first()
    assert (out["duplicate_rate"], out["near_duplicate_pairs"], out["concept_count"]) == (0.6, 2, 5)


@pytest.mark.parametrize(
    "edges, want",
    [
        ([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "d")], (0, 0, 0, 2, 1, 5)),
        ([("a", "b"), ("b", "a"), ("b", "c")], (1, 2, 0, 0, 0, 3)),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), ("x", "y"), ("y", "z")], (1, 3, 1, 2, 0, 6)),
        ([], (0, 0, 0, 0, 0, 0)),
    ],
)
def test_hierarchy_sanity(spark, edges, want):
    df = spark.createDataFrame([("IS_A", a, b) for a, b in edges] + [("CO_OCCURS", "q", "r")], "type string, source_id string, target_id string")
    assert tuple(metrics.hierarchy_sanity(df).first()) == want


def test_f1_at_k(spark):
    selected = spark.createDataFrame([("d", "rings", 0.9), ("d", "ring", 0.8), ("d", "valve", 0.7), ("e", "oil", 1.0)], "doc_id string, surface string, salience double")
    gold = spark.createDataFrame([("d", ["Ring", "relay"]), ("e", None)], "doc_id string, keyphrases array<string>")
    rows = {r["doc_id"]: r for r in metrics.f1_at_k_documents(selected, gold, (1, 2, 3)).collect()}
    assert (rows["d"]["precision_at_2"], rows["d"]["recall_at_2"], rows["d"]["precision_at_3"]) == (1.0, 0.5, 0.5)
    assert rows["e"]["precision_at_1"] == 0.0
    with pytest.raises(Exception, match="no gold"):
        metrics.f1_at_k(selected, gold.filter("doc_id = 'd'")).collect()


def test_coherence(spark):
    rows = [("1", "beatles"), ("1", "The Beatles"), ("2", "ring"), ("3", "x"), ("3", "x")]
    out = metrics.coherence(spark.createDataFrame(rows, "concept_id string, surface string")).first()
    assert round(out["coherence"], 4) == 0.8386 and out["multi_surface_concepts"] == 1 and out["singleton_fraction"] == pytest.approx(1 / 3)
    assert metrics.coherence(spark.createDataFrame(rows[2:], "concept_id string, surface string")).first()["coherence"] == 1.0


def test_intervals():
    span = stats.percentile_interval(50, [float(i) for i in range(100)])
    assert (span.lo, span.hi) == (pytest.approx(2.475), pytest.approx(96.525))
    assert stats.bca_interval(1.0, [1.0] * 5, [1.0, 1.0]).method == "degenerate"
    assert stats.bca_interval(0.0, [1.0, 2.0], [1.0, 2.0]).method == "percentile-fallback"
    rnd = random.Random(0)
    values = [rnd.gauss(0, 1) for _ in range(60)]
    mean = sum(values) / 60
    boot = [sum(rnd.choice(values) for _ in range(60)) / 60 for _ in range(500)]
    left = [(sum(values) - v) / 59 for v in values]
    out = stats.bca_interval(mean, boot, left)
    assert out.method == "bca" and out.lo < mean < out.hi
    d = stats.paired_delta([1.0, 2.0, 3.0], [0.0, 3.0, 1.0], 2.0, 1.0)
    assert d.estimate == 1.0 and d.prob_positive == pytest.approx(2 / 3)


def test_draws(spark):
    assert stats.seeded_draws(5, 2, 0, 2)[0][:2] == [0, 1] and len(stats.seeded_draws(5, 2, 0)[0]) == 5
    assert stats.seeded_draws(5, 3, 7) == stats.seeded_draws(5, 3, 7)
    order = stats.seeded_orders(6, 1, 3, 1)[0]
    assert order[0] == 0 and sorted(order) == list(range(6))
    rows = stats.draws(6, 4, 1, spark, fixed=2).collect()
    assert len(rows) == 24 and all(r["position"] == r["slot"] for r in rows if r["slot"] < 2) and all(2 <= r["position"] < 6 for r in rows if r["slot"] >= 2)
    assert stats.draws(0, 4, 1, spark).count() == 0


def test_draws_have_their_size_and_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    many = stats.draws(100_000, 100, 0, spark).select("sample", "position")
    assert int(many._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= 10_000_000 * 8
    rows = stats.draws(7, 3, 5, spark).collect()
    want = {(s, k, int(hashlib.md5(f"5-{s}-{k}".encode()).hexdigest()[:12], 16) % 7) for s in range(3) for k in range(7)}
    assert {(r["sample"], r["slot"], r["position"]) for r in rows} == want
    records = spark.createDataFrame([(i, i + 1) for i in range(50)], "key long, x long")
    boot = stats.bootstrap(records, "key", [F.sum("x").alias("x")], 4, 0)
    joins = [x for x in boot._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin" in x and "position" in x]
    assert joins and all("ShuffledHashJoin" in x for x in joins)
    assert {r["sample"]: r["x"] for r in boot.collect()} == {s: sum(int(hashlib.md5(f"0-{s}-{k}".encode()).hexdigest()[:12], 16) % 50 + 1 for k in range(50)) for s in range(4)}


def test_bootstrap_jackknife_numbered(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f"k{i:02}", float(i)) for i in range(30)], "key string, x double").repartition(5)
    numbered = stats.numbered(df, "key").collect()
    assert sorted((r["key"], r["position"]) for r in numbered) == [(f"k{i:02}", i) for i in range(30)]
    boot = stats.bootstrap(df, "key", [F.avg("x").alias("m"), F.count("*").alias("n")], 20, 5).collect()
    assert len(boot) == 20 and all(r["n"] == 30 for r in boot) and len({r["m"] for r in boot}) > 5
    left = stats.jackknife_sums(df, "key", ["x"]).collect()
    assert {(r["key"], r["x"], r["kept"]) for r in left} == {(f"k{i:02}", 435.0 - i, 29) for i in range(30)}
    spread = stats.spread(df, "x").first()
    assert (spread["min"], spread["max"], spread["range"]) == (0.0, 29.0, 29.0)


def test_order_runs_depend_on_the_order(spark, tmp_path):
    from weftmark.queries import evaluation

    # a chain of labels, each near the next alone: which are one concept depends on which comes first
    names = [f"{'x' * (i // 4)}inter{'n' * (i % 4)}ational committee of clustering research {'ab' * i}" for i in range(24)]
    rows = [(f"d{i:02}", [(0, len(x), x, f"g{i // 3}")]) for i, x in enumerate(names)]
    spark.createDataFrame(rows, "id string, mentions array<struct<span_start: int, span_end: int, surface: string, cluster: string>>").write.parquet(f"{tmp_path}/mini_clusters_ecb.parquet")
    got = {r["metric"]: r for r in evaluation.QUERIES["stats_order_runs"](spark, str(tmp_path)).collect()}
    assert set(got) == {"b3_precision", "b3_recall", "b3_f1", "ari"}
    assert got["b3_f1"]["range"] > 0 and all(r["min"] <= r["max"] for r in got.values())
