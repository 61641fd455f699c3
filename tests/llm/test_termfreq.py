from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftmark.llm import termfreq as T


def test_counts_equal_brute_force_and_hot_term(spark):
    rows = [("f", f"t{i % 7 if i % 3 else 0}", str(i % 50), i % 4) for i in range(900)]
    got = {(r["term"], r["occurrences"], r["records"]) for r in T.term_counts(spark.createDataFrame(rows, "field string, term string, record string, place int").repartition(5)).collect()}
    places, records = defaultdict(set), defaultdict(set)
    for _, t, r, p in rows:
        places[t].add((r, p))
        records[t].add(r)
    assert got == {(t, len(places[t]), len(records[t])) for t in places}


def test_nulls_spelling_repeats_and_marks(spark):
    df = spark.createDataFrame([("a", ["X  y", " x y", None, ""], "e"), ("a", ["X  y", " x y", None, ""], "e"), ("b", None, "e"), (None, ["z"], "e"), ("c", ["x Y"], None)], "id string, v array<string>, term string")
    counts = T.term_counts(T.occurrences(df, "v", "id", F.col("v")))
    assert [tuple(r) for r in counts.collect()] == [("v", "x y", 3, 2)]
    marked = T.marked(counts, {"v": F.lit(10)})
    assert marked.first()["mark"] == "rare"
    many = spark.createDataFrame([("v", "t", 9, 3), ("v", "u", 9, 4)], "field string, term string, occurrences long, records long")
    assert Counter(r["mark"] for r in T.marked(many, {"v": F.lit(60)}).collect()) == Counter({"usual": 1, "common": 1})


def test_empty(spark):
    assert T.term_counts(spark.createDataFrame([], "field string, term string, record string, place int")).count() == 0
