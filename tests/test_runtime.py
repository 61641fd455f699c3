from pyspark.sql import functions as F

from weftmark import runtime


def test_skew_join_equals_a_plain_join(spark):
    big = spark.range(3000).selectExpr("id as row", "if(id % 3 = 0, 'hot', concat('k', id % 50)) as key")
    counts = big.groupBy("key").agg(F.count("*").alias("n")).withColumn("mark", F.upper("key"))
    small = counts.filter("key <> 'k7'")
    for parts in (2, 40, 2000):
        got = runtime.skew_join(big, small, "key", "n", parts)
        assert got.columns == ["key", "row", "n", "mark"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "key").select("key", "row", "n", "mark").collect()))
    assert runtime.skew_join(big, small.limit(0), "key", "n").count() == 0
    assert runtime.skew_join(big.limit(0), small, "key", "n").count() == 0


def test_materialize_and_release(spark):
    table = runtime.materialize(spark.range(10).withColumn("x", F.rand()))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, table.collect()))
    assert runtime.shared_dir(spark) in table.inputFiles()[0].replace("file:///", "file:///") or table.inputFiles()
    runtime.release(table)


def test_ship_makes_the_package_importable(spark, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", "")
    runtime.ship(spark)
    runtime.ship(spark)

    def probe(batches):
        import weftmark

        for batch in batches:
            yield batch.assign(id=len(weftmark.__version__))

    assert spark.range(1).mapInPandas(probe, "id long").first()[0] > 0
