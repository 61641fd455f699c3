"""Frequency of every distinct value: external range sort and run-length scan.

(field, term, record, place) rows are sorted over the cluster by all four columns, so the rows of one hot
term are spread over as many partitions as they need. Spark's sorter spills to disk. A scan of each sorted
partition marks where a new record starts; a row's (term, record) run never crosses a partition, as the
partitions are cut by the same columns up to the record. The partial counts of a term that spans several
partitions are then added: one short row a term and partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.llm.common import n_records, plain

KEYS = ["field", "term", "record"]


def occurrences(df: DataFrame, field: str, record: str, values: Column) -> DataFrame:
    """(field, term, record, place) of each element of an array column, spelling aside; nulls and empties left out."""
    return (
        df.select(F.lit(field).alias("field"), F.col(record).cast("string").alias("record"), F.posexplode(values).alias("place", "value"))
        .select("field", plain(F.col("value")).alias("term"), "record", "place")
        .filter("term is not null and record is not null")
    )


def term_counts(rows: DataFrame) -> DataFrame:
    """(field, term, occurrences, records): equal rows count once.

    ``rows``: (field, term, record, place). An empty input gives no rows.
    """
    ordered = rows.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS, "place")
    run = Window.partitionBy(*KEYS).orderBy("place")
    before = F.lag("place").over(run)
    scanned = ordered.select("field", "term", before.isNull().cast("int").alias("new_record"), (before.isNull() | (before != F.col("place"))).cast("int").alias("new_place"))
    return scanned.groupBy("field", "term").agg(F.sum("new_place").alias("occurrences"), F.sum("new_record").alias("records"))


def marked(counts: DataFrame, totals: dict[str, Column], rare_below: int = 3, common_percent: int = 5) -> DataFrame:
    """Adds ``mark``: 'rare' below ``rare_below`` records, else 'common' above ``common_percent`` % of the field's records, else 'usual'."""
    total = reduce(lambda acc, kv: F.when(F.col("field") == kv[0], kv[1]).otherwise(acc), totals.items(), F.lit(None).cast("long"))
    return counts.withColumn(
        "mark",
        F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > total * common_percent, "common").otherwise("usual"),
    )


def corpus_terms(inspec: DataFrame, clusters: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts and marks of keyphrases, mention surfaces and document terms."""
    rows = (
        occurrences(inspec, "keyphrases", "id", F.col("keyphrases"))
        .unionByName(occurrences(clusters, "surface", "id", F.col("mentions.surface")))
        .unionByName(occurrences(documents, "term", "doc_id", F.array("term")))
    )
    totals = {"keyphrases": n_records(inspec, "id"), "surface": n_records(clusters, "id"), "term": n_records(documents, "doc_id")}
    return marked(term_counts(rows), totals)
