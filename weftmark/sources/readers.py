"""Datasets as document frames with their ground truth, read by schema; line order becomes ``doc_pos``."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark import schemas


@dataclass
class Dataset:
    """``documents``: DOCUMENTS; ``truth``: frames by name."""

    documents: DataFrame
    truth: dict[str, DataFrame] = field(default_factory=dict)


# The built-in three documents and their labels.
TOY = (
    ("doc-1", "The vector store indexes embeddings.\n\nThe vector store returns neighbors."),
    ("doc-2", "Embeddings come from the encoder model."),
    ("doc-3", "The vector store holds embeddings from the encoder."),
)
TOY_LABELS = ("vector", "store", "embeddings", "encoder")


def toy(spark: SparkSession) -> Dataset:
    """Three documents in order and four gold labels."""
    rows = [(i, d, "note", t, float(i), {}) for i, (d, t) in enumerate(TOY, 1)]
    return Dataset(spark.createDataFrame(rows, schemas.DOCUMENTS), {"concept_labels": spark.createDataFrame([(x,) for x in TOY_LABELS], "label string")})


def _file(root: str, name: str) -> str:
    path = Path(root) / name
    if "://" not in str(root) and not path.exists():
        raise FileNotFoundError(f"{path} is missing; convert the corpus with weftmark.sources.converters first")
    return f"{str(root).rstrip('/')}/{name}"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file with ``line``, their number from 0.

    Spark keeps the order of lines within a file: row numbers follow the split's place in the file and the row's
    place in the split.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    kept = rows.filter(F.trim("value") != "")
    from weftmark.plans.stats import numbered

    # the order key: place of the split, then place within it
    keyed = kept.withColumn("order", F.struct("at", "row"))
    return numbered(keyed, "order").select(F.col("position").alias("line"), F.from_json("value", schema).alias("r")).select("line", "r.*")


def inspec(spark: SparkSession, root: str = "data/inspec", split: str = "test", limit: int | None = None) -> Dataset:
    """Keyphrase abstracts: documents and truth cut to the first ``limit`` lines."""
    rows = json_lines(spark, _file(root, f"{split}.jsonl"), schemas.KEYPHRASE_RECORD)
    rows = rows if limit is None else rows.filter(F.col("line") < limit)
    docs = rows.select(F.col("line").alias("doc_pos"), F.col("id").alias("doc_id"), F.lit("abstract").alias("kind"), "text", F.col("line").cast("double").alias("timestamp"), F.create_map().cast("map<string,string>").alias("metadata"))
    return Dataset(docs, {"keyphrases_by_document": rows.select(F.col("id").alias("doc_id"), "keyphrases")})


def mention_clusters(spark: SparkSession, root: str, split: str = "test", limit: int | None = None) -> Dataset:
    """Documents with gold mentions: truth clusters_by_mention (doc_id, span_start, span_end, surface, cluster)."""
    rows = json_lines(spark, _file(root, f"{split}.jsonl"), schemas.CLUSTER_RECORD)
    rows = rows if limit is None else rows.filter(F.col("line") < limit)
    docs = rows.select(F.col("line").alias("doc_pos"), F.col("id").alias("doc_id"), "kind", "text", F.col("line").cast("double").alias("timestamp"), F.create_map().cast("map<string,string>").alias("metadata"))
    marks = rows.select(F.col("id").alias("doc_id"), F.explode("mentions").alias("m")).select("doc_id", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"), "m.surface", "m.cluster")
    gold = rows.select(F.col("id").alias("doc_id"), "text", F.transform("mentions", lambda m: F.struct(m["start"].alias("span_start"), m["end"].alias("span_end"), m["surface"].alias("surface"), m["cluster"].alias("cluster"))).alias("mentions"))
    return Dataset(docs, {"clusters_by_mention": marks, "gold": gold})


def taxonomy(spark: SparkSession, root: str, gold: str, limit: int | None = None) -> Dataset:
    """Glossary and articles; truth is_a_edges (hypo, hyper) and terms (term). ``limit`` counts articles only."""
    base = f"{root}/{gold}"
    rows = json_lines(spark, _file(base, "documents.jsonl"), schemas.TAXONOMY_RECORD)
    rows = rows if limit is None else rows.filter(F.col("line") <= limit)
    meta = F.when(F.col("term").isNotNull(), F.create_map(F.lit("term"), F.col("term"))).otherwise(F.create_map().cast("map<string,string>"))
    docs = rows.select(F.col("line").alias("doc_pos"), F.col("id").alias("doc_id"), "kind", "text", F.col("line").cast("double").alias("timestamp"), meta.alias("metadata"))
    edges = spark.read.text(_file(base, "gold_edges.jsonl")).select(F.from_json("value", "array<string>").alias("e")).filter("size(e) = 2").select(F.col("e")[0].alias("hypo"), F.col("e")[1].alias("hyper"))
    terms = spark.read.text(_file(base, "terms.txt")).select(F.trim("value").alias("term")).filter("term <> ''")
    return Dataset(docs, {"is_a_edges": edges, "terms": terms})


def parquet(spark: SparkSession, path: str, key: str = "doc_id", doc_id: str = "id", text: str = "text", kind: str = "kind") -> Dataset:
    """Documents of a parquet table; the numeric key is the order."""
    rows = spark.read.parquet(path)
    docs = rows.select(F.col(key).cast("long").alias("doc_pos"), F.col(doc_id).alias("doc_id"), F.col(kind).alias("kind"), F.col(text).alias("text"), F.col(key).cast("double").alias("timestamp"), F.create_map().cast("map<string,string>").alias("metadata"))
    return Dataset(docs)


DATASETS = {"toy": toy, "inspec": inspec, "mention-clusters": mention_clusters, "taxonomy": taxonomy}
