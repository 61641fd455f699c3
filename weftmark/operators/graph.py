"""The accreted graph: tables of concepts and relations, deltas, and their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concepts(resolutions: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(id, label, first_seen, updated_at): documents that made a concept and that last resolved to it.

    ``prior``: concepts from before, of the same columns; their first_seen stays.
    """
    order = F.struct("doc_pos", "unit_order", "ord")
    seen = resolutions.groupBy(F.col("concept_id").alias("id")).agg(
        F.first("concept_label").alias("label"), F.min_by("doc_id", order).alias("first_seen"), F.max_by("doc_id", order).alias("updated_at")
    )
    if prior is None:
        return seen
    old = prior.select("id", F.col("label").alias("l"), F.col("first_seen").alias("f"), F.col("updated_at").alias("u"))
    return seen.join(old, "id", "full").select("id", F.coalesce("l", "label").alias("label"), F.coalesce("f", "first_seen").alias("first_seen"), F.coalesce("updated_at", "u").alias("updated_at"))


def relations(induced: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(type, source_id, target_id, confidence, provenance), unique by the first three; the last document wins."""
    new = induced.groupBy("type", "source_id", "target_id").agg(F.max_by("confidence", "doc_pos").alias("confidence"), F.max_by("doc_id", "doc_pos").alias("provenance"))
    if prior is None:
        return new
    kept = prior.select(*new.columns).join(new.select("type", "source_id", "target_id"), ["type", "source_id", "target_id"], "left_anti")
    return kept.unionByName(new)


def deltas(documents: DataFrame, resolutions: DataFrame, induced: DataFrame) -> DataFrame:
    """(doc_pos, doc_id, concepts_added, concepts_updated, relations_added): counts of each document's change.

    A concept made and mentioned again in one document counts as added only; relations count with repeats.
    """
    each = resolutions.groupBy("doc_pos", "concept_id").agg(F.bool_or("is_new").alias("new"))
    by_doc = each.groupBy("doc_pos").agg(F.count_if("new").alias("concepts_added"), F.count_if(~F.col("new")).alias("concepts_updated"))
    edges = induced.groupBy("doc_pos").agg(F.count("*").alias("relations_added"))
    out = documents.select("doc_pos", "doc_id").join(by_doc, "doc_pos", "left").join(edges, "doc_pos", "left")
    return out.select("doc_pos", "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("concepts_added", "concepts_updated", "relations_added")])


class GraphView:
    """Queries on a snapshot."""

    def __init__(self, concepts: DataFrame, relations: DataFrame):
        self._concepts, self._relations = concepts, relations

    def concepts(self) -> DataFrame:
        return self._concepts

    def find_concept(self, label: str) -> DataFrame:
        """The concept of a label, letter case aside; of several, that of the largest id. No row if there is none."""
        hit = self._concepts.filter(F.lower("label") == F.lower(F.lit(label)))
        return hit.join(hit.agg(F.max("id").alias("id")), "id")

    def relations(self, kind: str | None = None) -> DataFrame:
        return self._relations if kind is None else self._relations.filter(F.col("type") == kind)

    def neighbors(self, ids: DataFrame, kind: str | None = None) -> DataFrame:
        """(id, other_id, other_label, type, source_id, target_id): relations of each id in both directions.

        ``ids``: one column. A relation of a concept with itself comes out once; others without a concept row are left out.
        """
        asked = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        edges = self.relations(kind)
        out = edges.withColumn("id", F.col("source_id")).withColumn("other_id", F.col("target_id"))
        back = edges.filter("source_id <> target_id").withColumn("id", F.col("target_id")).withColumn("other_id", F.col("source_id"))
        known = self._concepts.select(F.col("id").alias("other_id"), F.col("label").alias("other_label")).dropDuplicates(["other_id"])
        return out.unionByName(back).join(asked, "id").join(known, "other_id").select("id", "other_id", "other_label", "type", "source_id", "target_id")
