"""Resolutions to relations between concepts, a row a document and relation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.functions.text import words

OUT = ["doc_pos", "doc_id", "type", "source_id", "target_id", "confidence"]


def _relations(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("doc_pos", "doc_id", F.lit(kind).alias("type"), "source_id", "target_id", F.lit(1.0).alias("confidence"))


def co_occurrence(resolutions: DataFrame) -> DataFrame:
    """CO_OCCURS between each two concepts of a unit, the smaller id first, once a document."""
    units = resolutions.groupBy("doc_pos", "doc_id", "unit_order").agg(F.array_sort(F.collect_set("concept_id")).alias("ids"))
    pairs = units.select("doc_pos", "doc_id", F.posexplode("ids").alias("at", "source_id"), "ids").select("doc_pos", "doc_id", "source_id", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("target_id"))
    return _relations(pairs.distinct(), "CO_OCCURS")


def compound(resolutions: DataFrame, longest_only: bool = True) -> DataFrame:
    """IS_A from a concept to the concept of the same document whose label is the end of its label, by whole words.

    With ``longest_only`` only to the longest such label.
    """
    known = resolutions.groupBy("doc_pos", "doc_id", "concept_label").agg(F.min_by("concept_id", F.struct("unit_order", "span_start", "ord")).alias("concept_id"))
    parts = known.withColumn("w", words(F.col("concept_label"))).filter(F.size("w") > 1)
    ends = parts.select("doc_pos", "doc_id", F.col("concept_id").alias("source_id"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"), "w").withColumn(
        "end", F.array_join(F.expr("slice(w, i + 1, size(w))"), " ")
    )
    hits = ends.join(known.select("doc_pos", F.col("concept_label").alias("end"), F.col("concept_id").alias("target_id")), ["doc_pos", "end"])
    if longest_only:
        hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("doc_pos", "source_id").orderBy("i"))).filter("n = 1")
    return _relations(hits, "IS_A")


@dataclass(frozen=True)
class Pattern:
    """A connector that fills the text between two neighbouring anchors; ``up``: which of them is the broader
    concept; ``lists``: further anchors joined by list glue count too; ``lead``: what must stand before the left anchor."""

    connector: str
    up: str
    lists: bool = False
    lead: str | None = None


# The seven connectors, and the glue of lists.
PATTERNS = {
    "such-as": Pattern(r",?\s+such\s+as\s+", "left", True),
    "such-np-as": Pattern(r"\s+as\s+", "left", True, r"\bsuch\s+\z"),
    "including": Pattern(r",?\s+including\s+", "left", True),
    "especially": Pattern(r",?\s+especially\s+", "left", True),
    "and-other": Pattern(r",?\s+and\s+other\s+", "right"),
    "or-other": Pattern(r",?\s+or\s+other\s+", "right"),
    "copula": Pattern(r"\s+(?:is|are)\s+an?\s+(?:(?:kind|type)\s+of\s+)?", "right"),
}
GLUE = r",\s+|,?\s+(?:and|or)\s+"
FLAGS = "(?iuU)"


def hearst(resolutions: DataFrame, units: DataFrame, patterns: list[str] | None = None, copula: bool = True) -> DataFrame:
    """IS_A from lexico-syntactic patterns between neighbouring mentions of a unit.

    Neighbours that overlap have no connector. Lists are islands: runs of mentions joined by glue. Edges from a
    concept to itself are left out, an edge counts once a document. Unknown pattern names are an error.
    """
    names = [n for n in PATTERNS if copula or n != "copula"] if patterns is None else patterns
    unknown = sorted(set(names) - set(PATTERNS))
    if unknown:
        raise ValueError(f"unknown patterns: {unknown} (known: {sorted(PATTERNS)})")
    unit = Window.partitionBy("doc_pos", "unit_order").orderBy("span_start", "span_end", "ord")
    rows = resolutions.join(units.select("doc_pos", "unit_order", "text"), ["doc_pos", "unit_order"]).select("doc_pos", "doc_id", "unit_order", "ord", "span_start", "span_end", "concept_id", "text")
    at = (
        rows.withColumn("n", F.row_number().over(unit))
        .withColumn("last_end", F.lag("span_end").over(unit))
        .withColumn("next_start", F.lead("span_start").over(unit))
        .withColumn("next_id", F.lead("concept_id").over(unit))
    )
    joined = F.coalesce(
        (F.col("last_end") <= F.col("span_start")) & F.expr("substring(text, last_end + 1, span_start - last_end)").rlike(f"{FLAGS}^(?:{GLUE})\\z"), F.lit(False)
    )
    at = at.withColumn("island", F.sum((~joined).cast("int")).over(unit.rowsBetween(Window.unboundedPreceding, 0)))
    between = F.expr("substring(text, span_end + 1, next_start - span_end)")
    matched = []
    for name in names:
        p = PATTERNS[name]
        test = between.rlike(f"{FLAGS}^(?:{p.connector})\\z")
        if p.lead:
            test = test & F.expr("substring(text, 1, span_start)").rlike(FLAGS + p.lead)
        matched.append(F.when(test, F.struct(F.lit(p.up).alias("up"), F.lit(p.lists).alias("lists"))))
    hits = (
        at.filter(F.col("next_start") >= F.col("span_end"))
        .select("doc_pos", "doc_id", "unit_order", "n", "concept_id", "next_id", F.explode(F.array_compact(F.array(*matched))).alias("p"))
    )
    right = hits.filter("p.up = 'right'").select("doc_pos", "doc_id", F.col("concept_id").alias("source_id"), F.col("next_id").alias("target_id"))
    lists = hits.filter("p.up = 'left'").select("doc_pos", "doc_id", "unit_order", (F.col("n") + 1).alias("first"), F.col("concept_id").alias("target_id"), "p.lists")
    members = at.select("doc_pos", "unit_order", "n", "island", F.col("concept_id").alias("source_id"))
    heads = members.select("doc_pos", "unit_order", F.col("n").alias("first"), "island")
    left = (
        lists.join(heads, ["doc_pos", "unit_order", "first"]).join(members, ["doc_pos", "unit_order", "island"])
        .filter("n = first or (lists and n > first)").select("doc_pos", "doc_id", "source_id", "target_id")
    )
    return _relations(right.unionByName(left).filter("source_id <> target_id").distinct(), "IS_A")


def union(members: list[DataFrame]) -> DataFrame:
    """All members' relations, in order, repeats kept."""
    found = members[0]
    for member in members[1:]:
        found = found.unionByName(member)
    return found


INDUCERS = ("co-occurrence", "compound", "hearst", "union")
