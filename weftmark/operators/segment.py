"""Documents to units: a row a unit, in order, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions.text import strip

BLANK_LINE = "\n\n"


def _units(documents: DataFrame, pieces: Column, kind: str, speaker: Column | None = None) -> DataFrame:
    clean = F.filter(F.transform(pieces, strip), lambda x: x != "")
    return documents.select("doc_pos", "doc_id", F.posexplode(clean).alias("unit_order", "text")).select(
        "doc_pos",
        "doc_id",
        F.concat(F.col("doc_id"), F.lit(":u"), F.col("unit_order").cast("string")).alias("unit_id"),
        "unit_order",
        F.lit(kind).alias("kind"),
        (F.lit(None).cast("string") if speaker is None else speaker).alias("speaker"),
        "text",
    )


def block(documents: DataFrame) -> DataFrame:
    """Units between blank lines, stripped; empty ones left out, the rest numbered anew.

    ``documents``: doc_pos, doc_id, text. Null, empty and blank texts have no units.
    """
    return _units(documents, F.split("text", BLANK_LINE, -1), "block")


def sentence(documents: DataFrame) -> DataFrame:
    """Units that end with '.', '!' or '?' before white space; no abbreviations are known."""
    return _units(documents, F.split("text", r"(?U)(?<=[.!?])\s+", -1), "sentence")


def turn(documents: DataFrame) -> DataFrame:
    """A unit each line; a leading "name: " of a line is its speaker."""
    lines = block(documents.withColumn("text", F.regexp_replace("text", r"\r?\n", BLANK_LINE)))
    pattern = r"(?U)^([\w .'-]{1,40}):\s+"
    name = F.regexp_extract("text", pattern, 1)
    return lines.withColumn("kind", F.lit("turn")).withColumn("speaker", F.when(name != "", name)).withColumn("text", F.regexp_replace("text", pattern, ""))


SEGMENTERS = {"block": block, "sentence": sentence, "turn": turn}
