"""Units to candidate mentions with spans in code points of the unit's text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.functions.text import window_text

KEYS = ["doc_pos", "doc_id", "unit_order", "unit_id"]
OUT = [*KEYS, "ord", "surface", "span_start", "span_end", "context", "head", "lemma"]
TERMS_A_BLOCK = 500_000


def spans(units: DataFrame, pattern: str) -> DataFrame:
    """(units' columns, ord, match, span_start, span_end) of all matches of a Java pattern.

    A text is split by its own matches; a match starts behind all gaps up to it and all matches before it.
    The sums run in a window of the unit, which needs no exchange where units are partitioned by document.
    """
    rows = units.select(
        *units.columns, F.posexplode(F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"))).alias("ord", "m")
    ).filter("m.match is not null")
    so_far = Window.partitionBy("doc_pos", "unit_order").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("m.gap") + F.length("m.match")).over(so_far)
    return rows.withColumn("span_end", end.cast("int")).select(
        *units.columns, "ord", F.col("m.match").alias("match"), (F.col("span_end") - F.length("m.match")).cast("int").alias("span_start"), "span_end"
    )


def token(units: DataFrame, min_length: int = 4) -> DataFrame:
    """Words of letters and hyphens of at least ``min_length`` characters, in lower case; the context is the unit."""
    found = spans(units, "[A-Za-z][A-Za-z-]+").filter(F.length("match") >= min_length)
    low = F.lower("match")
    return found.select(*KEYS, "ord", low.alias("surface"), "span_start", "span_end", F.col("text").alias("context"), low.alias("head"), low.alias("lemma"))


def _fold(text: str) -> str:
    return "".join(low if len(low := ch.lower()) == 1 else ch for ch in text)


def _word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def gazetteer(units: DataFrame, terms: DataFrame, term: str = "term", block: int = TERMS_A_BLOCK) -> DataFrame:
    """Occurrences of the terms between non-word characters, letter case aside: leftmost first, the longest there,
    without overlap. Surfaces keep their case; the context is 40 characters to each side.

    The terms are taken in blocks of at most ``block``, each an automaton that tasks share, so a dictionary of
    any size is scanned whole; the choice among overlapping occurrences is made after all blocks. Null and
    empty terms match nothing. Equal terms count once.
    """
    spark = units.sparkSession
    wanted = terms.select(F.col(term).alias("term")).filter("term <> ''").distinct()
    n = wanted.count()
    blocks = max(1, -(-n // block))
    schema = "doc_pos long, unit_order int, span_start int, span_end int"
    found = None
    for k in range(blocks):
        part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(sorted({_fold(r["term"]) for r in part.toLocalIterator()}))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            machine = ahocorasick.Automaton()
            for t in shared.value:
                machine.add_word(t, len(t))
            if shared.value:
                machine.make_automaton()
            for batch in batches:
                rows = []
                for pos, order, text in zip(batch["doc_pos"], batch["unit_order"], batch["text"]):
                    low = _fold(text) if shared.value else ""
                    for last, size in machine.iter(low) if low else ():
                        a, b = last - size + 1, last + 1
                        if (a == 0 or not _word(low[a - 1])) and (b == len(low) or not _word(low[b])):
                            rows.append((pos, order, a, b))
                yield pd.DataFrame(rows, columns=["doc_pos", "unit_order", "span_start", "span_end"])

        hits = units.select("doc_pos", "unit_order", "text").mapInPandas(scan, schema)
        found = hits if found is None else found.unionByName(hits)
    # per unit: walk the occurrences by start, longest first, and keep those behind the last one kept
    walked = found.groupBy("doc_pos", "unit_order").agg(F.array_sort(F.collect_set(F.struct("span_start", (-F.col("span_end")).alias("back")))).alias("all"))
    empty = F.array().cast("array<struct<span_start:int,span_end:int>>")
    kept = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("at"), empty.alias("kept")),
        lambda acc, x: F.when(
            x["span_start"] >= acc["at"],
            F.struct((-x["back"]).alias("at"), F.concat(acc["kept"], F.array(F.struct(x["span_start"].alias("span_start"), (-x["back"]).alias("span_end")))).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    chosen = walked.select("doc_pos", "unit_order", F.posexplode(kept).alias("ord", "s")).select("doc_pos", "unit_order", "ord", "s.span_start", "s.span_end")
    surface = F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    return units.join(chosen, ["doc_pos", "unit_order"]).select(
        *KEYS, "ord", surface.alias("surface"), "span_start", "span_end", window_text(F.col("text"), F.col("span_start"), F.col("span_end")).alias("context"), F.lit("").alias("head"), F.lit("").alias("lemma")
    )


def gold_mentions(units: DataFrame, gold: DataFrame) -> DataFrame:
    """Stored mentions of each unit's document, in stored order.

    ``gold``: doc_id, text, mentions ARRAY<STRUCT<span_start, span_end, surface, ...>>, one row a document. A unit
    whose document is missing, or whose text is not the stored one, is an error when the result is computed.
    """
    joined = units.join(gold.select("doc_id", F.col("text").alias("stored"), F.col("mentions").alias("marks"), F.lit(True).alias("known")), "doc_id", "left")
    checked = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("no gold mentions for document "), F.col("doc_id")))).when(
        F.col("stored") != F.col("text"), F.raise_error(F.concat(F.lit("unit text differs from the gold text of document "), F.col("doc_id")))
    ).otherwise(F.col("marks"))
    rows = joined.withColumn("marks", checked).select(*KEYS, "text", F.posexplode("marks").alias("ord", "m"))
    return rows.select(
        *KEYS, "ord", F.col("m.surface").alias("surface"), F.col("m.span_start").alias("span_start"), F.col("m.span_end").alias("span_end"),
        window_text(F.col("text"), F.col("m.span_start"), F.col("m.span_end")).alias("context"), F.lit("").alias("head"), F.lit("").alias("lemma"),
    )


def noun_chunk(units: DataFrame, model: str = "en_core_web_sm", max_tokens: int = 5) -> DataFrame:
    """Noun chunks of an optional language model: leading determiners and pronouns trimmed, at most ``max_tokens`` long."""
    try:
        import spacy  # noqa: F401
    except ImportError as e:
        raise ImportError("the noun-chunk extractor needs the optional package spacy and a model such as " + model) from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import spacy

        nlp = spacy.load(model)
        for batch in batches:
            rows = []
            for keys, doc in zip(batch[KEYS].itertuples(index=False), nlp.pipe(batch["text"])):
                ord_ = 0
                for chunk in doc.noun_chunks:
                    tokens = list(chunk)
                    while tokens and tokens[0].pos_ in ("DET", "PRON"):
                        tokens.pop(0)
                    if tokens and len(tokens) <= max_tokens:
                        a, b = tokens[0].idx, tokens[-1].idx + len(tokens[-1])
                        rows.append((*keys, ord_, doc.text[a:b].lower(), a, b, doc.text, chunk.root.text.lower(), " ".join(t.lemma_.lower() for t in tokens)))
                        ord_ += 1
            yield pd.DataFrame(rows, columns=OUT)

    return units.select(*KEYS, "text").mapInPandas(
        run, "doc_pos long, doc_id string, unit_order int, unit_id string, ord int, surface string, span_start int, span_end int, context string, head string, lemma string"
    )
