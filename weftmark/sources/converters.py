"""Pure transforms of raw corpora to the records that the readers take, as frame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.functions.text import strip

ENTITY_PREFIXES = ("HUMAN_PART", "NON_HUMAN_PART", "LOC", "TIME")  # fixed values: tags of entity mentions
TEST_TOPICS = range(36, 46)  # fixed values: topics of the test split


def keyphrase_records(rows: DataFrame) -> DataFrame:
    """(id, text, keyphrases) from token arrays: tokens joined by spaces, extractive then abstractive phrases; a
    missing id becomes "doc-" and the row's ``line``."""
    none = F.array().cast("array<string>")
    return rows.select(
        F.coalesce("id", F.concat(F.lit("doc-"), F.col("line").cast("string"))).alias("id"),
        F.array_join("document", " ").alias("text"),
        F.concat(F.coalesce("extractive_keyphrases", none), F.coalesce("abstractive_keyphrases", none)).alias("keyphrases"),
    )


def dialogue_records(turns: DataFrame, marks: DataFrame, prefix: str) -> DataFrame:
    """(id, kind, text, mentions) of dialogues.

    ``turns``: dialogue_id, turn, utterance. ``marks``: dialogue_id, turn, mention, span_start, span_end, entity. Blank
    turns are dropped, the others stripped at the right and joined by line ends; spans move by what stands before. A
    mark that matches only when shortened to its mention is shortened; one that does not match, or a span with two
    entities, is an error when the result is computed. A mark on a blank turn counts as none.
    """
    clean = turns.withColumn("utterance", F.regexp_replace("utterance", r"(?U)\s+$", "")).filter("utterance <> ''")
    before = Window.partitionBy("dialogue_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = clean.withColumn("offset", F.coalesce(F.sum(F.length("utterance") + 1).over(before), F.lit(0)).cast("int"))
    texts = placed.groupBy("dialogue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "utterance"))), lambda t: t["utterance"]), "\n").alias("text"))
    joined = marks.join(placed, ["dialogue_id", "turn"])
    exact = F.expr("substring(utterance, span_start + 1, span_end - span_start)") == F.col("mention")
    cut = F.expr("substring(utterance, span_start + 1, length(mention))") == F.col("mention")
    end = F.when(exact, F.col("span_end")).when(cut, F.col("span_start") + F.length("mention")).otherwise(F.raise_error(F.concat(F.lit("span without its mention in dialogue "), F.col("dialogue_id").cast("string"))))
    spans = joined.select("dialogue_id", (F.col("offset") + F.col("span_start")).cast("int").alias("start"), (F.col("offset") + end).cast("int").alias("end"), F.col("mention").alias("surface"), F.col("entity").alias("cluster"))
    one = spans.groupBy("dialogue_id", "start", "end").agg(F.min("surface").alias("surface"), F.min("cluster").alias("cluster"), F.count_distinct("cluster").alias("n"))
    one = one.withColumn("cluster", F.when(F.col("n") == 1, F.col("cluster")).otherwise(F.raise_error(F.concat(F.lit("conflicting clusters in dialogue "), F.col("dialogue_id").cast("string")))))
    return _records(texts.select(F.concat(F.lit(prefix), F.col("dialogue_id").cast("string")).alias("id"), "dialogue_id", "text"), one, "dialogue_id", "transcript")


def _records(texts: DataFrame, spans: DataFrame, key: str, kind: str) -> DataFrame:
    marks = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "surface", "cluster"))).alias("mentions"))
    none = F.array().cast("array<struct<start:int,end:int,surface:string,cluster:string>>")
    return texts.join(marks, key, "left").select("id", F.lit(kind).alias("kind"), "text", F.coalesce("mentions", none).alias("mentions"))


def coreference_records(tokens: DataFrame, marks: DataFrame, links: DataFrame, validated: DataFrame) -> DataFrame:
    """(id, kind, text, mentions) of annotated documents.

    ``tokens``: doc, sentence, t_id, word. ``marks``: doc, m_id, tag, t_ids. ``links``: doc, m_id, relation, r_id, note.
    ``validated``: doc, sentence. Words of a sentence are joined by spaces, sentences by line ends; only validated
    sentences count. Marks that are no entities, reach outside, or have gaps are dropped; of equal spans the lowest
    m_id stays. The cluster is the note of a link across documents, else doc:r and the link, else doc:m and the mark.
    """
    kept = tokens.join(validated, ["doc", "sentence"], "left_semi")
    line = Window.partitionBy("doc").orderBy("sentence", "t_id")
    first = F.lag("sentence").over(line).isNull()
    step = F.length("word") + F.when(first, 0).otherwise(1)
    end = F.sum(step).over(line.rowsBetween(Window.unboundedPreceding, 0))
    placed = kept.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("word")).cast("int"))
    sentences = placed.groupBy("doc", "sentence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_id", "word"))), lambda t: t["word"]), " ").alias("s"))
    texts = sentences.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "s"))), lambda t: t["s"]), "\n").alias("text"))
    entity = F.lit(False)
    for p in ENTITY_PREFIXES:
        entity = entity | F.col("tag").startswith(p)
    rows = marks.filter(entity & (F.size("t_ids") > 0)).select("doc", "m_id", F.explode("t_ids").alias("t_id"), F.size("t_ids").alias("size"))
    spans = rows.join(placed, ["doc", "t_id"], "left").groupBy("doc", "m_id", "size").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("start").alias("met"), (F.max("t_id") - F.min("t_id") + 1).alias("wide"))
    whole = spans.filter("met = size and wide = size")
    lowest = whole.withColumn("n", F.row_number().over(Window.partitionBy("doc", "start", "end").orderBy(F.col("m_id").cast("int")))).filter("n = 1")
    names = links.filter("relation in ('CROSS_DOC_COREF', 'INTRA_DOC_COREF')").select("doc", "m_id", F.when(F.col("relation") == "CROSS_DOC_COREF", F.col("note")).otherwise(F.concat("doc", F.lit(":r"), "r_id")).alias("linked")).dropDuplicates(["doc", "m_id"])
    named = lowest.join(names, ["doc", "m_id"], "left").join(texts, "doc").select(
        "doc", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("surface"), F.coalesce("linked", F.concat("doc", F.lit(":m"), F.col("m_id").cast("string"))).alias("cluster")
    )
    return _records(texts.select(F.col("doc").alias("id"), "doc", "text"), named, "doc", "article")


def topic_order(doc: Column) -> Column:
    """Sort key of names like "36_4ecb.xml": topic, number, rest."""
    return F.struct(F.regexp_extract(doc, r"^(\d+)_", 1).cast("int").alias("topic"), F.regexp_extract(doc, r"^\d+_(\d+)", 1).cast("int").alias("number"), F.regexp_extract(doc, r"^\d+_(.*)$", 1).alias("rest"))


def in_test_split(doc: Column) -> Column:
    return F.regexp_extract(doc, r"^(\d+)_", 1).cast("int").isin(list(TEST_TOPICS))


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("line").alias("line"))


def normalize_terms(lines: DataFrame) -> DataFrame:
    """(line, term) of "id, tab, term" lines (line, value): lower case, stripped, the first of equal terms."""
    term = F.lower(strip(F.get(F.split("value", "\t", 2), 1)))
    return _first(lines.select("line", term.alias("term")).filter("term <> ''"), ["term"]).select("line", "term")


def parse_taxonomy(lines: DataFrame) -> DataFrame:
    """(line, hypo, hyper) of "id, tab, hypo, tab, hyper" lines: lower case, stripped, the first of equal pairs."""
    parts = F.split("value", "\t", 3)
    pairs = lines.filter(F.trim("value") != "").select("line", F.lower(strip(F.get(parts, 1))).alias("hypo"), F.lower(strip(F.get(parts, 2))).alias("hyper"))
    return _first(pairs, ["hypo", "hyper"]).select("line", "hypo", "hyper")


def usable_extracts(pages: DataFrame) -> DataFrame:
    """Pages (term, type, extract) of type "standard" with text."""
    return pages.filter("type = 'standard'").withColumn("extract", strip(F.col("extract"))).filter("extract <> ''")


def slug(term: Column) -> Column:
    """Lower case, spaces to hyphens, nothing but a-z, 0-9 and hyphens."""
    return F.regexp_replace(F.replace(F.lower(term), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")


def taxonomy_records(key: str, terms: DataFrame, extracts: DataFrame) -> DataFrame:
    """(line, id, kind, term, text): the glossary first, then an article a term with an extract, in term order.

    The second and later terms of one slug get -2, -3 and so on; an empty slug is "term".
    """
    glossary = terms.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "term"))), lambda t: t["term"]), "\n").alias("text")).select(
        F.lit(-1).cast("long").alias("line"), F.lit(f"{key}:glossary").alias("id"), F.lit("terminology").alias("kind"), F.lit(None).cast("string").alias("term"), "text"
    )
    met = terms.join(extracts.select("term", F.col("extract").alias("text")), "term").withColumn("slug", F.when(slug(F.col("term")) == "", "term").otherwise(slug(F.col("term"))))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("line"))
    name = F.concat(F.lit(f"{key}:"), "slug", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""))
    return glossary.unionByName(met.select("line", name.alias("id"), F.lit("article").alias("kind"), "term", "text"))


def recall_ceiling(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(reachable, edges): edges with both ends among the terms, and all."""
    known = terms.select("term").distinct()
    met = edges.join(known.toDF("hypo"), "hypo", "left_semi").join(known.toDF("hyper"), "hyper", "left_semi")
    return met.agg(F.count("*").alias("reachable")).withColumn("_k", F.lit(1)).join(edges.agg(F.count("*").alias("edges")).withColumn("_k", F.lit(1)), "_k").select("reachable", "edges")


def checksum(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)
