"""Mentions to scored mentions: every mention keeps its row; ``top_k`` distinct surfaces a document are selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.functions import vectors
from weftmark.functions.text import words

TOP_K = 10


def select_top(mentions: DataFrame, salience: str = "salience", top_k: int = TOP_K) -> DataFrame:
    """Adds ``selected``: the mention's surface is among the ``top_k`` by salience, then surface, of its document.

    Equal (salience, surface) share a dense rank, so surfaces are ranked without being reduced first.
    """
    order = Window.partitionBy("doc_pos").orderBy(F.desc(salience), "surface")
    return mentions.withColumn("selected", F.dense_rank().over(order) <= top_k)


def _with_salience(mentions: DataFrame, by_surface: DataFrame, top_k: int) -> DataFrame:
    return select_top(mentions.join(by_surface, ["doc_pos", "surface"]), top_k=top_k)


def frequency(mentions: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Salience: occurrences of the surface by those of the document's most frequent one."""
    counted = mentions.withColumn("_n", F.count("*").over(Window.partitionBy("doc_pos", "surface")))
    most = F.max("_n").over(Window.partitionBy("doc_pos"))
    return select_top(counted.withColumn("salience", F.col("_n") / most).drop("_n"), top_k=top_k)


def passthrough(mentions: DataFrame) -> DataFrame:
    """Every mention has salience 1 and is selected."""
    return mentions.withColumn("salience", F.lit(1.0)).withColumn("selected", F.lit(True))


def document_text(units: DataFrame) -> DataFrame:
    """(doc_pos, text): the units of each document joined by line ends."""
    parts = F.array_sort(F.collect_list(F.struct("unit_order", "text")))
    return units.groupBy("doc_pos").agg(F.array_join(F.transform(parts, lambda u: u["text"]), "\n").alias("text"))


def embedding_cosine(mentions: DataFrame, units: DataFrame, top_k: int = TOP_K, dim: int = vectors.DIM) -> DataFrame:
    """Salience: cosine of the surface's and the document's hashed vectors.

    Each distinct surface of the corpus is embedded once, each document once; a pair then costs a product over
    the few buckets of the surface.
    """
    pairs = mentions.select("doc_pos", "surface").distinct()
    surfaces = vectors.hashed(pairs.select("surface").distinct(), ["surface"], "surface", dim)
    docs = vectors.hashed(document_text(units), ["doc_pos"], "text", dim).select("doc_pos", vectors.dense(F.col("counts"), dim).alias("doc"), F.col("square").alias("doc_square"))
    both = pairs.join(surfaces, "surface", "left").join(docs, "doc_pos", "left")
    value = vectors.count_cosine(vectors.sparse_dot(F.col("counts"), F.col("doc")), F.coalesce("square", F.lit(0)), F.coalesce("doc_square", F.lit(0)))
    return _with_salience(mentions, both.select("doc_pos", "surface", value.alias("salience")), top_k)


def masked_texts(mentions: DataFrame, units: DataFrame, mask: str = "[MASK]") -> DataFrame:
    """(doc_pos, surface, text): the document with every occurrence of one of its surfaces masked.

    One mask a word of the surface, at least one; the units are joined by line ends. Spans are replaced from
    right to left, so earlier offsets hold.
    """
    marks = _marks(mentions)
    every = mentions.select("doc_pos", "surface").distinct().join(units.select("doc_pos", "unit_order", "text"), "doc_pos")
    text = _mask(F.col("text"), F.coalesce("marks", F.array().cast("array<struct<span_start:int,span_end:int>>")), F.col("surface"), mask)
    rows = every.join(marks, ["doc_pos", "surface", "unit_order"], "left").withColumn("text", text)
    parts = F.array_sort(F.collect_list(F.struct("unit_order", "text")))
    return rows.groupBy("doc_pos", "surface").agg(F.array_join(F.transform(parts, lambda u: u["text"]), "\n").alias("text"))


def _mask(text: Column, marks: Column, surface: Column, mask: str) -> Column:
    """Text with the spans of ``marks``, last first, replaced by a mask for each word of the surface."""
    masks = F.array_join(F.array_repeat(F.lit(mask), F.greatest(F.size(words(surface)), F.lit(1))), " ")
    return F.aggregate(marks, text, lambda acc, m: F.concat(F.substring(acc, F.lit(1), m["span_start"]), masks, F.substring(acc, m["span_end"] + 1, F.length(acc))))


def _marks(mentions: DataFrame) -> DataFrame:
    """(doc_pos, surface, unit_order, marks): spans of a surface in a unit, last first."""
    return mentions.groupBy("doc_pos", "surface", "unit_order").agg(F.sort_array(F.collect_set(F.struct("span_start", "span_end")), asc=False).alias("marks"))


def mderank(mentions: DataFrame, units: DataFrame, top_k: int = TOP_K, mask: str = "[MASK]", dim: int = vectors.DIM) -> DataFrame:
    """Salience: 1 minus the cosine of the document with itself after masking the surface.

    The masked document is not embedded anew. Its counts are the document's plus those of the masked units
    less those of the units as they were, each between its separators, and the trigrams across a separator
    whose neighbours changed. So a surface costs the units it stands in, not the whole document.
    """
    order = Window.partitionBy("doc_pos").orderBy("unit_order")
    placed = units.select("doc_pos", "unit_order", "text", F.row_number().over(order).alias("k"), F.lead("text").over(order).alias("next_text"))
    left, right = F.when(F.col("k") == 1, " ").otherwise("\n"), F.when(F.col("next_text").isNull(), " ").otherwise("\n")
    changed = (
        _marks(mentions).join(placed, ["doc_pos", "unit_order"])
        .select("doc_pos", "surface", "k", left.alias("l"), right.alias("r"), F.lower("text").alias("old"), F.lower(_mask(F.col("text"), F.col("marks"), F.col("surface"), mask)).alias("new"))
    )
    inner = vectors.counted(changed, ["doc_pos", "surface", "k"], F.concat("l", "new", "r"), F.concat("l", "old", "r"), dim).select("doc_pos", "surface", F.explode("counts").alias("c"))
    borders = placed.filter("next_text is not null").select("doc_pos", "k", F.right(F.lower("text"), F.lit(1)).alias("a"), F.left(F.lower("next_text"), F.lit(1)).alias("b"))
    ends = changed.select("doc_pos", "surface", "k", F.right("new", F.lit(1)).alias("a2"))
    starts = changed.select("doc_pos", "surface", (F.col("k") - 1).alias("k"), F.left("new", F.lit(1)).alias("b2"))
    across = ends.join(starts, ["doc_pos", "surface", "k"], "full").join(borders, ["doc_pos", "k"])
    crossing = across.select(
        "doc_pos", "surface",
        F.explode(F.array(
            F.struct(F.lit(1).alias("sign"), F.concat(F.coalesce("a2", "a"), F.lit("\n"), F.coalesce("b2", "b")).alias("gram")),
            F.struct(F.lit(-1).alias("sign"), F.concat("a", F.lit("\n"), "b").alias("gram")),
        )).alias("x"),
    ).select("doc_pos", "surface", "x.sign", "x.gram")
    moves = crossing.select("doc_pos", "surface", vectors.bucket(F.col("gram"), dim).alias("bucket"), F.col("sign").cast("long").alias("n"))
    by_bucket = inner.select("doc_pos", "surface", "c.bucket", "c.n").unionByName(moves).groupBy("doc_pos", "surface", "bucket").agg(F.sum("n").alias("n")).filter("n <> 0")
    delta = by_bucket.groupBy("doc_pos", "surface").agg(F.collect_list(F.struct("bucket", "n")).alias("delta"), F.sum(F.col("n") * F.col("n")).alias("square"))
    docs = vectors.hashed(document_text(units), ["doc_pos"], "text", dim).select("doc_pos", vectors.dense(F.col("counts"), dim).alias("doc"), F.col("square").alias("q"))
    both = mentions.select("doc_pos", "surface").distinct().join(docs, "doc_pos", "left").join(delta, ["doc_pos", "surface"], "left")
    moved = F.coalesce(vectors.sparse_dot(F.col("delta"), F.col("doc")), F.lit(0))
    q = F.coalesce("q", F.lit(0))
    value = F.round(1 - vectors.count_cosine(q + moved, q, q + 2 * moved + F.coalesce("square", F.lit(0))), 12)
    return _with_salience(mentions, both.select("doc_pos", "surface", value.alias("salience")), top_k)


def softmax(value: Column, window: Window) -> Column:
    """Softmax over a window, shifted by its largest value."""
    shifted = F.exp(value - F.max(value).over(window))
    return shifted / F.sum(shifted).over(window)


def first_positions(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_pos, surface, position): number of the first word of each surface in its document, from 1."""
    before = F.coalesce(F.sum(F.size(words(F.col("text")))).over(Window.partitionBy("doc_pos").orderBy("unit_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = units.select("doc_pos", "unit_order", F.col("text").alias("unit_text"), before.alias("offset"))
    at = F.col("offset") + F.size(words(F.substring(F.col("unit_text"), F.lit(1), F.col("span_start")))) + 1
    return mentions.join(placed, ["doc_pos", "unit_order"]).groupBy("doc_pos", "surface").agg(F.min(at).alias("position"))


def hcuke(mentions: DataFrame, units: DataFrame, top_k: int = TOP_K, denoise: float = 1.3, dim: int = vectors.DIM) -> DataFrame:
    """Salience: product of global relevance, local relevance and position weight of the surface.

    Position weight: softmax over the document's surfaces of 1 / first word position. Global: over distinct
    units with the surface, unit weight (softmax of 1 / (order + 1)) times cosine unit-document times cosine
    surface-unit. Local: sum over all surfaces of their cosine with this one, itself 1, minus ``denoise`` times
    the mean cosine of unordered pairs. The pair sums need no self-join: with unit vectors u, the sum of
    cosines of i is u_i times the document's summed vector.
    """
    pairs = mentions.select("doc_pos", "surface").distinct()
    surfaces = vectors.hashed(pairs.select("surface").distinct(), ["surface"], "surface", dim).select(
        "surface", vectors.embedding(F.col("counts"), F.col("square"), dim).alias("v")
    )
    docs = vectors.hashed(document_text(units), ["doc_pos"], "text", dim).select("doc_pos", vectors.embedding(F.col("counts"), F.col("square"), dim).alias("d"))
    sentences = vectors.hashed(units, ["doc_pos", "unit_order"], "text", dim).select("doc_pos", "unit_order", vectors.embedding(F.col("counts"), F.col("square"), dim).alias("s"))
    zero = F.array_repeat(F.lit(0.0), dim)

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    doc = Window.partitionBy("doc_pos")
    weights = units.select("doc_pos", "unit_order", softmax(1.0 / (F.col("unit_order") + 1), doc).alias("unit_weight"))
    in_units = mentions.select("doc_pos", "surface", "unit_order").distinct()
    overall = (
        in_units.join(weights, ["doc_pos", "unit_order"])
        .join(sentences, ["doc_pos", "unit_order"], "left").join(docs, "doc_pos", "left").join(surfaces, "surface", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("s", "d", "v")})
        .groupBy("doc_pos", "surface").agg(F.sum(F.col("unit_weight") * dot("s", "d") * dot("v", "s")).alias("overall"))
    )
    vec = pairs.join(surfaces, "surface", "left").withColumn("v", F.coalesce("v", zero))
    summed = vec.groupBy("doc_pos").agg(*[F.sum(F.col("v")[i]).alias(f"x{i}") for i in range(dim)]).select("doc_pos", F.array(*[f"x{i}" for i in range(dim)]).alias("sum"))
    local = (
        vec.join(summed, "doc_pos")
        .withColumn("others", dot("v", "sum") - dot("v", "v"))
        .withColumn("n", F.count("*").over(doc))
        .withColumn("mean", F.when(F.col("n") > 1, F.sum("others").over(doc) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))
        .select("doc_pos", "surface", (1.0 + F.col("others") - F.col("n") * denoise * F.col("mean")).alias("local"))
    )
    position = first_positions(mentions, units).withColumn("position_weight", softmax(1.0 / F.col("position"), doc))
    scored = (
        pairs.join(overall, ["doc_pos", "surface"], "left").join(local, ["doc_pos", "surface"]).join(position, ["doc_pos", "surface"], "left")
        .select("doc_pos", "surface", (F.round(F.coalesce("overall", F.lit(0.0)) * F.col("local") * F.coalesce("position_weight", F.lit(0.0)), 12) + 0.0).alias("salience"))
    )
    return _with_salience(mentions, scored, top_k)


SCORERS = {"frequency": frequency, "embedding-cosine": embedding_cosine, "mderank": mderank, "hcuke": hcuke, "passthrough": passthrough}
