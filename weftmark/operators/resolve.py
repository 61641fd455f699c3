"""Selected mentions to concepts, equal to the sequential fold over the stream, but set by set.

The position of a mention is (doc_pos, unit_order, ord). A concept's embedding never changes and concepts are
never removed, so which labels become concepts is decided at their first occurrence: the greedy leaders of
the similarity graph in order of first occurrence. They are found in rounds: a label with an earlier leader
beside it is out, one whose earlier neighbours are all out is a leader. Then each mention takes the best
leader made before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.functions import vectors
from weftmark.functions.ids import concept_id
from weftmark.functions.text import label
from weftmark.operators.simjoin import cosine_pairs
from weftmark.runtime import materialize

POSITION = ["doc_pos", "unit_order", "ord"]
MENTION = ["doc_pos", "doc_id", "unit_order", "unit_id", "ord", "surface", "span_start", "span_end"]


def labelled(mentions: DataFrame) -> DataFrame:
    """Selected mentions with their label and position."""
    return mentions.filter("selected").select(*MENTION, label(F.col("surface")).alias("label"), F.struct(*POSITION).alias("position"))


def exact_label(mentions: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Resolutions where equal labels are one concept: MENTION, label, concept_id, concept_label, is_new.

    ``prior``: concepts known before (id, label); a label among them keeps its id and is not new.
    """
    rows = labelled(mentions)
    first = F.min("position").over(Window.partitionBy("label"))
    rows = rows.withColumn("is_new", F.col("position") == first)
    if prior is not None:
        known = prior.groupBy("label").agg(F.max("id").alias("known_id"))
        rows = rows.join(known, "label", "left").withColumn("is_new", F.col("is_new") & F.col("known_id").isNull()).withColumn("concept_id", F.coalesce("known_id", concept_id(F.col("label"))))
    else:
        rows = rows.withColumn("concept_id", concept_id(F.col("label")))
    return rows.select(*MENTION, "label", "concept_id", F.col("label").alias("concept_label"), "is_new")


def embedding_nn(mentions: DataFrame, threshold: float = 0.8, prior: DataFrame | None = None, dim: int = vectors.DIM) -> DataFrame:
    """Resolutions by nearest concept with the hashing embedder: MENTION, label, concept_id, concept_label, is_new, cosine.

    A mention whose label is a concept's goes there; else to the concept of largest cosine (then smallest id)
    among those made before it, if that is at least ``threshold``; else it makes a concept.
    """
    rows = materialize(labelled(mentions))
    first = rows.groupBy("label").agg(F.min("position").alias("first"))
    if prior is not None:
        known = prior.groupBy("label").agg(F.max("id").alias("known_id"))
        first = first.join(known, "label", "full").select("label", "first", "known_id")
    else:
        first = first.withColumn("known_id", F.lit(None).cast("string"))
    # ranks of first occurrence without one task for all: by document, and within it
    numbered = materialize(first.withColumn("item", F.monotonically_increasing_id()))
    embedded = vectors.hashed(numbered.select("item", "label"), ["item"], "label", dim)
    vecs = numbered.select("item").join(embedded, "item", "left").select("item", vectors.dense(F.col("counts"), dim).alias("vector"))
    pairs = materialize(cosine_pairs(vecs, threshold, dim))
    sides = numbered.select("item", "first", F.col("known_id").isNotNull().alias("known"))
    both = pairs.join(sides.toDF("a", "fa", "ka"), "a").join(sides.toDF("b", "fb", "kb"), "b").filter("not (ka and kb)")
    a_first = F.col("ka") | (~F.col("kb") & (F.col("fa") < F.col("fb")))
    oriented = both.select(
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("item"), F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("before"), "cosine", F.when(a_first, F.col("ka")).otherwise(F.col("kb")).alias("before_known")
    )
    oriented = materialize(oriented)
    lead = _leaders_of(numbered, oriented)
    named = materialize(
        lead.join(numbered, "item").select("item", "label", "first", F.col("known_id").isNotNull().alias("known"), F.coalesce("known_id", concept_id(F.col("label"))).alias("concept_id"))
    )
    # every undirected edge in both directions: a leader may come later than the label it serves
    links = both.select(F.col("a").alias("item"), F.col("b").alias("leader"), "cosine").unionByName(both.select(F.col("b").alias("item"), F.col("a").alias("leader"), "cosine"))
    choices = (
        links.join(named.select(F.col("item").alias("leader"), F.col("concept_id").alias("other_id"), F.col("label").alias("other_label"), F.col("first").alias("made"), F.col("known").alias("made_before")), "leader")
        .join(named.select("item"), "item", "left_anti")
        .join(numbered.select("item", "label"), "item")
        .select("label", "cosine", "other_id", "other_label", "made", "made_before")
    )
    own = named.select("label", F.col("concept_id").alias("own_id"), F.col("first").alias("own_first"), F.col("known").alias("own_known"))
    leaders_rows = rows.join(own, "label").select(
        *MENTION, "label", F.col("own_id").alias("concept_id"), F.col("label").alias("concept_label"), (~F.col("own_known") & (F.col("position") == F.col("own_first"))).alias("is_new"), F.lit(1.0).alias("cosine")
    )
    merged = (
        rows.join(own.select("label"), "label", "left_anti").join(choices, "label").filter("made_before or made < position")
        .groupBy(*MENTION, "label").agg(F.min_by(F.struct("other_id", "other_label", "cosine"), F.struct(-F.col("cosine"), "other_id")).alias("best"))
        .select(*MENTION, "label", F.col("best.other_id").alias("concept_id"), F.col("best.other_label").alias("concept_label"), F.lit(False).alias("is_new"), F.col("best.cosine").alias("cosine"))
    )
    return leaders_rows.unionByName(merged)


def _leaders_of(numbered: DataFrame, oriented: DataFrame) -> DataFrame:
    """Leaders where each edge already says which end is earlier; known concepts are leaders from the start."""
    known = numbered.filter("known_id is not null").select("item")
    lead = materialize(numbered.join(oriented.select("item").distinct(), "item", "left_anti").select("item").unionByName(known).distinct())
    parts, open_ = [lead], materialize(oriented.join(known, "item", "left_anti").select("item", "before"))
    while open_.take(1):
        out = materialize(open_.join(lead.withColumnRenamed("item", "before"), "before", "left_semi").select("item").distinct())
        waiting = materialize(open_.join(out, "item", "left_anti"))
        rest = materialize(waiting.join(out.withColumnRenamed("item", "before"), "before", "left_anti").select("item", "before"))
        lead = materialize(waiting.select("item").distinct().join(rest.select("item").distinct(), "item", "left_anti"))
        parts.append(lead)
        open_ = rest
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def nearest_concepts(queries: DataFrame, concepts: DataFrame, k: int, dim: int) -> DataFrame:
    """(query, rank, id, cosine): the ``k`` concepts of largest cosine, then smallest id, of each query vector.

    ``queries``: query, vector: a stated set, compared with all concepts in blocks of the queries; the concepts
    are scanned once. Vectors of another length than ``dim`` count as zero vectors.
    """
    import numpy as np
    import pandas as pd

    asked = queries.select("query", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("vector"))
    rows = concepts.select("id", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("vector"))
    blocks = max(1, -(-asked.count() // 16_384))
    found = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        shared = queries.sparkSession.sparkContext.broadcast(part.toPandas())

        def scan(batches, shared=shared):
            q = np.stack([np.asarray(v, dtype=np.float64) for v in shared.value["vector"]]) if len(shared.value) else np.zeros((0, dim))
            qn = np.sqrt((q * q).sum(axis=1))
            names = shared.value["query"].to_numpy()
            for batch in batches:
                c = np.stack([np.asarray(v, dtype=np.float64) for v in batch["vector"]])
                whole = qn[:, None] * np.sqrt((c * c).sum(axis=1))[None, :]
                cos = np.round(np.divide(q @ c.T, whole, out=np.zeros_like(whole), where=whole > 0), 12)
                ids = batch["id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                cos, ids = cos[:, order], ids[order]
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query": np.repeat(names, top.shape[1]), "id": ids[top.ravel()], "cosine": np.take_along_axis(cos, top, 1).ravel()})

        kind = queries.schema["query"].dataType.simpleString()
        near = rows.mapInPandas(scan, f"query {kind}, id string, cosine double")
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "cosine")


RESOLVERS = {"exact-label": exact_label, "embedding-nn": embedding_nn}
