"""Evaluation: every metric is a one-row frame; empty denominators give 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.functions import vectors
from weftmark.functions.stemmer import stemmed
from weftmark.functions.text import strip
from weftmark.operators import hierarchy
from weftmark.operators.simjoin import cosine_pairs
from weftmark.runtime import materialize


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _prf(hit: Column, predicted: Column, gold: Column) -> list[Column]:
    p, r = _ratio(hit, predicted), _ratio(hit, gold)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def _sets(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (hit, predicted, gold): sizes of two sets of equal columns and of what they share."""
    both = predicted.distinct().withColumn("_p", F.lit(1)).unionByName(gold.distinct().withColumn("_p", F.lit(2)))
    each = both.groupBy(*predicted.columns).agg(F.sum("_p").alias("_s"))
    return each.agg(F.count_if(F.col("_s") == 3).alias("hit"), F.count_if(F.col("_s") != 2).alias("predicted"), F.count_if(F.col("_s") != 1).alias("gold"))


def label_f1(concepts: DataFrame, gold: DataFrame) -> DataFrame:
    """precision, recall, f1 of lower-case concept labels against gold labels (label)."""
    low = F.lower("label").alias("label")
    return _sets(concepts.select(low), gold.select(low)).select(*_prf(F.col("hit"), F.col("predicted"), F.col("gold")))


def edge_f1(concepts: DataFrame, relations: DataFrame, gold: DataFrame) -> DataFrame:
    """precision, recall, f1, predicted_edges, gold_edges of IS_A edges as lower-case label pairs against gold (hypo, hyper)."""
    names = concepts.select("id", F.lower("label").alias("name"))
    edges = (
        relations.filter("type = 'IS_A'")
        .join(names.toDF("source_id", "hypo"), "source_id").join(names.toDF("target_id", "hyper"), "target_id").select("hypo", "hyper")
    )
    counted = _sets(edges, gold.select(F.lower("hypo").alias("hypo"), F.lower("hyper").alias("hyper")))
    return counted.select(*_prf(F.col("hit"), F.col("predicted"), F.col("gold")), F.col("predicted").alias("predicted_edges"), F.col("gold").alias("gold_edges"))


def normal_label(col: Column) -> Column:
    """Label for comparing: lower case, no leading article, no plural s of words over three letters."""
    plain = F.regexp_replace(strip(F.lower(col)), r"^(?:a|an|the)\s+", "")
    return F.when((F.length(plain) > 3) & plain.endswith("s") & ~plain.endswith("ss"), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)


def redundancy(concepts: DataFrame, threshold: float = 0.9, dim: int = 64) -> DataFrame:
    """duplicate_rate, near_duplicate_pairs, concept_count: concepts of equal normal label or cosine ``threshold`` or more.

    The pairs are the union of an equi-join on the label and a similarity join. Embeddings of another length
    than ``dim`` count as zero vectors. Large groups of one label are counted, not paired: their pairs with
    similar vectors are taken off by label.
    """
    rows = materialize(
        concepts.select("id", normal_label(F.col("label")).alias("norm"), F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("vector")).withColumn("item", F.monotonically_increasing_id())
    )
    groups = rows.groupBy("norm").agg(F.count("*").alias("n")).filter("n > 1 and norm is not null")
    near = materialize(cosine_pairs(rows.select("item", "vector"), threshold, dim))
    side = rows.select("item", "norm")
    apart = near.join(side.toDF("a", "na"), "a").join(side.toDF("b", "nb"), "b").filter(~F.col("na").eqNullSafe(F.col("nb")) | F.col("na").isNull())
    same_pairs = groups.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("same"))
    dup = rows.join(groups, "norm", "left_semi").select("item").unionByName(apart.select(F.explode(F.array("a", "b")).alias("item"))).distinct()
    counts = rows.agg(F.count("*").alias("concept_count"))
    # three one-row frames side by side
    return (
        counts.withColumn("_k", F.lit(1)).join(same_pairs.withColumn("_k", F.lit(1)), "_k").join(apart.agg(F.count("*").alias("apart")).withColumn("_k", F.lit(1)), "_k").join(dup.agg(F.count("*").alias("dup")).withColumn("_k", F.lit(1)), "_k")
        .select(_ratio(F.col("dup"), F.col("concept_count")).alias("duplicate_rate"), (F.col("same") + F.col("apart")).cast("long").alias("near_duplicate_pairs"), "concept_count")
    )


def hierarchy_sanity(relations: DataFrame) -> DataFrame:
    """cycle_components, cycle_nodes, self_loops, max_depth, transitive_shortcuts, is_a_edges of the IS_A relations."""
    edges = materialize(relations.filter("type = 'IS_A'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")))
    proper = materialize(edges.filter("child <> parent").distinct())
    loops = hierarchy.cycle_nodes(proper)
    free = proper.join(loops.select(F.col("node").alias("child")), "child", "left_anti").join(loops.select(F.col("node").alias("parent")), "parent", "left_anti").select("child", "parent")
    parts = loops.agg(F.count_distinct("part"), F.count("*")).first()
    counts = edges.agg(F.count_if(F.col("child") == F.col("parent")), F.count("*")).first()
    shortcuts = hierarchy.shortcut_edges(proper, loops).count()
    row = (parts[0], parts[1], counts[0], hierarchy.longest_walk(materialize(free)), shortcuts, counts[1])
    return relations.sparkSession.createDataFrame([row], "cycle_components long, cycle_nodes long, self_loops long, max_depth long, transitive_shortcuts long, is_a_edges long")


def f1_at_k_documents(selected: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """(doc_id, precision_at_k, recall_at_k, f1_at_k ...) of each document.

    ``selected``: doc_id, surface, salience of selected mentions; ``gold``: doc_id, keyphrases. Surfaces are
    ranked by salience, then surface; phrases are compared by stems, and the size of a prediction is that of
    its set of stems. A document of ``selected`` without gold is an error when the result is computed.
    """
    best = selected.groupBy("doc_id", "surface").agg(F.max("salience").alias("salience"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("salience"), "surface"))).filter(F.col("rank") <= max(ks))
    phrases = gold.select("doc_id", F.explode("keyphrases").alias("phrase")).filter("phrase is not null")
    texts = ranked.select(F.col("surface").alias("phrase")).unionByName(phrases.select("phrase")).distinct()
    stems = materialize(texts.select("phrase", stemmed(F.col("phrase")).alias("stem")))
    wanted = phrases.join(stems, "phrase").select("doc_id", "stem").distinct()
    guessed = ranked.join(stems.withColumnRenamed("phrase", "surface"), "surface").groupBy("doc_id", "stem").agg(F.min("rank").alias("rank"))
    hits = guessed.join(wanted.withColumn("hit", F.lit(True)), ["doc_id", "stem"], "left")
    aggs = []
    for k in ks:
        aggs += [F.count_if(F.col("rank") <= k).alias(f"p{k}"), F.count_if((F.col("rank") <= k) & F.col("hit")).alias(f"h{k}")]
    sizes = gold.select("doc_id").distinct().join(wanted.groupBy("doc_id").agg(F.count("*").alias("g")), "doc_id", "left").select("doc_id", F.coalesce("g", F.lit(0)).alias("g"))
    rows = hits.groupBy("doc_id").agg(*aggs).join(sizes, "doc_id", "left")
    rows = rows.withColumn("g", F.when(F.col("g").isNull(), F.raise_error(F.concat(F.lit("no gold keyphrases for document "), F.col("doc_id")))).otherwise(F.col("g")))
    out = []
    for k in ks:
        p, r, f = _prf(F.col(f"h{k}"), F.col(f"p{k}"), F.col("g"))
        out += [p.alias(f"precision_at_{k}"), r.alias(f"recall_at_{k}"), f.alias(f"f1_at_{k}")]
    return rows.select("doc_id", *out)


def f1_at_k(selected: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """Unweighted mean of ``f1_at_k_documents`` over documents."""
    docs = f1_at_k_documents(selected, gold, ks)
    return docs.agg(*[F.avg(c).alias(c) for c in docs.columns if c != "doc_id"])


def clustering(rows: DataFrame) -> DataFrame:
    """b3_precision, b3_recall, b3_f1, ari of (mention, predicted, gold), one row a mention.

    B-cubed averages over mentions. ARI is 1 where there are no pairs or expected and largest index agree.
    No rows give 0 for all but ARI.
    """
    cells = rows.groupBy("predicted", "gold").agg(F.count("*").cast("double").alias("n"))
    cells = cells.withColumn("p", F.sum("n").over(Window.partitionBy("predicted"))).withColumn("g", F.sum("n").over(Window.partitionBy("gold")))

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    # a cell holds n of a cluster's p mentions: summed over cells, pairs(p) n / p gives each cluster's pairs once
    sums = cells.agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n") / F.col("p")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("g")).alias("br"),
        F.sum(pairs(F.col("n"))).alias("index"), F.sum(pairs(F.col("p")) * F.col("n") / F.col("p")).alias("a"), F.sum(pairs(F.col("g")) * F.col("n") / F.col("g")).alias("b"),
    ).na.fill(0.0)
    p, r = _ratio(F.col("bp"), F.col("m")), _ratio(F.col("br"), F.col("m"))
    total = pairs(F.col("m"))
    expected, most = F.col("a") * F.col("b") / total, (F.col("a") + F.col("b")) / 2
    ari = F.when(total <= 0, 1.0).when(F.abs(most - expected) < 1e-12 * F.greatest(most, F.lit(1.0)), 1.0).otherwise((F.col("index") - expected) / (most - expected))
    return sums.select(p.alias("b3_precision"), r.alias("b3_recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("b3_f1"), ari.alias("ari"))


def check_coverage(predicted: DataFrame, gold: DataFrame, key: str = "mention") -> None:
    """Raises unless both have the same mentions."""
    missing, extra = gold.join(predicted, key, "left_anti").count(), predicted.join(gold, key, "left_anti").count()
    if missing or extra:
        raise ValueError(f"mentions do not cover each other: {missing} of the gold missing, {extra} unknown")


def coherence(resolutions: DataFrame, dim: int = vectors.DIM) -> DataFrame:
    """coherence, multi_surface_concepts, singleton_fraction of resolutions (concept_id, surface), with the hashing embedder.

    Coherence: mean over concepts with two or more distinct lower-case surfaces of the mean cosine of their
    pairs; 1 if there are none. The pair sum is taken from the summed unit vector, so no pairs are made.
    """
    per = resolutions.groupBy("concept_id").agg(F.count("*").alias("resolved"))
    surfaces = resolutions.select("concept_id", F.lower("surface").alias("surface")).distinct()
    multi = surfaces.groupBy("concept_id").agg(F.count("*").alias("n")).filter("n > 1")
    used = surfaces.join(multi, "concept_id")
    embedded = vectors.hashed(used.select("surface").distinct(), ["surface"], "surface", dim)
    parts = used.join(embedded, "surface").select("concept_id", "n", F.explode("counts").alias("c"), "square")
    summed = parts.groupBy("concept_id", "n", F.col("c.bucket").alias("bucket")).agg(F.sum(F.col("c.n") / F.sqrt(F.col("square").cast("double"))).alias("x"))
    alive = used.join(embedded, "surface").groupBy("concept_id").agg(F.count("*").alias("alive"))
    each = summed.groupBy("concept_id", "n").agg(F.sum(F.col("x") * F.col("x")).alias("whole")).join(alive, "concept_id").select("concept_id", ((F.col("whole") - F.col("alive")) / (F.col("n") * (F.col("n") - 1))).alias("value"))
    means = multi.join(each, "concept_id", "left").agg(F.coalesce(F.avg(F.coalesce("value", F.lit(0.0))), F.lit(1.0)).alias("coherence"), F.count("*").alias("multi_surface_concepts"))
    singles = per.agg(_ratio(F.count_if(F.col("resolved") == 1), F.count("*")).alias("singleton_fraction"))
    return means.withColumn("_k", F.lit(1)).join(singles.withColumn("_k", F.lit(1)), "_k").select("coherence", "multi_surface_concepts", "singleton_fraction")
