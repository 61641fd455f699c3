"""Items that appear together: pair counts by large-basket blocking, and association scores.

A basket of up to ``chunk`` items gives its pairs in one row. A larger one is split by item hash into
chunks; every pair of chunks becomes a row of its own key, so the products of one huge basket are spread
over the cluster and no task holds more than two chunks. Pair counts are summed map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import n_records
from weftmark.runtime import materialize, skew_join

CHUNK = 256


def basket_items(df: DataFrame, basket: str, item) -> DataFrame:
    """Distinct (basket, item) rows; a null basket or item takes no part."""
    return df.select(F.col(basket).alias("basket"), item.alias("item")).filter("basket is not null and item is not null").distinct()


def pair_counts(items: DataFrame, min_pairs: int = 1, most: "F.Column | None" = None, chunk: int = CHUNK) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab) with item_a < item_b, of pairs in at least ``min_pairs`` baskets.

    ``items``: distinct (basket, item). An item in fewer than ``min_pairs`` baskets is in no such pair and is
    left out before any pair is made; so are items in more than ``most`` baskets, if the caller can prove that
    they form no wanted pair. Baskets of one item give no pair. Ties and repeats cannot occur in the input.
    """
    items = materialize(items)
    singles = items.groupBy("item").agg(F.count("*").alias("n"))
    if most is not None:
        singles = singles.filter(F.col("n") <= most)
    singles = materialize(singles.filter(F.col("n") >= min_pairs))
    kept = materialize(skew_join(items, singles, "item", "n"))
    sizes = kept.groupBy("basket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.count("*").alias("size")).filter("size > 1")
    large = materialize(sizes.filter("chunks > 1").drop("size"))
    member = F.struct("item", "n")
    # ordinary baskets: at most ``chunk`` items a group
    small = kept.join(F.broadcast(large.select("basket")) if _few(large) else large.select("basket"), "basket", "left_anti")
    whole = small.groupBy("basket").agg(F.sort_array(F.collect_list(member)).alias("x")).filter(F.size("x") > 1)
    parts = _pairs_within(whole)
    if large.take(1):
        chunked = kept.join(F.broadcast(large) if _few(large) else large, "basket").withColumn("c", F.pmod(F.xxhash64("item"), F.col("chunks")))
        # each item goes to the pairs of its chunk with every chunk
        spread = chunked.select(
            "basket", "item", "n", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d")
        ).select("basket", F.least("c", "d").alias("c1"), F.greatest("c", "d").alias("c2"), "item", "n", "c")
        blocks = spread.groupBy("basket", "c1", "c2").agg(
            F.sort_array(F.collect_list(F.when(F.col("c") == F.col("c1"), member))).alias("x"),
            F.sort_array(F.collect_list(F.when(F.col("c") != F.col("c1"), member))).alias("y"),
        )
        parts = parts.unionByName(_pairs_within(blocks.filter("c1 = c2"))).unionByName(_pairs_across(blocks.filter("c1 < c2")))
    return (
        parts.groupBy("item_a", "item_b")
        .agg(F.count("*").alias("n_ab"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
        .filter(F.col("n_ab") >= min_pairs)
        .select("item_a", "item_b", "n_a", "n_b", "n_ab")
    )


def _few(df: DataFrame, most: int = 100_000) -> bool:
    """Whether a table is so short that it may be broadcast; counted, not estimated."""
    return df.count() <= most


def _pairs_within(groups: DataFrame) -> DataFrame:
    """Pairs of the sorted array ``x``: each item with those behind it."""
    return (
        groups.select(F.posexplode("x").alias("at", "a"), "x")
        .select("a", F.explode(F.expr("slice(x, at + 2, size(x))")).alias("b"))
        .select(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    )


def _pairs_across(groups: DataFrame) -> DataFrame:
    """Pairs of one item of ``x`` with one of ``y``, put in order."""
    return (
        groups.select(F.explode("x").alias("p"), "y")
        .select("p", F.explode("y").alias("q"))
        .select(
            F.when(F.col("p.item") < F.col("q.item"), F.col("p")).otherwise(F.col("q")).alias("a"),
            F.when(F.col("p.item") < F.col("q.item"), F.col("q")).otherwise(F.col("p")).alias("b"),
        )
        .select(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    )


def association(pairs: DataFrame, total: "F.Column") -> DataFrame:
    """Adds expected count, lift, PMI (bits), normalised PMI, Jaccard and log-likelihood G2 to pair counts.

    ``total``: number of baskets. Normalised PMI is 1 where the pair is in every basket. G2 takes 0 log 0 as 0.
    """
    a, b, ab = (F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab"))
    t = F.col("_total").cast("double")

    def term(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    g2 = 2 * (
        term(ab, a * b / t)
        + term(a - ab, a * (t - b) / t)
        + term(b - ab, (t - a) * b / t)
        + term(t - a - b + ab, (t - a) * (t - b) / t)
    )
    pmi = F.log2(ab * t / (a * b))
    return (
        pairs.withColumn("_total", total)
        .withColumn("expected", a * b / t)
        .withColumn("lift", ab * t / (a * b))
        .withColumn("pmi", pmi)
        .withColumn("npmi", F.when(ab >= t, 1.0).otherwise(pmi / -F.log2(ab / t)))
        .withColumn("jaccard", ab / (a + b - ab))
        .withColumn("g2", g2)
        .drop("_total")
    )


def mention_items(clusters: DataFrame) -> DataFrame:
    """(basket, item): record id and mention surface, spelling aside, of a mention-cluster table."""
    from weftmark.llm.common import plain

    surfaces = clusters.select("id", F.explode("mentions.surface").alias("surface"))
    return basket_items(surfaces, "id", plain(F.col("surface")))


def unusual_pairs(clusters: DataFrame, min_pairs: int = 5, min_lift: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Pairs of mention surfaces in at least ``min_pairs`` records and ``min_lift`` times the expected number.

    As n_ab is at most the smaller of n_a and n_b, an item in more than total / min_lift records is in no such pair.
    """
    total = n_records(clusters, "id")
    pairs = pair_counts(mention_items(clusters), min_pairs, total / min_lift, chunk)
    return pairs.filter(F.col("n_ab") * n_records(clusters, "id") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
