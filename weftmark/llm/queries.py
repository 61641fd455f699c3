"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.llm import cooccurrence, garbled, lookalike, mixing, neighbors, overlap, splitting, termfreq, tokenize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark, d):
    return cooccurrence.unusual_pairs(table(spark, d, "mini_clusters_ecb")).select(F.col("item_a").alias("surface_a"), F.col("item_b").alias("surface_b"))


def p1_scores(spark, d):
    clusters = table(spark, d, "mini_clusters_ecb")
    pairs = cooccurrence.pair_counts(cooccurrence.mention_items(clusters))
    scored = cooccurrence.association(pairs, cooccurrence.n_records(clusters, "id"))
    return scored.select(
        F.col("item_a").alias("surface_a"), F.col("item_b").alias("surface_b"), "n_a", "n_b", "n_ab", *[F.round(c, 6).alias(c) for c in ("expected", "lift", "pmi", "jaccard", "g2")]
    )


def p4_found(spark, d):
    return p4_terms(spark, d).filter("mark <> 'usual'").select("field", "term", "mark")


def p4_terms(spark, d):
    return termfreq.corpus_terms(table(spark, d, "mini_inspec"), table(spark, d, "mini_clusters_ecb"), table(spark, d, "documents"))


def p7_found(spark, d):
    return splitting.split_texts(table(spark, d, "documents"), "doc_id").filter("unit_order = 0").select("doc_id")


def p7_pieces(spark, d):
    return splitting.split_texts(table(spark, d, "documents"), "doc_id")


def p8_ids(spark, d):
    return tokenize.encode_texts(table(spark, d, "documents"), "doc_id")


def p9_selection(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p2_found(spark, d):
    return lookalike.disguised_mentions(table(spark, d, "mentions"), table(spark, d, "concepts"))


def p2_forms(spark, d):
    return lookalike.unified_forms(table(spark, d, "mentions"), table(spark, d, "concepts"))


def p5_found(spark, d):
    return neighbors.similar_pairs(table(spark, d, "concepts"))


def p5_neighbors(spark, d):
    concepts = table(spark, d, "concepts")
    labels = concepts.select(F.col("id").alias("neighbor_id"), F.col("label").alias("neighbor_label")).dropDuplicates(["neighbor_id"])
    return neighbors.neighbors(concepts).join(labels, "neighbor_id").select("id", "rank", "neighbor_id", "neighbor_label", F.round("cosine", 5).alias("cosine"))


def _splits(spark, d):
    return overlap.split_overlaps({name: table(spark, d, name) for name in ("mini_inspec", "mini_clusters_ecb")})


def p6_found(spark, d):
    return overlap.overlap_pairs(*_splits(spark, d))


def p6_counts(spark, d):
    return overlap.overlap_counts(*_splits(spark, d))


def p10_found(spark, d):
    return garbled.garbled(table(spark, d, "documents"), "doc_id", rounds=1).select("doc_id")


def p10_restored(spark, d):
    return garbled.garbled(table(spark, d, "documents"), "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p5_found": p5_found,
    "p5_neighbors": p5_neighbors,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p8_ids": p8_ids,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}


def _plain(x: str) -> str:
    return f"lower(regexp_replace(trim({x}), ' +', ' ', 'g'))"


_ITEMS = f"""items as (select distinct id as basket, {_plain('m.surface')} as item
  from (select id, unnest(mentions) as m from mini_clusters_ecb) where m.surface is not null and trim(m.surface) <> '' and id is not null),
singles as (select item, count(*) as n from items group by 1),
total as (select count(distinct id) as t from mini_clusters_ecb),
pairs as (select a.item as a, b.item as b, count(*) as n_ab from items a join items b on a.basket = b.basket and a.item < b.item group by 1, 2),
full_pairs as (select p.a as surface_a, p.b as surface_b, x.n as n_a, y.n as n_b, p.n_ab, t from pairs p join singles x on x.item = p.a join singles y on y.item = p.b, total)"""

_TERMS = f"""raw as (
  select 'keyphrases' as field, id as rec, unnest(keyphrases) as v, unnest(range(len(keyphrases))) as place from mini_inspec
  union all select 'surface', id, m.surface, place from (select id, unnest(mentions) as m, unnest(range(len(mentions))) as place from mini_clusters_ecb)
  union all select 'term', cast(doc_id as varchar), term, 0 from documents),
rows_ as (select distinct field, rec, {_plain('v')} as term, place from raw where v is not null and trim(v) <> ''),
counts as (select field, term, count(*) as occurrences, count(distinct rec) as records from rows_ group by 1, 2),
totals as (select 'keyphrases' as field, count(distinct id) as t from mini_inspec union all select 'surface', count(distinct id) from mini_clusters_ecb
  union all select 'term', count(distinct doc_id) from documents),
marks as (select field, term, occurrences, records, case when records < 3 then 'rare' when records * 100 > t * 5 then 'common' else 'usual' end as mark
  from counts join totals using (field))"""

_SETS = f"""recs as (select 'mini_inspec' as corpus, id, {_plain('split')} as split, source, text from mini_inspec
  union select 'mini_clusters_ecb', id, {_plain('split')}, source, text from mini_clusters_ecb),
sets as (select corpus, id, split, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from recs
  where split is not null and text is not null and len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) >= 8),
alike as (select a.corpus, a.id as x, b.id as y from sets a join sets b on a.corpus = b.corpus and a.split = 'train' and b.split <> 'train'
  and len(a.w) * 5 >= len(b.w) * 4 and len(b.w) * 5 >= len(a.w) * 4
  where len(list_intersect(a.w, b.w)) * 9 >= (len(a.w) + len(b.w)) * 4)"""

ORACLE = {
    "p1_found": f"with {_ITEMS} select surface_a, surface_b from full_pairs where n_ab >= 5 and n_ab * t >= 4 * n_a * n_b",
    "p1_scores": f"""with {_ITEMS} select surface_a, surface_b, n_a, n_b, n_ab, round(n_a::double * n_b / t, 6) as expected,
round(n_ab::double * t / (n_a::double * n_b), 6) as lift, round(log2(n_ab::double * t / (n_a::double * n_b)), 6) as pmi,
round(n_ab::double / (n_a + n_b - n_ab), 6) as jaccard,
round(2 * (n_ab * ln(n_ab / (n_a::double * n_b / t))
 + case when n_a > n_ab then (n_a - n_ab) * ln((n_a - n_ab) / (n_a::double * (t - n_b) / t)) else 0 end
 + case when n_b > n_ab then (n_b - n_ab) * ln((n_b - n_ab) / ((t - n_a)::double * n_b / t)) else 0 end
 + case when t - n_a - n_b + n_ab > 0 then (t - n_a - n_b + n_ab) * ln((t - n_a - n_b + n_ab) / ((t - n_a)::double * (t - n_b) / t)) else 0 end), 6) as g2
from full_pairs""",
    "p4_found": f"with {_TERMS} select field, term, mark from marks where mark <> 'usual'",
    "p4_terms": f"with {_TERMS} select field, term, occurrences, records, mark from marks",
    "p6_found": f"with {_SETS} select corpus, least(x, y) as id_a, greatest(x, y) as id_b from alike group by all",
    "p6_counts": f"""with {_SETS}, hits as (select distinct corpus, y from alike)
select s.corpus, s.split, s.source, count(distinct s.id) as records, count(distinct h.y) as overlapping
from sets s left join hits h on h.corpus = s.corpus and h.y = s.id where s.split <> 'train' group by 1, 2, 3""",
    "p7_found": "select doc_id from documents where length(text) > 2000",
}
