"""Queries of the metrics and of the resampling statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.operators import extract, hierarchy, metrics, resolve, score, segment
from weftmark.plans import stats
from weftmark.queries.common import MENTIONS, sql_low, sql_strip, sql_trigrams, table, units, mentions
from weftmark.runtime import materialize

SAMPLES, SEED = 100, 0
ORDERS = 5


def _concepts(spark, d):
    return table(spark, d, "concepts").dropDuplicates(["id"])


def _relations(spark, d):
    kind = F.upper(F.regexp_replace(F.trim("type"), " +", " "))
    rows = table(spark, d, "relations").filter("type is not null and source_id is not null and target_id is not null")
    return rows.select(kind.alias("type"), "source_id", "target_id").distinct()


def metric_label_f1(spark, d):
    gold = table(spark, d, "documents").filter("term is not null").select(F.col("term").alias("label"))
    return _rounded(metrics.label_f1(_concepts(spark, d).filter("label is not null"), gold))


def metric_edge_f1(spark, d):
    """IS_A relations against the edges from each label to the label that is its last word."""
    concepts = _concepts(spark, d).filter("label is not null")
    low = concepts.select(F.lower("label").alias("hypo")).distinct()
    ends = low.withColumn("hyper", F.substring_index("hypo", " ", -1)).filter("hyper <> hypo")
    gold = ends.join(low.select(F.col("hypo").alias("hyper")), "hyper", "left_semi")
    return _rounded(metrics.edge_f1(concepts, _relations(spark, d), gold))


def metric_redundancy(spark, d):
    return _rounded(metrics.redundancy(_concepts(spark, d), 0.9))


def metric_hierarchy(spark, d):
    return metrics.hierarchy_sanity(_relations(spark, d))


def hierarchy_shortcuts(spark, d):
    edges = materialize(hierarchy.typed_edges(table(spark, d, "relations")))
    return hierarchy.shortcut_edges(edges)


def _keyphrases(spark, d):
    """Selected mentions of the keyphrase records, and the records."""
    records = table(spark, d, "mini_inspec").filter("text is not null").dropDuplicates(["id"])
    docs = records.select(F.xxhash64("id").alias("doc_pos"), F.col("id").alias("doc_id"), "text")
    rows = score.frequency(extract.token(segment.sentence(docs.repartition("doc_pos"))), 15)
    return rows.filter("selected").select("doc_id", "surface", "salience"), records.select(F.col("id").alias("doc_id"), "keyphrases")


def metric_f1_at_k(spark, d):
    return _rounded(metrics.f1_at_k(*_keyphrases(spark, d)))


def _gold_mentions(spark, d):
    rows = table(spark, d, "mini_clusters_ecb").dropDuplicates(["id"]).select("id", F.explode("mentions").alias("m"))
    return rows.filter("m.surface is not null and m.cluster is not null").select("id", "m.span_start", "m.span_end", "m.surface", F.col("m.cluster").alias("gold")).distinct()


def metric_clustering(spark, d):
    """Clusters by exact label against the gold clusters."""
    from weftmark.functions.text import label

    return _rounded(metrics.clustering(_gold_mentions(spark, d).select(label(F.col("surface")).alias("predicted"), "gold")))


def metric_coherence(spark, d):
    return _rounded(metrics.coherence(_gold_mentions(spark, d).select(F.col("gold").alias("concept_id"), "surface")))


def _records(spark, d):
    """A record a document: its mentions and how many of them begin with a capital."""
    u = units(spark, d)
    rows = mentions(spark, d, u)
    return rows.groupBy("doc_pos").agg(F.count("*").alias("n"), F.count_if(F.col("surface").rlike("^[A-Z]")).alias("c"))


def stats_draws(spark, d):
    n = table(spark, d, "documents").count()
    return stats.draws(n, 10, SEED, spark).groupBy("position").agg(F.count("*").alias("times"))


def stats_bootstrap(spark, d):
    rows = stats.bootstrap(_records(spark, d), "doc_pos", [F.sum("n").alias("n"), F.sum("c").alias("c")], SAMPLES, SEED)
    return rows.select("sample", F.round(F.col("c") / F.col("n"), 9).alias("share"))


def stats_jackknife(spark, d):
    rows = stats.jackknife_sums(_records(spark, d), "doc_pos", ["n", "c"])
    return rows.select("doc_pos", F.round(F.col("c") / F.col("n"), 9).alias("share"))


def stats_intervals(spark, d):
    """Percentile interval of the bootstrapped share."""
    low, high = F.expr("percentile(share, 0.025)"), F.expr("percentile(share, 0.975)")
    return stats_bootstrap(spark, d).agg(F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"))


def stats_bca(spark, d):
    """BCa interval; the resampled shares reach the driver, the jackknife only as two sums."""
    records = materialize(_records(spark, d))
    total = records.agg(F.sum("c") / F.sum("n")).first()[0]
    boot = [r["share"] for r in stats_bootstrap(spark, d).collect()]
    left = stats.jackknife_sums(records, "doc_pos", ["n", "c"]).select((F.col("c") / F.col("n")).alias("j"))
    mean = left.agg(F.avg("j").alias("mean"))
    gap = F.col("mean") - F.col("j")
    sums = left.withColumn("_k", F.lit(1)).join(F.broadcast(mean.withColumn("_k", F.lit(1))), "_k").agg(F.sum(gap**2), F.sum(gap**3)).first()
    span = stats.bca_from_moments(total, boot, sums[0], sums[1])
    return spark.createDataFrame([(round(total, 6), round(span.lo, 6), round(span.hi, 6), span.method)], "estimate double, lo double, hi double, method string")


def stats_paired_delta(spark, d):
    """Share of capitals in mentions less that in distinct surfaces, over the same draws."""
    u = units(spark, d)
    rows = mentions(spark, d, u)
    capital = F.col("surface").rlike("^[A-Z]")
    records = rows.groupBy("doc_pos").agg(F.count("*").alias("n"), F.count_if(capital).alias("c"), F.count_distinct("surface").alias("n2"), F.count_distinct(F.when(capital, F.col("surface"))).alias("c2"))
    boot = stats.bootstrap(records, "doc_pos", [F.sum(c).alias(c) for c in ("n", "c", "n2", "c2")], SAMPLES, SEED)
    gap = boot.select((F.col("c") / F.col("n") - F.col("c2") / F.col("n2")).alias("gap"))
    return gap.agg(F.round(F.expr("percentile(gap, 0.025)"), 6).alias("lo"), F.round(F.expr("percentile(gap, 0.975)"), 6).alias("hi"), F.round(F.avg((F.col("gap") > 0).cast("double")), 6).alias("prob_positive"))


def stats_order_spread(spark, d):
    rows = stats.spread(stats_bootstrap(spark, d), "share")
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


def stats_order_runs(spark, d):
    """Spread of the clustering metrics over seeded orders of the records, each resolved anew by nearest embedding."""
    rows = _gold_mentions(spark, d).filter("trim(surface) <> ''")
    place = F.row_number().over(Window.partitionBy("id").orderBy("span_start", "span_end", "surface", "gold"))
    gold = materialize(rows.select(F.col("id").alias("doc_id"), place.alias("ord"), "surface", "span_start", "span_end", "gold"))
    runs = None
    for k in range(ORDERS):
        order = F.xxhash64(F.lit(SEED), F.lit(k), F.col("doc_id"))
        found = gold.drop("gold").select(order.alias("doc_pos"), "*", F.lit(0).alias("unit_order"), F.concat("doc_id", F.lit(":u0")).alias("unit_id"), F.lit(True).alias("selected"))
        resolved = resolve.embedding_nn(found, 0.9).select("doc_id", "ord", F.col("concept_id").alias("predicted"))
        run = materialize(metrics.clustering(resolved.join(gold.select("doc_id", "ord", "gold"), ["doc_id", "ord"])))
        runs = run if runs is None else runs.unionByName(run)
    out = None
    for c in runs.columns:
        row = stats.spread(runs, c).select(F.lit(c).alias("metric"), *[F.round(x, 6).alias(x) for x in ("min", "max", "range", "std")])
        out = row if out is None else out.unionByName(row)
    return out


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


QUERIES = {
    f.__name__: f
    for f in (
        metric_label_f1, metric_edge_f1, metric_redundancy, metric_hierarchy, hierarchy_shortcuts, metric_f1_at_k, metric_clustering, metric_coherence,
        stats_draws, stats_bootstrap, stats_jackknife, stats_intervals, stats_bca, stats_paired_delta, stats_order_spread, stats_order_runs,
    )
}

_PRF = """coalesce(h / nullif(p, 0), 0) as precision, coalesce(h / nullif(g, 0), 0) as recall"""
_F1 = "round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1"
_C = "c as (select distinct on (id) * from concepts order by id)"
_R = "r as (select distinct upper(regexp_replace(trim(type), ' +', ' ', 'g')) as type, source_id, target_id from relations where type is not null and source_id is not null and target_id is not null)"
_GOLD = """raw as (select distinct on (id) id, mentions from mini_clusters_ecb order by id),
gm as (select distinct id, m.span_start as span_start, m.span_end as span_end, m.surface as surface, m.cluster as gold from (select id, unnest(mentions) as m from raw) where m.surface is not null and m.cluster is not null)"""
_BOOT = f"""{MENTIONS},
rec as (select doc_pos, count(*) as n, count(*) filter (where regexp_matches(surface, '^[A-Z]')) as c, count(distinct surface) as n2,
  count(distinct surface) filter (where regexp_matches(surface, '^[A-Z]')) as c2 from m group by 1),
num as (select *, row_number() over (order by doc_pos) - 1 as position, count(*) over () as size from rec),
grid as (select s as sample, k as slot, cast('0x' || substr(md5('{SEED}-' || s || '-' || k), 1, 12) as bigint) % size as position
  from (select unnest(range({SAMPLES})) as s), (select position as k, size from num)),
boot as (select sample, sum(n) as n, sum(c) as c, sum(n2) as n2, sum(c2) as c2 from grid join num using (position) group by 1),
shares as (select sample, round(c / n, 9) as share from boot)"""

# walks from each child of several parents by its other edges, for every edge of its own
_WALKS = """walk as (select e.child, e.parent, o.parent as place from proper e join proper o on o.child = e.child and o.parent <> e.parent
  union select w.child, w.parent, x.parent from walk w join proper x on x.child = w.place and not (x.child = w.child and x.parent = w.parent)),
shortcuts as (select distinct child, parent from walk where place = parent)"""

ORACLE = {
    "metric_hierarchy": f"""with recursive {_R}, edges as (select source_id as child, target_id as parent from r where type = 'IS_A'), proper as (select * from edges where child <> parent),
pairs as (select child as node, parent as ancestor from proper union select p.node, e.parent from pairs p join proper e on e.child = p.ancestor),
loops as (select a.node, min(b.node) as part from pairs a join pairs b on a.node = b.ancestor and a.ancestor = b.node where a.node in (select node from pairs where node = ancestor) group by 1),
free as (select * from proper where child not in (select node from loops) and parent not in (select node from loops)),
deep as (select child as node, parent as ancestor, 1 as steps from free union select d.node, e.parent, d.steps + 1 from deep d join free e on e.child = d.ancestor), {_WALKS}
select (select count(distinct part) from loops) as cycle_components, (select count(*) from loops) as cycle_nodes, (select count(*) from edges where child = parent) as self_loops,
(select coalesce(max(steps), 0) from deep)::bigint as max_depth, (select count(*) from shortcuts) as transitive_shortcuts, (select count(*) from edges) as is_a_edges""",
    "hierarchy_shortcuts": f"""with recursive {_R}, proper as (select source_id as child, target_id as parent from r where type = 'IS_A' and source_id <> target_id), {_WALKS} select child, parent from shortcuts""",
    "metric_label_f1": f"""with {_C}, a as (select distinct {sql_low('label')} as l from c where label is not null), b as (select distinct {sql_low('term')} as l from documents where term is not null),
x as (select (select count(*) from a where l in (select l from b))::double as h, (select count(*) from a)::double as p, (select count(*) from b)::double as g),
y as (select {_PRF} from x) select {_F1} from y""",
    "metric_edge_f1": f"""with {_C}, {_R}, n as (select id, {sql_low('label')} as l from c where label is not null),
a as (select distinct x.l as hypo, y.l as hyper from r join n x on x.id = source_id join n y on y.id = target_id where type = 'IS_A'),
low as (select distinct l as hypo, list_extract(string_split(l, ' '), -1) as hyper from n),
b as (select hypo, hyper from low where hypo <> hyper and hyper in (select l from n)),
x as (select (select count(*) from a where (hypo, hyper) in (select (hypo, hyper) from b))::double as h, (select count(*) from a)::double as p, (select count(*) from b)::double as g),
y as (select {_PRF}, p::bigint as predicted_edges, g::bigint as gold_edges from x) select {_F1}, predicted_edges, gold_edges from y""",
    "metric_redundancy": f"""with {_C},
n0 as (select id, regexp_replace({sql_strip(sql_low('label'))}, '^(?:a|an|the)[\\s]+', '') as l, case when len(embedding) = 64 then embedding else list_transform(range(64), lambda i: 0.0) end as v from c),
n as (select id, case when length(l) > 3 and l like '%s' and l not like '%ss' then l[:-2] else l end as l, v, list_dot_product(v, v) as q from n0),
near as (select a.id as x, b.id as y from n a join n b on a.id < b.id where a.l = b.l or (a.q > 0 and b.q > 0 and round(list_dot_product(a.v, b.v) / sqrt(a.q * b.q), 12) >= 0.9))
select round((select count(distinct i) from (select x as i from near union all select y from near)) / (select count(*) from c), 6) as duplicate_rate, (select count(*) from near) as near_duplicate_pairs, (select count(*) from c) as concept_count""",
    "metric_clustering": f"""with {_GOLD}, r as (select {sql_low(sql_strip('surface'))} as p, gold as g from gm),
c as (select p, g, count(*)::double as n from r group by 1, 2), cp as (select p, sum(n) as n from c group by 1), cg as (select g, sum(n) as n from c group by 1),
t as (select sum(n) as m, sum(n * (n - 1) / 2) as i from c),
b as (select sum(c.n * c.n / cp.n) / any_value(m) as bp, sum(c.n * c.n / cg.n) / any_value(m) as br from c join cp using (p) join cg using (g), t),
e as (select (select sum(n * (n - 1) / 2) from cp) as a, (select sum(n * (n - 1) / 2) from cg) as b)
select round(bp, 6) as b3_precision, round(br, 6) as b3_recall, round(2 * bp * br / (bp + br), 6) as b3_f1,
round((i - e.a * e.b / (m * (m - 1) / 2)) / ((e.a + e.b) / 2 - e.a * e.b / (m * (m - 1) / 2)), 6) as ari from b, t, e""",
    "metric_coherence": f"""with {_GOLD}, r as (select gold as k, surface from gm), s as (select distinct k, {sql_low('surface')} as x from r),
mu as (select k from s group by 1 having count(*) > 1), us as (select s.* from s join mu using (k)),
v as materialized ({sql_trigrams('(select distinct x from us)', 'x', 'x')}), q as (select x, sum(n * n) as q from v group by 1),
pr as (select a.k, a.x as x, b.x as y from us a join us b on a.k = b.k and a.x < b.x),
ds as (select pr.k, pr.x, pr.y, sum(va.n * vb.n)::double as dot from pr join v va on va.x = pr.x join v vb on vb.x = pr.y and vb.bucket = va.bucket group by 1, 2, 3),
cs as (select pr.k, coalesce(dot, 0) / sqrt(qa.q::double * qb.q) as c from pr left join ds on ds.k = pr.k and ds.x = pr.x and ds.y = pr.y join q qa on qa.x = pr.x join q qb on qb.x = pr.y),
me as (select k, avg(c) as c from cs group by 1)
select round(coalesce((select avg(c) from me), 1), 6) as coherence, (select count(*) from mu) as multi_surface_concepts,
round((select count(*) filter (where n = 1) / count(*) from (select k, count(*) as n from r group by 1)), 6) as singleton_fraction""",
    "stats_draws": """select cast('0x' || substr(md5('0-' || s || '-' || k), 1, 12) as bigint) % n as position, count(*) as times
from (select unnest(range(10)) as s), (select unnest(range((select count(*) from documents))) as k), (select count(*) as n from documents) group by 1""",
    "stats_bootstrap": f"with {_BOOT} select sample, share from shares",
    "stats_jackknife": f"with {_BOOT}, t as (select sum(n) as n, sum(c) as c from rec) select doc_pos, round((t.c - rec.c) / (t.n - rec.n), 9) as share from rec, t",
    "stats_intervals": f"with {_BOOT} select round(quantile_cont(share, 0.025), 6) as lo, round(quantile_cont(share, 0.975), 6) as hi from shares",
    "stats_paired_delta": f"""with {_BOOT}, g as (select c / n - c2 / n2 as gap from boot)
select round(quantile_cont(gap, 0.025), 6) as lo, round(quantile_cont(gap, 0.975), 6) as hi, round(avg((gap > 0)::int), 6) as prob_positive from g""",
    "stats_order_spread": f"with {_BOOT} select round(min(share), 6) as min, round(max(share), 6) as max, round(max(share) - min(share), 6) as range, round(stddev_pop(share), 6) as std from shares",
}
