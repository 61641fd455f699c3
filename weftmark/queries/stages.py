"""Queries of the stages: segment, extract, score, embed, resolve, induce, integrate, and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmark.functions import vectors
from weftmark.operators import extract, graph, induce, resolve, score, segment
from weftmark.queries.common import (
    COMPOUND, COOC, EXACT, FREQUENCY, HEARST, MENTIONS, UNITS, WS, documents, mentions, sql_low, sql_strip, sql_trigrams, table, units,
)
from weftmark.runtime import materialize

UNIT = ["doc_id", "unit_id", "unit_order", "kind", "text"]
DIM = vectors.DIM


def seg_block(spark, d):
    return segment.block(documents(spark, d)).select(*UNIT)


def seg_sentence(spark, d):
    return segment.sentence(documents(spark, d)).select(*UNIT)


def seg_turn(spark, d):
    return segment.turn(documents(spark, d)).select(*UNIT, "speaker")


def ext_token(spark, d):
    return extract.token(units(spark, d)).select("unit_id", "ord", "surface", "span_start", "span_end")


def ext_gazetteer(spark, d):
    return extract.gazetteer(units(spark, d), table(spark, d, "documents").select("term")).select("unit_id", "ord", "surface", "span_start", "span_end", "context")


def _gold(spark, d):
    return table(spark, d, "mini_clusters_ecb").dropDuplicates(["id"]).filter("text is not null")


def ext_gold_mentions(spark, d):
    gold = _gold(spark, d).select(F.col("id").alias("doc_id"), "text", "mentions")
    whole = gold.select(F.xxhash64("doc_id").alias("doc_pos"), "doc_id", F.concat("doc_id", F.lit(":u0")).alias("unit_id"), F.lit(0).alias("unit_order"), "text")
    return extract.gold_mentions(whole, gold).select("doc_id", "ord", "surface", "span_start", "span_end")


def ext_gold_spans(spark, d):
    """Context windows of the gold mentions."""
    gold = _gold(spark, d).select(F.col("id").alias("doc_id"), "text", "mentions")
    whole = gold.select(F.xxhash64("doc_id").alias("doc_pos"), "doc_id", F.concat("doc_id", F.lit(":u0")).alias("unit_id"), F.lit(0).alias("unit_order"), "text")
    return extract.gold_mentions(whole, gold).select("doc_id", "ord", "context")


def _inputs(spark, d):
    u = units(spark, d)
    return u, mentions(spark, d, u)


def _scores(rows):
    return rows.select("doc_id", "surface", F.round("salience", 6).alias("salience"), "selected").distinct()


def score_frequency(spark, d):
    return _scores(score.frequency(_inputs(spark, d)[1]))


def score_passthrough(spark, d):
    return score.passthrough(_inputs(spark, d)[1]).select("ord", "salience", "selected")


def score_embedding_cosine(spark, d):
    u, m = _inputs(spark, d)
    return _scores(score.embedding_cosine(m, u)).drop("selected")


def score_mderank(spark, d):
    u, m = _inputs(spark, d)
    return _scores(score.mderank(m, u)).drop("selected")


def score_hcuke(spark, d):
    u, m = _inputs(spark, d)
    return _scores(score.hcuke(m, u)).drop("selected")


def embed_hashing(spark, d):
    labels = table(spark, d, "concepts").select("label").filter("label is not null").distinct()
    return vectors.trigram_buckets(labels, ["label"], "label")


def vec_cosine(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


def store_nearest(spark, d):
    rows = table(spark, d, "embeddings").dropDuplicates(["vec_id"]).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("vector"))
    store = rows.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("v").alias("embedding"))
    return resolve.nearest_concepts(asked, store, 5, DIM).select("query", "rank", "id", F.round("cosine", 5).alias("cosine"))


def _selected(spark, d):
    u, m = _inputs(spark, d)
    return u, score.frequency(m)


def _exact(spark, d):
    u, m = _selected(spark, d)
    return u, materialize(resolve.exact_label(m))


def resolve_exact(spark, d):
    return graph.concepts(_exact(spark, d)[1])


def resolve_nn(spark, d):
    return resolve.embedding_nn(_selected(spark, d)[1], 0.9).select("doc_id", "unit_order", "ord", "surface", "concept_id", "concept_label", "is_new")


def induce_cooccurrence(spark, d):
    return induce.co_occurrence(_exact(spark, d)[1]).select("doc_id", "type", "source_id", "target_id")


def induce_compound(spark, d):
    return induce.compound(_exact(spark, d)[1]).select("doc_id", "type", "source_id", "target_id")


def induce_hearst(spark, d):
    u, r = _exact(spark, d)
    return induce.hearst(r, u).select("doc_id", "type", "source_id", "target_id")


def _union(spark, d):
    u, r = _exact(spark, d)
    return u, r, induce.union([induce.hearst(r, u), induce.compound(r), induce.co_occurrence(r)])


def induce_union(spark, d):
    return _union(spark, d)[2].groupBy("doc_id", "type", "source_id", "target_id").agg(F.count("*").alias("times"))


def graph_concepts(spark, d):
    return graph.concepts(_exact(spark, d)[1]).select("id", "label")


def graph_relations(spark, d):
    return graph.relations(_union(spark, d)[2]).select("type", "source_id", "target_id", "provenance")


def graph_delta(spark, d):
    _, r, i = _union(spark, d)
    return graph.deltas(documents(spark, d), r, i).select("doc_id", "concepts_added", "concepts_updated", "relations_added")


def pipeline_walking(spark, d):
    """Block units, tokens, top ten by frequency, exact labels, co-occurrence: concepts' relations from raw documents."""
    docs = documents(spark, d).repartition("doc_pos")
    rows = resolve.exact_label(score.frequency(extract.token(segment.block(docs))))
    return graph.relations(induce.co_occurrence(materialize(rows))).select("type", "source_id", "target_id", "provenance")


def _view(spark, d):
    return graph.GraphView(table(spark, d, "concepts").dropDuplicates(["id"]), table(spark, d, "relations").dropDuplicates(["type", "source_id", "target_id"]))


def view_find(spark, d):
    return _view(spark, d).find_concept("Common Brass Fixture").select("id", "label")


def view_relations(spark, d):
    return _view(spark, d).relations("IS_A").select("source_id", "target_id")


def view_neighbors(spark, d):
    view = _view(spark, d)
    return view.neighbors(view.concepts().select("id"), "IS_A")


def _plain_view(spark, d):
    """View with the spelling of types put aside; null types and ends take no part."""
    kind = F.upper(F.regexp_replace(F.trim("type"), " +", " "))
    rows = table(spark, d, "relations").filter("type is not null and source_id is not null and target_id is not null")
    return graph.GraphView(table(spark, d, "concepts").dropDuplicates(["id"]), rows.select(kind.alias("type"), "source_id", "target_id").distinct())


def view_relations_plain(spark, d):
    return _plain_view(spark, d).relations("IS_A").select("source_id", "target_id")


def view_neighbors_all(spark, d):
    """Relations of all types of every concept, in both directions."""
    view = _plain_view(spark, d)
    return view.neighbors(view.concepts().select("id"))


QUERIES = {
    f.__name__: f
    for f in (
        seg_block, seg_sentence, seg_turn, ext_token, ext_gazetteer, ext_gold_mentions, ext_gold_spans, score_frequency, score_passthrough, score_embedding_cosine, score_mderank, score_hcuke,
        embed_hashing, vec_cosine, store_nearest, resolve_exact, resolve_nn, induce_cooccurrence, induce_compound, induce_hearst, induce_union, graph_concepts, graph_relations, graph_delta,
        pipeline_walking, view_find, view_relations, view_neighbors, view_relations_plain, view_neighbors_all,
    )
}


def _seg(kind: str, pieces: str) -> str:
    return f"""with p as (select id as doc_id, list_filter(list_transform({pieces}, lambda x: {sql_strip('x')}), lambda x: x <> '') as w from documents where text is not null)
select doc_id, doc_id || ':u' || i as unit_id, i::int as unit_order, '{kind}' as kind, w[i + 1] as text from (select doc_id, w, unnest(range(len(w))) as i from p)"""


_TOKEN = """toks as (select doc_pos, unit_order, unit_id, t, g, i from (select doc_pos, unit_order, unit_id, regexp_extract_all(text, '{p}') as t, regexp_split_to_array(text, '{p}') as g from {src}), unnest(range(len(t))) as x(i)),
spans as (select doc_pos, unit_order, unit_id, i::int as ord, t[i + 1] as match, sum(length(g[i + 1]) + length(t[i + 1])) over (partition by doc_pos, unit_order order by i)::int as span_end from toks)"""
_PLAIN = "e as (select distinct upper(regexp_replace(trim(type), ' +', ' ', 'g')) as type, source_id, target_id from relations where type is not null and source_id is not null and target_id is not null)"
_DOC = "doc as (select doc_pos, string_agg(text, chr(10) order by unit_order) as text from u group by 1)"
_COS = f"""{MENTIONS}, {_DOC},
pairs as (select distinct doc_pos, doc_id, surface from m),
sv as materialized ({sql_trigrams('(select distinct surface from pairs)', 'surface', 'surface')}),
dv as materialized ({sql_trigrams('doc', 'doc_pos', 'text')}),
sq as (select surface, sum(n * n) as q from sv group by 1), dq as (select doc_pos, sum(n * n) as q from dv group by 1),
dots as (select p.doc_pos, p.surface, sum(sv.n * dv.n) as dot from pairs p join sv on sv.surface = p.surface join dv on dv.doc_pos = p.doc_pos and dv.bucket = sv.bucket group by 1, 2)"""

ORACLE = {
    "seg_block": _seg("block", "string_split(text, chr(10) || chr(10))"),
    "seg_sentence": _seg("sentence", f"string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"),
    "ext_token": f"with {UNITS}, {_TOKEN.format(p='[A-Za-z][A-Za-z-]+', src='u')} select unit_id, ord, lower(match) as surface, span_end - length(match)::int as span_start, span_end from spans where length(match) >= 4",
    "ext_gold_mentions": """with g as (select distinct on (id) id, mentions from mini_clusters_ecb where text is not null order by id)
select id as doc_id, i::int as ord, mentions[i + 1].surface as surface, mentions[i + 1].span_start as span_start, mentions[i + 1].span_end as span_end from g, unnest(range(len(mentions))) as x(i)""",
    "ext_gold_spans": """with g as (select distinct on (id) id, text, mentions from mini_clusters_ecb where text is not null order by id)
select id as doc_id, i::int as ord, substr(text, greatest(mentions[i + 1].span_start - 40, 0) + 1, mentions[i + 1].span_end + 40 - greatest(mentions[i + 1].span_start - 40, 0)) as context from g, unnest(range(len(mentions))) as x(i)""",
    "score_frequency": f"with {FREQUENCY} select distinct doc_id, surface, round(salience, 6) as salience, selected from ranked",
    "score_passthrough": f"with {MENTIONS} select ord, 1.0::double as salience, true as selected from m",
    "score_embedding_cosine": f"""with {_COS}
select distinct p.doc_id, p.surface, round(coalesce(dot / sqrt(sq.q::double * dq.q), 0), 6) as salience
from pairs p left join dots using (doc_pos, surface) left join sq on sq.surface = p.surface left join dq on dq.doc_pos = p.doc_pos""",
    "embed_hashing": sql_trigrams("(select distinct label from concepts where label is not null)", "label", "label"),
    "vec_cosine": """with e as (select distinct on (vec_id) vec_id, embedding::double[] as v from embeddings order by vec_id)
select a.vec_id, round(list_cosine_similarity(a.v, b.v), 5) as cosine from e a join e b on b.vec_id = a.vec_id + 1""",
    "store_nearest": """with e as (select distinct on (vec_id) vec_id, embedding::double[] as v from embeddings order by vec_id),
r as (select q.vec_id as query, lpad(c.vec_id::varchar, 12, '0') as id, round(list_cosine_similarity(q.v, c.v), 12) as cosine from e q, e c where q.vec_id % 100 = 0)
select query, rank::int as rank, id, round(cosine, 5) as cosine from (select *, row_number() over (partition by query order by cosine desc, id) as rank from r) where rank <= 5""",
    "resolve_exact": f"""with {EXACT}
select concept_id as id, any_value(label) as label, arg_min(doc_id, (doc_pos, unit_order, ord)) as first_seen, arg_max(doc_id, (doc_pos, unit_order, ord)) as updated_at from res group by 1""",
    "induce_cooccurrence": f"with {EXACT}, {COOC} select doc_id, type, source_id, target_id from cooc",
    "induce_compound": f"with {EXACT}, {COMPOUND} select doc_id, type, source_id, target_id from comp",
    "induce_hearst": f"with {EXACT}, {HEARST} select doc_id, type, source_id, target_id from hear",
    "induce_union": f"""with {EXACT}, {COOC}, {COMPOUND}, {HEARST}
select doc_id, type, source_id, target_id, count(*) as times from (select * from cooc union all select * from comp union all select * from hear) group by 1, 2, 3, 4""",
    "graph_concepts": f"with {EXACT} select distinct concept_id as id, label from res",
    "graph_relations": f"""with {EXACT}, {COOC}, {COMPOUND}, {HEARST}
select type, source_id, target_id, arg_max(doc_id, doc_pos) as provenance from (select * from cooc union all select * from comp union all select * from hear) group by 1, 2, 3""",
    "graph_delta": f"""with {EXACT}, {COOC}, {COMPOUND}, {HEARST},
e as (select doc_pos, concept_id, bool_or(is_new) as new_ from res group by 1, 2), c as (select doc_pos, count(*) filter (where new_) as a, count(*) filter (where not new_) as b from e group by 1),
r as (select doc_pos, count(*) as n from (select * from cooc union all select * from comp union all select * from hear) group by 1)
select id as doc_id, coalesce(a, 0)::bigint as concepts_added, coalesce(b, 0)::bigint as concepts_updated, coalesce(n, 0)::bigint as relations_added
from documents left join c on c.doc_pos = doc_id left join r on r.doc_pos = doc_id""",
    "pipeline_walking": f"""with blocks as ({_seg('block', "string_split(text, chr(10) || chr(10))")}),
src as (select cast(substr(doc_id, 5) as bigint) as doc_pos, unit_order, unit_id, text from blocks),
{_TOKEN.format(p='[A-Za-z][A-Za-z-]+', src='src')},
m as (select doc_pos, unit_order, lower(match) as surface from spans where length(match) >= 4),
counted as (select *, count(*) over (partition by doc_pos, surface) as n from m), scored as (select *, n::double / max(n) over (partition by doc_pos) as s from counted),
ranked as (select *, dense_rank() over (partition by doc_pos order by s desc, surface) <= 10 as selected from scored),
h as (select distinct surface as label, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('concept:' || surface)) as h from ranked where selected),
ids as (select label, (substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', cast('0x' || substr(h, 17, 1) as int) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) as concept_id from h),
res as (select distinct r.doc_pos, r.unit_order, i.concept_id from ranked r join ids i on i.label = r.surface where r.selected)
select 'CO_OCCURS' as type, a.concept_id as source_id, b.concept_id as target_id, 'doc-' || max(a.doc_pos) as provenance
from res a join res b on a.doc_pos = b.doc_pos and a.unit_order = b.unit_order and a.concept_id < b.concept_id group by 2, 3""",
    "view_find": "select id, label from concepts where lower(label) = 'common brass fixture' order by id desc limit 1",
    "view_relations": "select distinct source_id, target_id from relations where type = 'IS_A'",
    "view_neighbors": """with e as (select distinct type, source_id, target_id from relations where type = 'IS_A'), c as (select distinct on (id) id, label from concepts order by id),
o as (select source_id as id, target_id as other_id, * from e union all select target_id, source_id, * from e where source_id <> target_id)
select o.id, o.other_id, b.label as other_label, o.type, o.source_id, o.target_id from o join c a on a.id = o.id join c b on b.id = o.other_id""",
    "view_relations_plain": f"with {_PLAIN} select source_id, target_id from e where type = 'IS_A'",
    "view_neighbors_all": f"""with {_PLAIN}, c as (select distinct on (id) id, label from concepts order by id),
o as (select source_id as id, target_id as other_id, * from e union all select target_id, source_id, * from e where source_id <> target_id)
select o.id, o.other_id, b.label as other_label, o.type, o.source_id, o.target_id from o join c a on a.id = o.id join c b on b.id = o.other_id""",
}
