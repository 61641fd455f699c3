"""Reading of the given tables in the engine's form, and pieces of SQL shared by the oracle texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the scan prunes columns and takes pushed filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_pos, doc_id, text, one partition key for all later windows and groups of a document."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc_pos"), F.col("id").alias("doc_id"), "kind", "text")


def units(spark: SparkSession, d: str) -> DataFrame:
    """Given units, each once: doc_pos, doc_id, unit_id, unit_order, kind, speaker, text."""
    rows = table(spark, d, "units").filter("text is not null and document_id is not null").dropDuplicates(["id"])
    return rows.select(
        F.expr("cast(substring(document_id, 5) as bigint)").alias("doc_pos"), F.col("document_id").alias("doc_id"), F.col("id").alias("unit_id"), "unit_order", "kind", "speaker", "text"
    )


def mentions(spark: SparkSession, d: str, given_units: DataFrame) -> DataFrame:
    """Given mentions, each once, with the document and order of their unit; ``ord`` is the mention's number."""
    rows = table(spark, d, "mentions").filter("surface is not null").dropDuplicates(["mention_id"]).select(
        "unit_id", F.col("mention_id").alias("ord"), "surface", "span_start", "span_end", "context", "head", "lemma"
    )
    return rows.join(given_units.select("unit_id", "doc_pos", "doc_id", "unit_order"), "unit_id")


# RE2 knows white space of ASCII only; this is the class the engine uses.
WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_low(x: str) -> str:
    """Lower case with the small final sigma that the engine's lower gives."""
    return f"lower(regexp_replace({x}, '(\\p{{L}})Σ(\\P{{L}}|$)', '\\1ς\\2', 'g'))"


UNITS = """u as (select distinct on (id) cast(substr(document_id, 5) as bigint) as doc_pos, document_id as doc_id, id as unit_id, unit_order, kind, text
  from units where text is not null and document_id is not null order by id)"""
MENTIONS = f"""{UNITS},
m as (select a.mention_id as ord, a.surface, a.span_start, a.span_end, u.unit_id, u.doc_pos, u.doc_id, u.unit_order
  from (select distinct on (mention_id) * from mentions where surface is not null order by mention_id) a join u on u.unit_id = a.unit_id)"""
FREQUENCY = f"""{MENTIONS},
counted as (select *, count(*) over (partition by doc_pos, surface) as n from m),
scored as (select *, n::double / max(n) over (partition by doc_pos) as salience from counted),
ranked as (select *, dense_rank() over (partition by doc_pos order by salience desc, surface) <= 10 as selected from scored)"""
CONCEPT_ID = """(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', cast('0x' || substr(h, 17, 1) as int) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""
EXACT = f"""{FREQUENCY},
named as (select doc_pos, doc_id, unit_order, unit_id, ord, surface, span_start, span_end, {sql_low(sql_strip('surface'))} as label from ranked where selected),
ids as (select label, {CONCEPT_ID} as concept_id from (select distinct label, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('concept:' || label)) as h from named)),
res as (select n.*, i.concept_id, row_number() over (partition by n.label order by doc_pos, unit_order, ord) = 1 as is_new from named n join ids i using (label))"""
COOC = """cooc as (select distinct a.doc_pos, a.doc_id, 'CO_OCCURS' as type, a.concept_id as source_id, b.concept_id as target_id
  from res a join res b on a.doc_pos = b.doc_pos and a.unit_order = b.unit_order and a.concept_id < b.concept_id)"""
COMPOUND = f"""known as (select distinct doc_pos, doc_id, label, concept_id from res),
split_ as (select *, list_filter(regexp_split_to_array(label, '{WS}+'), lambda x: x <> '') as w from known),
ends as (select doc_pos, doc_id, concept_id, unnest(range(1, len(w))) as i, w from split_ where len(w) > 1),
hits as (select e.doc_pos, e.doc_id, e.concept_id as source_id, k.concept_id as target_id, row_number() over (partition by e.doc_pos, e.concept_id order by e.i) as n
  from ends e join known k on k.doc_pos = e.doc_pos and k.label = array_to_string(e.w[e.i + 1:], ' ')),
comp as (select doc_pos, doc_id, 'IS_A' as type, source_id, target_id from hits where n = 1)"""
_S = WS
HEARST = f"""at_ as (select r.doc_pos, r.doc_id, r.unit_order, r.ord, r.span_start, r.span_end, r.concept_id, u.text,
  row_number() over w as n, lag(span_end) over w as last_end, lead(span_start) over w as next_start, lead(concept_id) over w as next_id
  from res r join u on u.doc_pos = r.doc_pos and u.unit_order = r.unit_order window w as (partition by r.doc_pos, r.unit_order order by span_start, span_end, r.ord)),
isl as (select *, sum(case when last_end <= span_start and regexp_full_match(substr(text, last_end + 1, span_start - last_end), '(?i),{_S}+|,?{_S}+(?:and|or){_S}+') then 0 else 1 end)
  over (partition by doc_pos, unit_order order by span_start, span_end, ord rows unbounded preceding) as island from at_),
conn as (select *, substr(text, span_end + 1, next_start - span_end) as c, substr(text, 1, span_start) as before from isl where next_start >= span_end),
lists as (select doc_pos, doc_id, unit_order, n + 1 as first, concept_id as target_id from conn where
  regexp_full_match(c, '(?i),?{_S}+such{_S}+as{_S}+') or (regexp_full_match(c, '(?i){_S}+as{_S}+') and regexp_matches(before, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])such{_S}+$'))
  or regexp_full_match(c, '(?i),?{_S}+including{_S}+') or regexp_full_match(c, '(?i),?{_S}+especially{_S}+')),
rights as (select doc_pos, doc_id, concept_id as source_id, next_id as target_id from conn where
  regexp_full_match(c, '(?i),?{_S}+and{_S}+other{_S}+') or regexp_full_match(c, '(?i),?{_S}+or{_S}+other{_S}+')
  or regexp_full_match(c, '(?i){_S}+(?:is|are){_S}+an?{_S}+(?:(?:kind|type){_S}+of{_S}+)?')),
lefts as (select l.doc_pos, l.doc_id, b.concept_id as source_id, l.target_id from lists l join isl a on a.doc_pos = l.doc_pos and a.unit_order = l.unit_order and a.n = l.first
  join isl b on b.doc_pos = a.doc_pos and b.unit_order = a.unit_order and b.island = a.island and b.n >= l.first),
hear as (select distinct doc_pos, doc_id, 'IS_A' as type, source_id, target_id from (select * from rights union all select * from lefts) where source_id <> target_id)"""
TRIGRAMS = """select {keys}, cast('0x' || substr(md5(substr(t, i, 3)), 31, 2) as int) % 64 as bucket, count(*) as n
  from (select {keys}, t, unnest(range(1, length(t) - 1)) as i from (select {keys}, ' ' || {low} || ' ' as t from {src})) group by {keys}, bucket"""


def sql_trigrams(src: str, keys: str, text: str) -> str:
    return TRIGRAMS.format(src=src, keys=keys, low=sql_low(text))
