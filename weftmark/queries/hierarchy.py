"""Queries on hierarchies of concepts."""

from __future__ import annotations

from weftmark.operators import hierarchy as H
from weftmark.queries.common import table
from weftmark.runtime import materialize


def _edges(spark, d):
    return materialize(H.typed_edges(table(spark, d, "relations")))


def p3_found(spark, d):
    return H.roots_and_cycles(_edges(spark, d))


def p3_nodes(spark, d):
    return H.node_summary(_edges(spark, d))


def p3_descendants(spark, d):
    pairs = H.ancestor_pairs(_edges(spark, d))
    return pairs.selectExpr("ancestor as concept_id", "node as descendant_id", "steps")


def p3_paths(spark, d):
    return H.root_paths(_edges(spark, d)).selectExpr("concept_id", "root_id", "array_join(path, ' ') as path")


QUERIES = {"p3_found": p3_found, "p3_nodes": p3_nodes, "p3_descendants": p3_descendants, "p3_paths": p3_paths}

_EDGES = """edges as (
  select distinct source_id as child, target_id as parent from relations
  where lower(regexp_replace(trim(type), ' +', ' ', 'g')) = 'is_a' and source_id is not null and target_id is not null)"""

_PAIRS = f"""with recursive {_EDGES},
pairs as (select child as node, parent as ancestor from edges
  union select p.node, e.parent from pairs p join edges e on e.child = p.ancestor)"""

# fewest steps of each pair: no shortest walk has more steps than there are edges
_STEPS = f"""with recursive {_EDGES},
walks as (select child as node, parent as ancestor, 1 as steps from edges
  union select p.node, e.parent, p.steps + 1 from walks p join edges e on e.child = p.ancestor where p.steps < (select count(*) from edges)),
least_ as (select node, ancestor, min(steps)::bigint as steps from walks group by 1, 2)"""

ORACLE = {
    "p3_found": f"""{_PAIRS},
roots as (select distinct parent as root from edges where parent not in (select child from edges))
select node as concept_id, ancestor as root_id from pairs where ancestor in (select root from roots)
union all select node, ancestor from pairs where node = ancestor""",
    "p3_nodes": f"""{_STEPS},
roots as (select distinct parent as root from edges where parent not in (select child from edges)),
nodes as (select child as node from edges union select parent from edges),
met as (select node, min(steps) as depth, count(*) as roots from least_ where ancestor in (select root from roots) group by 1)
select n.node as concept_id, case when n.node in (select root from roots) then 0 else depth end::bigint as depth, coalesce(roots, 0)::bigint as roots,
  n.node in (select node from least_ where node = ancestor) as on_cycle from nodes n left join met using (node)""",
    "p3_descendants": f"{_STEPS} select ancestor as concept_id, node as descendant_id, steps from least_",
    "p3_paths": f"""with recursive {_EDGES},
pairs as (select child as node, parent as ancestor from edges union select p.node, e.parent from pairs p join edges e on e.child = p.ancestor),
loops as (select node from pairs where node = ancestor),
roots as (select distinct parent as root from edges where parent not in (select child from edges)),
to_root as (select child as node, parent as place, [child, parent] as path from edges where child <> parent
  union all select t.node, e.parent, list_append(t.path, e.parent) from to_root t join edges e on e.child = t.place where not list_contains(t.path, e.parent)),
to_loop as (select child as node, parent as place, [child, parent] as path from edges where child not in (select node from loops)
  union all select t.node, e.parent, list_append(t.path, e.parent) from to_loop t join edges e on e.child = t.place where t.place not in (select node from loops))
select node as concept_id, place as root_id, array_to_string(path, ' ') as path from to_root where place in (select root from roots)
union all select node, place, array_to_string(path, ' ') from to_loop where place in (select node from loops)
union all select node, node, node from loops""",
}
