"""Parent-child rows to full hierarchies.

1. Chains are contracted: a node with one parent points at it, and pointers are doubled until they end at a node
   with several parents (a branching node) or at a root. One row a node, and rounds in the logarithm of the
   longest chain; a pointer that never ends leads into a cycle of such nodes.
2. What is left is a small graph of the branching nodes, with the chains as weighted edges. Nodes without
   parents and without children are peeled off level by level; what remains holds its cycles, of which
   the strongly connected parts are found by colours. Nothing ever holds pairs of nodes of a cyclic part.
3. From the roots the frontier goes down level by level over this graph; only (node, root) pairs that are new or
   nearer go on. At the end the nodes of the chains take over what the upper end of their chain has.

Every round is a shuffle join and an aggregate, written to the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.runtime import materialize, release


def plain(col):
    """Text "spelling aside": outer spaces off, runs of spaces to one, lower case."""
    return F.lower(F.regexp_replace(F.trim(col), " +", " "))


def typed_edges(relations: DataFrame, kind: str = "is_a", child: str = "source_id", parent: str = "target_id", type_col: str = "type") -> DataFrame:
    """Distinct (child, parent) edges of one type, the type's spelling aside; rows with a null end take no part."""
    return (
        relations.filter((plain(F.col(type_col)) == kind) & F.col(child).isNotNull() & F.col(parent).isNotNull())
        .select(F.col(child).alias("child"), F.col(parent).alias("parent"))
        .distinct()
    )


@dataclass
class Contracted:
    """Edges with their chains contracted."""

    edges: DataFrame
    jumps: list[DataFrame]  # k: (node, to, steps, open), 2**k steps up the chain, or to its end where ``open`` is false
    tops: DataFrame  # (node, to, steps): nodes of one parent and the end of their chain
    endless: DataFrame  # (node, to): nodes of one parent whose chain has no end, and 2**k steps up
    kernel: DataFrame  # (child, via, target, steps): edges of branching nodes; via is the parent, target the end of its chain
    lost: DataFrame  # (node): branching nodes with a parent whose chain has no end

    @property
    def branching(self) -> DataFrame:
        return self.edges.join(self.jumps[0].select(F.col("node").alias("child")), "child", "left_anti").select(F.col("child").alias("node")).distinct()


def contract(edges: DataFrame, keep: DataFrame | None = None) -> Contracted:
    """Chains of ``edges`` (distinct child, parent) contracted; nodes of ``keep`` (node) are taken as branching."""
    single = edges.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("to")).filter("n = 1").select(F.col("child").alias("node"), "to")
    if keep is not None:
        single = single.join(keep.select("node"), "node", "left_anti")
    single = materialize(single)
    among = single.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    jumps = [materialize(single.join(among, "to", "left").select("node", "to", F.lit(1).cast("long").alias("steps"), F.coalesce("open", F.lit(False)).alias("open")))]
    left = jumps[0].filter("open").count()
    while left:
        now = jumps[-1]
        on = now.select(F.col("node").alias("via"), "to", F.col("steps").alias("b"), "open")
        further = now.filter("open").select("node", F.col("to").alias("via"), F.col("steps").alias("a")).join(on, "via").select("node", "to", (F.col("a") + F.col("b")).alias("steps"), "open")
        jumps.append(materialize(now.filter("not open").unionByName(further)))
        before, left = left, jumps[-1].filter("open").count()
        if left == before:  # a chain of any length has nodes at all shorter distances from its end, so none of these ends
            break
    tops, endless = jumps[-1].filter("not open").select("node", "to", "steps"), jumps[-1].filter("open").select("node", "to")
    rest = edges.join(single.select(F.col("node").alias("child")), "child", "left_anti")
    ends = jumps[-1].select(F.col("node").alias("parent"), "to", "steps", "open")
    found = materialize(
        rest.join(ends, "parent", "left").select(
            "child", F.col("parent").alias("via"), F.coalesce("to", "parent").alias("target"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.coalesce("open", F.lit(False)).alias("open")
        )
    )
    return Contracted(edges, jumps, tops, endless, found.filter("not open").drop("open"), found.filter("open").select(F.col("child").alias("node")).distinct())


def _roots(edges: DataFrame) -> DataFrame:
    """(node) of the parents that are no child."""
    return edges.select(F.col("parent").alias("node")).join(edges.select(F.col("child").alias("node")), "node", "left_anti").distinct()


def _rooted(c: Contracted) -> DataFrame:
    """(node, root, steps): all roots above each node, with the fewest steps; level by level from the roots down."""
    tops = materialize(_roots(c.edges))
    at_root = tops.select(F.col("node").alias("target"))
    first = c.kernel.join(at_root, "target", "left_semi").groupBy(F.col("child").alias("node"), F.col("target").alias("root")).agg(F.min("steps").alias("steps"))
    known = materialize(first.withColumn("new", F.lit(True)))
    while known.filter("new").take(1):
        front = known.filter("new").select(F.col("node").alias("target"), "root", F.col("steps").alias("a"))
        offered = c.kernel.join(front, "target").select(F.col("child").alias("node"), "root", (F.col("a") + F.col("steps")).alias("steps"), F.lit(None).cast("long").alias("was"))
        merged = known.select("node", "root", "steps", F.col("steps").alias("was")).unionByName(offered).groupBy("node", "root").agg(F.min("steps").alias("steps"), F.min("was").alias("was"))
        nxt = materialize(merged.select("node", "root", "steps", (F.col("was").isNull() | (F.col("steps") < F.col("was"))).alias("new")))
        release(known)
        known = nxt
    known = known.drop("new")
    chains = c.tops.join(known.select(F.col("node").alias("to"), "root", F.col("steps").alias("a")), "to").select("node", "root", (F.col("steps") + F.col("a")).alias("steps"))
    straight = c.tops.join(tops.select(F.col("node").alias("to")), "to", "left_semi").select("node", F.col("to").alias("root"), "steps")
    return known.unionByName(chains).unionByName(straight)


def _above_cycles(c: Contracted, loops: DataFrame) -> DataFrame:
    """(node) of the nodes from which a cycle is reached, those on one included."""
    known = materialize(c.lost.unionByName(loops.select("node").join(c.branching, "node", "left_semi")).distinct())
    new = known
    while new.take(1):
        new = materialize(c.kernel.join(new.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("child").alias("node")).distinct().join(known, "node", "left_anti"))
        known = materialize(known.unionByName(new))
    chains = c.tops.join(known.select(F.col("node").alias("to")), "to", "left_semi").select("node")
    return known.unionByName(chains).unionByName(c.endless.select("node"))


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node)."""
    return (
        edges.join(nodes.select(F.col("node").alias("child")), "child", "left_semi")
        .join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
        .select("child", "parent")
    )


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without parents and nodes without children are taken off until there are none."""
    left = edges.count()
    while left:
        kept = materialize(
            edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent")
        )
        before, left, edges = left, kept.count(), kept
        if left == before:
            break
    return edges


def _pure_cycles(c: Contracted) -> DataFrame:
    """(node, part) of the nodes of one parent on cycles of such nodes: what pointers keep leading to."""
    if not c.endless.take(1):
        return c.endless.select("node", F.col("node").alias("part"))
    jump, size = c.endless, None
    while True:
        ring = materialize(jump.select(F.col("to").alias("node")).distinct())
        before, size = size, ring.count()
        if size == before:  # the pointers map the nodes onto themselves
            break
        jump = materialize(jump.withColumnRenamed("to", "via").join(jump.withColumnRenamed("node", "via"), "via").select("node", "to"))
    low = materialize(c.jumps[0].join(ring, "node", "left_semi").select("node", "to", F.col("node").alias("part")))
    while True:  # the least node of ever longer stretches; where none changes, of the whole cycle
        on = low.select(F.col("node").alias("via"), "to", F.col("part").alias("other"))
        nxt = materialize(low.withColumnRenamed("to", "via").join(on, "via").select("node", "to", F.least("part", "other").alias("part"), (F.col("other") < F.col("part")).alias("changed")))
        low = nxt.drop("changed")
        if not nxt.filter("changed").take(1):
            return low.select("node", "part")


def _coloured(core: DataFrame) -> DataFrame:
    """(node, part) of nodes in strongly connected parts of two or more nodes, or with an edge to themselves.

    Every node takes the largest id that reaches it; the nodes of one colour that also reach their
    colour's own node form a part. Parts found are removed and the rest is coloured again. Memory is in
    proportion to the edges; the rounds follow the width of the parts.
    """
    loops = core.filter("child = parent").select(F.col("child").alias("node"))
    found = loops.select("node", F.col("node").alias("part")).limit(0)
    edges = materialize(core.filter("child <> parent"))
    while edges.count():
        nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
        colour, total = materialize(nodes.withColumn("colour", F.col("node"))), None
        while True:
            passed = edges.join(colour, F.col("child") == F.col("node")).select(F.col("parent").alias("node"), "colour")
            nxt = materialize(colour.unionByName(passed).groupBy("node").agg(F.max("colour").alias("colour")))
            changed = nxt.join(colour.withColumnRenamed("colour", "was"), "node").filter("colour <> was").count()
            release(colour)
            colour = nxt
            if not changed:
                break
        same = materialize(
            edges.join(colour.select(F.col("node").alias("child"), F.col("colour").alias("c1")), "child")
            .join(colour.select(F.col("node").alias("parent"), F.col("colour").alias("c2")), "parent")
            .filter("c1 = c2")
            .select("child", "parent", F.col("c1").alias("colour"))
        )
        part = materialize(colour.filter("node = colour"))
        known = part.count()
        while True:
            more = same.join(part.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node"), "colour")
            nxt = materialize(part.unionByName(more).distinct())
            total = nxt.count()
            release(part)
            part = nxt
            if total == known:
                break
            known = total
        big = part.groupBy("colour").count().filter("count > 1").select("colour")
        found = found.unionByName(part.join(big, "colour", "left_semi").select("node", F.col("colour").alias("part")))
        rest = nodes.join(part.select("node"), "node", "left_anti")
        edges = materialize(_within(edges, rest))
    alone = loops.join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("part")))


def cycle_nodes(edges: DataFrame, contracted: Contracted | None = None) -> DataFrame:
    """(node, part) of every node that reaches itself by one or more steps; ``part`` is the same for nodes that reach each other."""
    c = contract(edges) if contracted is None else contracted
    between = materialize(c.kernel.select("child", F.col("target").alias("parent")).join(c.branching.select(F.col("node").alias("parent")), "parent", "left_semi").select("child", "parent").distinct())
    parts = materialize(_coloured(_peeled(between)))
    # chains between two nodes of one part: what lies on them, by jumps of ever shorter length
    inside = c.kernel.join(parts.toDF("child", "part"), "child").join(parts.toDF("target", "other"), "target").filter("part = other and via <> target")
    marked = materialize(inside.select(F.col("via").alias("node"), "part").distinct())
    lengths = [j.filter("open").select("node", "to") for j in reversed(c.jumps)] if marked.take(1) else []
    for k in range(0, len(lengths), 3):  # three lengths a round
        for jump in lengths[k : k + 3]:
            marked = marked.unionByName(marked.join(jump, "node").select(F.col("to").alias("node"), "part"))
        marked = materialize(marked.distinct())
    return materialize(parts.unionByName(marked).unionByName(_pure_cycles(c)))


def roots_and_cycles(edges: DataFrame) -> DataFrame:
    """(concept_id, root_id): every node with each root above it, and (x, x) for each x on a cycle.

    ``edges``: distinct (child, parent). Empty edges give no rows; an edge to oneself is a cycle; a node on
    a cycle keeps the roots it reaches.
    """
    c = contract(edges)
    return _rooted(c).select(F.col("node").alias("concept_id"), F.col("root").alias("root_id")).unionByName(
        cycle_nodes(edges, c).select(F.col("node").alias("concept_id"), F.col("node").alias("root_id"))
    )


def ancestor_pairs(edges: DataFrame) -> DataFrame:
    """(node, ancestor, steps): all pairs with their least number of steps, by squaring.

    Read from ``ancestor`` it lists all descendants. On a cycle a node is its own ancestor. The size is
    that of the result; nothing larger is built.
    """
    pairs = materialize(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("steps")))
    known = pairs.count()
    reach = 1
    while True:
        # only pairs in the upper half of the reach can be extended to something new
        far = pairs.filter(F.col("steps") > reach // 2) if reach > 1 else pairs
        longer = (
            far.select("node", F.col("ancestor").alias("via"), F.col("steps").alias("a"))
            .join(pairs.select(F.col("node").alias("via"), "ancestor", F.col("steps").alias("b")), "via")
            .select("node", "ancestor", (F.col("a") + F.col("b")).alias("steps"))
        )
        nxt = materialize(pairs.unionByName(longer).groupBy("node", "ancestor").agg(F.min("steps").alias("steps")))
        total = nxt.count()
        release(pairs)
        pairs = nxt
        if total == known:
            return pairs
        known, reach = total, reach * 2


def node_summary(edges: DataFrame) -> DataFrame:
    """(concept_id, depth, roots, on_cycle) of every node.

    ``depth``: fewest steps to a root, 0 for a root, null where no root is reached. ``roots``: number of
    distinct roots above; ``on_cycle``: the node reaches itself.
    """
    c = contract(edges)
    loops = cycle_nodes(edges, c)
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    tops = _roots(edges)
    met = _rooted(c).groupBy("node").agg(F.min("steps").alias("depth"), F.count("*").alias("roots"))
    met = met.unionByName(tops.select("node", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("roots")))
    return (
        nodes.join(met, "node", "left")
        .join(loops.select("node", F.lit(True).alias("on_cycle")), "node", "left")
        .select(F.col("node").alias("concept_id"), "depth", F.coalesce("roots", F.lit(0)).cast("long").alias("roots"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    )


def _paths_to(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """(node, end, path): every simple path along edges that ends in ``tops`` (node), which have no edges upwards.

    Round k holds the open paths of exactly 2**k edges and the finished ones of at most that many.
    """
    mark = tops.select(F.col("node").alias("end"), F.lit(True).alias("done"))
    front = materialize(
        edges.filter("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("end"), F.array("child", "parent").alias("path"))
        .join(mark, "end", "left")
        .select("node", "end", "path", F.coalesce("done", F.lit(False)).alias("done"))
    )
    while front.filter("not done").take(1):
        open_ = front.filter("not done").select("node", F.col("end").alias("via"), F.col("path").alias("low"))
        on = front.select(F.col("node").alias("via"), "end", F.expr("slice(path, 2, size(path) - 1)").alias("high"), "done")
        further = open_.join(on, "via").filter(~F.arrays_overlap("low", "high")).select("node", "end", F.concat("low", "high").alias("path"), "done")
        nxt = materialize(front.filter("done").unionByName(further))
        release(front)
        front = nxt
    return front.select("node", "end", "path")


def root_paths(edges: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """(concept_id, root_id, path): for every node all its simple paths up, as arrays from the node to their end.

    A path ends at a root; besides, where a cycle is above, at the first node on one, with that node as
    ``root_id``: the stretch up to the cycle. A node on a cycle has the path of itself alone as that stretch.
    The size is that of all simple paths, which grows exponentially where many levels have several parents.
    """
    c = contract(edges)
    rooted = materialize(_rooted(c).select("node", "root"))
    roots = rooted.select(F.col("root").alias("node")).distinct()
    to_root = _paths_to(materialize(_within(edges, materialize(rooted.select("node").union(roots).distinct()))), roots)
    found = cycle_nodes(edges, c)
    loops = found.select("node")
    above = materialize(_above_cycles(c, found).distinct())
    below = materialize(_within(edges, above).join(loops.select(F.col("node").alias("child")), "child", "left_anti"))
    to_cycle = _paths_to(below, loops)
    out = to_root.unionByName(to_cycle).unionByName(loops.select("node", F.col("node").alias("end"), F.array("node").alias("path")))
    if node_ids is not None:
        out = out.join(node_ids.select(F.col(node_ids.columns[0]).alias("node")), "node", "left_semi")
    return out.select(F.col("node").alias("concept_id"), F.col("end").alias("root_id"), "path")


def longest_walk(edges: DataFrame) -> int:
    """Most edges on a path of an acyclic graph; 0 without edges."""
    c = contract(edges)
    known = materialize(c.kernel.groupBy(F.col("child").alias("node")).agg(F.max("steps").alias("most")).withColumn("new", F.lit(True)))
    while known.filter("new").take(1):
        front = known.filter("new").select(F.col("node").alias("target"), F.col("most").alias("a"))
        offered = c.kernel.join(front, "target").select(F.col("child").alias("node"), (F.col("a") + F.col("steps")).alias("most"), F.lit(None).cast("long").alias("was"))
        merged = known.select("node", "most", F.col("most").alias("was")).unionByName(offered).groupBy("node").agg(F.max("most").alias("most"), F.max("was").alias("was"))
        nxt = materialize(merged.select("node", "most", (F.col("most") > F.col("was")).alias("new")))
        release(known)
        known = nxt
    chains = c.tops.join(known.withColumnRenamed("node", "to"), "to", "left").select((F.col("steps") + F.coalesce("most", F.lit(0))).alias("most"))
    return int(known.select("most").unionByName(chains).agg(F.coalesce(F.max("most"), F.lit(0))).first()[0])


def shortcut_edges(edges: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """Edges (child, parent) whose parent is also reached from the child without them, itself not passed again.

    Off cycles that is: another parent of the child has the edge's parent as ancestor. Where another parent is
    on one cycle with the child, what it reaches without passing the child is found within that cycle's part
    first, and beyond it from there.
    """
    edges = materialize(edges.filter("child <> parent").select("child", "parent").distinct())
    loops = cycle_nodes(edges) if loops is None else loops
    # only a child of several parents can have such an edge, so only what its parents reach among each other counts
    several = edges.groupBy("child").count().filter("count > 1").select("child")
    ends = materialize(edges.join(several, "child", "left_semi").select(F.col("parent").alias("node")).distinct())
    kernel = contract(edges, ends).kernel.select("child", F.col("target").alias("parent")).distinct()
    above = materialize(ancestor_pairs(kernel).select(F.col("node").alias("via"), F.col("ancestor").alias("parent")))
    part = loops.select(F.col("node").alias("child"), F.col("part").alias("p1"))
    other = loops.select(F.col("node").alias("via"), F.col("part").alias("p2"))
    starts = edges.withColumnRenamed("parent", "via").join(part, "child", "left").join(other, "via", "left")
    inside = F.col("p1").isNotNull() & F.col("p1").eqNullSafe(F.col("p2"))
    outer = starts.filter(~inside).select("child", "via")
    # reach without the child, within the part: rows (child, start, via)
    inner_edges = materialize(edges.join(part, "child").join(loops.select(F.col("node").alias("parent"), F.col("part").alias("p2")), "parent").filter("p1 = p2").select(F.col("child").alias("via"), F.col("parent").alias("nxt")))
    seen = materialize(starts.filter(inside).select("child", F.col("via").alias("start"), "via"))
    new = seen
    while new.take(1):
        step = new.join(inner_edges, "via").filter("nxt <> child").select("child", "start", F.col("nxt").alias("via")).distinct()
        new = materialize(step.join(seen, ["child", "start", "via"], "left_anti"))
        seen = materialize(seen.unionByName(new))
    exits = edges.select(F.col("child").alias("via"), F.col("parent").alias("out")).join(other, "via").join(loops.select(F.col("node").alias("out"), F.col("part").alias("p3")), "out", "left").filter("p3 is null or p3 <> p2")
    left = seen.join(exits.select("via", "out"), "via").select("child", "start", F.col("out").alias("via")).distinct()
    reached = (
        outer.select("child", F.col("via").alias("start"), "via").join(above, "via").select("child", "start", "parent")
        .unionByName(seen.select("child", "start", F.col("via").alias("parent")))
        .unionByName(left.select("child", "start", F.col("via").alias("parent")))
        .unionByName(left.join(above, "via").select("child", "start", "parent"))
    )
    return edges.join(reached.filter("start <> parent").select("child", "parent").distinct(), ["child", "parent"], "left_semi")
