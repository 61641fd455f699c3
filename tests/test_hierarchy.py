import random

import pytest

from weftmark.operators import hierarchy as H


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "child string, parent string")


def reach(edges, start, without=None):
    seen, stack = set(), [p for c, p in edges if c == start and (c, p) != without]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += [p for c, p in edges if c == x and (c, p) != without]
    return seen


def graphs():
    rnd = random.Random(7)
    for n, m in ((9, 16), (14, 18)):
        yield {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)}
    yield {(f"c{i:03}", f"c{i + 1:03}") for i in range(70)} | {("c010", "c005")}
    yield {("a", "b"), ("b", "a"), ("b", "c"), ("x", "x"), ("x", "y")}
    # cycles through chains, cycles of chains alone with tails, a diamond on a chain, an edge to oneself beside another
    chain = [("p", "q"), ("q", "r"), ("r", "m"), ("m", "p"), ("m", "z"), ("z", "y"), ("t", "q"), ("u", "v"), ("v", "w"), ("w", "v"), ("u2", "u"), ("m2", "u"), ("m2", "m"), ("s", "s"), ("s2", "s")]
    yield set(chain) | {("d", "e"), ("d", "f"), ("e", "g"), ("f", "g"), ("g", "h"), ("d", "h"), ("k", "k"), ("k", "h")}


@pytest.mark.parametrize("edges", list(graphs()))
def test_against_brute_force(spark, edges):
    df = frame(spark, edges)
    nodes = {x for e in edges for x in e}
    up = {x: reach(edges, x) for x in nodes}
    roots = {p for _, p in edges} - {c for c, _ in edges}
    want = {(x, r) for x in nodes for r in up[x] & roots} | {(x, x) for x in nodes if x in up[x]}
    assert {tuple(r) for r in H.roots_and_cycles(df).collect()} == want
    assert {(r["node"], r["ancestor"]) for r in H.ancestor_pairs(df).collect()} == {(x, y) for x in nodes for y in up[x]}
    summary = {r["concept_id"]: r for r in H.node_summary(df).collect()}
    assert set(summary) == nodes and all(summary[x]["on_cycle"] == (x in up[x]) for x in nodes)
    parts = {r["node"]: r["part"] for r in H.cycle_nodes(df).collect()}
    assert set(parts) == {x for x in nodes if x in up[x]}
    assert all((parts[x] == parts[y]) == (x == y or (y in up[x] and x in up[y])) for x in parts for y in parts)
    shortcuts = {tuple(r) for r in H.shortcut_edges(df).collect()}
    assert shortcuts == {(c, p) for c, p in edges if c != p and p in reach(edges - {(c, c)}, c, (c, p))}
    for r in H.root_paths(df).collect():
        path = r["path"]
        assert path[0] == r["concept_id"] and path[-1] == r["root_id"] and all(e in edges for e in zip(path, path[1:]))


def simple_paths(edges, path):
    more = [p for c, p in edges if c == path[-1] and p not in path]
    if not any(c == path[-1] for c, _ in edges):
        yield path
    for p in more:
        yield from simple_paths(edges, (*path, p))


@pytest.mark.parametrize("edges", [list(graphs())[0], {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e"), ("u", "v"), ("v", "w"), ("w", "v")}])
def test_all_simple_paths(spark, edges):
    nodes = {x for e in edges for x in e}
    loops = {x for x in nodes if x in reach(edges, x)}
    to_root = {p for x in nodes for p in simple_paths(edges, (x,)) if len(p) > 1}
    short = {(c, p) for c, p in edges if c not in loops}
    to_cycle = {p for x in nodes for p in simple_paths(short, (x,)) if p[-1] in loops}
    got = [tuple(r["path"]) for r in H.root_paths(frame(spark, edges)).collect()]
    assert len(got) == len(set(got)) and set(got) == to_root | to_cycle


def test_large_cyclic_part_stays_linear(spark, monkeypatch):
    """Rows written for a random graph of two parents a node, most of it one cyclic part, follow its edges."""
    rnd = random.Random(9)
    n = 1500
    edges = {(f"n{i:05}", f"n{rnd.randrange(n):05}") for i in range(n) for _ in range(2)} | {("n00000", "top"), ("top", "peak")}
    written, plain = [], H.materialize

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(H, "materialize", counted)
    rows = {tuple(r) for r in H.roots_and_cycles(frame(spark, edges)).collect()}
    up = {x: set() for e in edges for x in e}
    for c, p in edges:
        up[c].add(p)
    below = {p: {c for c, q in edges if q == p} for p in ("top",)}
    assert ("n00000", "peak") in rows and below["top"] == {"n00000"}
    assert max(written) <= 2 * len(edges)
    on = {a for a, b in rows if a == b}
    assert all(any(p in on for p in up[x]) for x in on)


def test_typed_edges_and_depth(spark):
    rows = [(" Is_A ", "a", "b", "x"), ("is_a", "a", "b", "y"), ("IS_A", None, "b", "x"), (None, "q", "b", "x"), ("co_occurs", "q", "b", "x"), ("IS_A", "b", "c", None)]
    df = spark.createDataFrame(rows, "type string, source_id string, target_id string, child string")
    edges = H.typed_edges(df)
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("b", "c")}
    assert {r["concept_id"]: (r["depth"], r["roots"]) for r in H.node_summary(edges).collect()} == {"a": (2, 1), "b": (1, 1), "c": (0, 0)}
    assert H.longest_walk(edges) == 2
    empty = edges.limit(0)
    assert H.roots_and_cycles(empty).count() == 0 and H.ancestor_pairs(empty).count() == 0 and H.longest_walk(empty) == 0
