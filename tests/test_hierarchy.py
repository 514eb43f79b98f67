import random

import pytest

from lemmaflow.operators import graph, hierarchy

LINKS = "proof_id string, parent_id string, child_id string"


def brute(links):
    out, kids = {}, {}
    for p, a, b in links:
        kids.setdefault((p, a), set())
        if b is not None:
            kids[(p, a)].add(b)
            kids.setdefault((p, b), set())
    for p in {k[0] for k in kids}:
        mine = {a: bs for (q, a), bs in kids.items() if q == p}
        below = set().union(*mine.values()) if mine else set()
        best = {}
        for r in sorted(set(mine) - below):
            dist, front = {r: 0}, [r]
            while front:
                nxt = []
                for x in front:
                    for y in mine[x]:
                        if y not in dist:
                            dist[y] = dist[x] + 1
                            nxt.append(y)
                front = nxt
            for n, h in dist.items():
                best[n] = min(best.get(n, (h, r)), (h, r))
        for n in mine:
            seen, stack = set(), list(mine[n])
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack.extend(mine[x])
            h, r = best.get(n, (-1, ""))
            out[(p, n)] = (p, n, r, h, int(n in seen)), seen
    return out


def random_links(seed, n=14, m=15):
    rng = random.Random(seed)
    links = {(p, f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for p in "ab" for _ in range(m)}
    return sorted(links | {("a", f"c{i:02}", f"c{i + 1:02}") for i in range(6)} | {("b", "alone", None)}, key=repr)


@pytest.mark.parametrize("kernel_links", [1000, 12, 3])
def test_kernel_and_distributed_rounds_agree_with_brute_force(spark, rows, kernel_links):
    links = random_links(kernel_links)
    got = rows(hierarchy.hierarchy(spark.createDataFrame(links, LINKS), kernel_links))
    assert got == sorted((v[0] for v in brute(links).values()), key=repr)


def test_paths_descendants_and_back_edges(spark, rows):
    links = random_links(7, 25, 30)
    df, expected = spark.createDataFrame(links, LINKS), brute(links)
    pairs = rows(hierarchy.descendants(df))
    assert pairs == sorted(((p, n, x) for (p, n), (_, seen) in expected.items() for x in seen), key=repr)
    real = {(p, a, b) for p, a, b in links}
    for r in hierarchy.hierarchy_nodes(df).collect():
        if r.hops >= 0:
            assert len(r.path) == r.hops + 1 and r.path[0] == r.root_id and r.path[-1] == r.node_id
            assert all((r.proof_id, a, b) in real for a, b in zip(r.path, r.path[1:]))
        assert r.n_descendants == len(expected[(r.proof_id, r.node_id)][1])
    back = rows(hierarchy.back_edges(df))
    left = [x for x in links if x not in set(back)]
    assert not any(v[0][4] for v in brute(left).values())  # without its back edges a graph has no cycle


def test_dirty_tables(spark, rows):
    edges = spark.createDataFrame([("p", " a ", "b\t", 0), ("p", "a", "b", 1), ("p", None, "c", 0), ("p", " ", "c", 0), (None, "x", "y", 0), ("p", "s", "s", 0)], LINKS + ", child_order int")
    nodes = spark.createDataFrame([("p", "b", ["c", None, " ", "c "], 5), ("p", "z", None, 1), ("p", None, ["q"], 1)], "proof_id string, node_id string, child_ids array<string>, hops int")
    got = rows(hierarchy.hierarchy(hierarchy.links_of(edges, nodes)))
    assert got == [("p", "a", "a", 0, 0), ("p", "b", "a", 1, 0), ("p", "c", "a", 2, 0), ("p", "s", "", -1, 1), ("p", "z", "z", 0, 0)]
    assert rows(hierarchy.hierarchy(hierarchy.links_of(edges.limit(0), nodes.limit(0)))) == []


@pytest.mark.parametrize("kernel_links", [1000, 4])
def test_strong_components(spark, rows, kernel_links):
    links = [(a, b) for p, a, b in random_links(3, 12, 16) if p == "a"]
    reach = {n: v[1] for (_, n), v in brute([("a", a, b) for a, b in links]).items()}
    expected = sorted((n, min([n, *(x for x in reach[n] if n in reach[x])])) for n in reach)
    assert rows(graph.strong_components(spark.createDataFrame(links, "src string, dst string"), kernel_links)) == expected


def test_components_layers_and_closure(spark, rows):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("e", "e"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    assert dict(rows(graph.components(e))) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "x": "x", "y": "x", "z": "x"}
    nodes = spark.createDataFrame([(x,) for x in "abcdxyz"], "id string")
    for links in (1000, 0):
        layers = {r.id: (r.batch, r.cyclic) for r in graph.batches(nodes, e, links).collect()}
        assert layers == {"a": (0, False), "b": (1, False), "c": (2, False), "d": (2, False), "x": (3, True), "y": (3, True), "z": (3, True)}
    assert ("c", "a") in rows(graph.closure(e)) and ("x", "x") not in rows(graph.closure(e))
    deps = spark.createDataFrame([("A", "B"), ("A", "C"), ("A", "X"), ("B", "D")], "src string, dst string")
    assert graph.support_order(deps, "A") == ["D", "B", "C", "X"]
    ring = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "src string, dst string")
    assert graph.support_order(ring, "A") == ["C", "B"]
    found = {tuple(r.members) for r in graph.cyclic_components(e, graph.strong_components(e)).collect()}
    assert found == {("e",), ("x", "y")}
