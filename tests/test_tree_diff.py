import os

import pytest

from lemmaflow.operators import hierarchy, snapshots, store
from lemmaflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
HEADERS = "proof_id string, snapshot_id string, delivery_no int, taken_at int, leaf_ids array<string>"
NODES = "proof_id string, snapshot_id string, delivery_no int, node_id string, node_kind string, statement_text string, node_depth int, child_ids array<string>, delivered_at int"


def diff(spark, headers, nodes):
    n = store.first_and_last(snapshots.latest_headers(headers), nodes)
    keyed = store.comparable(n, hierarchy.descendants(store.links_below(n)))
    return store.tree_diff(keyed.where("side = 'old'"), keyed.where("side = 'new'"))


def test_parents_are_keyed_by_all_leaves_below_and_depth_counts(spark, rows):
    headers = spark.createDataFrame([("p", "s1", 1, 1, []), ("p", "s2", 1, 2, []), ("p", "s3", 1, 3, []), ("q", "t1", 1, 1, [])], HEADERS)
    leaf = lambda s, i, depth=2, said="x", at=1: ("p", s, 1, i, "leaf", said, depth, [], at)
    par = lambda s, i, kids, depth=1, said="y": ("p", s, 1, i, "parent", said, depth, kids, 1)
    old = [par("s1", "p_r", ["p_a", "p_b"], 0), par("s1", "p_a", ["l1", "l2"]), par("s1", "p_b", ["l3", "gone", "p_b"]), leaf("s1", "l1"), leaf("s1", "l2", said="first"), leaf("s1", "l2", said="a", at=2), leaf("s1", "l3")]
    mid = [par("s2", "p_r", [], 0, "not looked at")]
    new = [par("s3", "p_r", ["p_a", "p_b"], 0), par("s3", "p_a", ["l1", "p_c"]), par("s3", "p_c", ["l2"]), par("s3", "p_b", ["l3", "l4"]), leaf("s3", "l1"), leaf("s3", "l2", 3, "a"), leaf("s3", "l3"), leaf("s3", "l4")]
    nodes = spark.createDataFrame(old + mid + new + [("q", "t1", 1, "z", "leaf", "x", 0, [], 1)], NODES)
    expected = [
        ("p|leaf:l2", 1, "changed"), ("p|leaf:l4", 1, "added"), ("p|parent:l1,l2,l3", 1, "removed"), ("p|parent:l1,l2,l3,l4", 1, "added"),
        ("p|parent:l2", 1, "added"), ("p|parent:l3", 1, "removed"), ("p|parent:l3,l4", 1, "added"),
    ]
    assert rows(diff(spark, headers, nodes)) == sorted(expected, key=repr)
    assert rows(diff(spark, headers.limit(0), nodes.limit(0))) == []


def brute(headers, nodes):
    """The first and last snapshot of each proof compared in plain Python, walking down from each node."""
    clean = lambda x: (x or "").strip() or None
    best = {}
    for h in headers:
        k = (clean(h.proof_id), clean(h.snapshot_id))
        if None not in k and (k not in best or (h.delivery_no, h.taken_at) > best[k]):
            best[k] = (h.delivery_no, h.taken_at)
    ends = {}
    for (p, s), (n, t) in best.items():
        ends.setdefault(p, []).append((t, s, n))
    trees = {}
    for p, found in ends.items():
        for side, (_, s, n) in (("old", min(found)), ("new", max(found))):
            trees.setdefault((p, s, n), []).append((side, p))
    held = {}
    for r in nodes:
        for tree in trees.get((clean(r.proof_id), clean(r.snapshot_id), r.delivery_no), []):
            if clean(r.node_id):
                held.setdefault(tree, {}).setdefault(clean(r.node_id), []).append(r)
    sides = {"old": {}, "new": {}}
    for (side, p), by_id in held.items():
        last = {i: max(rs, key=lambda r: (r.delivered_at, r.node_kind, r.statement_text or "", r.node_depth)) for i, rs in by_id.items()}
        for i, r in last.items():
            seen, stack = {i}, [i]
            while stack:
                x = last.get(stack.pop())
                for c in (x.child_ids or []) if x is not None and x.node_kind != "leaf" else []:
                    if clean(c) and clean(c) not in seen:
                        seen.add(clean(c))
                        stack.append(clean(c))
            key = f"leaf:{i}" if r.node_kind == "leaf" else "parent:" + ",".join(sorted(x for x in seen if x in last and last[x].node_kind == "leaf"))
            sides[side].setdefault(f"{p}|{key}", []).append((i, " ".join(r.statement_text.split()) if r.statement_text is not None else None, r.node_depth))
    out = []
    for key in sides["old"].keys() | sides["new"].keys():
        a, b = sorted(sides["old"].get(key, [])), sorted(sides["new"].get(key, []))
        for k in range(max(len(a), len(b))):
            what = "added" if k >= len(a) else "removed" if k >= len(b) else "changed" if a[k][1:] != b[k][1:] else None
            if what:
                out.append((key, k + 1, what))
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_equals_brute_force(spark, rows):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    assert rows(QUERIES["tree_diff"](spark, DATA)) == brute(read("tree_snapshots"), read("snapshot_nodes"))
