from lemmaflow.functions.canon import Config
from lemmaflow.operators import policy, recover
from lemmaflow.operators.trees import build_tree

CONFIG = Config(complexity_band=2)


def leaves(*rows):
    return {i: recover.Leaf(i, s, list(needs), f"{s}|{sorted(needs)}") for i, s, needs in rows}


def tree_over(ls):
    t = recover.Tree({}, "", ls, CONFIG, policy.joined)
    recover._built(t, policy.joined)
    return t


BASE = leaves(*((f"l{i}", f"lemma number{i} holds", [f"l{i - 1}"] if i % 3 else []) for i in range(9)))


def ways(new, base=BASE):
    t = tree_over(base)
    way, reason, plan, out = recover.recovered(t.nodes, t.root, base, new, CONFIG)
    assert {i for i, n in out.nodes.items() if n.kind == "leaf"} == set(new) == {i for i in out.reached() if out.nodes[i].kind == "leaf"}
    for n in out.nodes.values():  # every parent says what its children say now
        if n.kind == "parent" and way != "regeneration":
            assert n.said == policy.joined(out.children(n.kids), CONFIG).said
    return way, reason, plan, out


def test_unchanged_and_edited():
    assert ways(BASE)[0] == "rebased"
    way, _, plan, out = ways(BASE | leaves(("l4", "lemma changed holds", ["l3"])))
    assert way == "blocked_subtree" and plan.changed == ["l4"] and plan.blocked == ["l4", "l5"] and plan.batches == [["l4"], ["l5"]] and "changed" in out.nodes[out.root].said


def test_removed():
    way, _, plan, out = ways({i: x for i, x in BASE.items() if i not in ("l6", "l7", "l8")})
    assert way == "removal" and plan.removed == ["l6", "l7", "l8"] and (out.recomputed or out.collapsed or out.dropped)
    assert max(n.depth for n in out.nodes.values()) == out.nodes[out.root].depth


def test_added():
    way, _, plan, out = ways(BASE | leaves(("new1", "lemma extra holds", ["l4"]), ("new2", "lemma further holds", ["new1"]), ("other", "lemma apart holds", [])))
    assert way == "insertion" and plan.added == ["new1", "new2", "other"] and len(out.inserted) == 2
    joint = next(n for n in out.nodes.values() if n.id in out.inserted and "l4" in n.kids)
    assert len(joint.kids) == 2


def test_mixed_regenerated_and_rebuilt():
    gone = {i: x for i, x in BASE.items() if i != "l8"}
    way, _, _, out = ways(gone | leaves(("new", "lemma extra holds", [])))
    assert way == "mixed" and out.counts["grounding"] + out.counts["generated"] > 0
    cyclic = BASE | leaves(("l3", "lemma number3 holds", ["l5"]))
    way, _, plan, _ = ways(cyclic)
    assert plan.cyclic == 1 and way == "regeneration"
    assert recover.rebuild_reason(plan, False) == "cyclic_blocked_subtree"
    way, reason, _, out = recover.recovered({}, "", {}, BASE, CONFIG)
    assert way == "rebuild" and reason == "" and out.root


def test_summaries_are_taken_over_by_statement():
    base = leaves(("a", "one thing", []), ("b", "two things", []))
    t = tree_over(base)
    t.nodes[t.root].why = "an old reason"
    renamed = leaves(("x", "two things", []), ("y", "one thing", []))
    t.leaves = renamed
    out = recover.regeneration(t)
    assert out.counts["signature"] == 1 and out.nodes[out.root].why == "an old reason" and sorted(out.nodes[out.root].refs) == ["x", "y"]


def test_trees_by_table(spark):
    t = tree_over(BASE)
    cols = "proof_id string, node_id string, node_kind string, statement_text string, child_ids array<string>, complexity double, refs array<string>, terms array<string>, why string, abstraction double, confidence double, depth int"
    nodes = spark.createDataFrame([("p", n.id, n.kind, n.said, n.kids, n.complexity, n.refs, n.terms, n.why, n.abstraction, n.confidence, n.depth) for n in t.nodes.values()], cols)
    L = "proof_id string, leaf_id string, theorem_kind string, module_path string, declaration_name string, statement_text string, pretty_statement string, dependency_ids array<string>, tags array<string>"
    row = lambda x, said=None: ("p", x.id, "lemma", "m", x.id, said or x.said, said or x.said, x.needs, [])
    old = spark.createDataFrame([row(x) for x in BASE.values()], L)
    new = spark.createDataFrame([row(x, "lemma changed holds" if x.id == "l0" else None) for x in BASE.values()] + [("q", "only", "lemma", "m", "n", "alone", "alone", [], [])], L)
    got = recover.recover(nodes, spark.createDataFrame([("p", t.root)], "proof_id string, root_id string"), old, new, CONFIG).collect()
    status = {r.tree_id: (r.way, r.changed, r.blocked) for r in got if r.part == "status"}
    assert status == {"p": ("blocked_subtree", ["l0"], ["l0", "l1", "l2"]), "q": ("rebuild", ["only"], ["only"])}
    assert {r.node_id for r in got if r.part == "node" and r.tree_id == "p"} == set(t.nodes) and [r.node_id for r in got if r.tree_id == "q" and r.is_root] == ["only"]
    assert recover.recover(nodes.limit(0), spark.createDataFrame([], "proof_id string, root_id string"), old.limit(0), new.limit(0), CONFIG).count() == 0


def test_a_stored_tree_with_a_cycle_is_only_a_source_of_summaries():
    t = tree_over(BASE)
    one = next(n for n in t.nodes.values() if n.kind == "parent" and n.id != t.root)
    one.kids.append(t.root)
    for new in ({i: x for i, x in BASE.items() if i != "l8"}, BASE | leaves(("new", "lemma extra holds", ["l4"]))):
        assert recover.recovered(t.nodes, t.root, BASE, new, CONFIG)[0] == "regeneration"
