from lemmaflow.operators import change
from lemmaflow.plans.queries import QUERIES

TREE = "proof_id string, node_id string, node_kind string, statement_text string, child_ids array<string>, complexity_score double, evidence_refs array<string>, new_terms_introduced array<string>, ingested_at int"
HEADERS = "proof_id string, snapshot_id string, delivery_no int, taken_at int, leaf_ids array<string>"
NODES = "proof_id string, snapshot_id string, delivery_no int, node_id string, node_kind string, statement_text string, node_depth int, child_ids array<string>, delivered_at int"


def test_parents_are_matched_by_what_their_children_say(spark, rows, tmp_path):
    old = [("p", "p_1", "parent", "own", ["a", "b"]), ("p", "p_2", "parent", "own 2", ["c", "a"]), ("p", "p_3", "parent", "own 3", ["a", "lost"]), ("p", "a", "leaf", "A", []), ("p", "b", "leaf", "B", []), ("p", "c", "leaf", "C", [])]
    spark.createDataFrame([(*r, 1.0, [], [], 1) for r in old], TREE).write.parquet(f"{tmp_path}/tree_nodes.parquet")
    spark.createDataFrame([("p", "s", 2, 1, []), ("p", "s", 1, 1, [])], HEADERS).write.parquet(f"{tmp_path}/tree_snapshots.parquet")
    row = lambda i, kind, said, kids=(), n=2: ("p", "s", n, i, kind, said, 1, list(kids), n)
    new = [
        row("q_same", "parent", "another own text", ["b", "a"]), row("q_says", "parent", "own", ["a", "c2"]), row("q_changed", "parent", "own", ["a", "b2"]), row("q_lost", "parent", "own 3", ["a", "lost"]),
        row("q_same", "parent", "own", ["a", "b2"], 1), row("q_early", "parent", "own", ["a", "b"], 1),
        row("a", "leaf", "A"), row("b", "leaf", " B"), row("b", "leaf", "old B", n=1), row("b2", "leaf", "other"), row("c2", "leaf", "C"),
    ]
    spark.createDataFrame(new, NODES).write.parquet(f"{tmp_path}/snapshot_nodes.parquet")
    assert rows(QUERIES["reuse_match"](spark, str(tmp_path))) == [("s|q_same", "p_1", "grounding"), ("s|q_says", "p_2", "signature")]


def test_old_parents_of_one_grounding_are_not_ambiguous(spark, rows):
    P = "node_id string, child_ids array<string>, said array<string>"
    old = spark.createDataFrame([("p1", ["a", "b"], ["x", "y"]), ("p2", ["b", "a"], ["y", "x"])], P)
    new = spark.createDataFrame([("q1", ["b", "a"], ["y", "x"]), ("q2", ["c", "d"], ["y", "x"])], P)
    assert rows(change.reuse(old, new)) == [("q1", "p1", "grounding"), ("q2", "p1", "signature")]
