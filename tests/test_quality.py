import pytest
from pyspark.sql import functions as F

from lemmaflow.functions.canon import Config, group_hash
from lemmaflow.operators import hierarchy, policy, quality, trees, views

CONFIG = Config(complexity_band=2, term_budget=0, detail="formal")


def test_rules_before_and_after_a_summary():
    kids = [policy.Child("a", "alpha lemma", 1.0, ["b"]), policy.Child("b", "beta lemma", 5.0)]
    assert policy.before(kids, CONFIG) == (4.0, 1, ["sibling_complexity_spread", "prerequisite_order"])
    assert policy.before(kids[::-1], Config(complexity_band=3))[1:] == (0, ["sibling_complexity_spread"])
    s = policy.joined(kids, CONFIG)
    assert s.said == "alpha lemma and beta lemma" and not policy.criticize(s, kids, CONFIG) and policy.after(s, kids, CONFIG)[2] == []
    bad = policy.Summary("unrelated invented content throughout", "", ["term"], ["a", "zz"], 9.0, float("nan"), 2.0)
    assert policy.criticize(bad, kids, CONFIG) == ["schema", "schema", "schema", "schema", "evidence_refs", "term_budget", "complexity_band", "unsupported_terms"]
    evidence, share, codes = policy.after(bad, kids, CONFIG)
    assert evidence == 0.5 and share == 0.0 and codes == ["evidence_coverage", "term_budget", "vocabulary_continuity"]


def test_a_cycle_of_needs_splits_a_group():
    ring = [("l1", "first holds", None, {"l2"}), ("l2", "second holds", None, {"l3"}), ("l3", "third holds", None, {"l4"}), ("l4", "fourth holds", None, {"l1"})]
    rows = trees.build_tree(ring, CONFIG, policy.bracketed, strict=True)
    events = [r for r in rows if r["part"] == "event"]
    assert [(e["reason"], e["round"], [len(g) for g in e["groups"]], e["codes"]) for e in events] == [("pre_summary_policy", 0, [2, 2], ["prerequisite_order"])]
    assert len([r for r in rows if r["part"] == "node"]) == 3 and next(r for r in rows if r["part"] == "layer")["codes"] == ["missing_complexity", "cycle_detected"]
    # split groups take places after the layer's groups, a group that stays takes its own
    assert [r["place"] for r in rows if r["part"] == "node"] == [1, 2, 0]
    pair = [("a", "first holds", None, {"b"}), ("b", "second holds", None, {"a"})]
    stuck = trees.build_tree(pair, CONFIG, strict=True)
    assert [r["reason"] for r in stuck if r["part"] == "issue"] == ["pre_summary_policy"] and not [r for r in stuck if r["part"] == "node"]
    assert [r["codes"] for r in trees.build_tree(pair, CONFIG) if r["part"] == "node"] == [["prerequisite_order"]]
    far = trees.build_tree([("a", "x", 1.0, set()), ("b", "y", 5.0, set())], Config(), strict=True)
    assert [r["reason"] for r in far] == ["no_progress"]
    assert trees.depth_limit(1, 5) == 0 and trees.depth_limit(30, 5) == 30 and trees.depth_limit(9000, 2) == 2048
    assert trees.by_needs(["c", "a", "b"], {"a": {"c"}}) == ["b", "c", "a"]


def built(spark):
    rows = [("t", f"l{i}", f"lemma number{i} keeps order", None, [f"l{i - 1}"] if i % 2 else []) for i in range(7)] + [("u", "only", "one", 2.0, [])]
    b = trees.build(spark.createDataFrame(rows, "tree_id string, node_id string, statement_text string, complexity_score double, needs array<string>"), CONFIG, summarize=policy.bracketed, strict=True)
    n = trees.nodes_of(b)
    tree = n.select(F.col("tree_id").alias("proof_id"), "node_id", "node_kind", "statement_text", "child_ids", F.col("complexity_score").alias("complexity"), F.col("evidence_refs").alias("refs"), "terms", F.col("node_depth").alias("depth"), F.coalesce("why", F.lit("")).alias("why"), F.col("abstraction_score").alias("abstraction"), "confidence")
    return b, n, tree


def test_report_of_built_trees(spark):
    b, n, tree = built(spark)
    own = policy.decisions(policy.groups_of(tree), CONFIG)
    kept = {r.node_id: (r.spread, r.evidence, r.continuity) for r in n.where("node_kind = 'parent'").collect()}
    assert {r.node_id: (r.spread, r.evidence, r.continuity) for r in own.collect()} == kept  # column rules and plain rules agree
    assert policy.critic(policy.groups_of(tree), CONFIG).count() == 0
    sample = quality.samples(tree, hierarchy.descendants(hierarchy.links_of_tree(tree)), own.withColumn("violations", F.size("pre_codes") + F.size("post_codes")))
    m = quality.metrics(sample, CONFIG).first()
    assert (m.parent_count, m.unsupported_parent_count, m.mean_evidence_coverage, m.mean_term_jump_rate) == (len(kept), 0, 1.0, 0.0)
    levels = {(r.scope, r.proof_id, r.depth): r.parent_count for r in quality.metric_levels(sample, CONFIG).collect()}
    assert levels[("all", None, None)] == levels[("proof", "t", None)] == len(kept) == sum(v for k, v in levels.items() if k[0] == "depth")
    gate = {r.code: r.ok for r in quality.gate(quality.metrics(sample, CONFIG), CONFIG, quality.Thresholds(min_repartition_event_rate=0.1)).collect()}
    assert len(gate) == 10 and [c for c, ok in gate.items() if not ok] == ["min_repartition_event_rate"]
    roots = n.join(n.select("tree_id", F.explode("child_ids").alias("node_id")), ["tree_id", "node_id"], "left_anti").select(F.col("tree_id").alias("proof_id"), F.col("node_id").alias("root_id"))
    r = quality.report(sample, roots, CONFIG).first()
    assert r.threshold_pass and r.text.startswith('{"rootId":"' + r.root_id) and '"thresholdFailures":[]' in r.text and r.hash == quality.report(sample.repartition(5), roots, CONFIG).first().hash
    assert quality.metrics(sample.limit(0), CONFIG).first().mean_evidence_coverage == 1.0 and quality.metric_levels(sample.limit(0), CONFIG).count() == 0
    assert trees.validate(n, 5).count() == 0 and {r.code for r in trees.validate(n, 2).collect()} == {"branching_factor"}
    gone = n.where("node_id <> 'l0'")
    assert {r.code for r in trees.validate(gone, 5, leaves=n.where("node_id = 'l0'")).collect()} == {"missing_node"}
    assert {r.code for r in trees.validate(n.where("node_id <> 'l0'"), 5, roots=spark.createDataFrame([("t", "nobody"), ("u", "only")], "tree_id string, node_id string")).collect()} == {"missing_root", "not_connected", "leaf_not_preserved"}


def test_thresholds_presets_and_baselines(spark):
    t = quality.Thresholds(max_term_jump_rate=float("nan"), max_complexity_spread_mean=-1, max_repartition_max_round=2.7, min_evidence_coverage_mean=7).normalized(CONFIG)
    assert (t.max_term_jump_rate, t.max_complexity_spread_mean, t.max_repartition_max_round, t.min_evidence_coverage_mean, t.min_vocabulary_continuity_mean) == (0.0, 0.0, 2, 1, 0.7)
    p = quality.Preset("b", "d", "root", ("z", "a", "z"), {}, {"minRepartitionEventRate": 0.3, "maxUnsupportedParentRate": 1})
    assert p.text() == '{"name":"b","description":"d","projectRoot":"root","includePaths":["a","z"],"thresholdOverrides":{"maxUnsupportedParentRate":1,"minRepartitionEventRate":0.3}}'
    assert p.limits().min_repartition_event_rate == 0.3
    known = quality.Presets([p, quality.Preset("a", "", "", (), {"entailmentMode": "strict"})])
    assert [x.name for x in known.listed()] == ["a", "b"] and known.resolve("c") is None and known.table(spark).count() == 2
    rows = [("b", "h", "q", True, 4, 3, 1, 0), ("a", "h", "q", False, 1, 1, 0, 0)]
    cols = "preset_name string, preset_hash string, quality_report_hash string, threshold_pass boolean, leaf_count int, parent_count int, repartition_event_count int, repartition_max_round int"
    entries = spark.createDataFrame(rows, cols)
    outcome = quality.outcome_hash(quality.build_baseline(entries))
    assert quality.checked_baseline(entries, "1.0.0", outcome).count() == 2
    for bad in ((entries, "2.0.0", outcome), (entries, "1.0.0", "x"), (entries.unionByName(entries), "1.0.0", outcome), (entries.drop("leaf_count"), "1.0.0", outcome)):
        with pytest.raises(ValueError):
            quality.checked_baseline(*bad)


def test_views(spark):
    nodes = spark.createDataFrame([("p", "r", "parent", "all", ["m", "c", "gone"], 2, []), ("p", "m", "parent", "some", ["a", "b", "r"], 1, []), ("p", "a", "leaf", "a", [], 0, []), ("p", "b", "leaf", "b", [], 0, []), ("p", "c", "leaf", "c", [], 0, []), ("p", "orphan", "leaf", "o", [], 0, [])], "proof_id string, node_id string, node_kind string, statement_text string, child_ids array<string>, depth int, refs array<string>")
    roots = spark.createDataFrame([("p", "r"), ("q", "none")], "proof_id string, root_id string")
    opened = spark.createDataFrame([("p", "r"), ("p", "m"), ("p", "a"), ("p", "orphan"), ("p", "zz")], "proof_id string, node_id string")
    shown = views.disclosed(nodes, roots, opened, 1).orderBy("place").collect()
    assert [(r.node_id, r.depth_from_root, r.parent_id, r.hidden_count) for r in shown] == [("r", 0, None, 2), ("m", 1, "r", 2), ("a", 2, "m", 0)]
    assert sorted((r.node_id, r.code) for r in views.expanded_codes(nodes, views.reachable(nodes, roots), opened).collect()) == [("a", "expanded_node_not_parent"), ("orphan", "expanded_node_not_reachable"), ("zz", "expanded_node_missing")]
    assert sorted((r.proof_id, r.code, r.node_id, r.parent_id) for r in views.walk_codes(nodes, roots).collect()) == [("p", "cycle_detected", "r", "m"), ("p", "missing_node", "gone", "r"), ("q", "missing_root", "none", "")]
    asked = spark.createDataFrame([("p", "r", 1, 1), ("p", "r", 9, 1), ("p", "a", 0, 1), ("p", "zz", 0, 1)], "proof_id string, node_id string, page_offset int, page_limit int")
    assert sorted((r.node_id, r.page_offset, r.total, r.has_more, r.code or "", r.child_id or "") for r in views.pages(nodes, asked).collect()) == [("a", 0, 0, False, "not_a_parent", ""), ("r", 1, 2, False, "", "c"), ("r", 2, 2, False, "", ""), ("zz", 0, 0, False, "node_not_found", "")]
    assert {r.node_id: r.path for r in views.provenance_paths(nodes, roots).collect()}["b"] == ["r", "m", "b"]
    for f in (views.provenance_paths, views.reachable):  # one task a tree, and rounds over large ones
        assert sorted(map(repr, f(nodes, roots).collect())) == sorted(map(repr, f(nodes, roots, 0).collect()))
    assert {r.proof_id: r.loaded for r in views.fully_loaded(nodes, roots).collect()} == {"p": False, "q": False}
    assert views.render_window(1000, 500, 100, 10) == views.RowWindow("windowed", 440, 559, 440, 440) and views.render_window(5, 3).mode == "full" and views.render_window(0, 0).end == -1
    w, above, below = views.scroll_window(100, 250, 10, 5, 2)
    assert (w.start, w.end, above, below) == (23, 31, 230, 680)
    assert group_hash(views.view_lines(views.disclosed(nodes, roots, opened), nodes, roots), ["proof_id"], ["part"]).count() == 1
