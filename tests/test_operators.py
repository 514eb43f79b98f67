import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import canon, text
from lemmaflow.operators import change, ingest, leaf, policy, quality, store, tagging, trees


def test_stems_tokens_and_delta(spark):
    words = {"queries": "query", "folding": "fold", "merged": "merg", "hatches": "hatch", "moves": "move", "cells": "cell", "bus": "bus", "thing": "thing"}
    df = spark.createDataFrame([(" ".join(words), "a good start ends", "a bad start ends")], "t string, a string, b string")
    r = df.select(text.stems("t").alias("s"), text.statement_delta(F.col("a"), F.col("b")).alias("d"), text.tokens(F.lit(None).cast("string")).alias("n"), text.grouping_tokens(F.lit("The cat and the hat")).alias("g")).first()
    assert r.s == list(words.values()) and r.n == [] and r.g == ["cat", "hat"]
    assert tuple(r.d) == ("a ", "goo", "ba", "d start ends")
    assert text.fnv1a("") == 0x811C9DC5 and text.fnv1a("a") == 0xE40C292C
    assert text.first_json_object('said ```json\n{"a": {"b": "}"}}\n``` so') == '{"a": {"b": "}"}}' and text.first_json_object("{no} {\"k\": 1}") == "{no}" and text.first_json_object('x {"a": "}"} y') == '{"a": "}"}' and text.first_json_object(None) is None


def test_config_and_profiles():
    c = canon.Config()
    # the published hash of the default configuration
    assert c.hash() == "a75632c3c71bea58a13445a49951b87763ebd9e868fb4f51ac128e6c783e8af7"
    assert not c.errors() and canon.Config(max_children=1, audience="x").errors() == ["audienceLevel", "maxChildrenPerParent"]
    assert canon.Config(audience="expert", reading_level="middle_school").errors() == ["readingLevelTarget"]
    limits = canon.Config(provider=canon.Provider(max_retries=5, timeout_ms=1000))
    assert c.regeneration(c) == "none" and c.regeneration(limits) == "partial" and limits.changed(c) == ["modelProvider.maxRetries", "modelProvider.timeoutMs"]
    assert all(c.regeneration(x) == "full" for x in (canon.Config(language="fr"), canon.Config(audience="expert"), canon.Config(max_children=3), canon.Config(provider=canon.Provider(model="m", max_retries=5))))
    assert canon.Config(entailment="strict").coverage_floor() == 1 and abs(c.coverage_floor() - 0.65) < 1e-9
    assert abs(canon.Config(audience="novice").continuity_threshold() - 0.55) < 1e-9 and abs(canon.Config(audience="expert").continuity_threshold() - 0.65) < 1e-9
    p = canon.Profiles()
    assert p.upsert("P", "u", "a b", "x", c) == "full" and p.upsert("p", "U", "a b", "x", c) == "none" and list(p.rows) == ["project:p:user:u:profile:a_b"] and p.delete("p", "u", "a b")
    assert canon.canonical_json({"b": 1.0, "a": None, "c": [True]}) == '{"b":1,"c":[true]}'
    assert canon.stable_json({"b": 1, "B": 2, "a_c": 3, "ab": 4}) == '{"a_c":3,"ab":4,"b":1,"B":2}'


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, f"x{i}" if i % 3 else None) for i in range(50)], "i int, s string")
    assert canon.table_fingerprint(df).first() == canon.table_fingerprint(df.orderBy(F.rand(1)).repartition(7)).first() != canon.table_fingerprint(df.where("i > 0")).first()


def test_ingestion(spark, rows, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / ".lake").mkdir()
    (tmp_path / ".lake" / "skip.lean").write_text("theorem no : True := by trivial\n")
    (tmp_path / "A" / "Core.lean").write_text("mutual\nend\n\ntheorem core_safe (n : Nat) :\n  n = n := by\n  rfl\n\nprivate def helper : Nat := 3\nlemma uses : core_safe = helper\n  where x\n")
    (tmp_path / "A" / "B.lean").write_text("  theorem «odd name» : x := y\r\nabbrev t := core_safe\n")
    found, links, warn = ingest.ingest(ingest.read_sources(spark, str(tmp_path)))
    got = {r.declaration_name: (r.theorem_kind, r.statement_text, r.start_line, r.end_line) for r in found.collect()}
    assert got["core_safe"] == ("theorem", "(n : Nat) : n = n", 4, 7) and got["helper"][:2] == ("definition", ": Nat")
    assert got["uses"][1] == ": core_safe = helper" and got["t"][1] == "definition t" and got["odd name"][1] == "theorem «odd name» : x" and "no" not in got
    assert rows(links.select(F.regexp_extract("src", "^lean:[^:]+:([^:]+):", 1), F.regexp_extract("dst", "^lean:[^:]+:([^:]+):", 1))) == [("t", "core_safe"), ("uses", "core_safe"), ("uses", "helper")]
    assert {(r.code, r.line, r.column, r.snippet) for r in warn.collect()} == {("unsupported_construct", 1, 1, "mutual"), ("parse_fallback", 2, 1, "abbrev t := core_safe")}
    with pytest.raises(ValueError, match="1 unsupported"):
        ingest.refuse_unsupported(warn)
    one = spark.createDataFrame([("A.lean", "theorem foo : a bypass b := by simp")], "file_path string, content string")
    adapters = {"k": tagging.keyword_adapter("d:k", r"(^|/)A$", "zzz"), tagging.FALLBACK: tagging.generic}
    tagged, none, said = ingest.ingest(one, adapters)
    assert [(r.statement_text, r.adapter_id, r.tags) for r in tagged.collect()] == [(": a", "k", ["d:k"])]
    lines = ingest.canonical_lines(tagged, none, said).withColumn("one", F.lit(""))
    assert canon.group_hash(lines, ["one"], ["part"]).first().lines == 5
    path = lambda x: spark.range(1).select(ingest.canonical_path("/r/p", F.lit(x))).first()[0]
    assert [path(x) for x in ("/r/p/A/B.lean", "A//./B.lean", "A/../C.lean", "../x.lean", "/q/r.lean")] == ["A/B.lean", "A/B.lean", "C.lean", "../x.lean", "/q/r.lean"]


def test_leaves_and_migration(spark):
    old = spark.createDataFrame([(" m ", "n", "LEMMA", "s", None, ["b", "a", "b ", None]), (None, "n", "odd", None, "p", None)], "module string, name string, kind string, statement string, pretty string, deps array<string>")
    got = {r.module_path: r for r in leaf.leaves(leaf.migrated(old)).collect()}
    assert got["m"].theorem_kind == "lemma" and got["m"].dependency_ids == ["a", "b"] and got["m"].pretty_statement == "s" and got["m"].leaf_id.startswith("decl_")
    assert got[""].theorem_kind == "unknown" and got[""].dependency_ids == []
    assert {(p.path) for p in leaf.problems(leaf.leaves(leaf.migrated(old))).where("path NOT LIKE 'sourceSpan%'").collect()} == {"modulePath", "statementText"}
    raw = spark.createDataFrame([("1.0.0", "d", "m", "n", "odd", "s", "p", ("f", 2, 1, 1, 0), ["a", " ", None], None), (None, None, None, None, None, None, None, None, [], [])], "schema_version string, declaration_id string, module_path string, declaration_name string, theorem_kind string, statement_text string, pretty_statement string, source_span struct<file_path:string,start_line:int,start_column:int,end_line:int,end_column:int>, tags array<string>, dependency_ids array<string>")
    broken = sorted((r.leaf_id or "", r.path) for r in leaf.problems(leaf.as_delivered(raw)).collect())
    assert [p for i, p in broken if i == "d"] == ["dependencyIds", "sourceSpan.endColumn", "sourceSpan.endLine", "tags", "theoremKind"]
    assert len([p for i, p in broken if i == ""]) == 12
    mixed = spark.createDataFrame([("m1", None, "A"), (None, "m2", "B")], "module string, module_path string, name string")
    assert sorted(r.module_path for r in leaf.migrated(mixed).collect()) == ["m1", "m2"]


def test_tags(spark):
    row = spark.createDataFrame([("a", "K.Kernel", "loop_inv", "lemma", "for all state", ""), ("b", "M", "n", "lemma", "nothing here", None)], "leaf_id string, module_path string, declaration_name string, theorem_kind string, statement_text string, pretty_statement string")
    adapters = {"k": tagging.keyword_adapter("d:k", r"Kernel$", "zzz"), tagging.FALLBACK: tagging.generic}
    got = {r.leaf_id: r for r in tagging.classify(row, adapters).collect()}
    assert got["a"].tags == ["concept:loop", "concept:state", "d:k"] and got["a"].confidence == 0.75 and got["b"].adapter_id == tagging.FALLBACK and got["a"].evidence == ["loop keyword", "module/name signal", "state keyword"]
    forced = {r.leaf_id: r for r in tagging.classify(row, adapters, forced="k").collect()}
    assert forced["b"].downgraded_from == "k" and [w.code for w in forced["b"].warnings] == ["low_confidence_downgrade"] and forced["b"].evidence == [tagging.FALLBACK_EVIDENCE]
    assert [w.code for w in tagging.classify(row, adapters, forced="none").first().warnings] == ["forced_adapter_missing"]
    o = spark.createDataFrame([("b", "k", 0.05, [" new "], ["kind:lemma"])], "leaf_id string, force_adapter_id string, min_confidence double, add_tags array<string>, remove_tags array<string>")
    own = {r.leaf_id: r for r in tagging.classify(row, adapters, overrides=o).collect()}
    assert own["b"].adapter_id == "k" and own["b"].tags == ["new"] and [w.code for w in own["b"].warnings] == ["manual_override_applied"] and own["a"].warnings == []
    samples = spark.createDataFrame([("1", ["x", "y"], ["x", "z"]), ("2", ["x"], ["x"])], "sample_id string, expected array<string>, predicted array<string>")
    m = {r.tag: (r.tp, r.fp, r.fn, r.f1) for r in tagging.evaluate(samples).collect()}
    assert m == {"x": (2, 0, 0, 1.0), "y": (0, 0, 1, 0.0), "z": (0, 1, 0, 0.0)} and tagging.macro(tagging.evaluate(samples)).first().macro_f1 == 0.3333


LEAVES = "tree_id string, node_id string, statement_text string, complexity_score double, needs array<string>"


@pytest.mark.parametrize("shard_leaves", [2000, 6])
def test_trees_have_one_root_and_keep_every_leaf(spark, shard_leaves):
    data = [("t", f"l{i:02}", f"the {['cat', 'dog', 'hat'][i % 3]} number{i}", float(i % 3), [f"l{i - 1:02}"] if i % 4 else None) for i in range(30)] + [("one", "x", None, None, None), (None, "y", "", 1.0, None), ("t", "l00", "the cat number0", 0.0, None)]
    nodes = trees.build_trees(spark.createDataFrame(data, LEAVES), canon.Config(), shard_leaves)
    codes = [r.code for r in trees.validate(nodes, 5).collect()]
    assert not set(codes) - {"policy_violation"}
    got = {r.node_id: r for r in nodes.where("tree_id = 't'").collect()}
    assert {k for k, r in got.items() if r.node_kind == "leaf"} == {f"l{i:02}" for i in range(30)}
    shuffled = trees.build_trees(spark.createDataFrame(data[::-1], LEAVES).repartition(5), canon.Config(), shard_leaves)
    assert {r.node_id for r in shuffled.where("tree_id = 't'").collect()} == set(got)
    assert [r.node_id for r in nodes.where("tree_id = 'one'").collect()] == ["x"]
    assert trees.build_trees(spark.createDataFrame([], LEAVES), canon.Config()).count() == 0


def test_grouping_kernels():
    order, rest = trees.topological_order(["a", "b", "c", "d"], {"a": {"c"}, "c": set(), "b": {"d"}, "d": {"b"}})
    assert order == ["c", "a", "b", "d"] and rest == ["b", "d"]
    groups = trees.greedy_groups({"a": ("x", 1.0), "b": ("x", 2.0), "c": ("x", 4.0), "d": ("x", 5.0)}, {}, 4, 3.0, 1.0)
    assert groups == [["a", "b"], ["c", "d"]]
    assert trees.by_needs(["a", "b"], {"a": {"b"}}) == ["b", "a"] and trees.by_needs(["b", "a"], {"a": {"b"}, "b": {"a"}}) == ["a", "b"]


@pytest.mark.parametrize("kernel_links", [1000, 0])
def test_ancestry_with_a_cycle(spark, rows, kernel_links):
    e = spark.createDataFrame([("p", "r", "a"), ("p", "a", "b"), ("p", "z", "b"), ("p", "x", "y"), ("p", "y", "x")], "proof_id string, parent_id string, child_id string")
    got = {r.node_id: (r.path, r.cut) for r in store.ancestry(e, kernel_links).collect()}
    assert got["b"] == (["r", "a", "b"], False) and got["y"] == (["x", "y"], True) and got["z"] == (["z"], False)


def test_change_plan_and_reuse(spark):
    L = "leaf_id string, module_path string, declaration_name string, theorem_kind string, statement_text string, pretty_statement string, tags array<string>, dependency_ids array<string>"
    row = lambda i, s, deps=(): (i, "m", i, "lemma", s, s, [], list(deps))
    old, new = [row("a", "1"), row("b", "2", ["a"]), row("gone", "3"), row("s", "4")], [row("a", "1x"), row("b", "2", ["a"]), row("c", "5", ["b"]), row("s", "4")]
    edge = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    got = {r.id: (r.change_type, r.is_blocked, r.batch) for r in change.plan(spark.createDataFrame(old, L), spark.createDataFrame(new, L), edge).collect()}
    assert got == {"a": ("changed", True, 0), "b": ("same", True, 1), "c": ("added", True, 2), "gone": ("removed", True, None), "s": ("same", False, None)}
    P = "node_id string, child_ids array<string>, said array<string>"
    o = spark.createDataFrame([("p1", ["a"], ["x"]), ("p2", ["b"], ["y"]), ("p3", ["c"], ["y"])], P)
    n = spark.createDataFrame([("q1", ["a"], ["x "]), ("q2", ["z"], ["x"]), ("q3", ["z"], ["y"])], P)
    assert sorted(map(tuple, change.reuse(o, n).collect())) == [("q1", "p1", "grounding"), ("q2", "p1", "signature")]
    paths = spark.createDataFrame([("p", "a", ["r", "m", "a"]), ("p", "b", ["r", "m", "b"])], "proof_id string, node_id string, path array<string>")
    assert change.lowest_common_ancestors(paths, spark.createDataFrame([("p", "a", "b")], "proof_id string, a string, b string")).first().ancestor == "m"


def test_baseline_and_coverage(spark):
    a = spark.createDataFrame([("x", 1, 2), ("y", 1, 2)], "k string, m int, n int")
    b = spark.createDataFrame([("x", 1, 3), ("z", 1, 2)], "k string, m int, n int")
    found = sorted((r.k, r.code, r.field, r.expected, r.actual) for r in quality.compare_baseline(a, b, "k", ["m", "n"]).collect())
    assert found == [("x", "field_mismatch", "n", "2", "3"), ("y", "missing_preset", "", None, None), ("z", "unexpected_preset", "", None, None)]
    r = spark.range(1).select(policy.token_coverage(F.lit("merging tokens never fails"), F.array(F.lit("tokens merged")), F.array(F.lit("never"))).alias("c")).first()
    assert r.c.total == 3 and abs(r.c.ratio - 1.0) < 1 or r.c.ratio >= 0
