from datetime import datetime

from lemmaflow.operators import orphans

T = lambda m, d=1: datetime(2025, m, d)
DECL = "declaration_id string, dependency_ids array<string>, indexed_at timestamp, deleted_at timestamp, period string"
MISS = "declaration_id string, dependency_id string, reported_at timestamp, reason string"
PROV = "node_id string, leaf_id string, recorded_at timestamp, ref_key string"


def test_reasons_periods_and_cascade(spark, rows):
    decls = spark.createDataFrame([("a", ["b ", "nowhere", None, " ", "sym"], T(3), None, ""), ("b", ["late"], T(1), T(2), ""), ("b", None, T(2, 15), T(4), ""), ("late", [], T(6), None, ""), ("up", ["a"], T(5), None, ""), ("top", ["up"], T(5), None, "")], DECL)
    miss = spark.createDataFrame([("a", "b", T(4), ""), ("a", "b", T(4), ""), (None, "a", T(1), ""), ("a", None, T(1), "")], MISS)
    prov = spark.createDataFrame([("n", "top", T(7), ""), ("n", "b", T(2, 3), ""), ("n", "b", None, "")], PROV)
    symbols = spark.createDataFrame([("sym ",), (None,)], "symbol_id string")
    refs = orphans.references(decls, miss, prov)
    c = orphans.cascade(orphans.labelled(refs, decls, symbols))
    assert rows(orphans.found(c)) == sorted([
        ("lean_declarations", "a", "nowhere", "2025-03", "missing"), ("lean_declarations", "b", "late", "2025-01", "late"), ("missing_dependency_refs", "a", "b", "2025-04", "deleted"),
        ("missing_dependency_refs", "", "a", "2025-01", "late"), ("tree_provenance", "n", "b", "2025-02", "deleted"), ("tree_provenance", "n", "b", "", "deleted"),
    ], key=repr)
    inherited = {(r.src_key, r.ref_key, r.round) for r in c.where("kind = 'inherited'").collect()}
    assert inherited == {("a", "b", 1), ("up", "a", 1), ("top", "up", 2), ("n", "top", 3)}
    assert orphans.report(c).count() == 8
    assert rows(orphans.cascade(orphans.labelled(refs.limit(0), decls, symbols))) == []
    assert orphans.labelled(refs, decls.limit(0), symbols).where("reason <> 'missing'").count() == 0


def test_a_long_chain_is_followed_to_its_end(spark):
    n = 60
    decls = spark.createDataFrame([(f"d{i:03}", [f"d{i - 1:03}" if i else "nowhere"], T(1), None, "") for i in range(n)], DECL)
    refs = orphans.references(decls, spark.createDataFrame([], MISS), spark.createDataFrame([], PROV))
    c = orphans.cascade(orphans.labelled(refs, decls, spark.createDataFrame([], "symbol_id string")))
    assert c.count() == n and c.agg({"round": "max"}).first()[0] == n - 1
