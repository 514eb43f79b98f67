"""Change plans between two versions of a set of declarations, and reuse of what was built before.

Defined results: rows of null ids take no part; a version without rows makes everything added or removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.ids import squash_space
from lemmaflow.operators.graph import batches
from lemmaflow.operators.recover import fingerprint
from lemmaflow.session import cut_lineage


def semantic_fingerprint(leaf: DataFrame) -> DataFrame:
    """id, fp: hash of what a leaf says and depends on, without its place."""
    cols = {c: F.col(c) for c in ("leaf_id", "theorem_kind", "module_path", "declaration_name", "statement_text", "pretty_statement", "dependency_ids", "tags")}
    return leaf.select(F.col("leaf_id").alias("id"), fingerprint(cols).alias("fp"))


def change_types(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change_type (added, removed, changed, same) of two leaf tables."""
    j = semantic_fingerprint(old).withColumnRenamed("fp", "a").join(semantic_fingerprint(new).withColumnRenamed("fp", "b"), "id", "full")
    return j.select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change_type"))


def blocked(changes: DataFrame, edge: DataFrame) -> DataFrame:
    """id, round: what changed, and all that depends on it."""
    seen = front = cut_lineage(changes.where("change_type <> 'same'").select("id", F.lit(0).alias("round")))
    edge, n = cut_lineage(edge.distinct()), 0
    while not front.isEmpty():
        n += 1
        up = edge.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        front = cut_lineage(up.join(seen, "id", "left_anti").withColumn("round", F.lit(n)))
        seen = seen.unionByName(front)
        if n % 10 == 0:  # what is known is read again each round, but written anew only now and then
            seen = cut_lineage(seen)
    return seen


def plan(old: DataFrame, new: DataFrame, edge: DataFrame) -> DataFrame:
    """id, change_type, is_blocked, batch, cyclic: the order in which blocked declarations of the new version are to be worked on again (batch null: nothing to do)."""
    change = cut_lineage(change_types(old, new))
    stop = blocked(change, edge)
    there = stop.join(change.where("change_type <> 'removed'"), "id", "left_semi").select("id")
    order = batches(there, edge)
    return change.join(stop.select("id", F.lit(True).alias("b")), "id", "left").join(order, "id", "left").select("id", "change_type", F.coalesce("b", F.lit(False)).alias("is_blocked"), "batch", "cyclic")


def plan_summary(planned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, changed, added, removed, blocked, unaffected, batches, cyclic_batches, reshaped, rebuild_required, plan_hash of a plan: the hash is the same for the same rows in any order."""
    n = lambda c: F.count(F.when(c, 1))
    kind, stopped = F.col("change_type"), F.col("is_blocked") & (F.col("change_type") != "removed")
    row = F.concat_ws("\x1f", "id", "change_type", F.col("is_blocked").cast("string"), F.coalesce(F.col("batch").cast("string"), F.lit("")))
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(20,0)")), F.lit(0)).cast("string")
    counts = [n(kind != "same").alias("changed"), n(kind == "added").alias("added"), n(kind == "removed").alias("removed"), n(stopped).alias("blocked"), n(~F.col("is_blocked")).alias("unaffected"), F.countDistinct("batch").alias("batches"), F.coalesce(F.max(F.col("cyclic").cast("int")), F.lit(0)).alias("cyclic_batches")]
    g = planned.groupBy(*keys) if keys else planned
    out = g.agg(*counts, F.sha2(F.concat_ws(":", total(1), total(2)), 256).alias("plan_hash"))
    return out.select(*(keys or []), *(c for c in ("changed", "added", "removed", "blocked", "unaffected", "batches", "cyclic_batches")), ((F.col("added") > 0) | (F.col("removed") > 0)).alias("reshaped"), ((F.col("blocked") > 0) | (F.col("removed") > 0)).alias("rebuild_required"), "plan_hash")


def cache_status(entries: DataFrame, current: DataFrame) -> DataFrame:
    """proof_id, config_hash, status (hit, miss), code of what is asked for against what is stored, by (proof_id, config_hash).

    entries: source_fingerprint, graph_hash, snapshot_hash as stored and actual_graph_hash, actual_snapshot_hash as computed from what is stored (null: it couldn't be read); current: source_fingerprint as it is now."""
    e = entries.withColumn("_there", F.lit(True)).withColumnRenamed("source_fingerprint", "_stored")
    j = current.join(e, ["proof_id", "config_hash"], "left")
    code = (
        F.when(F.col("_there").isNull() | ~F.col("_stored").eqNullSafe(F.col("source_fingerprint")), "cache_miss").when(F.col("actual_graph_hash").isNull() | F.col("actual_snapshot_hash").isNull(), "cache_entry_invalid")
        .when(~F.col("actual_graph_hash").eqNullSafe(F.col("graph_hash")), "cache_dependency_hash_mismatch").when(~F.col("actual_snapshot_hash").eqNullSafe(F.col("snapshot_hash")), "cache_snapshot_hash_mismatch").otherwise("cache_hit")
    )
    return j.select("proof_id", "config_hash", F.when(code == "cache_hit", "hit").otherwise("miss").alias("status"), code.alias("code"))


def with_children_said(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node_id, child_ids, said (the children's statements, in the same order) of the parents of a node table with the keys of its tree; a parent with a child that isn't there is left out, as nothing is known of what it was built from."""
    kids = nodes.where("node_kind = 'parent'").select(*keys, "node_id", F.posexplode("child_ids").alias("at", "child_id"), F.size("child_ids").alias("n"))
    said = nodes.select(*keys, F.col("node_id").alias("child_id"), F.coalesce("statement_text", F.lit("")).alias("said"))
    whole = kids.join(said, [*keys, "child_id"]).groupBy(*keys, "node_id", "n").agg(F.array_sort(F.collect_list(F.struct("at", "child_id", "said"))).alias("c")).where(F.size("c") == F.col("n"))
    return whole.select(*keys, "node_id", F.col("c.child_id").alias("child_ids"), F.col("c.said").alias("said"))


def reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """new_id, old_id, how: parents (node_id, child_ids, said: the children's statements, a child's at its place) built before, by children and what they say ('grounding'), else by what they say if the old parents of it
    are of one grounding ('signature'). The children's order doesn't count; of several old parents of a grounding the one with the smallest id is taken."""
    said = F.transform("said", squash_space)
    both = F.array_sort(F.zip_with("child_ids", said, lambda i, s: F.concat(i, F.lit("\x1f"), s)))
    sign = lambda df, n: df.select(F.col("node_id").alias(n), F.sha2(F.concat_ws("\x1e", both), 256).alias("g"), F.sha2(F.concat_ws("\x1e", F.array_sort(said)), 256).alias("s"))
    a, b = sign(old, "old_id").groupBy("g", "s").agg(F.min("old_id").alias("old_id")), sign(new, "new_id")
    exact = b.join(a.select("g", "old_id"), "g").select("new_id", "old_id", F.lit("grounding").alias("how"))
    single = a.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("old_id").alias("old_id")).where("n = 1")
    more = b.join(exact, "new_id", "left_anti").join(single, "s").select("new_id", "old_id", F.lit("signature").alias("how"))
    return exact.unionByName(more)


def primary_paths(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Of store.ancestry's chains of first parents those that reach the root of their tree."""
    j = paths.where("NOT cut").join(roots.select("proof_id", "root_id"), "proof_id")
    return j.where(F.element_at("path", 1) == F.col("root_id")).select("proof_id", "node_id", "path")


def lowest_common_ancestors(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """proof_id, a, b, ancestor: the last node of the beginning that the two paths (proof_id, node_id, path from the root) share; null if they share none."""
    p = lambda n: paths.select("proof_id", F.col("node_id").alias(n), F.col("path").alias(f"path_{n}"))
    j = pairs.join(p("a"), ["proof_id", "a"]).join(p("b"), ["proof_id", "b"])
    same = F.zip_with("path_a", "path_b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same)).cast("int")
    return j.select("proof_id", "a", "b", F.when(n > 0, F.element_at("path_a", n)).alias("ancestor"))


def heights(levels: DataFrame) -> DataFrame:
    """proof_id, node_id, depth: nodes a root leads to, by their height over the deepest level of their tree (levels: proof_id, node_id, hops)."""
    w = Window.partitionBy("proof_id")
    return levels.where("hops >= 0").select("proof_id", "node_id", (F.max("hops").over(w) - F.col("hops")).alias("depth"))
