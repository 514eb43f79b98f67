"""Views of stored trees: roots, pages of children, checked ancestry, leaf details, drill-down, differences, catalogue, scenes and windows.

Trees are tables of nodes (proof_id, node_id, node_kind, statement_text, child_ids, depth, ...) with a root a tree (proof_id, root_id). Views are levels of joins over all trees at once; the few that
depend on the order of one walk (which link closes a cycle) run as a kernel a tree.

Defined results: a child that isn't among the nodes is no child but is reported; a tree without its root shows nothing but 'missing_root'; nodes are shown once a place; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions import text
from lemmaflow.functions.canon import Config, json_text
from lemmaflow.functions.groups import by_group
from lemmaflow.operators.hierarchy import KERNEL_LINKS
from lemmaflow.operators.store import support_sets
from lemmaflow.session import cut_lineage


def child_rows(nodes: DataFrame, parents_only: bool = False) -> DataFrame:
    """proof_id, parent_id, child_id, child_order (place in the list), there: the links by child_ids, with every repeat."""
    links = (nodes.where("node_kind = 'parent'") if parents_only else nodes).select("proof_id", F.col("node_id").alias("parent_id"), F.posexplode("child_ids").alias("child_order", "child_id"))
    ids = nodes.select("proof_id", F.col("node_id").alias("child_id"), F.lit(True).alias("there")).distinct()
    return links.join(ids, ["proof_id", "child_id"], "left").select("proof_id", "parent_id", "child_id", "child_order", F.coalesce("there", F.lit(False)).alias("there"))


def root_nodes(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """proof_id, root_id, node_kind, statement_text, code: each tree's root, or 'missing_root'."""
    one = nodes.select("proof_id", F.col("node_id").alias("root_id"), "node_kind", "statement_text")
    j = roots.select("proof_id", "root_id").join(one, ["proof_id", "root_id"], "left")
    return j.withColumn("code", F.when(F.col("node_kind").isNull(), "missing_root"))


def pages(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """proof_id, node_id, page_offset, page_limit, total, has_more, code, at, child_id of each asked page (proof_id, node_id, page_offset, page_limit; a null limit is all).

    A page's children come in their order, one row each; a page without children is one row with nulls. code: node_not_found, not_a_parent. The offset is held to the number of children."""
    known = nodes.select("proof_id", "node_id", "node_kind")
    w = Window.partitionBy("proof_id", "parent_id")
    kids = child_rows(nodes).where("there").withColumn("at", F.row_number().over(w.orderBy("child_order", "child_id")) - 1).withColumn("total", F.count(F.lit(1)).over(w)).select("proof_id", F.col("parent_id").alias("node_id"), "child_id", "at", "total")
    total = kids.groupBy("proof_id", "node_id").agg(F.max("total").alias("total"))
    q = asked.join(known, ["proof_id", "node_id"], "left").join(total, ["proof_id", "node_id"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    q = q.withColumn("page_offset", F.least(F.greatest(F.coalesce("page_offset", F.lit(0)), F.lit(0)), "total").cast("int")).withColumn("page_limit", F.greatest(F.coalesce("page_limit", "total"), F.lit(1)).cast("int"))
    code = F.when(F.col("node_kind").isNull(), "node_not_found").when(F.col("node_kind") != "parent", "not_a_parent")
    q = q.select("proof_id", "node_id", "page_offset", "page_limit", "total", (F.col("page_offset") + F.col("page_limit") < F.col("total")).alias("has_more"), code.alias("code"))
    k = kids.select("proof_id", "node_id", "child_id", "at").alias("k")
    on = (F.col("q.proof_id") == F.col("k.proof_id")) & (F.col("q.node_id") == F.col("k.node_id")) & (F.col("k.at") >= F.col("q.page_offset")) & (F.col("k.at") < F.col("q.page_offset") + F.col("q.page_limit"))
    return q.alias("q").join(k, on, "left").select("q.*", "k.at", "k.child_id")


def _by_levels(with_path: bool):  # noqa: ANN202
    def run(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
        """What a walk by levels meets, children in their order: the first way to a node is the shortest, and of equal ones the first."""
        kids: dict[str, list[tuple[int, str]]] = {}
        for p, c, at in zip(cols["parent_id"], cols["child_id"], cols["child_order"]):
            if isinstance(p, str):
                kids.setdefault(p, []).append((int(at), c))
        root = cols["root_id"][0]
        up: dict[str, str | None] = {root: None}
        queue = [root]
        for i in queue:
            for _, c in sorted(kids.get(i, ())):
                if c not in up:
                    up[c] = i
                    queue.append(c)
            if not with_path:
                yield key[0], i
                continue
            trail, j = [], i
            while j is not None:
                trail.append(j)
                j = up[j]
            yield key[0], i, trail[::-1]

    return run


def _small_and_large(nodes: DataFrame, roots: DataFrame, kernel_links: int) -> tuple[DataFrame, DataFrame]:
    """Rows for _by_levels of the trees that fit one task (proof_id, root_id, parent_id, child_id, child_order), and (proof_id) of the others."""
    top = roots.select("proof_id", "root_id").join(nodes.select("proof_id", F.col("node_id").alias("root_id")), ["proof_id", "root_id"], "left_semi").distinct()
    rows = cut_lineage(top.join(child_rows(nodes).where("there").drop("there"), "proof_id", "left"))
    large = cut_lineage(rows.groupBy("proof_id").count().where(F.col("count") > kernel_links).select("proof_id"))
    return rows.join(large, "proof_id", "left_anti"), large


def reachable(nodes: DataFrame, roots: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """proof_id, node_id that a tree's root leads to, the root too, as far as they are there. A tree is walked in one task, one of over `kernel_links` links in rounds over all such trees; the rows are the same."""
    small, large = _small_and_large(nodes, roots, kernel_links)
    out = by_group(small, ["proof_id"], ["parent_id", "child_order"], _by_levels(False), "proof_id string, node_id string")
    if large.isEmpty():
        return out
    return out.unionByName(_reachable_rounds(nodes.join(large, "proof_id", "left_semi"), roots.join(large, "proof_id", "left_semi")))


def _reachable_rounds(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    kids = cut_lineage(child_rows(nodes).where("there").select("proof_id", "parent_id", F.col("child_id").alias("node_id")).distinct())
    front = seen = cut_lineage(roots.select("proof_id", F.col("root_id").alias("node_id")).join(nodes.select("proof_id", "node_id"), ["proof_id", "node_id"], "left_semi").distinct())
    n = 0
    while not front.isEmpty():
        step = kids.join(front.withColumnRenamed("node_id", "parent_id"), ["proof_id", "parent_id"]).select("proof_id", "node_id").distinct()
        front = cut_lineage(step.join(seen, ["proof_id", "node_id"], "left_anti"))
        seen, n = seen.unionByName(front), n + 1
        if n % 10 == 0:
            seen = cut_lineage(seen)
    return seen


def _walk(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
    """Codes of a depth-first walk from the root, children in their order."""
    kids: dict[str, list[tuple[int, str, bool]]] = {}
    root, there = cols["root_id"][0], cols["root_there"][0]
    if not there:
        yield key[0], "missing_root", root, ""
        return
    for p, c, at, ok in zip(cols["parent_id"], cols["child_id"], cols["child_order"], cols["there"]):
        if isinstance(p, str):
            kids.setdefault(p, []).append((int(at), c, bool(ok)))
    for a in kids.values():
        a.sort()
    seen, open_, stack = {root}, {root}, [(root, iter(kids.get(root, ())))]
    while stack:
        at, rest = stack[-1]
        for _, c, ok in rest:
            if not ok:
                yield key[0], "missing_node", c, at
            elif c in open_:
                yield key[0], "cycle_detected", c, at
            elif c not in seen:
                seen.add(c)
                open_.add(c)
                stack.append((c, iter(kids.get(c, ()))))
                break
        else:
            stack.pop()
            open_.discard(at)


def walk_codes(nodes: DataFrame, roots: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """proof_id, code (missing_root, missing_node, cycle_detected), node_id, parent_id: what a walk from the root meets. One walk a tree, in order, so a tree over `kernel_links` links is refused."""
    ids = nodes.select("proof_id", F.col("node_id").alias("root_id"), F.lit(True).alias("root_there")).distinct()
    top = roots.select("proof_id", "root_id").join(ids, ["proof_id", "root_id"], "left").withColumn("root_there", F.coalesce("root_there", F.lit(False)))
    rows = cut_lineage(top.join(child_rows(nodes), "proof_id", "left"))
    if not rows.groupBy("proof_id").count().where(F.col("count") > kernel_links).isEmpty():
        raise ValueError(f"a tree has more than {kernel_links} links; a walk in order needs it whole: raise kernel_links")
    return by_group(rows, ["proof_id"], ["parent_id", "child_order", "child_id"], _walk, "proof_id string, code string, node_id string, parent_id string")


def expanded_codes(nodes: DataFrame, reached: DataFrame, expanded: DataFrame) -> DataFrame:
    """proof_id, node_id, code (expanded_node_missing, expanded_node_not_reachable, expanded_node_not_parent) of nodes that can't be opened."""
    j = expanded.select("proof_id", "node_id").distinct().join(nodes.select("proof_id", "node_id", "node_kind"), ["proof_id", "node_id"], "left").join(reached.select("proof_id", "node_id", F.lit(True).alias("r")), ["proof_id", "node_id"], "left")
    code = F.when(F.col("node_kind").isNull(), "expanded_node_missing").when(F.col("r").isNull(), "expanded_node_not_reachable").when(F.col("node_kind") != "parent", "expanded_node_not_parent")
    return j.select("proof_id", "node_id", code.alias("code")).where("code IS NOT NULL")


def place_text(c: Column) -> Column:
    """A list of places as a text that sorts like the list."""
    return F.array_join(F.transform(c, lambda x: F.lpad(x.cast("string"), 10, "0")), ".")


def disclosed(nodes: DataFrame, roots: DataFrame, expanded: DataFrame, max_children: int | None = None) -> DataFrame:
    """The visible nodes of each tree in pre-order of place: proof_id, place, node_id, node_kind, depth_from_root, parent_id, is_expanded, is_expandable, child_count, visible_count, hidden_count.

    Only the nodes in expanded (proof_id, node_id) are opened, to their first max_children; a node that is its own ancestor isn't shown again. Levels go on until none shows a node."""
    facts = nodes.select("proof_id", "node_id", "node_kind", F.size("child_ids").alias("child_count")).join(expanded.select("proof_id", "node_id", F.lit(True).alias("open")).distinct(), ["proof_id", "node_id"], "left")
    expandable = (F.col("node_kind") == "parent") & (F.col("child_count") > 0)
    facts = cut_lineage(facts.withColumn("is_expandable", F.coalesce(expandable, F.lit(False))).withColumn("is_expanded", F.col("is_expandable") & F.coalesce("open", F.lit(False))).drop("open"))
    kids = child_rows(nodes) if max_children is None else child_rows(nodes).where(F.col("child_order") < max_children)
    kids = cut_lineage(kids.where("there").join(facts.where("is_expanded").select("proof_id", F.col("node_id").alias("parent_id")), ["proof_id", "parent_id"], "left_semi").drop("there"))
    none = F.lit(None).cast("string")
    level = cut_lineage(roots.select("proof_id", F.col("root_id").alias("node_id")).join(facts.select("proof_id", "node_id"), ["proof_id", "node_id"], "left_semi").select("proof_id", "node_id", none.alias("parent_id"), F.array(F.lit(0)).alias("place"), F.array("node_id").alias("trail")))
    out = level
    while not level.isEmpty():
        up = level.select("proof_id", F.col("node_id").alias("parent_id"), F.col("place").alias("p"), "trail")
        step = kids.join(up, ["proof_id", "parent_id"]).where(~F.array_contains("trail", F.col("child_id")))
        level = cut_lineage(step.select("proof_id", F.col("child_id").alias("node_id"), "parent_id", F.array_append("p", F.col("child_order")).alias("place"), F.array_append("trail", F.col("child_id")).alias("trail")))
        out = out.unionByName(level)
    shown = F.when(~F.col("is_expanded"), 0).otherwise(F.col("child_count") if max_children is None else F.least("child_count", F.lit(max_children)))
    j = out.join(facts, ["proof_id", "node_id"])
    return j.select("proof_id", place_text(F.col("place")).alias("place"), "node_id", "node_kind", (F.size("place") - 1).alias("depth_from_root"), "parent_id", "is_expanded", "is_expandable", "child_count", shown.alias("visible_count"), (F.col("child_count") - shown).alias("hidden_count"))


def view_lines(shown: DataFrame, nodes: DataFrame, roots: DataFrame, config_hash: str = "none", max_children: int | None = None) -> DataFrame:
    """proof_id, part, line: the canonical text of each tree's drill-down without its diagnostics; hashed by canon.group_hash."""
    w = Window.partitionBy("proof_id").orderBy("place")
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).otherwise("none")
    facts = nodes.select("proof_id", "node_id", "statement_text", F.col("refs"), "child_ids")
    rows = shown.withColumn("i", F.row_number().over(w) - 1).join(facts, ["proof_id", "node_id"])
    flag = lambda c: F.col(c).cast("string")
    fields = [("id", F.col("node_id")), ("kind", F.col("node_kind")), ("depth", F.col("depth_from_root").cast("string")), ("parent", F.coalesce("parent_id", F.lit("none"))), ("expanded", flag("is_expanded")), ("expandable", flag("is_expandable")), ("child_count", F.col("child_count").cast("string")), ("visible_child_ids", listed(F.slice("child_ids", F.lit(1), F.col("visible_count")))), ("hidden_child_count", F.col("hidden_count").cast("string")), ("evidence_refs", listed("refs")), ("statement", json_text(F.col("statement_text")))]
    body = rows.select("proof_id", (F.col("i") + 10).alias("part"), F.concat_ws("\n", *(F.concat(F.lit("visible["), F.col("i").cast("string"), F.lit(f"].{n}="), c) for n, c in fields)).alias("line"))
    opened = shown.groupBy("proof_id").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("is_expanded"), F.col("node_id"))))), ",").alias("e"), F.count(F.lit(1)).alias("n"))
    head = roots.join(opened, "proof_id").select("proof_id", F.posexplode(F.array(F.lit("schema=progressive-disclosure-v1"), F.concat(F.lit("root_id="), "root_id"), F.lit(f"tree_config_hash={config_hash}"), F.concat(F.lit("expanded="), F.when(F.col("e") == "", "none").otherwise(F.col("e"))), F.lit(f"max_children={'none' if max_children is None else max_children}"), F.concat(F.lit("visible_count="), F.col("n").cast("string")))).alias("part", "line"))
    return head.select("proof_id", F.col("part").cast("int").alias("part"), "line").unionByName(body)


def provenance_paths(nodes: DataFrame, roots: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """proof_id, node_id, path: the shortest path from the root to each node it leads to, of equal ones the one that comes first by the children's order. Trees of over `kernel_links` links go level by level, as in reachable."""
    small, large = _small_and_large(nodes, roots, kernel_links)
    out = by_group(small, ["proof_id"], ["parent_id", "child_order"], _by_levels(True), "proof_id string, node_id string, path array<string>")
    if large.isEmpty():
        return out
    return out.unionByName(_path_rounds(nodes.join(large, "proof_id", "left_semi"), roots.join(large, "proof_id", "left_semi")))


def _path_rounds(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    kids = cut_lineage(child_rows(nodes).where("there").groupBy("proof_id", "parent_id", "child_id").agg(F.min("child_order").alias("child_order")))
    front = cut_lineage(roots.select("proof_id", F.col("root_id").alias("node_id")).join(nodes.select("proof_id", "node_id"), ["proof_id", "node_id"], "left_semi").distinct().select("proof_id", "node_id", F.array().cast("array<int>").alias("place"), F.array("node_id").alias("path")))
    done, n = front, 0
    while not front.isEmpty():
        step = kids.join(front.select("proof_id", F.col("node_id").alias("parent_id"), "place", "path"), ["proof_id", "parent_id"])
        step = step.groupBy("proof_id", F.col("child_id").alias("node_id")).agg(F.min(F.struct(F.array_append("place", F.col("child_order")).alias("place"), "path")).alias("v"))
        front = cut_lineage(step.join(done.select("proof_id", "node_id"), ["proof_id", "node_id"], "left_anti").select("proof_id", "node_id", "v.place", F.array_append("v.path", F.col("node_id")).alias("path")))
        done, n = done.unionByName(front), n + 1
        if n % 8 == 0:
            done = cut_lineage(done)
    return done.select("proof_id", "node_id", "path")


def checked_ancestry(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """proof_id, node_id, path, ok, code of store.ancestry's paths: cycle_detected where a cycle ends the chain, leaf_not_reachable where it doesn't begin at the root."""
    j = paths.join(roots.select("proof_id", "root_id"), "proof_id", "left")
    code = F.when(F.col("cut"), "cycle_detected").when(~F.element_at("path", 1).eqNullSafe(F.col("root_id")), "leaf_not_reachable")
    return j.select("proof_id", "node_id", "path", code.isNull().alias("ok"), code.alias("code"))


#: Labels (fixed values): what an origin of a source address, and a failed rule of the gate, is called.
ORIGINS = {
    "leaf": ("Leaf-attested URL", "The leaf record includes an explicit sourceUrl."),
    "source_span": ("Resolved from source span", "The link was deterministically derived from sourceBaseUrl plus sourceSpan."),
    "missing": ("Missing source URL", "No sourceUrl is available for this leaf; deep-link verification is unavailable."),
}
FAILURES = {
    "unsupported_parent_rate": "Unsupported parent rate too high",
    "prerequisite_violation_rate": "Prerequisite-order violation rate too high",
    "policy_violation_rate": "Policy violation rate too high",
    "term_jump_rate": "Term-jump rate too high",
    "complexity_spread_mean": "Mean complexity spread too high",
    "evidence_coverage_mean": "Mean evidence coverage too low",
    "vocabulary_continuity_mean": "Mean vocabulary continuity too low",
    "min_repartition_event_rate": "Repartition pressure below minimum",
    "repartition_event_rate": "Repartition pressure above maximum",
    "repartition_max_round": "Repartition max round above maximum",
}


def _looked_up(values: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c)


def failure_label(code: Column) -> Column:
    return F.coalesce(_looked_up(FAILURES, code), F.concat(F.lit("Threshold check failed ("), text.display_text(text.humanize(code)), F.lit(")")))


def leaf_details(leaf: DataFrame, paths: DataFrame, rollup: DataFrame, base: str | None = None) -> DataFrame:
    """One row a tree and leaf on it: proof_id, leaf_id, path, compact and markdown reference, source_url, its origin with label, jobs and the latest one, code (missing_source_url).

    leaf: leaf-shaped rows, with source_url where they have one; paths: provenance_paths; rollup: store.job_rollup with latest_status; base: where source addresses begin."""
    from lemmaflow.operators.ingest import source_url

    own = F.nullif(F.trim("source_url"), F.lit("")) if "source_url" in leaf.columns else F.lit(None).cast("string")
    s = F.col("source_span")
    made = source_url(F.lit(base or ""), s["file_path"], s, keep_empty=False) if base else F.lit(None).cast("string")
    url = F.coalesce(own, made)
    origin = F.when(own.isNotNull(), "leaf").when(made.isNotNull(), "source_span").otherwise("missing")
    name = F.concat_ws(".", "module_path", "declaration_name")
    span = F.format_string("%d:%d-%d:%d", s["start_line"], s["start_column"], s["end_line"], s["end_column"])
    rows = leaf.select("leaf_id", name.alias("declaration"), F.concat(name, F.lit("@"), span).alias("compact"), url.alias("source_url"), origin.alias("source_url_origin"))
    j = rows.join(paths.select("proof_id", F.col("node_id").alias("leaf_id"), "path"), "leaf_id").join(rollup, "leaf_id", "left")
    mark = F.when(F.col("source_url").isNotNull(), F.concat(F.lit("["), "declaration", F.lit("]("), "source_url", F.lit(")"))).otherwise(F.concat(F.lit("`"), "compact", F.lit("`")))
    label = lambda k: _looked_up({o: v[k] for o, v in ORIGINS.items()}, F.col("source_url_origin"))
    return j.select("proof_id", "leaf_id", "path", "compact", mark.alias("markdown"), "source_url", "source_url_origin", label(0).alias("origin_label"), F.coalesce("jobs", F.lit(0)).alias("total_jobs"), "latest_job", "latest_status", F.when(F.col("source_url").isNull(), "missing_source_url").alias("code"))


def unreachable_leaves(leaf: DataFrame, trees: DataFrame, paths: DataFrame) -> DataFrame:
    """proof_id, leaf_id, code: asked leaves (trees: proof_id, leaf_id) that aren't known (leaf_not_found) or to which no path leads (leaf_not_reachable)."""
    j = trees.select("proof_id", "leaf_id").distinct().join(leaf.select("leaf_id", F.lit(True).alias("known")).distinct(), "leaf_id", "left").join(paths.select("proof_id", F.col("node_id").alias("leaf_id"), F.lit(True).alias("led")), ["proof_id", "leaf_id"], "left")
    code = F.when(F.col("known").isNull(), "leaf_not_found").when(F.col("led").isNull(), "leaf_not_reachable")
    return j.select("proof_id", "leaf_id", code.alias("code")).where("code IS NOT NULL")


def comparables(nodes: DataFrame, pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """proof_id, key, node_id, node_kind, support, statement_text, depth of the nodes that the root leads to: a leaf's key is its id, a parent's all leaves below it."""
    n = nodes.join(reached, ["proof_id", "node_id"], "left_semi")
    below = support_sets(n, pairs).select("proof_id", "node_id", "support")
    support = F.coalesce("support", F.lit(""))
    key = F.when(F.col("node_kind") == "leaf", F.concat(F.lit("leaf:"), "node_id")).otherwise(F.concat(F.lit("parent:"), support))
    return n.join(below, ["proof_id", "node_id"], "left").select("proof_id", key.alias("key"), "node_id", "node_kind", support.alias("support"), "statement_text", "depth")


def diff_report(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """proof_id, key (with '#' and the place within equal keys), type (added, removed, changed), node_kind, support, and node_id, statement and depth of both sides, of comparables."""
    w = Window.partitionBy("proof_id", "key").orderBy("node_id")
    put = lambda df, s: df.select("proof_id", "key", (F.row_number().over(w) - 1).alias("at"), F.struct("node_kind", "support", "node_id", F.col("statement_text").alias("said"), "depth").alias(s))
    j = put(baseline, "a").join(put(candidate, "b"), ["proof_id", "key", "at"], "full")
    same = F.col("a.said").eqNullSafe(F.col("b.said")) & F.col("a.depth").eqNullSafe(F.col("b.depth"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~same, "changed")
    cols = [F.col(f"{s}.{c}").alias(f"{n}_{d}") for s, n in (("a", "baseline"), ("b", "candidate")) for c, d in (("node_id", "node_id"), ("said", "statement"), ("depth", "depth"))]
    return j.select("proof_id", F.concat("key", F.lit("#"), F.col("at").cast("string")).alias("key"), kind.alias("type"), F.coalesce("a.node_kind", "b.node_kind").alias("node_kind"), F.coalesce("a.support", "b.support").alias("support"), *cols).where("type IS NOT NULL")


def diff_summary(changes: DataFrame) -> DataFrame:
    """proof_id, total, added, removed, changed."""
    n = lambda t: F.count(F.when(F.col("type") == t, 1)).alias(t)
    return changes.groupBy("proof_id").agg(F.count(F.lit(1)).alias("total"), n("added"), n("removed"), n("changed"))


def diff_panel(changes: DataFrame, max_changes: int = 24) -> DataFrame:
    """proof_id, at, key, type, node_kind, support_count, delta (of changed statements), total, hidden: the first changes of each tree by key; between 1 and 200 of them."""
    most = min(200, max(1, max_changes))
    w = Window.partitionBy("proof_id")
    rows = changes.withColumn("at", F.row_number().over(w.orderBy("key")) - 1).withColumn("total", F.count(F.lit(1)).over(w)).where(F.col("at") < most)
    delta = F.when(F.col("type") == "changed", text.statement_delta(F.coalesce("baseline_statement", F.lit("")), F.coalesce("candidate_statement", F.lit(""))))
    return rows.select("proof_id", "at", "key", "type", "node_kind", F.when(F.col("support") == "", 0).otherwise(F.size(F.split("support", ","))).alias("support_count"), delta.alias("delta"), "total", F.greatest(F.col("total") - most, F.lit(0)).alias("hidden"))


def diff_lines(changes: DataFrame, baseline: Config, candidate: Config) -> DataFrame:
    """proof_id, part, line: a canonical text of each tree's differences, a line a change by key, after the plan that the two configurations ask for; hashed by canon.group_hash."""
    plan = baseline.regeneration_plan(candidate)
    fields = ["key", "type", "node_kind", "support", *(f"{s}_{c}" for s in ("baseline", "candidate") for c in ("node_id", "statement", "depth"))]
    line = F.to_json(F.struct(*fields))
    head = diff_summary(changes).select("proof_id", F.lit("").alias("part"), F.concat_ws("|", F.lit(plan["scope"]), F.lit(",".join(plan["changedFields"])), F.lit(baseline.hash()), F.lit(candidate.hash()), F.col("total").cast("string")).alias("line"))
    return head.unionByName(changes.select("proof_id", F.col("key").alias("part"), line.alias("line")))


def catalogue(nodes: DataFrame, roots: DataFrame, config: Config) -> DataFrame:
    """proof_id, root_id, root_statement, config_hash, leaf_count, max_depth of each tree; a root that isn't there stands for its statement."""
    n = nodes.groupBy("proof_id").agg(F.count(F.when(F.col("node_kind") == "leaf", 1)).alias("leaf_count"), F.max("depth").alias("max_depth"))
    said = nodes.select("proof_id", F.col("node_id").alias("root_id"), F.col("statement_text").alias("s"))
    return roots.join(n, "proof_id").join(said, ["proof_id", "root_id"], "left").select("proof_id", "root_id", F.coalesce("s", "root_id").alias("root_statement"), F.lit(config.hash()).alias("config_hash"), "leaf_count", "max_depth")


def fully_loaded(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """proof_id, loaded: whether all that a tree's root leads to is there."""
    reached = reachable(nodes, roots)
    gone = child_rows(nodes, True).where("NOT there").join(reached.withColumnRenamed("node_id", "parent_id"), ["proof_id", "parent_id"], "left_semi").select("proof_id").distinct()
    top = reached.select("proof_id").distinct().withColumn("there", F.lit(True))
    return roots.select("proof_id").join(top, "proof_id", "left").join(gone.withColumn("gone", F.lit(True)), "proof_id", "left").select("proof_id", (F.col("there").isNotNull() & F.col("gone").isNull()).alias("loaded"))


def scene(nodes: DataFrame, roots: DataFrame, sample: DataFrame, seed: str, selected: DataFrame | None = None, on_path: DataFrame | None = None) -> DataFrame:
    """proof_id, node_id, depth, parent_id, x, y, z, status of what a root leads to: a level is ordered as a walk by levels meets it, 7.2 apart and centred, levels are 5.6 apart, z is a jitter of the id.

    status, the first that holds: selected, path, root, leaf, unsupported_parent, prerequisite_violation, policy_violation, parent_ok. sample: quality.samples; selected, on_path: (proof_id, node_id)."""
    kids = cut_lineage(child_rows(nodes, True).where("there").groupBy("proof_id", "parent_id", "child_id").agg(F.min("child_order").alias("child_order")))
    front = cut_lineage(roots.select("proof_id", F.col("root_id").alias("node_id")).join(nodes.select("proof_id", "node_id"), ["proof_id", "node_id"], "left_semi").select("proof_id", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("rank"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("width")))
    done, d = front, 0
    level = Window.partitionBy("proof_id")
    while not front.isEmpty():
        d += 1
        step = kids.join(front.select("proof_id", F.col("node_id").alias("parent_id"), "rank"), ["proof_id", "parent_id"]).join(done.select("proof_id", F.col("node_id").alias("child_id")), ["proof_id", "child_id"], "left_anti")
        first = step.groupBy("proof_id", F.col("child_id").alias("node_id")).agg(F.min(F.struct("rank", "child_order", "parent_id")).alias("v"))
        front = cut_lineage(first.select("proof_id", "node_id", "v.parent_id", (F.row_number().over(level.orderBy("v.rank", "v.child_order")) - 1).alias("rank"), F.lit(d).alias("depth"), F.count(F.lit(1)).over(level).alias("width")))
        done = done.unionByName(front)
        if d % 8 == 0:
            done = cut_lineage(done)
    flag = lambda df, n: df.select("proof_id", "node_id", F.lit(True).alias(n)).distinct()
    j = done.join(nodes.select("proof_id", "node_id", "node_kind"), ["proof_id", "node_id"]).join(sample.select("proof_id", "node_id", "supported_claim_ratio", "prerequisite_order_violations", "policy_violation_count"), ["proof_id", "node_id"], "left")
    for df, n in ((selected, "is_selected"), (on_path, "in_path")):
        j = j.join(flag(df, n), ["proof_id", "node_id"], "left") if df is not None else j.withColumn(n, F.lit(None).cast("boolean"))
    status = F.when(F.col("is_selected"), "selected").when(F.col("in_path"), "path").when(F.col("depth") == 0, "root").when(F.col("node_kind") == "leaf", "leaf").when(F.col("supported_claim_ratio") < 1, "unsupported_parent").when(F.col("prerequisite_order_violations") > 0, "prerequisite_violation").when(F.col("policy_violation_count") > 0, "policy_violation").otherwise("parent_ok")
    three = lambda c: F.floor(c * 1000 + 0.5) / 1000
    jitter = F.pmod(text.fnv1a_column(F.concat(F.lit(f"{seed}:"), "node_id")), F.lit(1000)) / 1000 - 0.5
    return j.select("proof_id", "node_id", "depth", "parent_id", three((F.col("rank") - (F.col("width") - 1) / 2) * 7.2).alias("x"), three(F.col("depth") * -5.6).alias("y"), three(jitter * 1.8).alias("z"), status.alias("status"))


@dataclass(frozen=True)
class RowWindow:
    """Rows that are drawn: first and last index (last before first if none), rows above and below."""

    mode: str
    start: int
    end: int
    above: int
    below: int


def render_window(total: int, anchor: int, most: int = 120, overscan: int = 24) -> RowWindow:
    """A window of `most` rows around the anchor, with `overscan` more on each side."""
    total = max(0, total)
    if total <= most:
        return RowWindow("full", 0, total - 1, 0, 0)
    core = min(max(0, min(max(anchor, 0), total - 1) - most // 2), total - most)
    start, end = max(0, core - overscan), min(total - 1, core + most - 1 + overscan)
    return RowWindow("windowed", start, end, start, total - end - 1)


def scroll_window(total: int, top_px: int, row_px: int, rows: int, overscan: int) -> tuple[RowWindow, int, int]:
    """The window at a scroll position, with the heights of the spaces above and below it."""
    total = max(0, total)
    top = min(max(top_px, 0), max(0, total * row_px - rows * row_px))
    first = top // row_px
    last = min(total - 1, first + rows - 1)
    start, end = max(0, first - overscan), min(total - 1, last + overscan)
    w = RowWindow("virtualized", start, end, start, total - end - 1)
    return w, start * row_px, max(0, w.below) * row_px


def window_rows(rows: DataFrame, keys: list[str], order: list[str], anchor: int, most: int = 120, overscan: int = 24) -> DataFrame:
    """The rows of each group's render window, with their index: the same arithmetic over a table."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    core = F.least(F.greatest(F.lit(0), F.least(F.lit(max(anchor, 0)), F.col("n") - 1) - most // 2), F.col("n") - most)
    inside = (F.col("n") <= most) | F.col("at").between(core - overscan, core + most - 1 + overscan)
    return r.where(inside).drop("n")
