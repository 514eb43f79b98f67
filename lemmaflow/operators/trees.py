"""Bottom-up explanation trees: greedy bounded grouping, policy checks with repartition, one root a tree.

Grouping is sequential by nature, so it runs as a kernel over one tree in one task. A tree of over `shard_leaves` leaves is cut into ranges of its
topological order (the layers of its dependency graph), so that what a leaf needs lies in its own range or an earlier one; the ranges' roots are the leaves of
the next round, and no task holds an unbounded group. For such trees groups don't cross ranges, which is a documented change of meaning.

Defined results: null or blank ids make no leaf, repeated ids count once (the first by statement); a missing complexity is the
target; empty input gives no rows. Where a tree can't go on by the rules (a group of two that breaks the policy, a layer in which nothing can be grouped, the depth limit) an
issue is reported; with `strict` the tree ends there, else the group is kept with its codes in `violations` and neighbours are paired, so that every tree has one root.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.canon import Config, locale_key
from lemmaflow.functions.groups import by_group
from lemmaflow.functions.ids import clean_id, clean_ids
from lemmaflow.functions.text import GROUPING_STOP, grouping_tokens
from lemmaflow.operators import policy
from lemmaflow.operators.graph import batches
from lemmaflow.session import cut_lineage

#: Rows of all kinds that the kernel gives (part: node, event, layer, issue); ids are child ids, the group's ids or the layer's order.
ROW = (
    "tree_id string, part string, depth int, place int, round int, node_id string, node_kind string, statement_text string, ids array<string>, groups array<array<string>>, codes array<string>, reason string, "
    "complexity_score double, abstraction_score double, confidence double, why string, terms array<string>, refs array<string>, spread double, order_violations int, evidence double, continuity double"
)
_NAMES = [c.split()[0] for c in ROW.split(", ")]


def topological_order(ids: list[str], needs: dict[str, set[str]]) -> tuple[list[str], list[str]]:
    """(order, left over): always the first id, by locale, that is ready; what a cycle holds back, or needs itself, follows by id."""
    key = {i: locale_key(i) for i in ids}
    wait = {i: {p for p in needs.get(i, ()) if p in key} for i in ids}
    users = defaultdict(list)
    for i, ps in wait.items():
        for p in ps:
            users[p].append(i)
    ready = [(key[i], i) for i in ids if not wait[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, i = heapq.heappop(ready)
        out.append(i)
        for j in users[i]:
            wait[j].discard(i)
            if not wait[j]:
                heapq.heappush(ready, (key[j], j))
    placed = set(out)
    rest = sorted((i for i in ids if i not in placed), key=key.get)
    return out + rest, rest


def word_set(text: str) -> frozenset[str]:
    return frozenset(w for w in re.split("[^a-z0-9_]+", text.lower()) if len(w) >= 3 and w not in GROUPING_STOP)


def greedy_groups(nodes: dict[str, tuple[str, float | None]], needs: dict[str, set[str]], most: int, target: float, band: float) -> list[list[str]]:
    """Groups of at most `most`: seeds in topological order, each filled with the eligible node most alike any member; of equal ones the nearest to the members' mean, then to the target, then the first.

    Eligible is what needs nothing that isn't grouped yet. Nodes that share a word with a member are found by an index of words, the nearest one by a list sorted by complexity."""
    order, _ = topological_order(list(nodes), needs)
    place, c = {i: k for k, i in enumerate(order)}, {i: target if nodes[i][1] is None else nodes[i][1] for i in nodes}
    words, holders = {i: word_set(nodes[i][0]) for i in nodes}, defaultdict(set)
    for i, ws in words.items():
        for w in ws:
            holders[w].add(i)
    wait = {i: {p for p in needs.get(i, ()) if p in nodes} for i in nodes}
    users = defaultdict(list)
    for i, ps in wait.items():
        for p in ps:
            users[p].append(i)
    pool = sorted((c[i], place[i]) for i in nodes if not wait[i])
    free, groups = set(nodes), []

    def take(i: str) -> None:
        free.discard(i)
        at = bisect.bisect_left(pool, (c[i], place[i]))
        if at < len(pool) and pool[at] == (c[i], place[i]):
            pool.pop(at)
        for w in words[i]:
            holders[w].discard(i)
        for j in users[i]:
            wait[j].discard(i)
            if not wait[j] and j in free:
                bisect.insort(pool, (c[j], place[j]))

    def nearest(lo: float, hi: float, mean: float) -> str | None:
        at, found = bisect.bisect_left(pool, (mean, -1)), []
        if at < len(pool) and pool[at][0] <= hi:
            found.append(pool[at])
        if at > 0 and pool[at - 1][0] >= lo:
            found.append(pool[bisect.bisect_left(pool, (pool[at - 1][0], -1))])
        return order[min(found, key=lambda x: (abs(x[0] - mean), abs(x[0] - target), x[1]))[1]] if found else None

    for seed in order:
        if seed not in free:
            continue
        group, best = [], {}
        i, lo, hi, total = seed, c[seed], c[seed], 0.0
        while True:
            take(i)
            group.append(i)
            lo, hi, total = min(lo, c[i]), max(hi, c[i]), total + c[i]
            if len(group) >= most:
                break
            shared: dict[str, int] = defaultdict(int)
            for w in words[i]:
                for j in holders[w]:
                    shared[j] += 1
            for j, n in shared.items():
                best[j] = max(best.get(j, 0.0), n / (len(words[i]) + len(words[j]) - n))
            mean = total / len(group)
            alike = [j for j in best if j in free and not wait[j] and max(hi, c[j]) - min(lo, c[j]) <= band]
            if alike:
                i = min(alike, key=lambda j: (-best[j], abs(c[j] - mean), abs(c[j] - target), place[j]))
            else:
                i = nearest(hi - band, lo + band, mean)
                if i is None or max(hi, c[i]) - min(lo, c[i]) > band:
                    break
        groups.append(group)
    return groups


def by_needs(group: list[str], needs: dict[str, set[str]]) -> list[str]:
    """The group with needs first, by id where it is free; a cycle is broken at its first id."""
    left, out = sorted(group, key=locale_key), []
    while left:
        ready = next((i for i in left if not any(p in left for p in needs.get(i, ()))), left[0])
        left.remove(ready)
        out.append(ready)
    return out


def parent_id(depth: int, index: int, children: list[str]) -> str:
    return f"p_{depth}_{index}_" + hashlib.sha256(f"{depth}:{index}:{','.join(children)}".encode()).hexdigest()[:16]


def depth_limit(leaves: int, most: int) -> int:
    return 0 if leaves <= 1 else max(math.ceil(math.log(leaves) / math.log(max(2, most))) + 2, min(2048, leaves))


def build_tree(leaves: list[tuple[str, str, float | None, set[str]]], config: Config, summarize: policy.Summarizer = policy.joined, depth: int = 0, strict: bool = False) -> list[dict]:
    """Rows (dicts of ROW's columns) of one tree above its leaves (id, statement, complexity, needs): nodes, repartition events, layers and issues."""
    target, band, most = float(config.complexity_level), float(config.complexity_band), config.max_children
    nodes: dict[str, tuple[str, float | None]] = {i: (s, c) for i, s, c, _ in leaves}
    needs = {i: set(n) for i, _, _, n in leaves}
    active, rows, limit = list(nodes), [], depth + depth_limit(len(nodes), most)

    def issue(code: str, at: int, ids: list[str], codes: list[str]) -> None:
        rows.append({"part": "issue", "depth": depth, "place": at, "ids": ids, "reason": code, "codes": codes})

    while len(active) > 1:
        depth += 1
        if depth > limit:
            issue("depth_limit", 0, active, [])
            if strict:
                return rows
        here = {i: nodes[i] for i in active}
        groups = greedy_groups(here, needs, most, target, band)
        order, left_over = topological_order(active, needs)
        warned = ["missing_complexity"] * any(c is None for _, c in here.values()) + ["cycle_detected"] * bool(left_over)
        stuck = all(len(g) == 1 for g in groups)
        if stuck:
            issue("no_progress", 0, active, [])
            if strict:
                return rows
            groups = [order[k : k + 2] for k in range(0, len(order), 2)]
        rows.append({"part": "layer", "depth": depth, "ids": order, "codes": warned, "groups": groups})
        above, spare = [], len(groups)
        for index, group in enumerate(groups):
            made, passed, todo = [], [], [(group, 0)]
            while todo:
                g, turn = todo.pop(0)
                if len(g) == 1:
                    passed.append(g[0])
                    continue
                g = by_needs(g, needs)
                kids = [policy.Child(i, *nodes[i], sorted(needs.get(i, ()))) for i in g]
                spread, late, broken = policy.before(kids, config)
                reason, codes, said, evidence, share, tries = "pre_summary_policy", list(broken), None, 0.0, 0.0, 0
                if not broken:
                    reason, codes = "post_summary_policy", []
                    for tries in range(2):
                        said = summarize(kids, config, tries)
                        bad = policy.criticize(said, kids, config)
                        evidence, share, codes = (0.0, 0.0, [policy.AS_POLICY[b] for b in bad]) if bad else policy.after(said, kids, config)
                        if not codes:
                            break
                if codes and len(g) > 2 and not stuck:
                    half = (len(g) + 1) // 2
                    rows.append({"part": "event", "depth": depth, "place": index, "round": turn, "reason": reason, "ids": g, "groups": [g[:half], g[half:]], "codes": sorted(set(codes))})
                    todo[:0] = [(g[:half], turn + 1), (g[half:], turn + 1)]
                    continue
                if codes:
                    issue(reason, index, g, sorted(set(codes)))
                    if strict:
                        return rows
                    said = said or summarize(kids, config, 0)
                at = index if turn == 0 else spare
                spare += turn > 0
                pid = parent_id(depth, at, g)
                rows.append({
                    "part": "node", "depth": depth, "place": at, "round": tries, "node_id": pid, "node_kind": "parent", "statement_text": said.said, "ids": g, "codes": sorted(set(codes)), "complexity_score": said.complexity,
                    "abstraction_score": said.abstraction, "confidence": said.confidence, "why": said.why, "terms": said.terms, "refs": said.refs, "spread": float(spread), "order_violations": late, "evidence": evidence, "continuity": share,
                })
                nodes[pid] = (said.said, said.complexity)
                made.append(pid)
            above += made + passed
        active = above
    return rows


def _kernel(config: Config, first: bool, summarize: policy.Summarizer, strict: bool):  # noqa: ANN202
    def run(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
        leaves = list(dict((i, (i, s, None if c is None or c != c else float(c), set(n))) for i, s, c, n in reversed(list(zip(cols["node_id"], cols["statement_text"], cols["complexity_score"], cols["needs"])))).values())
        rows = [{"part": "node", "depth": 0, "node_id": i, "node_kind": "leaf", "statement_text": s, "complexity_score": c, "ids": [], "codes": [], "refs": [i], "terms": []} for i, s, c, _ in leaves] if first else []
        rows += build_tree(leaves, config, summarize, int(max(cols["node_depth"])), strict)
        for r in rows:
            yield tuple(key[0] if n == "tree_id" else r.get(n) for n in _NAMES)

    return run


def build(leaves: DataFrame, config: Config, shard_leaves: int = 20_000, summarize: policy.Summarizer = policy.joined, strict: bool = False) -> DataFrame:
    """ROW rows of one tree a tree_id over (tree_id, node_id, statement_text, complexity_score, needs), written once."""
    rows = leaves.select(clean_id("tree_id").alias("tree_id"), clean_id("node_id").alias("node_id"), F.coalesce("statement_text", F.lit("")).alias("statement_text"), F.col("complexity_score").cast("double").alias("complexity_score"), clean_ids("needs").alias("needs"), F.lit(0).alias("node_depth"))
    rows = rows.where("tree_id IS NOT NULL AND node_id IS NOT NULL").groupBy("tree_id", "node_id").agg(F.min(F.struct("statement_text", "complexity_score", "needs", "node_depth")).alias("v")).select("tree_id", "node_id", "v.*")
    rows, out, first = cut_lineage(rows), None, True
    while True:
        sizes = rows.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
        large = cut_lineage(sizes.where(F.col("n") > shard_leaves))
        more = not large.isEmpty()
        placed = rows.withColumn("shard", F.lit(0))
        if more:
            hot = rows.join(large, "tree_id")
            ids = lambda c: F.concat_ws("\x1f", "tree_id", c)
            layer = batches(hot.select(ids("node_id").alias("id")), hot.select(ids("node_id").alias("src"), F.explode("needs").alias("d"), "tree_id").select("src", ids("d").alias("dst")))
            cuts = hot.join(layer.select(F.substring_index("id", "\x1f", 1).alias("tree_id"), F.substring_index("id", "\x1f", -1).alias("node_id"), "batch"), ["tree_id", "node_id"], "left")
            # ranges of the layers: a layer's nodes go on in order of their hash, so that no task sorts a whole tree
            part = cuts.withColumn("slot", F.pmod(F.xxhash64("node_id"), F.lit(1024)))
            count = part.groupBy("tree_id", "batch", "slot").agg(F.count(F.lit(1)).alias("m"))
            up_to = F.sum("m").over(Window.partitionBy("tree_id").orderBy("batch", "slot").rowsBetween(Window.unboundedPreceding, -1))
            cut = count.withColumn("shard", F.floor(F.coalesce(up_to, F.lit(0)) / shard_leaves).cast("int")).drop("m")
            hot = part.join(cut, ["tree_id", "batch", "slot"]).select(*rows.columns, "shard")
            placed = placed.join(large, "tree_id", "left_anti").unionByName(hot)
        built = cut_lineage(by_group(placed, ["tree_id", "shard"], ["node_id"], _kernel(config, first, summarize, strict), ROW))
        out = built if out is None else out.unionByName(built)
        if not more:
            return out
        kids = out.where("part = 'node'").select("tree_id", F.explode("ids").alias("node_id")).distinct()
        top = out.where("part = 'node'").join(large.select("tree_id"), "tree_id", "left_semi").join(kids, ["tree_id", "node_id"], "left_anti")
        rows, first = cut_lineage(top.select("tree_id", "node_id", "statement_text", "complexity_score", F.array().cast("array<string>").alias("needs"), F.col("depth").alias("node_depth"))), False


def nodes_of(built: DataFrame) -> DataFrame:
    """tree_id, node_id, node_kind, statement_text, child_ids, node_depth, complexity_score, abstraction_score, confidence, why, terms, evidence_refs, spread, order_violations, evidence, continuity, retries, violations."""
    z = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return built.where("part = 'node'").select(
        "tree_id", "node_id", "node_kind", "statement_text", F.col("ids").alias("child_ids"), F.col("depth").alias("node_depth"), "complexity_score", "abstraction_score", "confidence", "why", "terms",
        F.col("refs").alias("evidence_refs"), z("spread", 0.0), z("order_violations", 0), z("evidence", 1.0), z("continuity", 1.0), F.coalesce("round", F.lit(0)).alias("retries"), F.col("codes").alias("violations"),
    )


def events_of(built: DataFrame) -> DataFrame:
    """tree_id, depth, group_index, round, reason, input_ids, output_groups, codes: groups that were split."""
    return built.where("part = 'event'").select("tree_id", "depth", F.col("place").alias("group_index"), "round", "reason", F.col("ids").alias("input_ids"), F.col("groups").alias("output_groups"), "codes")


def plan_of(built: DataFrame) -> DataFrame:
    """tree_id, depth, group_index, input_ids, output_id, spread: the groups that became parents."""
    return built.where("part = 'node' AND node_kind = 'parent'").select("tree_id", "depth", F.col("place").alias("group_index"), F.col("ids").alias("input_ids"), F.col("node_id").alias("output_id"), "spread")


def layers_of(built: DataFrame) -> DataFrame:
    """tree_id, depth, ordered_ids, groups, warnings (missing_complexity, cycle_detected) of each layer's grouping."""
    return built.where("part = 'layer'").select("tree_id", "depth", F.col("ids").alias("ordered_ids"), "groups", F.col("codes").alias("warnings"))


def issues_of(built: DataFrame) -> DataFrame:
    """tree_id, depth, group_index, code (pre_summary_policy, post_summary_policy, no_progress, depth_limit), ids, codes: where the rules end a tree."""
    return built.where("part = 'issue'").select("tree_id", "depth", F.col("place").alias("group_index"), F.col("reason").alias("code"), "ids", "codes")


def build_trees(leaves: DataFrame, config: Config, shard_leaves: int = 20_000) -> DataFrame:
    """The nodes of one tree a tree_id."""
    return nodes_of(build(leaves, config, shard_leaves))


def pair_similarity(leaves: DataFrame, least: float = 0.5) -> DataFrame:
    """a, b, jaccard of leaves of a tree (a < b) that share grouping words, from `least` on; found by their rarer words (prefix filter), so that no group's pairs are all looked at."""
    t = leaves.select("tree_id", "node_id", F.array_sort(grouping_tokens("statement_text")).alias("w")).where(F.size("w") > 0).distinct()
    freq = t.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = t.select("tree_id", "node_id", F.explode("w").alias("word")).join(freq, "word").groupBy("tree_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
    keep = F.size("r") - F.ceil(F.size("r") * F.lit(least)) + 1
    keyed = ranked.select("tree_id", "node_id", F.transform("r", lambda x: x["word"]).alias("w"), F.explode(F.transform(F.slice("r", F.lit(1), keep.cast("int")), lambda x: x["word"])).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = (F.col("a.node_id") < F.col("b.node_id")) & (F.size("a.w") >= least * F.size("b.w")) & (F.size("b.w") >= least * F.size("a.w"))
    pairs = a.join(b, (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("a.key") == F.col("b.key")) & near)
    score = F.size(F.array_intersect("a.w", "b.w")) / F.size(F.array_union("a.w", "b.w"))
    return pairs.select(F.col("a.tree_id").alias("tree_id"), F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"), F.round(score, 6).alias("jaccard")).where(F.col("jaccard") >= least).distinct()


def validate(nodes: DataFrame, most: int, roots: DataFrame | None = None, leaves: DataFrame | None = None, has_policy: str | None = None) -> DataFrame:
    """tree_id, code, node_id of trees (tree_id, node_id, node_kind, child_ids, violations): missing_root, missing_node, branching_factor, policy_missing, policy_violation, not_connected, leaf_not_preserved.

    roots: (tree_id, node_id) of each tree, else what is nobody's child; only what a root leads to is checked, as far as it is there. leaves: (tree_id, node_id) that have to be reached, else the
    table's own. has_policy: the column that is null where a parent has no diagnostics."""
    kids = cut_lineage(nodes.select("tree_id", F.col("node_id").alias("parent"), F.explode("child_ids").alias("node_id")).distinct())
    ids = cut_lineage(nodes.select("tree_id", "node_id").distinct())
    code = lambda df, c: df.select("tree_id", F.lit(c).alias("code"), "node_id")
    top = ids.join(kids, ["tree_id", "node_id"], "left_anti") if roots is None else roots.select("tree_id", "node_id").distinct()
    no_root = ids.select("tree_id").distinct().join(top, "tree_id", "left_anti").select("tree_id", F.lit("").alias("node_id"))
    if roots is not None:
        no_root = no_root.unionByName(top.join(ids, ["tree_id", "node_id"], "left_anti"))
    front = seen = cut_lineage(top.join(ids, ["tree_id", "node_id"], "left_semi"))
    n = 0
    while not front.isEmpty():
        step = kids.join(front.withColumnRenamed("node_id", "parent"), ["tree_id", "parent"]).select("tree_id", "node_id").distinct()
        front = cut_lineage(step.join(seen, ["tree_id", "node_id"], "left_anti"))
        seen, n = seen.unionByName(front), n + 1
        if n % 10 == 0:
            seen = cut_lineage(seen)
    gone = code(seen.join(ids, ["tree_id", "node_id"], "left_anti"), "missing_node")
    there = nodes.join(seen, ["tree_id", "node_id"], "left_semi").where("node_kind = 'parent'")
    wide, broken = code(there.where(F.size("child_ids") > most), "branching_factor"), code(there.where(F.size("violations") > 0), "policy_violation")
    bare = code(there.where(F.col(has_policy).isNull()), "policy_missing") if has_policy else code(there.where(F.lit(False)), "policy_missing")
    lost = code(ids.join(seen, ["tree_id", "node_id"], "left_anti"), "not_connected")
    own = nodes.where("node_kind = 'leaf'").select("tree_id", "node_id") if leaves is None else leaves.select("tree_id", "node_id")
    left = code(own.distinct().join(seen, ["tree_id", "node_id"], "left_anti"), "leaf_not_preserved")
    return code(no_root, "missing_root").unionByName(gone).unionByName(wide).unionByName(bare).unionByName(broken).unionByName(lost).unionByName(left).distinct()
