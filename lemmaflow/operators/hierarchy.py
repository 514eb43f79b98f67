"""Parent-child links to full hierarchies: roots, hops, paths, descendants and cycles.

Connected components are found by union-find in blocks of links whose labels are contracted until none changes. Each component is
co-located, and one kernel call walks it with an iterative depth-first traversal that colours nodes (open, closed); a link to an
open node is a back edge and closes a cycle. The order in which the walk closes nodes gives roots, hops and paths (relaxed
from the top, level by level only inside a cycle) and descendants (collected from the bottom). A component of more than `kernel_links` links doesn't fit one task and is worked on by
set-parallel rounds (`_large_*`), which give the same rows without gathering it anywhere.

Defined results: null or blank ids make no link and no node, rows with a null or blank proof_id none either; repeated
links count once; a link from a node to itself is a cycle; a node that no root leads to has root_id '' and hops -1;
empty tables give an empty result; other columns of the tables are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.groups import by_group, salted
from lemmaflow.functions.ids import clean_id, clean_ids
from lemmaflow.session import cut_lineage

#: Links that one kernel call may hold: about 300 bytes each in Python.
KERNEL_LINKS = 400_000

#: Targets in one piece of work of the pairs.
TARGETS = 1024

FOUND = "proof_id string, node_id string, root_id string, hops int, in_cycle int"
NODES = "proof_id string, node_id string, component_id string, root_id string, hops int, in_cycle int, path array<string>, n_descendants int"
PAIRS = "proof_id string, node_id string, descendant_id string"
BACK = "proof_id string, parent_id string, child_id string"


def links_of(tree_edges: DataFrame, tree_nodes: DataFrame) -> DataFrame:
    """Distinct (proof_id, parent_id, child_id) of both tables; a node without links is a row with a null child."""
    edges = tree_edges.select(clean_id("proof_id").alias("proof_id"), clean_id("parent_id").alias("parent_id"), clean_id("child_id").alias("child_id"))
    edges = edges.where("parent_id IS NOT NULL AND child_id IS NOT NULL")
    own = tree_nodes.select(clean_id("proof_id").alias("proof_id"), clean_id("node_id").alias("parent_id"), clean_ids("child_ids").alias("kids"))
    own = own.where("parent_id IS NOT NULL").select("proof_id", "parent_id", F.explode(F.array_append("kids", F.lit(None).cast("string"))).alias("child_id"))
    return edges.unionByName(own).where("proof_id IS NOT NULL").distinct()


def links_of_tree(tree: DataFrame) -> DataFrame:
    """The links of a tree table (proof_id, node_id, child_ids), as links_of."""
    rows = tree.select("proof_id", F.col("node_id").alias("parent_id"), F.explode(F.array_append("child_ids", F.lit(None).cast("string"))).alias("child_id"))
    return rows.distinct()


class Graph:
    """One group of links as integers; ids are sorted, so a smaller number is a smaller id."""

    def __init__(self, parents: list[str], children: list[str | None]) -> None:
        self.ids = sorted({*parents, *(c for c in children if c is not None)})
        at = {x: i for i, x in enumerate(self.ids)}
        self.out: list[list[int]] = [[] for _ in self.ids]
        self.parents: list[list[int]] = [[] for _ in self.ids]
        for p, c in zip(parents, children):
            if c is not None:
                i, j = at[p], at[c]
                self.out[i].append(j)
                self.parents[j].append(i)
        for a in self.out:
            a.sort()

    def components(self) -> list[int]:
        """The smallest node of each node's connected component."""
        label = [-1] * len(self.ids)
        for s in range(len(self.ids)):
            if label[s] < 0:
                label[s], stack = s, [s]
                while stack:
                    i = stack.pop()
                    for near in (self.out[i], self.parents[i]):
                        for j in near:
                            if label[j] < 0:
                                label[j] = s
                                stack.append(j)
        return label

    def levels(self) -> tuple[list[int], list[int], list[int]]:
        """hops, root and previous node on the path (the smallest of those with that root) of each node; -1 where no root leads there. depth_first() goes before.

        The walk's components are taken from the top down, so that all that leads to one is settled before it; only inside a cycle nodes are settled by rising hops."""
        n = len(self.ids)
        best: list[tuple[int, int, int] | None] = [None if self.parents[i] else (0, i, -1) for i in range(n)]
        for members in reversed(self.sinks_first):
            if len(members) > 1:
                inside = set(members)
                queue = [(*best[i], i) for i in members if best[i] is not None]
                heapq.heapify(queue)
                while queue:
                    h, r, b, i = heapq.heappop(queue)
                    if best[i] != (h, r, b):
                        continue
                    for j in self.out[i]:
                        if j in inside and (best[j] is None or (h + 1, r, i) < best[j]):
                            best[j] = (h + 1, r, i)
                            heapq.heappush(queue, (h + 1, r, i, j))
            for i in members:
                if best[i] is None:
                    continue
                h, r, _ = best[i]
                for j in self.out[i]:
                    if (best[j] is None or (h + 1, r, i) < best[j]) and (len(members) == 1 or j not in inside) and j != i:
                        best[j] = (h + 1, r, i)
        none = (-1, -1, -1)
        return tuple([(x or none)[k] for x in best] for k in range(3))

    def strong(self) -> list[int]:
        """The smallest node of each node's strongly connected component."""
        self.depth_first()
        return self.scc

    def depth_first(self) -> tuple[list[bool], list[tuple[int, int]]]:
        """Which nodes lie on a cycle, and the back edges, from one walk with colours; lowest reachable open positions tell cycles apart."""
        self.scc = list(range(len(self.ids)))
        self.sinks_first: list[list[int]] = []  # the strong components, each after all it leads to
        n = len(self.ids)
        order, low = [0] * n, [0] * n  # 0: not yet seen
        is_open, cyclic, back = [False] * n, [False] * n, []
        count, path = 0, []
        for s in sorted(range(n), key=lambda i: (bool(self.parents[i]), i)):
            if order[s]:
                continue
            count += 1
            order[s] = low[s] = count
            is_open[s] = True
            path.append(s)
            walk = [(s, iter(self.out[s]))]
            on_walk = {s}
            while walk:
                i, rest = walk[-1]
                for j in rest:
                    if not order[j]:
                        count += 1
                        order[j] = low[j] = count
                        is_open[j] = True
                        path.append(j)
                        on_walk.add(j)
                        walk.append((j, iter(self.out[j])))
                        break
                    if is_open[j]:
                        low[i] = min(low[i], order[j])
                        if j in on_walk:
                            back.append((i, j))
                        if i == j:
                            cyclic[i] = True
                else:
                    walk.pop()
                    on_walk.discard(i)
                    if walk:
                        low[walk[-1][0]] = min(low[walk[-1][0]], low[i])
                    if low[i] == order[i]:
                        members = []
                        while True:
                            j = path.pop()
                            is_open[j] = False
                            members.append(j)
                            if j == i:
                                break
                        self.sinks_first.append(members)
                        if len(members) > 1:
                            least = min(members)
                            for j in members:
                                cyclic[j], self.scc[j] = True, least
        return cyclic, back

    def reach(self, first: int, size: int) -> list[int]:
        """For each node a bit set of which of the nodes first, first + 1, ... (size of them) it reaches over one link or more. depth_first() goes before."""
        bits = [0] * len(self.ids)
        for members in self.sinks_first:
            r = 0
            for i in members:
                for j in self.out[i]:
                    r |= bits[j]
                    if 0 <= j - first < size:
                        r |= 1 << (j - first)
            for i in members:
                bits[i] = r
        return bits


def _walked(cols: dict[str, list]) -> tuple[Graph, list[bool], list[tuple[int, int]]]:
    g = Graph(cols["parent_id"], [c if isinstance(c, str) else None for c in cols["child_id"]])
    return g, *g.depth_first()


def _found(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
    g, cyclic, _ = _walked(cols)
    for i, h, r, c in zip(g.ids, *g.levels()[:2], cyclic):
        yield key[0], i, g.ids[r] if r >= 0 else "", h, int(c)


def _nodes(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
    g, cyclic, _ = _walked(cols)
    hops, root, prev = g.levels()
    n = [0] * len(g.ids)
    for first in range(0, len(g.ids), 4096):
        for i, r in enumerate(g.reach(first, 4096)):
            n[i] += r.bit_count()
    for i, x in enumerate(g.ids):
        trail, j = [], i
        while hops[i] >= 0 and j >= 0:
            trail.append(g.ids[j])
            j = prev[j]
        yield key[0], x, g.ids[0], g.ids[root[i]] if root[i] >= 0 else "", hops[i], int(cyclic[i]), trail[::-1] if trail else None, n[i]


def _pairs(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
    """Descendants from the bottom up, a block of targets at a time, so that what is held is one bit a node and target of the block."""
    g, _, _ = _walked(cols)
    for first in range(0, len(g.ids), TARGETS):
        for i, r in enumerate(g.reach(first, TARGETS)):
            while r:
                low = r & -r
                yield key[0], g.ids[i], g.ids[first + low.bit_length() - 1]
                r ^= low


def _back(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
    g, _, back = _walked(cols)
    for i, j in back:
        yield key[0], g.ids[i], g.ids[j]


def contract(edges: DataFrame, block_links: int = 100_000) -> DataFrame:
    """(key, node, label): the connected component of each end of (key, a, b), label being its smallest node.

    Each round first contracts the edges inside salted blocks of a key by union-find, which takes most of the work off
    the shuffle, and then pulls every label to the smallest one its neighbours have, until no block changes a label.
    """
    now = edges.select("key", "a", "b").where("a <> b")
    schema = "key string, node string, label string"

    def block(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[tuple[str, str], str] = {}

        def find(key: str, x: str) -> str:
            trail = []
            while (y := up.setdefault((key, x), x)) != x:
                trail.append(x)
                x = y
            for t in trail:
                up[(key, t)] = x
            return x

        for pdf in parts:
            for key, a, b in zip(pdf["key"], pdf["a"], pdf["b"]):
                x, y = find(key, a), find(key, b)
                if x != y:
                    up[(key, max(x, y))] = min(x, y)
            if len(up) > KERNEL_LINKS:  # the block is full: give out what it has and begin anew, which is only less contraction
                yield pd.DataFrame([(k, n, find(k, n)) for k, n in list(up)], columns=["key", "node", "label"])
                up.clear()
        yield pd.DataFrame([(k, n, find(k, n)) for k, n in list(up)], columns=["key", "node", "label"])

    labels = None
    now = cut_lineage(now)
    cores = edges.sparkSession.sparkContext.defaultParallelism
    while True:
        blocks = -(-now.count() // block_links) or 1
        # a key's links stay together where they fit one block, so that small keys are done after one round
        spread = salted(now, ["key"], "a", block_links).repartition(max(blocks, cores), "key", "salt").select("key", "a", "b")
        pairs = cut_lineage(spread.mapInPandas(block, schema).distinct())
        # every node keeps the smallest label given to it; its other labels are joined to that one in the next round
        least = pairs.groupBy("key", "node").agg(F.min("label").alias("label"), F.max("label").alias("most"))
        again = pairs.join(least.where("label <> most").drop("most").withColumnRenamed("label", "least"), ["key", "node"]).where("label <> least").select("key", F.col("label").alias("a"), F.col("least").alias("b")).distinct()
        joined = least.drop("most")
        if labels is None:
            labels = cut_lineage(joined)
        else:
            step = joined.select("key", F.col("node").alias("label"), F.col("label").alias("to"))
            labels = cut_lineage(labels.join(step, ["key", "label"], "left").select("key", "node", F.coalesce("to", "label").alias("label")))
        again = cut_lineage(again)
        if again.isEmpty():
            return labels
        now = again


def _large_levels(links: DataFrame, paths: bool) -> DataFrame:
    """proof_id, node_id, root_id, hops, path (null where no root leads, or without `paths`) by rounds over the frontier; the previous node on a path is the smallest of those with that root."""
    ends = links.select("proof_id", F.explode(F.array("parent_id", "child_id")).alias("node_id")).where("node_id IS NOT NULL").distinct()
    edge, none = cut_lineage(links.where("child_id IS NOT NULL")), F.lit(None).cast("array<string>")
    kids = edge.select("proof_id", F.col("child_id").alias("node_id")).distinct()
    front = cut_lineage(ends.join(kids, ["proof_id", "node_id"], "left_anti").select("proof_id", "node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("hops"), (F.array("node_id") if paths else none).alias("path")))
    done, level = front, 0
    while not front.isEmpty():
        level += 1
        up = front.select("proof_id", F.col("node_id").alias("parent_id"), "root_id", "path")
        reached = edge.join(up, ["proof_id", "parent_id"]).groupBy("proof_id", F.col("child_id").alias("node_id")).agg(F.min(F.struct("root_id", "parent_id", "path")).alias("v"))
        reached = reached.join(done.select("proof_id", "node_id"), ["proof_id", "node_id"], "left_anti")
        front = cut_lineage(reached.select("proof_id", "node_id", "v.root_id", F.lit(level).alias("hops"), F.array_append("v.path", F.col("node_id")).alias("path")))
        done = done.unionByName(front)
        if level % 8 == 0:
            done = cut_lineage(done)
    return ends.join(done, ["proof_id", "node_id"], "left").select("proof_id", "node_id", F.coalesce("root_id", F.lit("")).alias("root_id"), F.coalesce("hops", F.lit(-1)).alias("hops"), "path")


def _large_pairs(links: DataFrame) -> DataFrame:
    """All (node, descendant) pairs by rounds over those found last; the pairs are held in the checkpoint folder."""
    edge = cut_lineage(links.where("child_id IS NOT NULL").select("proof_id", "parent_id", "child_id"))
    front = done = edge.select("proof_id", F.col("parent_id").alias("node_id"), F.col("child_id").alias("descendant_id"))
    step, n = edge.select("proof_id", F.col("parent_id").alias("descendant_id"), F.col("child_id").alias("next_id")), 0
    while not front.isEmpty():
        n += 1
        further = front.join(step, ["proof_id", "descendant_id"]).select("proof_id", "node_id", F.col("next_id").alias("descendant_id")).distinct()
        front = cut_lineage(further.join(done, ["proof_id", "node_id", "descendant_id"], "left_anti"))
        done = done.unionByName(front)
        if n % 8 == 0:
            done = cut_lineage(done)
    return done


def _large_cycles(links: DataFrame, kernel_links: int) -> DataFrame:
    """(proof_id, node_id) on a cycle: nodes without a way in or out are peeled off, then colours split what is left."""
    edge = cut_lineage(links.where("child_id IS NOT NULL"))
    loops = edge.where("parent_id = child_id").select("proof_id", F.col("parent_id").alias("node_id"))
    edge = edge.where("parent_id <> child_id")
    found = loops
    while True:
        before = edge.count()
        while True:  # peel
            sources = edge.select("proof_id", F.col("child_id").alias("parent_id")).distinct()
            sinks = edge.select("proof_id", F.col("parent_id").alias("child_id")).distinct()
            edge = cut_lineage(edge.join(sources, ["proof_id", "parent_id"], "left_semi").join(sinks, ["proof_id", "child_id"], "left_semi"))
            left = edge.count()
            if left in (0, before):
                break
            before = left
        if left == 0:
            return found.distinct()
        # the largest node that reaches each node is its colour; a cycle has one colour
        nodes = edge.select("proof_id", F.col("parent_id").alias("node_id")).distinct()
        colour = cut_lineage(nodes.withColumn("colour", F.col("node_id")))
        while True:
            seen = edge.join(colour.withColumnRenamed("node_id", "parent_id"), ["proof_id", "parent_id"]).select("proof_id", F.col("child_id").alias("node_id"), "colour")
            new = cut_lineage(colour.unionByName(seen).groupBy("proof_id", "node_id").agg(F.max("colour").alias("colour")))
            same = new.join(colour, ["proof_id", "node_id", "colour"], "left_anti").isEmpty()
            colour = new
            if same:
                break
        a = colour.select("proof_id", F.col("node_id").alias("parent_id"), F.col("colour").alias("from_colour"))
        b = colour.select("proof_id", F.col("node_id").alias("child_id"), F.col("colour").alias("to_colour"))
        inner = cut_lineage(edge.join(a, ["proof_id", "parent_id"]).join(b, ["proof_id", "child_id"]).where("from_colour = to_colour").select("proof_id", F.col("from_colour").alias("colour"), "parent_id", "child_id"))
        sizes = inner.groupBy("proof_id", "colour").count()
        small = inner.join(sizes.where(F.col("count") <= kernel_links).drop("count"), ["proof_id", "colour"])
        marked = by_group(small, ["proof_id", "colour"], ["parent_id", "child_id"], _found, FOUND).where("in_cycle = 1").select("proof_id", "node_id")
        big = inner.join(sizes.where(F.col("count") > kernel_links).drop("count"), ["proof_id", "colour"])
        # of a large colour, the nodes that lead back to the node of that name form one strongly connected set
        reach = cut_lineage(big.where("child_id = colour").select("proof_id", "colour", F.col("parent_id").alias("node_id")).distinct())
        front = reach
        while not front.isEmpty():
            more = big.join(front.withColumnRenamed("node_id", "child_id"), ["proof_id", "colour", "child_id"]).select("proof_id", "colour", F.col("parent_id").alias("node_id")).distinct()
            front = cut_lineage(more.join(reach, ["proof_id", "colour", "node_id"], "left_anti"))
            reach = cut_lineage(reach.unionByName(front))
        found = cut_lineage(found.unionByName(marked).unionByName(reach.select("proof_id", "node_id")))
        # what of the large colours isn't in that set goes round again
        out = reach.select("proof_id", "colour", F.col("node_id").alias("parent_id"))
        rest = big.join(out, ["proof_id", "colour", "parent_id"], "left_anti").join(out.withColumnRenamed("parent_id", "child_id"), ["proof_id", "colour", "child_id"], "left_anti")
        edge = cut_lineage(rest.select("proof_id", "parent_id", "child_id"))
        if edge.isEmpty():
            return found.distinct()


def _placed(links: DataFrame, kernel_links: int) -> tuple[DataFrame, DataFrame | None]:
    """The links with their component, all of kernel size, and the links of components that are larger (None if there are none)."""
    links = cut_lineage(links)
    label = contract(links.select(F.col("proof_id").alias("key"), F.col("parent_id").alias("a"), F.coalesce("child_id", "parent_id").alias("b")))
    label = label.select(F.col("key").alias("proof_id"), F.col("node").alias("parent_id"), F.col("label").alias("component"))
    placed = cut_lineage(links.join(label, ["proof_id", "parent_id"], "left").withColumn("component", F.coalesce("component", "parent_id")))
    size = placed.groupBy("proof_id", "component").agg(F.count(F.lit(1)).alias("n"))
    giant = cut_lineage(size.where(F.col("n") > kernel_links).drop("n"))
    if giant.isEmpty():
        return placed, None
    return placed.join(giant, ["proof_id", "component"], "left_anti"), placed.join(giant, ["proof_id", "component"], "left_semi")


def _large(giant: DataFrame, kernel_links: int, paths: bool) -> DataFrame:
    """proof_id, node_id, root_id, hops, path, in_cycle of the links of large components."""
    links = cut_lineage(giant.select("proof_id", "parent_id", "child_id"))
    cycles = _large_cycles(links, kernel_links).withColumn("in_cycle", F.lit(1))
    return _large_levels(links, paths).join(cycles, ["proof_id", "node_id"], "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(0)))


def hierarchy(links: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """proof_id, node_id, root_id, hops, in_cycle of every node."""
    fit, giant = _placed(links, kernel_links)
    out = by_group(fit, ["proof_id", "component"], ["parent_id", "child_id"], _found, FOUND)
    if giant is None:
        return out
    return out.unionByName(_large(giant, kernel_links, False).select(*out.columns))


def hierarchy_nodes(links: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """As `hierarchy`, with the component, the path from the root and the number of descendants."""
    fit, giant = _placed(links, kernel_links)
    out = by_group(fit, ["proof_id", "component"], ["parent_id", "child_id"], _nodes, NODES)
    if giant is None:
        return out
    giant = cut_lineage(giant)
    ends = giant.select("proof_id", F.col("component").alias("component_id"), F.explode(F.array("parent_id", "child_id")).alias("node_id")).where("node_id IS NOT NULL").distinct()
    below = _large_pairs(giant).groupBy("proof_id", "node_id").agg(F.count(F.lit(1)).cast("int").alias("n_descendants"))
    rest = _large(giant, kernel_links, True).join(ends, ["proof_id", "node_id"]).join(below, ["proof_id", "node_id"], "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))
    return out.unionByName(rest.select(*out.columns))


def descendants(links: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """All (node, descendant) pairs, given out in batches a component. Components over `kernel_links` go through rounds."""
    fit, giant = _placed(links, kernel_links)
    out = by_group(fit, ["proof_id", "component"], ["parent_id", "child_id"], _pairs, PAIRS)
    return out if giant is None else out.unionByName(_large_pairs(giant))


def back_edges(links: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """The links that close a cycle, as met by the walk. The walk is one after another by nature, so a component over `kernel_links` is refused."""
    fit, giant = _placed(links, kernel_links)
    if giant is not None:
        raise ValueError(f"a component has more than {kernel_links} links; a walk in order needs it whole: raise kernel_links")
    return by_group(fit, ["proof_id", "component"], ["parent_id", "child_id"], _back, BACK)
