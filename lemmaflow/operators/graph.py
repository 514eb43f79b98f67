"""Dependency graphs: nodes, edges, missing references, closure, strongly connected components, layers.

Defined results: null and blank ids make no node or edge; repeated edges count once; references to what isn't indexed are external
nodes; empty tables give empty results. Loops are set-parallel and cut their lineage into the checkpoint folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.canon import ordered_hash
from lemmaflow.functions.groups import ranked
from lemmaflow.functions.ids import clean_id
from lemmaflow.operators.hierarchy import KERNEL_LINKS, Graph, contract
from lemmaflow.session import cut_lineage


def edges(declarations: DataFrame) -> DataFrame:
    """src, dst of every distinct dependency of leaf-shaped rows (leaf_id, dependency_ids)."""
    return declarations.select(F.col("leaf_id").alias("src"), F.explode("dependency_ids").alias("dst")).distinct()


def nodes(declarations: DataFrame, edge: DataFrame, external: bool = True) -> DataFrame:
    """id, category (indexed, external)."""
    own = declarations.select(F.col("leaf_id").alias("id")).distinct()
    if not external:
        return own.withColumn("category", F.lit("indexed"))
    other = edge.select(F.col("dst").alias("id")).distinct().join(own, "id", "left_anti")
    return own.withColumn("category", F.lit("indexed")).unionByName(other.withColumn("category", F.lit("external")))


def missing(declarations: DataFrame, edge: DataFrame) -> DataFrame:
    """src, dst of edges to what isn't indexed."""
    return edge.join(declarations.select(F.col("leaf_id").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def degrees(node: DataFrame, edge: DataFrame) -> DataFrame:
    """id, category, dependencies, dependents."""
    out = edge.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("dependencies"))
    into = edge.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))
    return node.join(out, "id", "left").join(into, "id", "left").select("id", "category", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


def totals(node: DataFrame, edge: DataFrame, miss: DataFrame) -> DataFrame:
    n = node.agg(F.count(F.lit(1)).alias("node_count"), F.count(F.when(F.col("category") == "indexed", 1)).alias("indexed_count"), F.count(F.when(F.col("category") == "external", 1)).alias("external_count"))
    return n.join(edge.agg(F.count(F.lit(1)).alias("edge_count"))).join(miss.agg(F.count(F.lit(1)).alias("missing_count")))


def closure(edge: DataFrame, starts: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """src, dst: what each start (column src; all nodes without one) reaches, itself left out; `within` keeps only those dst (column dst). Semi-naive rounds."""
    if within is not None:
        edge = edge.join(within, "dst", "left_semi")
    edge = cut_lineage(edge.distinct())
    front = edge if starts is None else edge.join(starts, "src", "left_semi")
    front = cut_lineage(front.where("src <> dst"))
    seen, n = front, 0
    while not front.isEmpty():
        step = front.select("src", F.col("dst").alias("via")).join(edge.withColumnRenamed("src", "via"), "via").select("src", "dst").where("src <> dst").distinct()
        front = cut_lineage(step.join(seen, ["src", "dst"], "left_anti"))
        seen, n = seen.unionByName(front), n + 1
        if n % 10 == 0:  # rounds are appended; what is known is written anew only now and then
            seen = cut_lineage(seen)
    return seen


def support_order(edge: DataFrame, root: str) -> list[str]:
    """The support of one declaration in post-order, children in id order; for a support that fits one task."""
    reach = closure(edge, edge.where(F.col("src") == root).select("src").distinct())
    inner = edge.join(reach.select(F.col("dst").alias("src")).unionByName(reach.select("src")).distinct(), "src", "left_semi")
    if inner.count() > KERNEL_LINKS:
        raise ValueError("the support has too many edges for an ordered walk: use closure()")
    kids: dict[str, list[str]] = {}
    for r in inner.orderBy("src", "dst").collect():
        kids.setdefault(r["src"], []).append(r["dst"])
    out, seen, walk = [], {root}, [(root, iter(kids.get(root, [])))]
    while walk:
        node, rest = walk[-1]
        child = next((c for c in rest if c not in seen), None)
        if child is None:
            walk.pop()
            out.append(node)
        else:
            seen.add(child)
            walk.append((child, iter(kids.get(child, []))))
    return out[:-1]


def components(edge: DataFrame) -> DataFrame:
    """id, component (its smallest id): weakly connected."""
    label = contract(edge.select(F.lit("").alias("key"), F.col("src").alias("a"), F.col("dst").alias("b")))
    own = edge.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return own.join(label.select(F.col("node").alias("id"), F.col("label").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    g = Graph(pdf["src"].tolist(), pdf["dst"].tolist())
    label = g.strong()
    return pd.DataFrame({"id": g.ids, "scc": [g.ids[i] for i in label]})


def strong_components(edge: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """id, scc (smallest id of the strongly connected component). Nodes without a way in or out are peeled off in parallel, the rest
    is walked a connected component at a time; a larger component is cut by rounds of colours (forward) and reach (backward)."""
    edge = cut_lineage(edge.distinct())
    own = edge.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    core, before = cut_lineage(edge.where("src <> dst")), -1
    n = core.count()
    while n > kernel_links:  # fewer fit the kernel as they are
        core = cut_lineage(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        n = core.count()
        if n in (0, before):
            break
        before = n
    found = None
    while not core.isEmpty():
        if n <= kernel_links:
            placed = core.withColumn("component", F.lit(""))
        else:
            placed = cut_lineage(core.join(components(core).select(F.col("id").alias("src"), "component"), "src"))
        size = placed.groupBy("component").count()
        fit = placed.join(size.where(F.col("count") <= kernel_links), "component", "left_semi")
        part = cut_lineage(fit.groupBy("component").applyInPandas(_strong, "id string, scc string"))
        found = part if found is None else found.unionByName(part)
        big = cut_lineage(placed.join(size.where(F.col("count") > kernel_links), "component", "left_semi").select("src", "dst"))
        if big.isEmpty():
            break
        forward = cut_lineage(big.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            seen = big.join(forward.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "colour")
            new = cut_lineage(forward.unionByName(seen).groupBy("id").agg(F.min("colour").alias("colour")))
            done = new.join(forward, ["id", "colour"], "left_anti").isEmpty()
            forward = new
            if done:
                break
        a = forward.select(F.col("id").alias("src"), F.col("colour"))
        b = forward.select(F.col("id").alias("dst"), F.col("colour").alias("c2"))
        inner = cut_lineage(big.join(a, "src").join(b, "dst").where("colour = c2").select("src", "dst", "colour"))
        reach = front = cut_lineage(forward.where("id = colour"))
        while not front.isEmpty():
            more = inner.join(front.withColumnRenamed("id", "dst"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            front = cut_lineage(more.join(reach, ["id", "colour"], "left_anti"))
            reach = cut_lineage(reach.unionByName(front))
        found = cut_lineage(found.unionByName(reach.select("id", F.col("colour").alias("scc"))))
        gone = reach.select("id")
        core = cut_lineage(inner.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        n = core.count()
    out = own if found is None else own.join(found, "id", "left")
    return out.select("id", F.col("id").alias("scc")) if found is None else out.select("id", F.coalesce("scc", "id").alias("scc"))


def cyclic_components(edge: DataFrame, scc: DataFrame) -> DataFrame:
    """scc, members, size of components with a cycle: more than one node, or a loop."""
    loops = edge.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("has_loop", F.lit(True))
    g = scc.join(loops, "id", "left").groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("size"), F.max(F.coalesce("has_loop", F.lit(False))).alias("has_loop"))
    return g.where("size > 1 OR has_loop").select("scc", "members", "size")


def _layers(pdf: pd.DataFrame) -> pd.DataFrame:
    needs: dict[str, set[str]] = {}
    for src, dst in zip(pdf["src"], pdf["dst"]):
        needs.setdefault(src, set())
        if isinstance(dst, str):
            needs[src].add(dst)
    users: dict[str, list[str]] = {}
    for i, ds in needs.items():
        for j in ds:
            users.setdefault(j, []).append(i)
    open_ = {i: len(ds) for i, ds in needs.items()}
    ready, n, out = sorted(i for i, k in open_.items() if k == 0), 0, []
    while ready:
        out += [(i, n, False) for i in ready]
        n, nxt = n + 1, []
        for i in ready:
            for j in users.get(i, ()):
                open_[j] -= 1
                if open_[j] == 0:
                    nxt.append(j)
        ready = nxt
    done = {i for i, _, _ in out}
    out += [(i, n, True) for i in open_ if i not in done]
    return pd.DataFrame(out, columns=["id", "batch", "cyclic"]).astype({"batch": "int32", "cyclic": "bool"})


def batches(node: DataFrame, edge: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """id, batch, cyclic: layers in which every node comes after all it depends on; what a cycle holds back is one last batch.
    Up to `kernel_links` nodes and edges go through one kernel; more, through a parallel round a layer."""
    edge = edge.join(node.select(F.col("id").alias("src")), "src", "left_semi").join(node.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    both = cut_lineage(edge.unionByName(node.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"))).distinct())
    if both.count() <= kernel_links:
        return both.withColumn("one", F.lit("")).groupBy("one").applyInPandas(_layers, "id string, batch int, cyclic boolean")
    edge = both.where("dst IS NOT NULL")
    left, n, done = both.select(F.col("src").alias("id")).distinct(), 0, None
    while not left.isEmpty():
        ready = cut_lineage(left.join(edge.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("batch", F.lit(n)).withColumn("cyclic", F.lit(False)))
        if ready.isEmpty():
            rest = left.withColumn("batch", F.lit(n)).withColumn("cyclic", F.lit(True))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else done.unionByName(ready)
        left = cut_lineage(left.join(ready, "id", "left_anti"))
        edge = cut_lineage(edge.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti"))
        n += 1
    return done if done is not None else left.withColumn("batch", F.lit(0)).withColumn("cyclic", F.lit(False))


def fingerprint(node: DataFrame, edge: DataFrame) -> DataFrame:
    """graph_hash over the hash of each node's ordered edges, so that no row list is gathered but one hash a node prefix."""
    lines = node.select(F.concat_ws("|", F.lit("n"), "id", "category").alias("l")).unionByName(edge.select(F.concat_ws("|", F.lit("e"), "src", "dst").alias("l")))
    part = lines.groupBy(F.substring(F.sha2("l", 256), 1, 3).alias("p")).agg(ordered_hash(F.col("l"), F.col("l")).alias("h"))
    return part.agg(ordered_hash(F.col("h"), F.col("p")).alias("graph_hash"))


def canonical_lines(node: DataFrame, edge: DataFrame, miss: DataFrame, scc: DataFrame) -> DataFrame:
    """part, line: the graph's canonical text - counts, nodes with their sorted edges both ways, all strongly connected components and those with a cycle, numbered by their members; hashed by canon.group_hash."""
    sorted_ids = lambda df, k, v, n: df.groupBy(F.col(k).alias("id")).agg(F.array_join(F.array_sort(F.collect_set(v)), ",").alias(n))
    rows = node.join(sorted_ids(edge, "src", "dst", "out"), "id", "left").join(sorted_ids(edge, "dst", "src", "into"), "id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    line = F.concat_ws("|", F.concat(F.lit("node="), "id"), F.concat(F.lit("category="), "category"), F.concat(F.lit("deps="), none("out")), F.concat(F.lit("dependents="), none("into")))
    names = {"nodes": "node_count", "edges": "edge_count", "indexed": "indexed_count", "external": "external_count", "missing_refs": "missing_count"}
    head = totals(node, edge, miss).select(F.posexplode(F.array(F.lit("schema=1.0.0"), *(F.concat(F.lit(f"{n}="), F.col(c).cast("string")) for n, c in names.items()))).alias("i", "line"))
    part = lambda k, at, o: F.struct(F.lit(k).alias("k"), at.cast("long").alias("at"), o.alias("o")).alias("part")
    alone = node.join(scc, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))
    loops = edge.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("has_loop", F.lit(True))
    g = alone.join(loops, "id", "left").groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("members"), F.max(F.coalesce("has_loop", F.lit(False))).alias("has_loop"))
    out = head.select(part(0, F.col("i"), F.lit("")), "line").unionByName(rows.select(part(1, F.lit(0), F.col("id")), line.alias("line")))
    for k, name, df in ((2, "scc", g), (3, "cyclic_scc", g.where("size(members) > 1 OR has_loop"))):
        r = ranked(df.select(F.array_join("members", "\x00").alias("m"), F.array_join("members", ",").alias("t")), ["m"])
        out = out.unionByName(r.select(part(k, F.col("rank"), F.lit("")), F.concat(F.lit(f"{name}["), F.col("rank").cast("string"), F.lit("]="), "t").alias("line")))
    return out


def checked(declarations: DataFrame) -> DataFrame:
    """The declarations (leaf_id, dependency_ids), or an error if there is none, or an id is blank or there twice."""
    bad = declarations.groupBy(clean_id("leaf_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").first()
    if bad is not None:
        raise ValueError("a declaration id is blank" if bad["id"] is None else f"duplicate declaration id '{bad['id']}'")
    if declarations.isEmpty():
        raise ValueError("no declarations")
    return declarations


def lookups(asked: DataFrame, node: DataFrame, edge: DataFrame, scc: DataFrame) -> DataFrame:
    """asked, kind (dependency, dependent, support, cycle, declaration_not_found), id: what is known of each asked declaration (id); its support without itself, its component where it is in a cycle. All as rows, however many."""
    q = cut_lineage(asked.select(F.col("id").alias("asked")).distinct())
    there = q.join(node.select(F.col("id").alias("asked")), "asked", "left_semi")
    gone = q.join(there, "asked", "left_anti").select("asked", F.lit("declaration_not_found").alias("kind"), F.col("asked").alias("id"))
    out = there.join(edge.select(F.col("src").alias("asked"), F.col("dst").alias("id")).distinct(), "asked").select("asked", F.lit("dependency").alias("kind"), "id")
    into = there.join(edge.select(F.col("dst").alias("asked"), F.col("src").alias("id")).distinct(), "asked").select("asked", F.lit("dependent").alias("kind"), "id")
    support = closure(edge, there.select(F.col("asked").alias("src"))).select(F.col("src").alias("asked"), F.lit("support").alias("kind"), F.col("dst").alias("id"))
    mine = there.join(scc.select(F.col("id").alias("asked"), "scc"), "asked")
    cycle = mine.join(scc, "scc").select("asked", "id")
    loops = edge.where("src = dst").select(F.col("src").alias("asked")).distinct()
    real = cycle.where("asked <> id").select("asked").distinct().unionByName(loops).distinct()
    cycle = cycle.join(real, "asked", "left_semi").select("asked", F.lit("cycle").alias("kind"), "id")
    return gone.unionByName(out).unionByName(into).unionByName(support).unionByName(cycle)


def indexed(declarations: DataFrame) -> DataFrame:
    """(id) of declarations, for joins."""
    return declarations.select(clean_id("leaf_id").alias("id")).distinct()
