"""Stored trees and their queries: edges, child pages, ancestry, provenance, checks, drill-down, support sets, differences, jobs.

Defined results: ids are compared trimmed; null and blank ones are no node; of repeated rows one counts; empty tables give empty
results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmaflow.functions.canon import json_text
from lemmaflow.functions.ids import clean_id, clean_ids, squash_space
from lemmaflow.operators.hierarchy import KERNEL_LINKS
from lemmaflow.operators.leaf import canonical_text
from lemmaflow.session import cut_lineage


def edges_of(tree: DataFrame) -> DataFrame:
    """proof_id, parent_id, child_id, child_order: of a repeated child the first place."""
    e = tree.select("proof_id", F.col("node_id").alias("parent_id"), F.posexplode("child_ids").alias("child_order", "child_id"))
    return e.groupBy("proof_id", "parent_id", "child_id").agg(F.min("child_order").alias("child_order"))


def child_page(edge: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit of each parent's children in order, with total and has_more."""
    w = Window.partitionBy("proof_id", "parent_id")
    rows = edge.withColumn("at", F.row_number().over(w.orderBy("child_order", "child_id")) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    return rows.where((F.col("at") >= offset) & (F.col("at") < offset + limit)).withColumn("has_more", F.col("total") > offset + limit).select("proof_id", "parent_id", "child_id", "at", "total", "has_more")


def _chains(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    up = {c: p for c, p in zip(pdf["node_id"], pdf["up"]) if isinstance(p, str)}
    rows = []
    for n in sorted(set(pdf["node_id"])):
        path, seen, top = [n], {n}, n
        while (above := up.get(top)) is not None and above not in seen:
            path.append(above)
            seen.add(above)
            top = above
        rows.append((key[0], n, path[::-1], above is not None))
    return pd.DataFrame(rows, columns=["proof_id", "node_id", "path", "cut"])


def ancestry(edge: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """proof_id, node_id, path (root first), cut: each node's chain of first parents (the smallest parent id); cut where a cycle ends it.
    Proofs of up to `kernel_links` nodes go through a kernel each; larger ones, through a parallel round a level."""
    ups = edge.groupBy("proof_id", F.col("child_id").alias("node_id")).agg(F.min("parent_id").alias("up"))
    ids = edge.select("proof_id", F.explode(F.array("parent_id", "child_id")).alias("node_id")).distinct()
    rows = cut_lineage(ids.join(ups, ["proof_id", "node_id"], "left"))
    hot = rows.groupBy("proof_id").count().where(F.col("count") > kernel_links).select("proof_id")
    small = rows.join(hot, "proof_id", "left_anti").groupBy("proof_id").applyInPandas(_chains, "proof_id string, node_id string, path array<string>, cut boolean")
    if hot.isEmpty():
        return small
    return small.unionByName(_ancestry_rounds(edge.join(hot, "proof_id", "left_semi")))


def _ancestry_rounds(edge: DataFrame) -> DataFrame:
    first = cut_lineage(edge.groupBy("proof_id", F.col("child_id").alias("node_id")).agg(F.min("parent_id").alias("up")))
    start = edge.select("proof_id", F.explode(F.array("parent_id", "child_id")).alias("node_id")).distinct()
    now = cut_lineage(start.select("proof_id", "node_id", F.col("node_id").alias("top"), F.array("node_id").alias("path")))
    done = None
    while not now.isEmpty():
        step = now.join(first.select("proof_id", F.col("node_id").alias("top"), "up"), ["proof_id", "top"], "left")
        step = step.withColumn("stop", F.col("up").isNull()).withColumn("cut", F.coalesce(F.array_contains("path", F.col("up")), F.lit(False)))
        step = cut_lineage(step)
        over = step.where("stop OR cut").select("proof_id", "node_id", "path", "cut")
        done = over if done is None else done.unionByName(over)
        now = step.where("NOT stop AND NOT cut").select("proof_id", "node_id", F.col("up").alias("top"), F.concat(F.array("up"), "path").alias("path"))
    return done if done is not None else now.select("proof_id", "node_id", "path", F.lit(False).alias("cut"))


def provenance(tree: DataFrame, leaf: DataFrame) -> DataFrame:
    """proof_id, node_id, leaf_id, declaration_id, module_path, declaration_name, theorem_kind, source_span, source_url: evidence that names a leaf."""
    refs = tree.select("proof_id", "node_id", F.explode(F.array_distinct("refs")).alias("leaf_id"))
    url = F.col("source_url") if "source_url" in leaf.columns else F.lit(None).cast("string").alias("source_url")
    one = leaf.select("leaf_id", F.col("leaf_id").alias("declaration_id"), "module_path", "declaration_name", "theorem_kind", "source_span", url)
    return refs.join(one, "leaf_id").select("proof_id", "node_id", *one.columns)


def raw_links(edges: DataFrame) -> DataFrame:
    """proof_id, parent_id, child_id, child_order of delivered edges, trimmed; rows without one of the ids are left out."""
    e = edges.select(clean_id("proof_id").alias("proof_id"), clean_id("parent_id").alias("parent_id"), clean_id("child_id").alias("child_id"), "child_order")
    return e.where("proof_id IS NOT NULL AND parent_id IS NOT NULL AND child_id IS NOT NULL")


def violations(nodes: DataFrame, edges: DataFrame, headers: DataFrame, keys: tuple[str, ...] = ("proof_id",), schema_version: str = "1.0.0", known_configs: DataFrame | None = None) -> DataFrame:
    """keys, code, parent_id, child_id of snapshots: unsupported_schema_version, missing_root, unknown_edge_parent, unknown_edge_child, duplicate_edge (with its place), invalid_config_hash.

    nodes: (keys, node_id); edges: (keys, parent_id, child_id, child_order); headers: (keys, schema_version, root_id, config_hash); known_configs: (keys, computed_hash) where the configuration is stored. A snapshot's
    header is judged by itself, so a header without nodes lacks its root."""
    ks = list(keys)
    n = edges.groupBy(*ks, "parent_id", "child_id", "child_order").agg(F.count(F.lit(1)).alias("n"))
    ids = nodes.select(*ks, "node_id").distinct()
    out = lambda df, c, a="parent_id", b="child_id": df.select(*ks, F.lit(c).alias("code"), F.col(a).alias("parent_id") if a else F.lit("").alias("parent_id"), F.col(b).alias("child_id") if b else F.lit("").alias("child_id")).distinct()
    links = n.select(*ks, "parent_id", "child_id").distinct()
    parts = [
        out(links.join(ids.withColumnRenamed("node_id", "parent_id"), [*ks, "parent_id"], "left_anti"), "unknown_edge_parent"),
        out(links.join(ids.withColumnRenamed("node_id", "child_id"), [*ks, "child_id"], "left_anti"), "unknown_edge_child"),
        out(n.where("n > 1"), "duplicate_edge"),
        out(headers.where(~F.col("schema_version").eqNullSafe(schema_version)), "unsupported_schema_version", None, None),
        out(headers.join(ids.withColumnRenamed("node_id", "root_id"), [*ks, "root_id"], "left_anti"), "missing_root", "root_id", None),
    ]
    if known_configs is not None:
        parts.append(out(headers.join(known_configs, ks).where("config_hash <> computed_hash"), "invalid_config_hash", None, None))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


def exported(tree: DataFrame, leaf: DataFrame, roots: DataFrame, config_hash: str) -> dict[str, DataFrame]:
    """The tables of stored snapshots, canonical: header, nodes, edges, provenance, leaf_records; each holds all proofs."""
    leaves = tree.where("node_kind = 'leaf'").groupBy("proof_id").agg(F.array_sort(F.collect_set("node_id")).alias("leaf_ids"))
    deep = tree.groupBy("proof_id").agg(F.max("depth").alias("max_depth"))
    head = roots.join(leaves, "proof_id", "left").join(deep, "proof_id").select(F.lit("1.0.0").alias("schema_version"), "proof_id", "root_id", F.coalesce("leaf_ids", F.array().cast("array<string>")).alias("leaf_ids"), "max_depth", F.lit(config_hash).alias("config_hash"))
    used = provenance(tree, leaf)
    records = tree.where("node_kind = 'leaf'").select("proof_id", F.col("node_id").alias("leaf_id")).distinct().join(leaf, "leaf_id")
    return {"header": head, "nodes": tree, "edges": edges_of(tree), "provenance": used, "leaf_records": records}


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet below folder, its rows ordered by proof within files, so that a point query reads few row groups."""
    for name, df in tables.items():
        df.repartition("proof_id").sortWithinPartitions("proof_id").write.mode("overwrite").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("header", "nodes", "edges", "provenance", "leaf_records")}


def imported(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes of the snapshots without an error, diagnostics of the others): what is stored is trusted only as a whole."""
    bad = violations(tables["nodes"], tables["edges"], tables["header"])
    good = tables["header"].select("proof_id").join(bad.select("proof_id").distinct(), "proof_id", "left_anti")
    return tables["nodes"].join(good, "proof_id", "left_semi"), bad


def snapshot_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """proof_id, part, line: the canonical text of each snapshot; hashed by canon.group_hash. Tables are numbered in their order by ids, so no proof's text is gathered."""
    none = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ",")).otherwise("none")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    w = lambda *o: F.row_number().over(Window.partitionBy("proof_id").orderBy(*o)) - 1
    n, e, p, r = (tables[k] for k in ("nodes", "edges", "provenance", "leaf_records"))

    def block(df: DataFrame, k: int, name: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
        rows = df.withColumn("_i", w(*order))
        lines = F.concat_ws("\n", *(F.concat(F.lit(f"{name}["), F.col("_i").cast("string"), F.lit(f"].{f}="), F.coalesce(c, F.lit(""))) for f, c in fields.items()))
        return rows.select("proof_id", F.struct(F.lit(k).alias("k"), F.col("_i").alias("i")).alias("part"), lines.alias("line"))

    s = F.col("source_span")
    body = block(n, 11, "nodes", ["node_id"], {
        "id": F.col("node_id"), "kind": F.col("node_kind"), "depth": text(F.col("depth")), "statement": json_text(F.col("statement_text")), "child_ids": none("child_ids"), "evidence_refs": none("refs"), "complexity": text(F.col("complexity")), "abstraction": text(F.col("abstraction")),
        "confidence": text(F.col("confidence")), "why_true": json_text(F.col("why")), "new_terms": none("terms"), "policy_diagnostics": F.lit("none"),
    })
    body = body.unionByName(block(e, 13, "edges", ["parent_id", "child_order", "child_id"], {"parent_id": F.col("parent_id"), "child_id": F.col("child_id"), "order": F.col("child_order").cast("string")}))
    body = body.unionByName(block(p, 15, "provenance", ["node_id", "leaf_id", "module_path", "declaration_name"], {
        "node_id": F.col("node_id"), "leaf_id": F.col("leaf_id"), "declaration_id": F.col("declaration_id"), "module_path": F.col("module_path"), "declaration_name": F.col("declaration_name"), "theorem_kind": F.col("theorem_kind"), "source_file": s["file_path"],
        "source_start": F.format_string("%d:%d", s["start_line"], s["start_column"]), "source_end": F.format_string("%d:%d", s["end_line"], s["end_column"]), "source_url": text(F.col("source_url")),
    }))
    body = body.unionByName(block(r.join(canonical_text(r.dropDuplicates(["leaf_id"])).select("leaf_id", "text"), "leaf_id"), 17, "leaf_records", ["leaf_id"], {"id": F.concat(F.col("leaf_id"), F.lit("\nleaf_records.canonical_start\n"), F.col("text"), F.lit("\nleaf_records.canonical_end"))}))
    size = lambda df: df.groupBy("proof_id").agg(F.count(F.lit(1)).alias("_n"))
    head = tables["header"]
    lines = [(k, F.concat(F.lit(f"{f}="), c)) for k, (f, c) in enumerate([("schema", F.concat(F.lit("tree-storage-v"), "schema_version")), ("proof_id", F.col("proof_id")), ("root_id", F.col("root_id")), ("leaf_ids", none("leaf_ids")), ("max_depth", F.col("max_depth").cast("string")), ("config_hash", F.col("config_hash")), ("config_snapshot", F.lit("none"))])]
    top = head.select("proof_id", F.explode(F.array(*(F.struct(F.struct(F.lit(k).alias("k"), F.lit(0).alias("i")).alias("part"), c.alias("line")) for k, c in lines))).alias("v")).select("proof_id", "v.part", "v.line")
    for k, name, df in ((10, "nodes", n), (12, "edges", e), (14, "provenance", p), (16, "leaf_records", r)):
        counted = head.select("proof_id").join(size(df), "proof_id", "left")
        top = top.unionByName(counted.select("proof_id", F.struct(F.lit(k).alias("k"), F.lit(0).alias("i")).alias("part"), F.concat(F.lit(f"{name}_count="), F.coalesce("_n", F.lit(0)).cast("string")).alias("line")))
    return top.unionByName(body)


def support_sets(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """proof_id, node_id, n_leaves, support (sorted leaf ids joined by ','): leaves below each parent; a leaf supports itself."""
    leaf = tree.where("node_kind = 'leaf'").select("proof_id", F.col("node_id").alias("descendant_id"))
    own = leaf.select("proof_id", F.col("descendant_id").alias("node_id"), "descendant_id")
    below = pairs.join(tree.where("node_kind = 'parent'").select("proof_id", "node_id"), ["proof_id", "node_id"], "left_semi").join(leaf, ["proof_id", "descendant_id"]).select("proof_id", "node_id", "descendant_id")
    g = below.unionByName(own).distinct().groupBy("proof_id", "node_id").agg(F.count(F.lit(1)).alias("n_leaves"), F.array_join(F.array_sort(F.collect_list("descendant_id")), ",").alias("support"))
    return g


def last_nodes(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """proof_id, snapshot_id, node_id, node_kind, statement_text, node_depth, child_ids of the nodes of each snapshot's last delivery; of repeated rows the one delivered last."""
    rows = nodes.select(clean_id("proof_id").alias("proof_id"), clean_id("snapshot_id").alias("snapshot_id"), F.coalesce("delivery_no", F.lit(-1)).alias("delivery_no"), clean_id("node_id").alias("node_id"), "node_kind", "statement_text", "node_depth", clean_ids("child_ids").alias("child_ids"), "delivered_at")
    rows = rows.where("node_id IS NOT NULL").join(headers.select("proof_id", "snapshot_id", "delivery_no"), ["proof_id", "snapshot_id", "delivery_no"])
    cols = ["node_kind", "statement_text", "node_depth", "child_ids"]
    return rows.groupBy("proof_id", "snapshot_id", "node_id").agg(F.max_by(F.struct(*cols), F.struct("delivered_at", *cols)).alias("v")).select("proof_id", "snapshot_id", "node_id", "v.*")


def first_and_last(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """side ('old', 'new'), proof_id, node_id, node_kind, statement_text, node_depth, child_ids: the nodes of each proof's first and last snapshot, as last_nodes."""
    at = F.struct("taken_at", "snapshot_id")
    ends = headers.groupBy("proof_id").agg(F.min_by("snapshot_id", at).alias("a"), F.max_by("snapshot_id", at).alias("z"))
    ends = ends.select("proof_id", F.inline(F.array(F.struct(F.lit("old").alias("side"), F.col("a").alias("snapshot_id")), F.struct(F.lit("new").alias("side"), F.col("z").alias("snapshot_id")))))
    found = last_nodes(headers.join(ends, ["proof_id", "snapshot_id"], "left_semi"), nodes)
    return cut_lineage(found.join(ends, ["proof_id", "snapshot_id"]).select("side", "proof_id", "node_id", "node_kind", "statement_text", "node_depth", "child_ids"))


def _is_leaf() -> Column:
    return F.col("node_kind").eqNullSafe("leaf")


def links_below(nodes: DataFrame) -> DataFrame:
    """proof_id (the side, '|' and the proof), parent_id, child_id of first_and_last's nodes; nothing lies below a leaf."""
    n = nodes.where(~_is_leaf()).select(F.concat_ws("|", "side", "proof_id").alias("proof_id"), F.col("node_id").alias("parent_id"), F.explode("child_ids").alias("child_id"))
    return n.distinct()


def comparable(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """side, key, node_id, statement_text, node_depth of first_and_last's nodes: a leaf's key is its id, a parent's are all leaves below it at any depth, also over a cycle. pairs: the descendants by links_below."""
    n = nodes.select("*", F.concat_ws("|", "side", "proof_id").alias("tree"))
    as_tree = n.select(F.col("tree").alias("proof_id"), "node_id", F.when(_is_leaf(), "leaf").otherwise("parent").alias("node_kind"))
    below = support_sets(as_tree, pairs).select(F.col("proof_id").alias("tree"), "node_id", "support")
    key = F.when(_is_leaf(), F.concat(F.lit("leaf:"), "node_id")).otherwise(F.concat(F.lit("parent:"), F.coalesce("support", F.lit(""))))
    return n.join(below, ["tree", "node_id"], "left").select("side", F.concat_ws("|", "proof_id", key).alias("key"), "node_id", "statement_text", "node_depth")


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, place, change_type over (key, node_id, statement_text, node_depth): nodes of one key are paired by their order; changed means another statement or depth."""
    w = Window.partitionBy("key").orderBy("node_id")
    put = lambda df, s: df.select("key", F.row_number().over(w).alias("place"), F.struct(squash_space("statement_text").alias("said"), "node_depth").alias(s))
    j = put(a, "old").join(put(b, "new"), ["key", "place"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select("key", "place", change.alias("change_type")).where("change_type IS NOT NULL")


def job_table(jobs: DataFrame) -> DataFrame:
    """job_id, leaf_id, job_status, queue_sequence, created_at, finished_at, logs: one row a job, the one updated last."""
    rows = jobs.select(clean_id("job_id").alias("job_id"), clean_id("job_target.leaf_id").alias("leaf_id"), "job_status", "queue_sequence", "created_at", "updated_at", "finished_at").where("job_id IS NOT NULL")
    cols = ["leaf_id", "job_status", "queue_sequence", "created_at", "finished_at"]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*cols), F.struct("updated_at", *cols)).alias("v")).select("job_id", "v.*")


def job_rollup(job: DataFrame, statuses: list[str]) -> DataFrame:
    """leaf_id, jobs, one count a status, latest_job and its latest_status: the roll-up of each leaf's jobs."""
    counts = [F.count(F.when(F.col("job_status") == s, 1)).alias(f"n_{s}") for s in statuses]
    last = F.struct("queue_sequence", "job_id")
    return job.where("leaf_id IS NOT NULL").groupBy("leaf_id").agg(F.count(F.lit(1)).alias("jobs"), *counts, F.max_by("job_id", last).alias("latest_job"), F.max_by("job_status", last).alias("latest_status"))


def interleave_logs(jobs: DataFrame, cap: int) -> DataFrame:
    """job_id, at, line_index, stream_name, message: lines of all streams by index, stream, message. Over the cap the lines are numbered anew and the last one says how many are left out."""
    lines = jobs.select(clean_id("job_id").alias("job_id"), F.explode("logs").alias("l")).where("job_id IS NOT NULL AND l IS NOT NULL").select("job_id", "l.line_index", "l.stream_name", "l.message").distinct()
    w = Window.partitionBy("job_id")
    rows = lines.withColumn("at", F.row_number().over(w.orderBy("line_index", "stream_name", "message")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("at") < cap)
    over = F.col("n") > cap
    last = over & (F.col("at") == cap - 1)
    mark = F.format_string("Truncated %d log lines.", F.col("n") - (cap - 1))
    return rows.select("job_id", "at", F.when(over, F.col("at")).otherwise(F.col("line_index")).alias("line_index"), F.when(last, F.lit("system")).otherwise(F.col("stream_name")).alias("stream_name"), F.when(last, mark).otherwise(F.col("message")).alias("message"))


def next_queued(job: DataFrame, status: str = "queued") -> DataFrame:
    """The job with the smallest queue_sequence of that status."""
    return job.where(F.col("job_status") == status).agg(F.min(F.struct("queue_sequence", "job_id")).alias("m")).select("m.queue_sequence", "m.job_id").where("job_id IS NOT NULL")
