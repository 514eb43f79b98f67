"""The core's queries by name; each takes (spark, folder of tables) and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions import canon, text
from lemmaflow.functions.canon import Config
from lemmaflow.functions.ids import clean_id
from lemmaflow.operators import change, graph, hierarchy, ingest, jobs, leaf, logs, nested, orphans, policy, quality, recover, snapshots, store, tagging, trees, views
from lemmaflow.session import cut_lineage
from lemmaflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, "tree_nodes"), table(spark, d, "verification_jobs"), table(spark, d, "lean_declarations"))


@query
def p1_violations(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_diagnostics(table(spark, d, "tree_nodes"))["violations"]


@query
def p1_rewrites(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_diagnostics(table(spark, d, "tree_nodes"))["rewrites"]


@query
def p1_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_diagnostics(table(spark, d, "tree_nodes"))["diagnostics"]


@query
def p1_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_logs(table(spark, d, "verification_jobs"))


@query
def p1_warnings(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_warnings(table(spark, d, "lean_declarations"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.links_of(table(spark, d, "tree_edges"), table(spark, d, "tree_nodes"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, d))


@query
def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = hierarchy.hierarchy_nodes(_links(spark, d))
    return n.withColumn("path", F.array_join("path", " > "))


@query
def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, d))


@query
def p2_back_edges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.back_edges(_links(spark, d))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "tree_snapshots"), table(spark, d, "snapshot_nodes"))


@query
def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p3_found(spark, d))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return logs.found(logs.placed_lines(table(spark, d, "verification_jobs")))


@query
def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    return logs.entries(logs.placed_lines(table(spark, d, "verification_jobs")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    decls = table(spark, d, "lean_declarations")
    refs = orphans.references(decls, table(spark, d, "missing_dependency_refs"), table(spark, d, "tree_provenance"))
    return orphans.cascade(orphans.labelled(refs, decls, table(spark, d, "shared_symbols")))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(_orphans(spark, d))


@query
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_orphans(spark, d))


# The operators on declarations, graphs, trees and jobs.

CONFIG, OTHER_CONFIG = Config(), Config(detail="formal", complexity_band=2)
DOMAIN = tagging.keyword_adapter("domain:kernel", r"(^|\.)Kernel(\.|$)", r"(?i)(?<![A-Za-z0-9_])kernel(?![A-Za-z0-9_])")
ADAPTERS = {"kernel": DOMAIN, tagging.FALLBACK: tagging.generic}
SPLIT_TIME = "2025-07-01 00:00:00"
#: Lines of a job's log, the default.
LOG_LINES = 400


def _one(df: DataFrame) -> DataFrame:
    """Lines of one artifact, as canon.group_hash takes them."""
    return df.withColumn("artifact", F.lit(""))


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return leaf.leaves(table(spark, d, "lean_declarations"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_leaves(spark, d))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return quality.tree_table(table(spark, d, "tree_nodes"))


def _top(tree: DataFrame) -> DataFrame:
    """proof_id, root_id: of the parents that are nobody's child the one with most children, then the smallest id."""
    kids = tree.select("proof_id", F.explode("child_ids").alias("node_id")).distinct()
    top = tree.where("node_kind = 'parent'").join(kids, ["proof_id", "node_id"], "left_anti")
    return top.groupBy("proof_id").agg(F.min(F.struct((-F.size("child_ids")).alias("n"), "node_id")).alias("b")).select("proof_id", F.col("b.node_id").alias("root_id"))


def _pairs(tree: DataFrame) -> DataFrame:
    return hierarchy.descendants(hierarchy.links_of_tree(tree))


def _links_graph(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "tree_edges").select(clean_id("parent_id").alias("src"), clean_id("child_id").alias("dst"))
    return e.where("src IS NOT NULL AND dst IS NOT NULL").distinct()


@query
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query
def text_stems(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(text.stems("text")).alias("stem"))
    return t.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source IS NOT NULL").select(text.key_component("source").alias("source_key")).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))


@query
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    """Displayed and humanized texts with a 32-bit hash of each name."""
    x = table(spark, d, "tree_nodes").select(text.display_text("statement_text").alias("display"), text.humanize("node_id").alias("label"), text.fnv1a_column("node_id").alias("fnv"))
    return x.distinct()


@query
def text_replies(spark: SparkSession, d: str) -> DataFrame:
    """Summaries read from replies: here the reply is the node's own, in a code fence, as a model would give it."""
    t = _tree(spark, d).where("node_kind = 'parent'")
    body = F.to_json(F.struct(F.col("statement_text").alias("parent_statement"), F.col("why").alias("why_true_from_children"), F.col("terms").alias("new_terms_introduced"), F.col("complexity").alias("complexity_score"), F.col("abstraction").alias("abstraction_score"), F.col("refs").alias("evidence_refs"), "confidence"))
    reply = F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```\n"))
    s = t.select("proof_id", "node_id", text.parent_summary(text.json_object_column(reply)).alias("s"))
    return s.select("proof_id", "node_id", "s.parent_statement", "s.why_true_from_children", F.size("s.evidence_refs").alias("n_refs"), F.when(~F.isnan("s.complexity_score"), F.col("s.complexity_score")).alias("complexity_score"))


@query
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _leaves(spark, d).select(F.col("module_path").alias("tree_id"), F.col("leaf_id").alias("node_id"), "statement_text")
    return trees.pair_similarity(rows, 0.2)


@query
def leaf_map(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    return x.select("leaf_id", "module_path", "declaration_name", "theorem_kind", "statement_text", "pretty_statement", F.array_join("tags", ",").alias("tags"), F.array_join("dependency_ids", ",").alias("dependency_ids"))


@query
def leaf_problems(spark: SparkSession, d: str) -> DataFrame:
    """Of the declarations as delivered: lists with null or blank elements, missing texts, spans."""
    return leaf.problems(leaf.as_delivered(table(spark, d, "lean_declarations"))).groupBy("leaf_id", "path", "message").agg(F.count(F.lit(1)).alias("n"))


@query
def leaf_hashes(spark: SparkSession, d: str) -> DataFrame:
    return leaf.canonical_text(_leaves(spark, d)).select("leaf_id", "hash")


@query
def leaf_urls(spark: SparkSession, d: str) -> DataFrame:
    return leaf.with_source_url(_leaves(spark, d), "https://example.org/src/").select("leaf_id", "source_url")


@query
def classify_rules(spark: SparkSession, d: str) -> DataFrame:
    c = tagging.classify(_leaves(spark, d), ADAPTERS)
    return c.select("leaf_id", "adapter_id", "confidence", F.array_join("tags", ",").alias("tags"), F.array_join("evidence", ",").alias("evidence"))


def _tag_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tagging.evaluate(_tag_samples(spark, d))


def _tag_samples(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "lean_declarations").select(clean_id("declaration_id").alias("leaf_id"), F.explode(leaf.id_set("domain_classification.tags")).alias("t")).groupBy("leaf_id").agg(F.collect_set("t").alias("expected"))
    c = tagging.classify(_leaves(spark, d), ADAPTERS).join(said, "leaf_id")
    return c.select(F.col("leaf_id").alias("sample_id"), "expected", F.col("tags").alias("predicted"))


@query
def tag_eval(spark: SparkSession, d: str) -> DataFrame:
    return _tag_metrics(spark, d)


@query
def tag_eval_macro(spark: SparkSession, d: str) -> DataFrame:
    return tagging.macro(_tag_metrics(spark, d))


@query
def tag_report_hash(spark: SparkSession, d: str) -> DataFrame:
    s = _tag_samples(spark, d)
    return canon.group_hash(_one(tagging.report_lines(tagging.evaluate(s), s)), ["artifact"], ["part"]).drop("artifact")


@query
def tag_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of one kind forced to the specialised adapter with a raised threshold, and given or refused a tag."""
    x = _leaves(spark, d)
    o = x.where("theorem_kind IN ('lemma', 'definition')").select("leaf_id", F.when(F.col("theorem_kind") == "lemma", "kernel").alias("force_adapter_id"), F.when(F.col("theorem_kind") == "lemma", 0.3).alias("min_confidence"), F.array(F.lit("concept:reviewed")).alias("add_tags"), F.array(F.lit("concept:loop")).alias("remove_tags"))
    c = tagging.classify(x, ADAPTERS, overrides=o)
    return c.select("leaf_id", "adapter_id", "confidence", "downgraded_from", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"))


@query
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.xxhash64("text").alias("a"), F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("a")


def _code_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lower(doc_kind) = 'code'")
    body = F.array_join(F.expr("regexp_extract_all(text, r'(?s)```lean\\n(.*?)(?:```|$)', 1)"), "\n")
    return docs.select(F.concat(F.lit("Docs/D"), F.col("doc_id").cast("string"), F.lit(".lean")).alias("file_path"), body.alias("content"))


@query
def ingest_declarations(spark: SparkSession, d: str) -> DataFrame:
    return ingest.declarations(_code_sources(spark, d)).where("copy = 1").drop("copy", "body")


@query
def ingest_tagged(spark: SparkSession, d: str) -> DataFrame:
    x = ingest.ingest(_code_sources(spark, d), ADAPTERS)[0]
    return x.select("declaration_id", "adapter_id", "confidence", F.array_join("tags", ",").alias("tags"))


@query
def ingest_links(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest(_code_sources(spark, d))[1]


@query
def ingest_warnings(spark: SparkSession, d: str) -> DataFrame:
    return ingest.in_order(ingest.ingest(_code_sources(spark, d), ADAPTERS)[2])


@query
def ingest_hash(spark: SparkSession, d: str) -> DataFrame:
    lines = ingest.canonical_lines(*ingest.ingest(_code_sources(spark, d), ADAPTERS))
    return canon.group_hash(_one(lines), ["artifact"], ["part"]).drop("artifact")


@query
def source_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return canon.source_fingerprint(_code_sources(spark, d))


@query
def symbol_links(spark: SparkSession, d: str) -> DataFrame:
    """Names of declarations in the texts of documents: every document is a text, the declarations are the symbols."""
    x = _leaves(spark, d)
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("string").alias("src"), F.col("text").alias("body"))
    return ingest.symbol_links(docs, x.select(F.col("leaf_id").alias("id"), F.col("declaration_name").alias("name")).where("name <> ''"))


@query
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    return graph.nodes(x, graph.edges(x))


@query
def graph_missing(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    return graph.missing(x, graph.edges(x))


@query
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    e = graph.edges(x)
    return graph.degrees(graph.nodes(x, e), e)


@query
def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    e = graph.edges(x)
    return graph.totals(graph.nodes(x, e), e, graph.missing(x, e))


@query
def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_edges(spark, d))


@query
def graph_closure_no_external(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    return graph.closure(graph.edges(x), within=x.select(F.col("leaf_id").alias("dst")))


@query
def graph_scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_links_graph(spark, d))


@query
def graph_cyclic(spark: SparkSession, d: str) -> DataFrame:
    e = _links_graph(spark, d)
    c = graph.cyclic_components(e, graph.strong_components(e))
    return c.select("scc", F.array_join("members", ",").alias("members"), "size")


@query
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_links_graph(spark, d))


@query
def graph_batches(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    return graph.batches(graph.indexed(x), graph.edges(x))


@query
def graph_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Views of the declarations that runs reported to lack something."""
    x = _leaves(spark, d)
    e = graph.edges(x)
    asked = table(spark, d, "missing_dependency_refs").select(clean_id("declaration_id").alias("id")).where("id IS NOT NULL").distinct()
    return graph.lookups(asked, graph.nodes(x, e), e, graph.strong_components(e))


@query
def graph_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    e = graph.edges(x)
    return graph.fingerprint(graph.nodes(x, e), e)


@query
def graph_hash(spark: SparkSession, d: str) -> DataFrame:
    x = _leaves(spark, d)
    e = graph.edges(x)
    lines = graph.canonical_lines(graph.nodes(x, e), e, graph.missing(x, e), graph.strong_components(e))
    return canon.group_hash(_one(lines), ["artifact"], ["part"]).drop("artifact")


def _synthetic(spark: SparkSession, n: int = 5000) -> DataFrame:
    """(src, dst): each node needs the one before it, every third one also the one five before it."""
    ids = spark.range(n).select("id")
    name = lambda c: F.format_string("node_%05d", c)
    e = ids.where("id > 0").select("id", (F.col("id") - 1).alias("to")).unionByName(ids.where("id > 5 AND id % 3 = 0").select("id", (F.col("id") - 5).alias("to")))
    return e.select(name(F.col("id")).alias("src"), name(F.col("to")).alias("dst"))


@query
def graph_synthetic(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a made graph of 5,000 nodes: edges, cyclic components, and the support of its last node."""
    e = _synthetic(spark)
    last = e.agg(F.max("src").alias("src"))
    below = hierarchy.descendants(e.select(F.lit("g").alias("proof_id"), F.col("src").alias("parent_id"), F.col("dst").alias("child_id"))).join(last, F.col("node_id") == F.col("src")).agg(F.count(F.lit(1)).alias("closure_size"))
    cyclic = graph.cyclic_components(e, graph.strong_components(e)).agg(F.count(F.lit(1)).alias("cyclic_count"))
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.countDistinct("id").alias("node_count"))
    return e.agg(F.count(F.lit(1)).alias("edge_count")).join(ids).join(cyclic).join(below)


def _tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    need = _leaves(spark, d).select(F.col("leaf_id").alias("node_id"), F.col("dependency_ids").alias("needs"))
    return _tree(spark, d).where("node_kind = 'leaf'").join(need, "node_id", "left").select(F.col("proof_id").alias("tree_id"), "node_id", "statement_text", F.col("complexity").alias("complexity_score"), "needs")


def _built(spark: SparkSession, d: str) -> DataFrame:
    return trees.build(_tree_leaves(spark, d), CONFIG)


def _flat(df: DataFrame) -> DataFrame:
    """Lists of texts as one text, lists of lists with ';' between them."""
    for name, kind in df.dtypes:
        if kind == "array<string>":
            df = df.withColumn(name, F.array_join(name, ","))
        elif kind == "array<array<string>>":
            df = df.withColumn(name, F.array_join(F.transform(name, lambda x: F.array_join(x, ",")), ";"))
    return df


@query
def tree_build(spark: SparkSession, d: str) -> DataFrame:
    return _flat(trees.nodes_of(_built(spark, d)))


@query
def tree_events(spark: SparkSession, d: str) -> DataFrame:
    return _flat(trees.events_of(_built(spark, d)))


@query
def tree_group_plan(spark: SparkSession, d: str) -> DataFrame:
    return _flat(trees.plan_of(_built(spark, d)))


@query
def tree_layers(spark: SparkSession, d: str) -> DataFrame:
    return _flat(trees.layers_of(_built(spark, d)))


@query
def tree_issues(spark: SparkSession, d: str) -> DataFrame:
    return _flat(trees.issues_of(_built(spark, d)))


@query
def repartition_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.repartition_metrics(trees.events_of(_built(spark, d)))


@query
def tree_validation(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    nodes = t.select(F.col("proof_id").alias("tree_id"), "node_id", "node_kind", "child_ids", F.array().cast("array<string>").alias("violations"))
    return trees.validate(nodes, CONFIG.max_children, _top(t).select(F.col("proof_id").alias("tree_id"), F.col("root_id").alias("node_id")))


@query
def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    return store.edges_of(_tree(spark, d))


@query
def children_page(spark: SparkSession, d: str) -> DataFrame:
    return store.child_page(store.edges_of(_tree(spark, d)), 1, 2)


@query
def children_asked(spark: SparkSession, d: str) -> DataFrame:
    """The second page of two of every node, leaves and unknown ends of links included."""
    t = _tree(spark, d)
    ends = store.raw_links(table(spark, d, "tree_edges")).select("proof_id", F.col("child_id").alias("node_id"))
    asked = t.select("proof_id", "node_id").unionByName(ends).distinct().withColumn("page_offset", F.lit(1)).withColumn("page_limit", F.lit(2))
    return views.pages(t, asked)


@query
def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return views.root_nodes(_last_headers(spark, d).select("proof_id", "root_id"), t)


def _last_headers(spark: SparkSession, d: str) -> DataFrame:
    """Each proof's last snapshot: proof_id, snapshot_id, delivery_no, schema_version, root_id, config_hash."""
    h = table(spark, d, "tree_snapshots").select(clean_id("proof_id").alias("proof_id"), clean_id("snapshot_id").alias("snapshot_id"), F.coalesce("delivery_no", F.lit(-1)).alias("delivery_no"), "schema_version", clean_id("root_id").alias("root_id"), "config_hash", "taken_at")
    h = h.where("proof_id IS NOT NULL AND snapshot_id IS NOT NULL")
    cols = ["snapshot_id", "delivery_no", "schema_version", "root_id", "config_hash"]
    return h.groupBy("proof_id").agg(F.max_by(F.struct(*cols), F.struct("taken_at", "snapshot_id", "delivery_no", "root_id")).alias("v")).select("proof_id", "v.*")


@query
def ancestry_path(spark: SparkSession, d: str) -> DataFrame:
    a = store.ancestry(store.edges_of(_tree(spark, d)))
    return a.select("proof_id", "node_id", F.array_join("path", ">").alias("path"), "cut")


@query
def ancestry_checked(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return _flat(views.checked_ancestry(store.ancestry(store.edges_of(t)), _top(t)))


@query
def provenance_join(spark: SparkSession, d: str) -> DataFrame:
    return store.provenance(_tree(spark, d), _leaves(spark, d)).drop("source_span")


@query
def provenance_paths(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    p = views.provenance_paths(t, _top(t))
    return p.select("proof_id", "node_id", F.array_join("path", ">").alias("path"))


def _snapshot_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, links and headers of each proof's last snapshot."""
    h = _last_headers(spark, d)
    n = store.last_nodes(h, table(spark, d, "snapshot_nodes"))
    e = n.select("proof_id", F.col("node_id").alias("parent_id"), F.posexplode("child_ids").alias("child_order", "child_id"))
    return n, e, h


@query
def snapshot_violations(spark: SparkSession, d: str) -> DataFrame:
    return store.violations(_tree(spark, d), store.raw_links(table(spark, d, "tree_edges")), _last_headers(spark, d))


@query
def snapshot_import(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes of each proof's last snapshot are taken over: those of snapshots without an error."""
    n, e, h = _snapshot_parts(spark, d)
    good, _ = store.imported({"nodes": n, "edges": e, "header": h})
    return good.groupBy("proof_id").agg(F.count(F.lit(1)).alias("nodes"))


def _exported(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = _tree(spark, d)
    return store.exported(t, _leaves(spark, d), _top(t), CONFIG.hash())


@query
def snapshot_header(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_exported(spark, d)["header"])


@query
def snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    return canon.group_hash(store.snapshot_lines(_exported(spark, d)), ["proof_id"], ["part"])


def _opened(t: DataFrame) -> DataFrame:
    """Parents of at most four children."""
    return t.where("node_kind = 'parent' AND size(child_ids) BETWEEN 1 AND 4").select("proof_id", "node_id")


@query
def drilldown(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return views.disclosed(t, _top(t), _opened(t), 3)


@query
def drilldown_codes(spark: SparkSession, d: str) -> DataFrame:
    """Of the parents of delivered links, those that can't be opened."""
    t = _tree(spark, d)
    asked = store.raw_links(table(spark, d, "tree_edges")).select("proof_id", F.explode(F.array("parent_id", "child_id")).alias("node_id")).distinct()
    return views.expanded_codes(t, views.reachable(t, _top(t)), asked)


@query
def walk_codes(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return views.walk_codes(t, _top(t))


@query
def drilldown_hash(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    top = _top(t)
    lines = views.view_lines(views.disclosed(t, top, _opened(t), 3), t, top, CONFIG.hash(), 3)
    return canon.group_hash(lines, ["proof_id"], ["part"])


@query
def drilldown_window(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    shown = views.disclosed(t, _top(t), _opened(t))
    return views.window_rows(shown.select("proof_id", "place", "node_id"), ["proof_id"], ["place"], 10, 6, 2)


@query
def support_leaf_sets(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return store.support_sets(t, _pairs(t))


@query
def tree_diff(spark: SparkSession, d: str) -> DataFrame:
    n = store.first_and_last(snapshots.latest_headers(table(spark, d, "tree_snapshots")), table(spark, d, "snapshot_nodes"))
    keyed = store.comparable(n, hierarchy.descendants(store.links_below(n)))
    return store.tree_diff(keyed.where("side = 'old'"), keyed.where("side = 'new'"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Differences between each proof's first and last snapshot, of what their roots lead to."""
    n = store.first_and_last(snapshots.latest_headers(table(spark, d, "tree_snapshots")), table(spark, d, "snapshot_nodes"))
    # both sides are worked on as trees of their own, at once
    t = n.select(F.concat_ws("|", "side", "proof_id").alias("proof_id"), "node_id", "node_kind", F.coalesce("statement_text", F.lit("")).alias("statement_text"), "child_ids", F.col("node_depth").alias("depth"))
    c = cut_lineage(views.comparables(t, _pairs(t), views.reachable(t, _top(t))))
    of = lambda side: c.where(F.col("proof_id").startswith(f"{side}|")).withColumn("proof_id", F.substring("proof_id", 5, 1 << 30))
    return views.diff_report(of("old"), of("new"))


@query
def diff_report(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


@query
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.diff_summary(_changes(spark, d))


@query
def diff_panel(spark: SparkSession, d: str) -> DataFrame:
    p = views.diff_panel(_changes(spark, d))
    return p.select("proof_id", "at", "key", "type", "node_kind", "support_count", F.col("delta.before").alias("before"), F.col("delta.after").alias("after"), "total", "hidden")


@query
def diff_hash(spark: SparkSession, d: str) -> DataFrame:
    return canon.group_hash(views.diff_lines(_changes(spark, d), CONFIG, OTHER_CONFIG), ["proof_id"], ["part"])


def _decided(spark: SparkSession, d: str, t: DataFrame) -> DataFrame:
    p = policy.decisions(policy.groups_of(t, _edges(spark, d)), CONFIG)
    return p.select("proof_id", "node_id", "spread", "order_violations", "evidence", "continuity", (F.size("pre_codes") + F.size("post_codes")).alias("violations"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return quality.samples(t, _pairs(t), _decided(spark, d, t))


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of additions doesn't show."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query
def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    p = policy.decisions(policy.groups_of(_tree(spark, d), _edges(spark, d)), CONFIG)
    return _rounded(_flat(p))


@query
def quality_critic(spark: SparkSession, d: str) -> DataFrame:
    return policy.critic(policy.groups_of(_tree(spark, d)), CONFIG)


@query
def quality_samples(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_samples(spark, d))


@query
def quality_stored(spark: SparkSession, d: str) -> DataFrame:
    """Samples by the diagnostics that are stored with the nodes."""
    t = _tree(spark, d)
    return _rounded(quality.samples(t, _pairs(t), quality.stored_decisions(table(spark, d, "tree_nodes"))))


@query
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quality.metrics(_samples(spark, d), CONFIG))


@query
def quality_levels(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quality.metric_levels(_samples(spark, d), CONFIG))


@query
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quality.gate(quality.metrics(_samples(spark, d), CONFIG), CONFIG))


@query
def quality_gate_by_proof(spark: SparkSession, d: str) -> DataFrame:
    """The rules that each proof breaks, with their labels; trees that were built from its leaves give the repartition rate."""
    split = quality.repartition_metrics(trees.events_of(_built(spark, d))).where("depth IS NULL").withColumnRenamed("tree_id", "proof_id")
    g = quality.gate(quality.metrics(_samples(spark, d), CONFIG, "proof_id"), CONFIG, repartition=split, keys=["proof_id"]).where("NOT ok")
    return _rounded(g.withColumn("label", views.failure_label(F.col("code"))))


@query
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    sample = quality.samples(t, _pairs(t), _decided(spark, d, t))
    return quality.report(_rounded(sample), _top(t), CONFIG).drop("text")


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A baseline entry a proof, by its first and by its last snapshot."""
    n = store.first_and_last(snapshots.latest_headers(table(spark, d, "tree_snapshots")), table(spark, d, "snapshot_nodes"))
    g = n.groupBy("side", F.col("proof_id").alias("preset_name")).agg(F.count(F.when(F.col("node_kind") == "leaf", 1)).alias("leaf_count"), F.count(F.when(F.col("node_kind") == "parent", 1)).alias("parent_count"), F.max("node_depth").alias("max_depth"))
    return g.where("side = 'old'").drop("side"), g.where("side = 'new'").drop("side")


@query
def baseline_compare(spark: SparkSession, d: str) -> DataFrame:
    return quality.compare_baseline(*_entries(spark, d), "preset_name", ["leaf_count", "parent_count", "max_depth"])


@query
def spread_policy(spark: SparkSession, d: str) -> DataFrame:
    return quality.sibling_spread(_tree(spark, d), CONFIG)


@query
def prereq_violations(spark: SparkSession, d: str) -> DataFrame:
    """Links of the trees taken as what a child needs: a child before one of its own descendants in the same group."""
    t = _tree(spark, d)
    need = _pairs(t).select(F.col("node_id").alias("src"), F.col("descendant_id").alias("dst")).where("src <> dst").distinct()
    return quality.prerequisite_violations(t, need)


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The declarations as they stood at a time, and as they stand; rows without a time stood then."""
    decls = table(spark, d, "lean_declarations")
    return leaf.leaves(decls.where(F.coalesce(F.col("indexed_at") < F.lit(SPLIT_TIME).cast("timestamp"), F.lit(True)))), leaf.leaves(decls.where("deleted_at IS NULL"))


@query
def change_plan(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    c = change.change_types(old, new)
    b = change.blocked(c, graph.edges(new)).select("id", F.lit(True).alias("b"))
    return c.join(b, "id", "full").select("id", F.coalesce("change_type", F.lit("external")).alias("change_type"), F.coalesce("b", F.lit(False)).alias("is_blocked"))


@query
def change_batches(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return change.plan(old, new, graph.edges(new))


@query
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return change.plan_summary(change.plan(old, new, graph.edges(new))).drop("plan_hash")


@query
def cache_status(spark: SparkSession, d: str) -> DataFrame:
    """Stored snapshots against present ones: each delivery's leaf ids stand for its source, its configuration for itself."""
    h = table(spark, d, "tree_snapshots").where("proof_id IS NOT NULL AND config_hash IS NOT NULL")
    print_ = F.sha2(F.array_join(leaf.id_set("leaf_ids"), ","), 256)
    at = F.struct("taken_at", "delivery_no", "snapshot_id")
    by = h.groupBy("proof_id", "config_hash")
    first, last = by.agg(F.min_by(print_, at).alias("source_fingerprint")), by.agg(F.max_by(print_, at).alias("source_fingerprint"))
    entries = first.select("proof_id", "config_hash", "source_fingerprint", *(F.col("source_fingerprint").alias(c) for c in ("graph_hash", "actual_graph_hash", "snapshot_hash", "actual_snapshot_hash")))
    return change.cache_status(entries, last)


@query
def recovery(spark: SparkSession, d: str) -> DataFrame:
    """How each stored tree is brought up to date with the declarations as they stand: the way, and what it did."""
    t = _tree(spark, d)
    on = t.where("node_kind = 'leaf'").select("proof_id", F.col("node_id").alias("leaf_id")).distinct()
    old, new = (on.join(v, "leaf_id") for v in _versions(spark, d))
    r = recover.recover(t, _top(t), old, new, Config(complexity_band=3)).where("part = 'status'")
    return r.select("tree_id", "way", "reason", *(F.size(c).alias(c) for c in ("changed", "blocked", "recomputed", "collapsed", "dropped", "inserted")), "reused_by_grounding", "reused_by_signature", "generated", "skipped_ambiguous", "skipped_unrebasable")


@query
def reuse_match(spark: SparkSession, d: str) -> DataFrame:
    old = change.with_children_said(_tree(spark, d), ["proof_id"])
    last = store.last_nodes(snapshots.latest_headers(table(spark, d, "tree_snapshots")), table(spark, d, "snapshot_nodes"))
    new = change.with_children_said(last, ["proof_id", "snapshot_id"]).withColumn("node_id", F.concat_ws("|", "snapshot_id", "node_id"))
    return change.reuse(old, new)


@query
def common_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """The lowest common ancestor of each link between two leaves of a tree."""
    t = _tree(spark, d)
    on = t.where("node_kind = 'leaf'").select("proof_id", "node_id")
    e = _edges(spark, d)
    pairs = on.select("proof_id", F.col("node_id").alias("a")).join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a").join(on.select("proof_id", F.col("node_id").alias("b")), ["proof_id", "b"]).where("a <> b").select("proof_id", "a", "b")
    return change.lowest_common_ancestors(change.primary_paths(store.ancestry(store.edges_of(t)), _top(t)), pairs)


@query
def tree_heights(spark: SparkSession, d: str) -> DataFrame:
    return change.heights(hierarchy.hierarchy(_links(spark, d)).select("proof_id", "node_id", "hops"))


@query
def job_rollup(spark: SparkSession, d: str) -> DataFrame:
    return store.job_rollup(store.job_table(table(spark, d, "verification_jobs")), jobs.STATES)


@query
def next_queued(spark: SparkSession, d: str) -> DataFrame:
    return store.next_queued(store.job_table(table(spark, d, "verification_jobs")))


@query
def job_problems(spark: SparkSession, d: str) -> DataFrame:
    return jobs.problems(jobs.ledger(table(spark, d, "verification_jobs")))


@query
def job_hashes(spark: SparkSession, d: str) -> DataFrame:
    return canon.group_hash(jobs.job_lines(jobs.ledger(table(spark, d, "verification_jobs"))), ["job_id"], ["part"])


@query
def job_logs(spark: SparkSession, d: str) -> DataFrame:
    """Each job's two outputs collected by turns and capped, as a runner would hand them over."""
    j = jobs.ledger(table(spark, d, "verification_jobs"))
    said = lambda s: F.array_join(F.transform(F.filter(F.coalesce("logs", F.array().cast(jobs.LOG)), lambda x: x.isNotNull() & (x["stream_name"] == s)), lambda x: F.coalesce(x["message"], F.lit(""))), "\n")
    logs_ = jobs.capped_logs(jobs.collected_logs(said("stdout"), said("stderr")), 30)
    return j.select("job_id", F.inline(logs_))


@query
def job_queue(spark: SparkSession, d: str) -> DataFrame:
    """A job for each declaration that has none yet, after those there are."""
    from datetime import datetime

    j = store.job_table(table(spark, d, "verification_jobs"))
    todo = _leaves(spark, d).join(j.select("leaf_id").where("leaf_id IS NOT NULL").distinct(), "leaf_id", "left_anti")
    new = jobs.enqueue(todo, j, lambda path: jobs.contract("/src", "rev-1", path, "4.0.0"), datetime(2026, 1, 1))
    return new.select("job_id", "queue_sequence", F.col("job_target.leaf_id").alias("leaf_id"), "job_status", F.array_join("reproducibility.args", " ").alias("args"))


@query
def log_interleave(spark: SparkSession, d: str) -> DataFrame:
    return store.interleave_logs(table(spark, d, "verification_jobs"), LOG_LINES)


@query
def leaf_detail(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    rollup = store.job_rollup(store.job_table(table(spark, d, "verification_jobs")), jobs.STATES)
    x = _leaves(spark, d).where("source_span.file_path IS NOT NULL")
    v = views.leaf_details(x, views.provenance_paths(t, _top(t)), rollup, "https://example.org/src")
    return v.withColumn("path", F.array_join("path", ">"))


@query
def leaf_detail_codes(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    asked = table(spark, d, "tree_provenance").select(clean_id("proof_id").alias("proof_id"), clean_id("leaf_id").alias("leaf_id")).where("proof_id IS NOT NULL AND leaf_id IS NOT NULL")
    return views.unreachable_leaves(_leaves(spark, d), asked, views.provenance_paths(t, _top(t)))


@query
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return views.catalogue(t, _top(t), CONFIG)


@query
def fully_loaded(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return views.fully_loaded(t, _top(t))


@query
def scene_layout(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return views.scene(t, _top(t), quality.samples(t, _pairs(t), _decided(spark, d, t)), "seed")
