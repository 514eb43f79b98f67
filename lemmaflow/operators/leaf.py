"""Declarations as leaves: mapping, clean-up, validation, migration of an older layout.

Defined results: blank texts count as missing; missing kinds and unknown ones become 'unknown'; a missing pretty statement is the
statement; missing lists are empty; a missing id is derived from module, name, kind and span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.canon import json_text
from lemmaflow.functions.ids import SPACE, clean_id, clean_ids, strip_space
from lemmaflow.operators.ingest import source_url

SCHEMA_VERSION = "1.0.0"
#: Kinds of declarations.
KINDS = ["theorem", "lemma", "definition", "axiom", "inductive", "structure", "instance", "example", "unknown"]


def id_set(c: Column | str) -> Column:
    """Trimmed, without blanks and repeats, sorted."""
    return F.array_sort(F.array_distinct(clean_ids(c)))


def span_text(s: Column) -> Column:
    """file:line:column-line:column."""
    return F.concat(s["file_path"], F.lit(":"), s["start_line"].cast("string"), F.lit(":"), s["start_column"].cast("string"), F.lit("-"), s["end_line"].cast("string"), F.lit(":"), s["end_column"].cast("string"))


def derived_id(module: Column, name: Column, kind: Column, span: Column) -> Column:
    parts = [F.coalesce(x, F.lit("")) for x in (module, name, kind, span_text(span))]
    return F.concat(F.lit("decl_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def leaves(declarations: DataFrame) -> DataFrame:
    """One leaf a declaration: the row indexed last, equal times by the text's hash."""
    kind = F.lower(clean_id("theorem_kind"))
    rows = declarations.select(
        clean_id("declaration_id").alias("given_id"),
        F.regexp_replace(F.coalesce(clean_id("module_path"), F.lit("")), f"[{SPACE}]+", " ").alias("module_path"),
        F.coalesce(clean_id("declaration_name"), F.lit("")).alias("declaration_name"),
        F.when(kind.isin(*KINDS), kind).otherwise("unknown").alias("theorem_kind"),
        F.coalesce(clean_id("statement_text"), F.lit("")).alias("statement_text"),
        F.coalesce(clean_id("pretty_statement"), clean_id("statement_text"), F.lit("")).alias("pretty_statement"),
        "source_span",
        id_set("tags").alias("tags"),
        id_set("dependency_ids").alias("dependency_ids"),
        "indexed_at",
        F.coalesce("source_text_hash", F.lit("")).alias("source_text_hash"),
    )
    rows = rows.withColumn("leaf_id", F.coalesce("given_id", derived_id(F.col("module_path"), F.col("declaration_name"), F.col("theorem_kind"), F.col("source_span"))))
    fields = ["module_path", "declaration_name", "theorem_kind", "statement_text", "pretty_statement", "source_span", "tags", "dependency_ids"]
    best = F.max_by(F.struct(*fields), F.struct("indexed_at", "source_text_hash", "statement_text", "pretty_statement", "dependency_ids", "tags"))
    return rows.groupBy("leaf_id").agg(best.alias("l")).select(F.lit(SCHEMA_VERSION).alias("schema_version"), "leaf_id", "l.*")


def problems(leaf: DataFrame) -> DataFrame:
    """leaf_id, path, message: one row a broken rule. leaf: leaf-shaped rows as they are, before or after clean-up; a null list element or a blank one breaks its list's rule."""
    s = F.col("source_span")
    blank = lambda c: F.coalesce(strip_space(c) == "", F.lit(True))
    listed = lambda c: F.col(c).isNull() | F.exists(c, lambda x: F.coalesce(strip_space(x) == "", F.lit(True)))
    rules = [("schemaVersion", "schemaVersion is required.", blank(F.col("schema_version"))), ("id", "id is required.", blank(F.col("leaf_id")))]
    rules += [(n, f"{n} is required.", blank(F.col(c))) for n, c in (("modulePath", "module_path"), ("declarationName", "declaration_name"), ("statementText", "statement_text"), ("prettyStatement", "pretty_statement"))]
    rules += [("theoremKind", "Unsupported theorem kind.", ~F.coalesce(F.col("theorem_kind").isin(*KINDS), F.lit(False)))]
    rules += [(n, f"{n} must be an array of non-empty strings.", listed(c)) for n, c in (("tags", "tags"), ("dependencyIds", "dependency_ids"))]
    rules += [("sourceSpan.filePath", "filePath is required.", blank(s["file_path"]))]
    rules += [(f"sourceSpan.{n}", "must be a positive integer.", F.coalesce(s[c] <= 0, F.lit(True))) for n, c in (("startLine", "start_line"), ("startColumn", "start_column"), ("endLine", "end_line"), ("endColumn", "end_column"))]
    rules += [("sourceSpan.endLine", "endLine must be >= startLine.", s["end_line"] < s["start_line"]), ("sourceSpan.endColumn", "endColumn must be >= startColumn when startLine=endLine.", (s["end_line"] == s["start_line"]) & (s["end_column"] < s["start_column"]))]
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, m, c in rules)), lambda x: x.isNotNull())
    return leaf.select("leaf_id", F.inline(found))


def as_delivered(declarations: DataFrame) -> DataFrame:
    """The columns that problems() looks at, as they were delivered."""
    return declarations.select("schema_version", F.col("declaration_id").alias("leaf_id"), "module_path", "declaration_name", "theorem_kind", "statement_text", "pretty_statement", "source_span", "tags", "dependency_ids")


def migrated(old: DataFrame) -> DataFrame:
    """Rows of the older flat layout, or of both mixed, in the present one: each row takes the first of a field's names that it fills."""
    have = set(old.columns)
    pick = lambda *names: F.coalesce(*[clean_id(n) for n in names if n in have], F.lit(""))
    inner = lambda n: F.col(f"source_span.{n}") if "source_span" in have else F.lit(None)
    number = lambda n: F.coalesce(inner(n).cast("int"), F.col(n).cast("int") if n in have else F.lit(None).cast("int"))
    path = F.coalesce(clean_id(inner("file_path").cast("string")), pick("file_path", "file"))
    span = F.struct(path.alias("file_path"), *(number(n).alias(n) for n in ("start_line", "start_column", "end_line", "end_column")))
    both = [F.col(n) for n in ("dependency_ids", "deps") if n in have]
    none = F.array().cast("array<string>")
    return old.select(
        pick("declaration_id", "id").alias("declaration_id"), pick("module_path", "module").alias("module_path"), pick("declaration_name", "name").alias("declaration_name"), pick("theorem_kind", "kind").alias("theorem_kind"),
        pick("statement_text", "statement").alias("statement_text"), pick("pretty_statement", "pretty", "statement_text", "statement").alias("pretty_statement"), span.alias("source_span"),
        (F.coalesce("tags", none) if "tags" in have else none).alias("tags"), F.coalesce(*both, none).alias("dependency_ids"), F.lit(None).cast("timestamp").alias("indexed_at"), F.lit("").alias("source_text_hash"),
    )


def canonical_text(leaf: DataFrame) -> DataFrame:
    """leaf_id, text (eleven lines), hash; empty lists and a missing address are 'none'."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).otherwise("none")
    address = F.coalesce(clean_id("source_url"), F.lit("none")) if "source_url" in leaf.columns else F.lit("none")
    fields = {
        "schema": F.col("schema_version"), "id": F.col("leaf_id"), "module": F.col("module_path"), "declaration": F.col("declaration_name"), "kind": F.col("theorem_kind"), "span": F.coalesce(span_text(F.col("source_span")), F.lit("")),
        "statement": json_text(F.col("statement_text")), "pretty": json_text(F.col("pretty_statement")), "dependencies": listed("dependency_ids"), "tags": listed("tags"), "source_url": address,
    }
    return leaf.select("leaf_id", F.concat_ws("\n", *(F.concat(F.lit(f"{n}="), c) for n, c in fields.items())).alias("text")).withColumn("hash", F.sha2("text", 256))


def tree_inputs(leaf: DataFrame) -> DataFrame:
    """node_id, statement_text (the pretty one), needs: what trees are built from."""
    return leaf.select(F.col("leaf_id").alias("node_id"), F.col("pretty_statement").alias("statement_text"), F.col("dependency_ids").alias("needs"))


def with_source_url(leaf: DataFrame, base: str) -> DataFrame:
    """The leaves with source_url: their own, or the one of their span below base."""
    own = clean_id("source_url") if "source_url" in leaf.columns else F.lit(None).cast("string")
    s = F.col("source_span")
    return leaf.withColumn("source_url", F.coalesce(own, source_url(F.lit(base), s["file_path"], s, keep_empty=False)))
