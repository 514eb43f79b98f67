"""Source files to declarations: scan, line rules, blocks, statements, links and warnings - all as column expressions.

Defined results: null content is an empty file; files without declarations give none; a name declared again in one place (equal
ids) is kept once, in (id, file) order, and reported; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmaflow.functions.canon import json_text
from lemmaflow.functions.columns import let
from lemmaflow.functions.ids import squash_space, strip_space
from lemmaflow.operators import tagging

# The language's names, keywords and what isn't parsed.
PLAIN_NAME = r"[A-Za-z_][A-Za-z0-9_']*(?:\.[A-Za-z_][A-Za-z0-9_']*)*"
NAME = rf"(?:«[^»]+»|{PLAIN_NAME})"
KEYWORDS = "theorem|lemma|def|abbrev|axiom|inductive|structure|instance|example"
MODIFIERS = "private|protected|noncomputable|partial|unsafe"
DECLARATION = rf"^\s*(?:@[\w.]+\s+)?(?:(?:{MODIFIERS})\s+)*({KEYWORDS})\s+({NAME})(?=\s|:|\(|\{{|\[|$)"
UNSUPPORTED = {
    "mutual": "mutual declarations are not yet expanded by the ingestion parser.",
    "opaque": "opaque declarations are not currently indexed.",
    "macro_rules": "macro_rules are not declaration-level proof artifacts.",
    "elab": "elab declarations are not currently indexed.",
}
FALLBACK_MESSAGE = "Unable to extract a non-empty statement; using declaration heading fallback."
SKIPPED_FOLDERS = [".git", "node_modules", ".lake", "dist", "build"]
ENDS = [":=", "\nwhere", " where", "\nby", " by"]


def read_sources(spark: SparkSession, root: str, include: list[str] | None = None) -> DataFrame:
    """file_path (below root), content of every .lean file, without the skipped folders."""
    df = spark.read.text([f"{root}/{p}" for p in include] if include else root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.lean")
    full = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    path = F.regexp_replace(full, "^\\Q" + root.rstrip("/") + "\\E/", "")
    skipped = "(^|/)(" + "|".join(p.replace(".", r"\.") for p in SKIPPED_FOLDERS) + ")/"
    return df.select(path.alias("file_path"), F.col("value").alias("content")).where(~F.col("file_path").rlike(skipped)).dropDuplicates(["file_path"])


def module_of(path: Column) -> Column:
    return F.regexp_replace(path, r"\.lean$", "")


def source_lines(sources: DataFrame) -> DataFrame:
    """file_path, line (one-based), text."""
    clean = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n")
    return sources.select("file_path", F.posexplode(F.split(clean, "\n")).alias("at", "text")).select("file_path", (F.col("at") + 1).alias("line"), "text")


def canonical_path(root: str, path: Column) -> Column:
    """The path below root with '.' and '..' resolved; one that leaves the root stays as it is, with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = "/" + root.strip("/")
    full = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit(base + "/"), plain))
    step = lambda done, x: F.when((x == "") | (x == "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/"))
    return let(clean, lambda c: F.when(c.startswith(base.rstrip("/") + "/"), F.substring(c, F.lit(len(base.rstrip("/")) + 2), F.length(c))).otherwise(plain))


def statement_of(block: Column) -> Column:
    """The block without its heading, up to where the proof begins, on one line. A name in guillemets keeps its heading, as the heading is known by the plain name."""
    heading = rf"^\s*(?:@[\w.]+\s+)?(?:(?:{MODIFIERS})\s+)*(?:{KEYWORDS})\s+{PLAIN_NAME}\s*"
    first, rest = F.substring_index(block, "\n", 1), F.when(F.instr(block, "\n") > 0, F.expr("substring(body, instr(body, '\n'))")).otherwise("")

    def cut(text: Column) -> Column:
        end = F.least(*(F.nullif(F.instr(text, d), F.lit(0)) for d in ENDS))
        return squash_space(F.when(end.isNull(), text).otherwise(F.substring(text, F.lit(1), end - 1)))

    return let(F.concat(F.regexp_replace(first, heading, ""), rest), cut)


def declarations(sources: DataFrame) -> DataFrame:
    """declaration_id, module_path, declaration_name, theorem_kind, statement_text, file_path, start_line, end_line, end_column, source_text_hash, fallback, copy (1 is kept)."""
    lines = source_lines(sources)
    lines = lines.withColumn("kw", F.regexp_extract("text", DECLARATION, 1)).withColumn("starts", F.col("kw") != "")
    w = Window.partitionBy("file_path").orderBy("line")
    lines = lines.withColumn("block", F.sum(F.col("starts").cast("int")).over(w)).where("block > 0")
    b = lines.groupBy("file_path", "block").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.min_by("kw", "line").alias("kw"), F.min_by("text", "line").alias("head"), F.max_by("text", "line").alias("tail"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"),
    )
    name = F.regexp_replace(F.regexp_extract("head", DECLARATION, 2), "[«»]", "")
    kind = F.when(F.col("kw").isin("def", "abbrev"), "definition").otherwise(F.col("kw"))
    b = b.select("file_path", module_of(F.col("file_path")).alias("module_path"), name.alias("declaration_name"), kind.alias("theorem_kind"), statement_of(F.col("body")).alias("said"), "start_line", "end_line", F.greatest(F.lit(1), F.length("tail")).alias("end_column"), F.sha2("body", 256).alias("source_text_hash"), "body")
    b = b.withColumn("fallback", F.col("said") == "").withColumn("statement_text", F.when(F.col("said") == "", F.concat_ws(" ", "theorem_kind", "declaration_name")).otherwise(F.col("said"))).drop("said")
    b = b.withColumn("declaration_id", F.concat_ws(":", F.lit("lean"), "module_path", "declaration_name", F.col("start_line").cast("string"), F.lit("1")))
    return b.withColumn("copy", F.row_number().over(Window.partitionBy("declaration_id").orderBy("file_path")))


def warnings(sources: DataFrame, found: DataFrame) -> DataFrame:
    """code, message, file_path, line, column, snippet: unsupported constructs, fallbacks and duplicates."""
    lines = source_lines(sources)
    words = F.array(*(F.when(F.col("text").rlike(rf"^\s*{w}(?![A-Za-z0-9_])"), F.lit(m)) for w, m in UNSUPPORTED.items()))
    first = F.length("text") - F.length(F.regexp_replace("text", r"^\s+", "")) + 1
    odd = lines.select("file_path", "line", first.alias("column"), strip_space("text").alias("snippet"), F.explode(F.filter(words, lambda x: x.isNotNull())).alias("message"))
    odd = odd.select(F.lit("unsupported_construct").alias("code"), "message", "file_path", "line", "column", "snippet")
    here = lambda df, code, message, snippet: df.select(F.lit(code).alias("code"), message.alias("message"), "file_path", F.col("start_line").alias("line"), F.lit(1).alias("column"), snippet.alias("snippet"))
    more = here(found.where("fallback"), "parse_fallback", F.lit(FALLBACK_MESSAGE), strip_space(F.substring_index("body", "\n", 1)))
    again = here(found.where("copy > 1"), "duplicate_declaration", F.format_string("Duplicate declaration id '%s' found.", "declaration_id"), F.col("declaration_name"))
    return odd.unionByName(more).unionByName(again)


def in_order(warning: DataFrame) -> DataFrame:
    """Warnings by file, line, column and code."""
    return warning.orderBy("file_path", "line", "column", "code")


def refuse_unsupported(warning: DataFrame) -> DataFrame:
    """Strict mode: the warnings, or an error with the number of unsupported constructs if there are any."""
    n = warning.where("code = 'unsupported_construct'").count()
    if n:
        raise ValueError(f"{n} unsupported constructs")
    return warning


def symbol_links(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst: names in texts (src, body) joined with symbols (id, name) by full name and by last segment, without self-links."""
    words = texts.select("src", F.explode(F.array_distinct(F.expr(f"regexp_extract_all(body, r\"{NAME}\", 0)"))).alias("word"))
    full = symbols.select(F.col("id").alias("dst"), F.col("name").alias("word"))
    short = symbols.select(F.col("id").alias("dst"), F.element_at(F.split("name", r"\."), -1).alias("word"))
    return words.join(full.unionByName(short).distinct(), "word").where("src <> dst").select("src", "dst").distinct()


def ingest(sources: DataFrame, adapters: dict[str, tagging.Adapter] | None = None, overrides: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(declarations, links, warnings) of source texts (file_path, content). With adapters, declarations get tags and their classification, and its warnings are added."""
    found = declarations(sources)
    kept = found.where("copy = 1")
    links = symbol_links(kept.select(F.col("declaration_id").alias("src"), "body"), kept.select(F.col("declaration_id").alias("id"), F.col("declaration_name").alias("name")))
    warn = warnings(sources, found)
    kept = kept.drop("copy")
    if adapters:
        rows = kept.select(F.col("declaration_id").alias("leaf_id"), "module_path", "declaration_name", "theorem_kind", "statement_text", F.col("statement_text").alias("pretty_statement"))
        decided = tagging.classify(rows, adapters, overrides=overrides).withColumnRenamed("leaf_id", "declaration_id")
        kept = kept.join(decided, "declaration_id")
        said = kept.select("file_path", F.col("start_line").alias("line"), F.col("declaration_name").alias("snippet"), F.explode("warnings").alias("w"))
        more = said.select(F.lit("domain_classification").alias("code"), F.format_string("[%s] %s", "w.code", "w.message").alias("message"), "file_path", "line", F.lit(1).alias("column"), "snippet")
        warn = warn.unionByName(more)
        kept = kept.drop("warnings")
    return kept.drop("body"), links, refuse_unsupported(warn) if strict else warn


def canonical_lines(found: DataFrame, links: DataFrame, warning: DataFrame) -> DataFrame:
    """part, line: the canonical text of an ingestion, its root left out; hashed by canon.group_hash."""
    deps = links.groupBy(F.col("src").alias("declaration_id")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("deps"))
    span = F.format_string("%s:%d:1-%d:%d", "file_path", "start_line", "end_line", "end_column")
    field = lambda n, c: F.concat(F.lit(f"{n}="), F.coalesce(c, F.lit("")))
    record = F.concat_ws("|", *(field(n, c) for n, c in [
        ("record", F.col("declaration_id")), ("module", F.col("module_path")), ("name", F.col("declaration_name")), ("kind", F.col("theorem_kind")), ("span", span), ("deps", F.col("deps")), ("tags", F.array_join("tags", ",")),
        ("domain_adapter", F.col("adapter_id")), ("domain_confidence", F.format_string("%.4f", "confidence")), ("domain_downgraded_from", F.col("downgraded_from")), ("hash", F.col("source_text_hash")),
    ]))
    warned = F.concat_ws("|", *(field(n, c) for n, c in [("warning", F.col("code")), ("file", F.col("file_path")), ("line", F.col("line").cast("string")), ("column", F.col("column").cast("string")), ("message", json_text(F.col("message")))]))
    place = lambda k, *c: F.struct(F.lit(k).alias("k"), *(x.alias(f"o{i}") for i, x in enumerate(c)))
    none, zero = F.lit(""), F.lit(0)
    head = found.agg(F.count(F.lit(1)).alias("n")).crossJoin(warning.agg(F.count(F.lit(1)).alias("m"))).select(F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("schema=1.0.0").alias("t")), F.struct(F.lit(1).alias("i"), F.lit("project_root=<redacted>").alias("t")), F.struct(F.lit(2).alias("i"), F.format_string("records=%d", "n").alias("t")), F.struct(F.lit(3).alias("i"), F.format_string("warnings=%d", "m").alias("t")))).alias("h"))
    out = head.select(place(0, none, F.col("h.i"), zero, none).alias("part"), F.col("h.t").alias("line"))
    out = out.unionByName(found.join(deps, "declaration_id", "left").select(place(1, F.col("declaration_id"), zero, zero, none).alias("part"), record.alias("line")))
    return out.unionByName(warning.select(place(2, F.col("file_path"), F.col("line"), F.col("column"), F.col("code")).alias("part"), warned.alias("line")))


def source_url(base: Column, path: Column, span: Column, keep_empty: bool = True) -> Column:
    """base / percent-encoded path segments # the span; empty segments are kept as sources are linked, or left out as leaves are."""
    raw = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}

    def enc(s: Column) -> Column:
        out = F.url_encode(s)
        for a, b in raw.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    joined = F.array_join(F.transform(parts if keep_empty else F.filter(parts, lambda x: x != ""), enc), "/")
    anchor = F.format_string("#L%dC%d-L%dC%d", span["start_line"], span["start_column"], span["end_line"], span["end_column"])
    return F.concat(F.regexp_replace(base, "/+$", ""), F.when(F.lit(keep_empty) | (joined != ""), F.concat(F.lit("/"), joined)).otherwise(F.lit("")), anchor)
