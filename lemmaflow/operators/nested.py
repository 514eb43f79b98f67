"""Nested records to flat tables that keep the parent's key and every element's place.

The work is one higher-order projection a record: nested `transform` calls attach the owner's key and the
positions of all ancestors, `flatten` joins the arrays of one record, and one `inline` a target table emits rows.
JSON text is read as VARIANT on the JVM side, once, so spelling, wrapping and shape can differ from record to record.

Defined results: a null, blank or invalid text gives no row; null elements and elements that are no object keep
their place but give no row; a lone object in place of an array is its element 0; a null owner key gives no row;
repeated records give their rows once; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.columns import let
from lemmaflow.functions.ids import clean_id, strip_space
from lemmaflow.session import cut_lineage

FOUND = "owner_table string, owner_key string, child_path string, ordinals string"
_OBJECT = "map<string,variant>"
_LIST = "array<variant>"


def _spelling(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]+", "")


def member(obj: Column, name: str) -> Column:
    """The value of the object's key that reads like `name` (given in camel case) in any spelling (camel, snake, kebab, upper case); the spelling as given is looked up first."""
    spelled = re.sub("[^a-z0-9]+", "", name.lower())

    def search(o: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(o, "$", _OBJECT))
        hit = F.get(F.filter(entries, lambda e: (_spelling(e["key"]) == spelled) & ~F.is_variant_null(e["value"])), F.lit(0))["value"]
        direct = F.try_variant_get(o, f"$.{name}", "variant")
        return F.when(direct.isNotNull() & ~F.is_variant_null(direct), direct).otherwise(hit)

    return let(obj, search)


def parse_strict(text: Column) -> Column:
    """VARIANT of a whole JSON text, null where it isn't valid; the end must match the beginning, as the parser ignores what follows."""

    def parse(whole: Column) -> Column:
        ends = F.concat(F.substring(whole, 1, 1), F.substring(whole, -1, 1))
        return F.when(ends.isin("{}", "[]", '""') & (F.length(whole) > 1), F.try_parse_json(whole))

    return let(strip_space(text), parse)


def unwrapped(v: Column, wrapper: str) -> Column:
    """v without one layer: text that holds JSON is parsed, and an object that has the wrapper's key gives its value."""

    def peel(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        inner = F.when(kind == "STRING", parse_strict(F.try_variant_get(x, "$", "string"))).when(kind.startswith("OBJECT"), member(x, wrapper))
        return F.coalesce(inner, x)

    return let(v, peel)


def elements(v: Column) -> Column:
    """The array in v; a lone object is an array of one; anything else is null."""
    return let(v, lambda x: F.coalesce(F.try_variant_get(x, "$", _LIST), F.when(F.try_variant_get(x, "$", _OBJECT).isNotNull(), F.array(x))))


def _objects(items: Column) -> Column:
    """struct(pos, item) for each element that is an object."""
    placed = F.transform(items, lambda x, i: F.struct(i.alias("pos"), x.alias("item")))
    return F.filter(placed, lambda p: F.try_variant_get(p["item"], "$", _OBJECT).isNotNull())


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(member(v, name), "$", "string")


def layers_of(text: Column, wrapper: str) -> Column:
    """At least as many layers as the text can have: encoding a text again doubles its backslashes, and every wrapper names its key. An object that names no wrapper has none."""
    slashes = F.length(text) - F.length(F.replace(text, F.lit("\\"), F.lit("")))
    names = F.regexp_count(F.lower(text), F.lit("[^a-z0-9]*".join(wrapper.lower())))
    return F.when((names > 0) | strip_space(text).startswith('"'), F.ceil(F.log2(1 + slashes)) + 1 + names).otherwise(0).cast("int")


def diagnostics_records(tree_nodes: DataFrame, wrapper: str = "policyDiagnostics") -> DataFrame:
    """(owner_key, doc): the parsed diagnostics of each record, encodings and wrapper objects taken off, however many there are."""
    df = tree_nodes.select(clean_id("node_id").alias("owner_key"), F.col("policy_diagnostics").alias("text"))
    df = df.where("owner_key IS NOT NULL AND text IS NOT NULL").select("owner_key", parse_strict(F.col("text")).alias("doc"), layers_of(F.col("text"), wrapper).alias("layers"))
    doc = F.when(F.col("layers") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("layers", F.lit(1))), F.col("doc"), lambda d, _: unwrapped(d, wrapper))).otherwise(F.col("doc"))
    df = df.select("owner_key", doc.alias("doc"))
    return df.where(F.try_variant_get("doc", "$", _OBJECT).isNotNull())


def _seen(items: Column) -> Column:
    """struct(pos, code, message) of each object of a list."""
    return F.transform(_objects(elements(items)), lambda p: F.struct(p["pos"].alias("pos"), _text(p["item"], "code").alias("code"), _text(p["item"], "message").alias("message")))


def parsed_diagnostics(tree_nodes: DataFrame) -> DataFrame:
    """One row a record with its scalars and arrays, written once: every target table is inlined from it without parsing again."""
    doc = F.col("doc")
    number = lambda name: F.try_variant_get(member(doc, name), "$", "int")
    trace = F.transform(
        _objects(elements(member(doc, "rewriteTrace"))),
        lambda p: F.struct(
            p["pos"].alias("pos"),
            F.try_variant_get(member(p["item"], "attemptIndex"), "$", "int").alias("attempt_index"),
            _text(p["item"], "strategy").alias("strategy"),
            _seen(member(member(p["item"], "postSummary"), "violations")).alias("inner"),
        ),
    )
    rows = diagnostics_records(tree_nodes).select(
        "owner_key", number("depth").alias("record_depth"), number("groupIndex").alias("group_index"), number("retriesUsed").alias("retries_used"),
        _seen(member(member(doc, "preSummary"), "violations")).alias("pre"), _seen(member(member(doc, "postSummary"), "violations")).alias("post"), trace.alias("trace"),
    )
    return cut_lineage(rows)


def _violation(owner: Column, path: str, prefix: Column | None, p: Column) -> Column:
    place = p["pos"].cast("string")
    return F.struct(owner.alias("owner_key"), F.lit(path).alias("child_path"), (place if prefix is None else F.concat(prefix, F.lit("."), place)).alias("ordinals"), p["code"].alias("code"), p["message"].alias("message"))


def _diagnostics_rows(tree_nodes: DataFrame) -> dict[str, DataFrame]:
    owner, parts = F.col("owner_key"), parsed_diagnostics(tree_nodes)
    none = F.array().cast("array<struct<owner_key:string,child_path:string,ordinals:string,code:string,message:string>>")
    rows = F.flatten(
        F.array(
            F.coalesce(F.transform("pre", lambda p: _violation(owner, "preSummary.violations", None, p)), none),
            F.coalesce(F.transform("post", lambda p: _violation(owner, "postSummary.violations", None, p)), none),
            F.coalesce(F.flatten(F.transform("trace", lambda t: F.coalesce(F.transform(t["inner"], lambda p: _violation(owner, "rewriteTrace.postSummary.violations", t["pos"].cast("string"), p)), none))), none),
        )
    )
    rewrites = F.transform("trace", lambda t: F.struct(owner.alias("owner_key"), F.lit("rewriteTrace").alias("child_path"), t["pos"].cast("string").alias("ordinals"), t["attempt_index"].alias("attempt_index"), t["strategy"].alias("strategy")))
    return {
        "diagnostics": parts.select("owner_key", "record_depth", "group_index", "retries_used"),
        "violations": parts.select(F.inline(rows)),
        "rewrites": parts.select(F.inline(rewrites)),
    }


def flatten_diagnostics(tree_nodes: DataFrame) -> dict[str, DataFrame]:
    """Tables `diagnostics` (parent), `violations` and `rewrites` (children, linked by owner_key and ordinals)."""
    return {k: v.distinct() for k, v in _diagnostics_rows(tree_nodes).items()}


def _log_rows(jobs: DataFrame) -> DataFrame:
    owner = clean_id("job_id")
    lines = F.transform(
        "logs",
        lambda x, i: F.struct(F.lit("logs").alias("child_path"), i.cast("string").alias("ordinals"), x.isNotNull().alias("there"), x["line_index"].alias("line_index"), x["stream_name"].alias("stream_name"), x["message"].alias("message")),
    )
    df = jobs.select(owner.alias("owner_key"), "logs").where("owner_key IS NOT NULL").select("owner_key", F.inline(F.filter(lines, lambda s: s["there"])))
    return df.drop("there")


def flatten_logs(jobs: DataFrame) -> DataFrame:
    """One row a stored log line that isn't null."""
    return _log_rows(jobs).distinct()


def _warning_rows(declarations: DataFrame) -> DataFrame:
    owner = clean_id("declaration_id")
    rows = F.transform(
        "warnings",
        lambda x, i: F.struct(F.lit("warnings").alias("child_path"), i.cast("string").alias("ordinals"), x.isNotNull().alias("there"), x["code"].alias("code"), x["message"].alias("message"), F.to_json(x["details"]).alias("details")),
    )
    df = declarations.select(owner.alias("owner_key"), F.col("domain_classification.warnings").alias("warnings")).where("owner_key IS NOT NULL").select("owner_key", F.inline(F.filter(rows, lambda s: s["there"])))
    return df.drop("there")


def flatten_warnings(declarations: DataFrame) -> DataFrame:
    """One row a warning of a declaration's classification; details, a map, is kept as JSON text."""
    return _warning_rows(declarations).distinct()


def flatten_all(tree_nodes: DataFrame, jobs: DataFrame, declarations: DataFrame) -> dict[str, DataFrame]:
    """Every target table of the three kinds of record."""
    return flatten_diagnostics(tree_nodes) | {"log_lines": flatten_logs(jobs), "warnings": flatten_warnings(declarations)}


def found(tree_nodes: DataFrame, jobs: DataFrame, declarations: DataFrame) -> DataFrame:
    """owner_table, owner_key, child_path, ordinals of every child row; repeats are dropped once, at the end of each kind of record."""
    d, keys = _diagnostics_rows(tree_nodes), ["owner_key", "child_path", "ordinals"]
    kinds = {"tree_nodes": d["violations"].select(*keys).unionByName(d["rewrites"].select(*keys)), "verification_jobs": _log_rows(jobs).select(*keys), "lean_declarations": _warning_rows(declarations).select(*keys)}
    out = None
    for owner, part in kinds.items():
        part = part.distinct().select(F.lit(owner).alias("owner_table"), *keys)
        out = part if out is None else out.unionByName(part)
    return out
