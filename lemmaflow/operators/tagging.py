"""Rule adapters that tag declarations, and the evaluation of tags.

An adapter is a name with a function from the input's columns to struct(tags, confidence, evidence); adapters are tried in the
order of the registry. Defined results: null texts are empty; without samples there is no metric row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.columns import half_up, ratio
from lemmaflow.functions.ids import clean_ids, strip_space

# The signals' words, their tags and what is said as evidence.
SIGNALS = {
    "concept:loop": ("loop|while|for|iterate|invariant", "loop keyword"),
    "concept:arithmetic": ("add|sub|mul|div|nat|int|arith|plus|minus|succ", "arithmetic keyword"),
    "concept:conditional": ("if|then|else|branch|condition|cond", "conditional keyword"),
    "concept:memory": ("memory|heap|store|load|pointer|register|buffer", "memory keyword"),
    "concept:state": ("state|st|transition|invariant|preserve", "state keyword"),
    "concept:compiler_correctness": ("compiler|compile|correct|correctness|equiv|equivalence|refine|simulation|preserves?", "compiler-correctness keyword"),
}
FALLBACK, THRESHOLD = "lean-generic", 0.45
FALLBACK_EVIDENCE = "fallback generic Lean adapter"
Adapter = Callable[[dict[str, Column]], Column]
_WARNINGS = "array<struct<code:string,message:string>>"


def _decision(tags: Column, confidence: Column, evidence: Column) -> Column:
    return F.struct(F.array_sort(F.array_distinct(tags)).alias("tags"), half_up(confidence).alias("confidence"), F.array_sort(F.array_distinct(evidence)).alias("evidence"))


def generic(row: dict[str, Column]) -> Column:
    return _decision(F.array(F.lit("domain:lean/general"), F.concat(F.lit("kind:"), row["theorem_kind"])), F.lit(0.55), F.array(F.lit(FALLBACK_EVIDENCE)))


def keyword_adapter(domain: str, module: str, name: str, evidence: str = "module/name signal") -> Adapter:
    """Keywords as signals, and a domain whose module path or name matches."""

    def classify(row: dict[str, Column]) -> Column:
        source = F.concat_ws("\n", row["module_path"], row["declaration_name"], row["statement_text"], row["pretty_statement"])
        own = row["module_path"].rlike(module) | row["declaration_name"].rlike(name)
        word = {tag: source.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])") for tag, (words, _) in SIGNALS.items()}
        there = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
        tags = there([F.when(own, F.lit(domain)), *(F.when(hit, F.lit(tag)) for tag, hit in word.items())])
        said = there([F.when(own, F.lit(evidence)), *(F.when(hit, F.lit(SIGNALS[tag][1])) for tag, hit in word.items())])
        return _decision(tags, F.least(F.lit(0.95), F.lit(0.1) + F.when(own, 0.35).otherwise(0.0) + F.size(tags) * 0.1), said)

    return classify


def classify(leaf: DataFrame, adapters: dict[str, Adapter], forced: str | None = None, threshold: float = THRESHOLD, fallback: str = FALLBACK, overrides: DataFrame | None = None) -> DataFrame:
    """leaf_id, adapter_id, confidence, downgraded_from, tags, evidence, warnings(code, message).

    The best adapter decides, equal ones in the registry's order; under the threshold the fallback's decision stands. overrides: one row a leaf_id at most with
    force_adapter_id, min_confidence, add_tags and remove_tags, any of them null; removal wins over addition.
    """
    row = {c: strip_space(F.coalesce(F.col(c), F.lit(""))) for c in ("module_path", "declaration_name", "theorem_kind", "statement_text", "pretty_statement")}
    rows = leaf.select("leaf_id", *(f(row).alias(f"d_{n}") for n, f in adapters.items()))
    if overrides is None:
        rows = rows.select("*", F.lit(forced).cast("string").alias("forced"), F.lit(float(threshold)).alias("least"), *(F.lit(None).cast("array<string>").alias(c) for c in ("added", "removed")))
    else:
        o = overrides.select("leaf_id", F.col("force_adapter_id").alias("o_forced"), F.col("min_confidence").alias("o_least"), F.col("add_tags").alias("added"), F.col("remove_tags").alias("removed"))
        rows = rows.join(o, "leaf_id", "left").withColumn("forced", F.coalesce("o_forced", F.lit(forced).cast("string"))).withColumn("least", F.coalesce("o_least", F.lit(float(threshold)))).drop("o_forced", "o_least")
    options = F.array(*(F.struct((-F.col(f"d_{n}.confidence")).alias("c"), F.lit(i).alias("i"), F.lit(n).alias("adapter_id"), F.col(f"d_{n}").alias("d")) for i, n in enumerate(adapters)))
    known = F.coalesce(F.col("forced").isin(*adapters), F.lit(False))
    best = F.array_min(F.when(known, F.filter(options, lambda x: x["adapter_id"] == F.col("forced"))).otherwise(options))
    rows = rows.withColumn("b", best)
    low = (F.col("b.d.confidence") < F.col("least")) & (F.col("b.adapter_id") != fallback)
    pick = lambda f: F.when(low, F.col(f"d_{fallback}.{f}")).otherwise(F.col(f"b.d.{f}"))
    manual = (F.coalesce(F.size("added"), F.lit(0)) > 0) | (F.coalesce(F.size("removed"), F.lit(0)) > 0)
    tags = override(pick("tags"), F.coalesce(clean_ids("added"), F.array().cast("array<string>")), F.coalesce(clean_ids("removed"), F.array().cast("array<string>")))
    evidence = F.when(low, F.array_sort(F.array_union(F.col(f"d_{fallback}.evidence"), F.col("b.d.evidence")))).otherwise(F.col("b.d.evidence"))
    say = lambda cond, code, message: F.when(cond, F.struct(F.lit(code).alias("code"), message.alias("message")))
    said = F.array(
        say(F.col("forced").isNotNull() & ~known, "forced_adapter_missing", F.format_string("Forced adapter '%s' is unavailable; selecting best adapter instead.", "forced")),
        say(low, "low_confidence_downgrade", F.format_string(f"Adapter '%s' scored below threshold and was downgraded to '{fallback}'.", "b.adapter_id")),
        say(manual, "manual_override_applied", F.lit("Manual domain-tag override was applied.")),
    )
    return rows.select(
        "leaf_id", F.when(low, F.lit(fallback)).otherwise(F.col("b.adapter_id")).alias("adapter_id"), pick("confidence").alias("confidence"), F.when(low, F.col("b.adapter_id")).alias("downgraded_from"),
        F.when(manual, tags).otherwise(pick("tags")).alias("tags"), evidence.alias("evidence"), F.filter(said, lambda x: x.isNotNull()).cast(_WARNINGS).alias("warnings"),
    )


def override(tags: Column, add: Column, remove: Column) -> Column:
    """Added, then removed: removal wins."""
    return F.array_sort(F.array_except(F.array_union(tags, add), remove))


def evaluate(samples: DataFrame) -> DataFrame:
    """tag, tp, fp, fn, precision, recall, f1 over (sample_id, expected, predicted)."""
    side = lambda c, n: samples.select("sample_id", F.explode(F.array_distinct(c)).alias("tag")).withColumn(n, F.lit(1))
    both = side("expected", "e").join(side("predicted", "p"), ["sample_id", "tag"], "full")
    e, p = F.col("e").isNotNull(), F.col("p").isNotNull()
    n = both.groupBy("tag").agg(F.count(F.when(e & p, 1)).alias("tp"), F.count(F.when(~e & p, 1)).alias("fp"), F.count(F.when(e & ~p, 1)).alias("fn"))
    n = n.withColumn("precision", half_up(ratio(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", half_up(ratio(F.col("tp"), F.col("tp") + F.col("fn"))))
    return n.withColumn("f1", half_up(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def macro(metrics: DataFrame) -> DataFrame:
    """Means of the rounded metrics, rounded again; 0 without tags."""
    return metrics.agg(*(half_up(F.coalesce(F.avg(c), F.lit(0.0))).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def report_lines(metrics: DataFrame, samples: DataFrame) -> DataFrame:
    """part, line: the canonical text of a tag evaluation; hashed by canon.group_hash."""
    four = lambda c: F.format_string("%.4f", c)
    head = samples.agg(F.count(F.lit(1)).alias("n")).crossJoin(macro(metrics))
    lines = F.array(F.format_string("samples=%d", "n"), *(F.concat(F.lit(f"macro_{c}="), four(F.col(f"macro_{c}"))) for c in ("precision", "recall", "f1")))
    top = head.select(F.posexplode(lines).alias("at", "line")).select(F.struct(F.lit(0).alias("k"), F.col("at").alias("i"), F.lit("").alias("tag")).alias("part"), "line")
    row = F.concat_ws("|", F.concat(F.lit("tag="), "tag"), *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("tp", "fp", "fn")), *(F.concat(F.lit(f"{c}="), four(F.col(c))) for c in ("precision", "recall", "f1")))
    return top.unionByName(metrics.select(F.struct(F.lit(1).alias("k"), F.lit(0).alias("i"), "tag").alias("part"), row.alias("line")))
