"""Quality of explanation trees: samples a parent, metrics overall, by proof and by depth, repartition metrics, threshold gate, reports, presets and baselines.

Defined results: of repeated deliveries of a node the last counts; parents without meaningful stems are fully supported; a parent without policy decisions has spread 0, no violations,
its children's share among its references as evidence, and continuity 1; empty tables give the empty metrics (coverage means 1, all else 0) overall and no samples or groups.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions.canon import Config, json_text, locale_key, sha256, stable_json
from lemmaflow.functions.columns import ratio
from lemmaflow.functions.ids import clean_id, clean_ids
from lemmaflow.functions.text import meaningful_stems
from lemmaflow.operators import nested

SAMPLE = ["depth", "child_count", "complexity_spread", "prerequisite_order_violations", "evidence_coverage_ratio", "vocabulary_continuity_ratio", "supported_claim_ratio", "introduced_term_count", "introduced_term_rate", "policy_violation_count"]
METRICS = [
    "parent_count", "unsupported_parent_count", "prerequisite_violation_parent_count", "policy_violation_parent_count", "introduced_term_overflow_parent_count", "unsupported_parent_rate", "prerequisite_violation_rate",
    "policy_violation_rate", "mean_complexity_spread", "max_complexity_spread", "mean_evidence_coverage", "mean_vocabulary_continuity", "mean_term_jump_rate", "support_coverage_floor",
]


def tree_table(tree_nodes: DataFrame) -> DataFrame:
    """proof_id, node_id, node_kind, statement_text, child_ids, complexity, refs, terms, why, abstraction, confidence, depth: one row a node, the delivery ingested last. Of the last four a table may lack any."""
    given = lambda n, t: F.col(n) if n in tree_nodes.columns else F.lit(None).cast(t)
    rows = tree_nodes.select(
        clean_id("proof_id").alias("proof_id"), clean_id("node_id").alias("node_id"), "node_kind", F.coalesce("statement_text", F.lit("")).alias("statement_text"), clean_ids("child_ids").alias("child_ids"), F.col("complexity_score").alias("complexity"),
        clean_ids("evidence_refs").alias("refs"), clean_ids("new_terms_introduced").alias("terms"), F.coalesce(given("why_true_from_children", "string"), F.lit("")).alias("why"), given("abstraction_score", "double").alias("abstraction"), given("confidence", "double").alias("confidence"), given("node_depth", "int").alias("depth"), "ingested_at",
    )
    rows = rows.where("proof_id IS NOT NULL AND node_id IS NOT NULL")
    cols = ["node_kind", "statement_text", "child_ids", "complexity", "refs", "terms", "why", "abstraction", "confidence", "depth"]
    return rows.groupBy("proof_id", "node_id").agg(F.max_by(F.struct(*cols), F.struct("ingested_at", *cols)).alias("v")).select("proof_id", "node_id", "v.*")


def stored_decisions(tree_nodes: DataFrame) -> DataFrame:
    """proof_id, node_id, spread, order_violations, evidence, continuity, violations of the diagnostics stored with the nodes, in any spelling; of several deliveries the one ingested last that can be read."""
    keyed = tree_nodes.select(clean_id("proof_id").alias("proof_id"), clean_id("node_id").alias("own_id"), F.col("policy_diagnostics"), "ingested_at").where("proof_id IS NOT NULL AND own_id IS NOT NULL")
    docs = nested.diagnostics_records(keyed.select(F.concat_ws("\x1f", "proof_id", "own_id", F.coalesce(F.col("ingested_at").cast("string"), F.lit(""))).alias("node_id"), "policy_diagnostics"))
    side = lambda n: nested.member(F.col("doc"), n)
    number = lambda part, n: F.try_variant_get(nested.member(nested.member(side(part), "metrics"), n), "$", "double")
    count = lambda part: F.coalesce(F.size(nested.elements(nested.member(side(part), "violations"))), F.lit(0))
    cols = {"spread": number("preSummary", "complexitySpread"), "order_violations": number("preSummary", "prerequisiteOrderViolations").cast("int"), "evidence": number("postSummary", "evidenceCoverageRatio"), "continuity": number("postSummary", "vocabularyContinuityRatio"), "violations": count("preSummary") + count("postSummary")}
    rows = docs.select(F.split("owner_key", "\x1f").alias("k"), *(c.alias(n) for n, c in cols.items()))
    rows = rows.select(F.col("k")[0].alias("proof_id"), F.col("k")[1].alias("node_id"), F.col("k")[2].alias("at"), *cols)
    return rows.groupBy("proof_id", "node_id").agg(F.max_by(F.struct(*cols), F.struct("at", *cols)).alias("v")).select("proof_id", "node_id", "v.*")


def samples(tree: DataFrame, pairs: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """proof_id, node_id and SAMPLE of each parent. pairs: (proof_id, node_id, descendant_id); decided: (proof_id, node_id, spread, order_violations, evidence, continuity, violations) where there are decisions."""
    word = tree.select("proof_id", F.col("node_id").alias("descendant_id"), F.explode(meaningful_stems("statement_text")).alias("stem"))
    parents = tree.where("node_kind = 'parent'")
    own = parents.select("proof_id", "node_id", F.explode(meaningful_stems("statement_text")).alias("stem"))
    below = pairs.join(parents.select("proof_id", "node_id"), ["proof_id", "node_id"], "left_semi").where("node_id <> descendant_id")
    # only stems that the parent has are followed, and each counts once, so that the parts met on the way are partly counted before they are shuffled
    seen = below.join(word, ["proof_id", "descendant_id"]).select("proof_id", "node_id", "stem").distinct()
    new = parents.select("proof_id", "node_id", F.explode(meaningful_stems(F.array_join("terms", " "))).alias("stem"))
    known = seen.unionByName(new).distinct().withColumn("ok", F.lit(1))
    support = own.join(known, ["proof_id", "node_id", "stem"], "left").groupBy("proof_id", "node_id").agg(F.count(F.lit(1)).alias("n_stems"), F.count("ok").alias("n_known"))
    out = parents.select("proof_id", "node_id", "depth", F.size("child_ids").alias("child_count"), ratio(F.size(F.filter("child_ids", lambda c: F.array_contains("refs", c))), F.size("child_ids"), 1.0).alias("direct"), F.size("terms").alias("n_terms"))
    out = out.join(support, ["proof_id", "node_id"], "left")
    none = {"spread": "double", "order_violations": "int", "evidence": "double", "continuity": "double", "violations": "int"}
    out = out.join(decided.select("proof_id", "node_id", *none), ["proof_id", "node_id"], "left") if decided is not None else out.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    z = lambda x, v=0: F.coalesce(x, F.lit(v))
    n = z("n_stems")
    return out.select(
        "proof_id", "node_id", "depth", "child_count", z("spread", 0.0).alias("complexity_spread"), z("order_violations").alias("prerequisite_order_violations"), F.coalesce("evidence", "direct").alias("evidence_coverage_ratio"),
        z("continuity", 1.0).alias("vocabulary_continuity_ratio"), ratio(z("n_known"), n, 1.0).alias("supported_claim_ratio"), F.col("n_terms").alias("introduced_term_count"), ratio(F.col("n_terms"), n).alias("introduced_term_rate"), z("violations").alias("policy_violation_count"),
    )


def _aggregates(config: Config) -> list[Column]:
    rules = {"unsupported_parent": F.col("supported_claim_ratio") < config.support_floor(), "prerequisite_violation": F.col("prerequisite_order_violations") > 0, "policy_violation": F.col("policy_violation_count") > 0}
    count = lambda c: F.count(F.when(c, 1))
    mean = lambda c, e=0.0: F.coalesce(F.avg(c), F.lit(e))
    n = F.count("node_id")
    return [
        n.alias("parent_count"), count(rules["unsupported_parent"]).alias("unsupported_parent_count"), count(rules["prerequisite_violation"]).alias("prerequisite_violation_parent_count"), count(rules["policy_violation"]).alias("policy_violation_parent_count"),
        count(F.col("introduced_term_rate") > 1).alias("introduced_term_overflow_parent_count"), *(ratio(count(c), n).alias(f"{k}_rate") for k, c in rules.items()), mean("complexity_spread").alias("mean_complexity_spread"), F.coalesce(F.max("complexity_spread"), F.lit(0.0)).alias("max_complexity_spread"),
        mean("evidence_coverage_ratio", 1.0).alias("mean_evidence_coverage"), mean("vocabulary_continuity_ratio", 1.0).alias("mean_vocabulary_continuity"), mean("introduced_term_rate").alias("mean_term_jump_rate"), F.lit(config.support_floor()).alias("support_coverage_floor"),
    ]


def metrics(sample: DataFrame, config: Config, by: str | None = None) -> DataFrame:
    """METRICS overall, or by a column of the sample."""
    return sample.groupBy(by).agg(*_aggregates(config)) if by else sample.agg(*_aggregates(config))


def metric_levels(sample: DataFrame, config: Config) -> DataFrame:
    """scope (all, proof, depth), proof_id, depth and METRICS: overall, by proof, and by depth within a proof, from one pass with grouping sets. Without samples there is no row."""
    sets = sample.groupingSets([[], [F.col("proof_id")], [F.col("proof_id"), F.col("depth")]], F.col("proof_id"), F.col("depth"))
    g = sets.agg(F.grouping_id().alias("g"), *_aggregates(config))
    return g.select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "proof").otherwise("depth").alias("scope"), "proof_id", "depth", *METRICS)


def repartition_metrics(events: DataFrame) -> DataFrame:
    """tree_id, depth (null: the whole tree), event_count, pre_summary_event_count, post_summary_event_count, max_round of repartition events (tree_id, depth, reason, round)."""
    g = events.groupingSets([[F.col("tree_id")], [F.col("tree_id"), F.col("depth")]], F.col("tree_id"), F.col("depth"))
    pre = F.col("reason") == "pre_summary_policy"
    out = g.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("event_count"), F.count(F.when(pre, 1)).alias("pre_summary_event_count"), F.count(F.when(~pre, 1)).alias("post_summary_event_count"), F.max("round").alias("max_round"))
    return out.select("tree_id", F.when(F.col("g") == 0, F.col("depth")).alias("depth"), "event_count", "pre_summary_event_count", "post_summary_event_count", "max_round")


@dataclass(frozen=True)
class Thresholds:
    """Bounds of the gate; None follows from the configuration."""

    max_unsupported_parent_rate: float = 0.1
    max_prerequisite_violation_rate: float = 0
    max_policy_violation_rate: float = 0
    max_term_jump_rate: float = 0.35
    max_complexity_spread_mean: float | None = None
    min_evidence_coverage_mean: float = 1
    min_vocabulary_continuity_mean: float | None = None
    min_repartition_event_rate: float = 0
    max_repartition_event_rate: float = 1
    max_repartition_max_round: float = 3

    def normalized(self, config: Config) -> Thresholds:
        """Rates within 0 and 1 (0 if not finite), the spread not negative, the round a whole number."""
        spread = config.complexity_band if self.max_complexity_spread_mean is None else self.max_complexity_spread_mean
        share = config.continuity_threshold() if self.min_vocabulary_continuity_mean is None else self.min_vocabulary_continuity_mean
        rate = lambda v: max(0.0, min(1.0, v)) if math.isfinite(v) else 0.0
        out = {f.name: rate(getattr(self, f.name)) for f in fields(self) if f.name not in ("max_complexity_spread_mean", "min_vocabulary_continuity_mean", "max_repartition_max_round")}
        turn = self.max_repartition_max_round
        return Thresholds(**out, max_complexity_spread_mean=float(max(0, spread)) if math.isfinite(spread) else float(config.complexity_band), min_vocabulary_continuity_mean=rate(share), max_repartition_max_round=max(0, math.floor(turn)) if math.isfinite(turn) else 3)


#: The gate's rules (fixed values): code, metric, threshold, comparator.
RULES = [
    ("unsupported_parent_rate", "unsupported_parent_rate", "max_unsupported_parent_rate", "<="),
    ("prerequisite_violation_rate", "prerequisite_violation_rate", "max_prerequisite_violation_rate", "<="),
    ("policy_violation_rate", "policy_violation_rate", "max_policy_violation_rate", "<="),
    ("term_jump_rate", "mean_term_jump_rate", "max_term_jump_rate", "<="),
    ("complexity_spread_mean", "mean_complexity_spread", "max_complexity_spread_mean", "<="),
    ("evidence_coverage_mean", "mean_evidence_coverage", "min_evidence_coverage_mean", ">="),
    ("vocabulary_continuity_mean", "mean_vocabulary_continuity", "min_vocabulary_continuity_mean", ">="),
    ("min_repartition_event_rate", "repartition_event_rate", "min_repartition_event_rate", ">="),
    ("repartition_event_rate", "repartition_event_rate", "max_repartition_event_rate", "<="),
    ("repartition_max_round", "repartition_max_round", "max_repartition_max_round", "<="),
]


def gate(metric: DataFrame, config: Config, thresholds: Thresholds | None = None, repartition: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, code, actual, expected, comparator, ok of all rules; a tree passes if all are ok. repartition: (keys, event_count, max_round) of the trees that were split, where there are any."""
    t, keys = (thresholds or Thresholds()).normalized(config), keys or []
    if repartition is None:
        m = metric.withColumn("event_count", F.lit(0)).withColumn("max_round", F.lit(0))
    else:
        r = repartition.select(*keys, "event_count", "max_round")
        m = metric.join(r, keys, "left") if keys else metric.join(F.broadcast(r.agg(F.sum("event_count").alias("event_count"), F.max("max_round").alias("max_round"))))
    events, turn = F.coalesce("event_count", F.lit(0)), F.coalesce("max_round", F.lit(0))
    m = m.withColumn("repartition_event_rate", ratio(events, F.col("parent_count"))).withColumn("repartition_max_round", turn)
    rows = F.array(*(F.struct(F.lit(code).alias("code"), F.col(c).cast("double").alias("actual"), F.lit(float(getattr(t, name))).alias("expected"), F.lit(sign).alias("comparator"), ((F.col(c) <= getattr(t, name)) if sign == "<=" else (F.col(c) >= getattr(t, name))).alias("ok")) for code, c, name, sign in RULES))
    return m.select(*keys, F.inline(rows))


def js_number(c: Column) -> Column:
    """A number as JSON has it: whole ones without a fraction."""
    x = c.cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _members(cols: dict[str, Column]) -> Column:
    """A JSON object of columns that are JSON already."""
    parts = [F.concat(F.lit(("," if i else "") + f'"{k}":'), v) for i, (k, v) in enumerate(cols.items())]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def report(sample: DataFrame, roots: DataFrame, config: Config, thresholds: Thresholds | None = None, repartition: DataFrame | None = None) -> DataFrame:
    """proof_id, root_id, threshold_pass, text (canonical JSON, the time masked), hash: one report a tree. roots: (proof_id, root_id); repartition: repartition_metrics with the tree as proof_id.

    A report's samples are one JSON array, so a tree's parents are gathered in one row; the metrics behind it aren't."""
    t = (thresholds or Thresholds()).normalized(config)
    levels = metric_levels(sample, config)
    whole, deep = levels.where("scope = 'proof'").drop("scope", "depth"), levels.where("scope = 'depth'")
    rep = repartition if repartition is not None else sample.select(F.col("proof_id"), F.lit(None).cast("int").alias("depth"), *(F.lit(0).alias(c) for c in ("event_count", "pre_summary_event_count", "post_summary_event_count", "max_round"))).limit(0)
    total, parts = rep.where("depth IS NULL").drop("depth"), rep.where("depth IS NOT NULL")
    number = lambda names: {_camel(n): js_number(F.col(n)) for n in names}
    listed = lambda df, cols, order, name: df.select("proof_id", F.struct(*order, _members(cols).alias("j")).alias("s")).groupBy("proof_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["j"]), ","), F.lit("]")).alias(name))
    one = listed(sample, {"parentId": json_text(F.col("node_id"))} | number(SAMPLE), ["node_id"], "samples")
    deepest = ["depth", "parent_count", "unsupported_parent_rate", "prerequisite_violation_rate", "policy_violation_rate", "mean_complexity_spread", "mean_evidence_coverage", "mean_vocabulary_continuity", "mean_term_jump_rate"]
    two = listed(deep, number(deepest), ["depth"], "depths")
    counts = ["event_count", "pre_summary_event_count", "post_summary_event_count", "max_round"]
    three = listed(parts, number(["depth", *counts]), ["depth"], "turns")
    failed = gate(whole, config, t, total, ["proof_id"]).where("NOT ok")
    messages = dict(zip([r[0] for r in RULES], MESSAGES))
    said = F.element_at(F.create_map(*(F.lit(x) for kv in messages.items() for x in kv)), F.col("code"))
    four = listed(failed, {"code": json_text(F.col("code")), "message": json_text(said), "details": _members({"actual": js_number(F.col("actual")), "expected": js_number(F.col("expected")), "comparator": json_text(F.col("comparator"))})}, ["code"], "failures")
    j = roots.join(whole, "proof_id").join(one, "proof_id").join(two, "proof_id").join(three, "proof_id", "left").join(four, "proof_id", "left").join(total, "proof_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("[]"))
    text = _members({
        "rootId": json_text(F.col("root_id")), "configHash": F.lit(f'"{config.hash()}"'), "generatedAt": F.lit('"<non-deterministic>"'), "metrics": _members(number(METRICS)), "thresholds": F.lit(json.dumps({_camel(k): int(v) if float(v).is_integer() else v for k, v in asdict(t).items()}, separators=(",", ":"))),
        "thresholdPass": F.when(F.col("failures").isNull(), "true").otherwise("false"), "thresholdFailures": empty("failures"), "parentSamples": F.col("samples"), "depthMetrics": F.col("depths"),
        "repartitionMetrics": _members({_camel(c): js_number(F.coalesce(F.col(c), F.lit(0))) for c in counts} | {"depthMetrics": empty("turns")}),
    })
    return j.select("proof_id", "root_id", F.col("failures").isNull().alias("threshold_pass"), text.alias("text")).withColumn("hash", F.sha2("text", 256))


#: What a broken rule is reported as (fixed values), in the order of RULES.
MESSAGES = [
    "Unsupported parent rate exceeded threshold.", "Prerequisite-order violation rate exceeded threshold.", "Policy-violation rate exceeded threshold.", "Mean term-introduction jump rate exceeded threshold.", "Mean sibling complexity spread exceeded threshold.",
    "Mean evidence coverage dropped below threshold.", "Mean vocabulary continuity dropped below threshold.", "Repartition event rate dropped below threshold.", "Repartition event rate exceeded threshold.", "Maximum repartition round exceeded threshold.",
]


@dataclass(frozen=True)
class Preset:
    """A named benchmark: where its sources lie and what it changes in configuration and thresholds."""

    name: str
    description: str
    project_root: str
    include_paths: tuple[str, ...] = ()
    config: dict[str, object] = field(default_factory=dict)
    thresholds: dict[str, object] = field(default_factory=dict)

    def text(self) -> str:
        """Canonical JSON; overrides by their stored names, in locale order, and no member for an empty configuration."""
        by_name = lambda d: {k: d[k] for k in sorted((k for k in d if d[k] is not None), key=locale_key)}
        out = {"name": self.name, "description": self.description, "projectRoot": self.project_root, "includePaths": sorted(set(self.include_paths), key=locale_key)}
        if by_name(self.config):
            out["configOverrides"] = by_name(self.config)
        return json.dumps(out | {"thresholdOverrides": by_name(self.thresholds)}, separators=(",", ":"), ensure_ascii=False)

    def hash(self) -> str:
        return sha256(self.text())

    def limits(self) -> Thresholds:
        back = {_camel(f.name): f.name for f in fields(Thresholds)}
        return replace(Thresholds(), **{back[k]: v for k, v in self.thresholds.items()})


class Presets:
    """Presets by name, listed in locale order; a name may be there once."""

    def __init__(self, presets: list[Preset]) -> None:
        self.by_name = {p.name: p for p in presets}
        if len(self.by_name) != len(presets):
            raise ValueError("a preset's name is there twice")

    def listed(self) -> list[Preset]:
        return [self.by_name[n] for n in sorted(self.by_name, key=locale_key)]

    def resolve(self, name: str) -> Preset | None:
        return self.by_name.get(name)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.name, p.description, p.project_root, sorted(set(p.include_paths), key=locale_key), stable_json(p.config), stable_json(p.thresholds), p.hash()) for p in self.listed()], "preset_name string, description string, project_root string, include_paths array<string>, config_overrides string, threshold_overrides string, preset_hash string")


BASELINE = ["preset_name", "preset_hash", "quality_report_hash", "threshold_pass", "leaf_count", "parent_count", "repartition_event_count", "repartition_max_round"]
BASELINE_VERSION = "1.0.0"


def build_baseline(reports: DataFrame) -> DataFrame:
    """BASELINE rows of reports by preset; a preset that is reported twice, or without name, is an error."""
    bad = reports.groupBy("preset_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR preset_name IS NULL")
    first = bad.first()
    if first is not None:
        raise ValueError(f"duplicate quality gate baseline entry for preset '{first[0]}'" if first[0] is not None else "a report without a preset")
    return reports.select(*BASELINE)


def baseline_lines(entries: DataFrame) -> DataFrame:
    """part, line: the entries' canonical JSON, a line an entry in order of their names."""
    bools = {"threshold_pass"}
    texts = {"preset_name", "preset_hash", "quality_report_hash"}
    cols = {_camel(c): json_text(F.col(c)) if c in texts else F.col(c).cast("string") if c in bools else js_number(F.col(c)) for c in BASELINE}
    return entries.select(F.col("preset_name").alias("part"), _members(cols).alias("line"))


def outcome_hash(entries: DataFrame) -> str:
    """SHA-256 of the entries' JSON array; entries are one row a preset."""
    rows = sorted(((r["part"], r["line"]) for r in baseline_lines(entries).collect()), key=lambda r: locale_key(r[0]))
    return sha256("[" + ",".join(line for _, line in rows) + "]")


def checked_baseline(entries: DataFrame, version: str, outcome: str) -> DataFrame:
    """The entries of a stored baseline, or an error if its version, its columns, its names or its hash are wrong."""
    if version != BASELINE_VERSION:
        raise ValueError(f"quality gate baseline schemaVersion must be {BASELINE_VERSION}, received {version}")
    gone = [c for c in BASELINE if c not in entries.columns]
    if gone or not entries.where(" OR ".join(f"{c} IS NULL" for c in BASELINE)).isEmpty():
        raise ValueError(f"quality gate baseline entries lack {gone or 'values'}")
    built = build_baseline(entries)
    actual = outcome_hash(built)
    if actual != outcome:
        raise ValueError(f"quality gate baseline outcomeHash mismatch: expected {outcome}, actual {actual}")
    return built


def compare_baseline(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, code (missing_preset, unexpected_preset, field_mismatch), field, expected, actual: how what is found differs from the baseline."""
    a, b = expected.withColumn("_there", F.lit(True)).alias("a"), actual.withColumn("_there", F.lit(True)).alias("b")
    j = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    name = F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}"))
    none = F.lit(None).cast("string")
    hit = lambda code, f, x, y: F.struct(F.lit(code).alias("code"), F.lit(f).alias("field"), x.alias("expected"), y.alias("actual"))
    rows = F.when(F.col("b._there").isNull(), F.array(hit("missing_preset", "", none, none))).when(F.col("a._there").isNull(), F.array(hit("unexpected_preset", "", none, none))).otherwise(
        F.filter(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), hit("field_mismatch", f, F.col(f"a.{f}").cast("string"), F.col(f"b.{f}").cast("string"))) for f in fields)), lambda x: x.isNotNull())
    )
    return j.select(name.alias(key), F.inline(rows))


def sibling_spread(tree: DataFrame, config: Config) -> DataFrame:
    """proof_id, node_id, spread, ok: complexity spread of each parent's children, missing ones at the target."""
    kids = tree.where("node_kind = 'parent'").select("proof_id", "node_id", F.explode(F.array_distinct("child_ids")).alias("child"))
    c = kids.join(tree.select("proof_id", F.col("node_id").alias("child"), "complexity"), ["proof_id", "child"], "left").withColumn("complexity", F.coalesce("complexity", F.lit(float(config.complexity_level))))
    s = c.groupBy("proof_id", "node_id").agg((F.max("complexity") - F.min("complexity")).alias("spread"))
    return s.withColumn("ok", F.col("spread") <= config.complexity_band)


def prerequisite_violations(tree: DataFrame, edge: DataFrame) -> DataFrame:
    """proof_id, node_id, violations: children that stand before an in-group prerequisite (src needs dst)."""
    kids = tree.where("node_kind = 'parent'").select("proof_id", "node_id", F.posexplode("child_ids").alias("at", "child"))
    need = kids.join(edge.withColumnRenamed("src", "child"), "child").select("proof_id", "node_id", "at", F.col("dst").alias("other"))
    late = need.alias("n").join(kids.alias("k"), (F.col("n.proof_id") == F.col("k.proof_id")) & (F.col("n.node_id") == F.col("k.node_id")) & (F.col("n.other") == F.col("k.child")) & (F.col("k.at") > F.col("n.at")))
    return late.groupBy(F.col("n.proof_id").alias("proof_id"), F.col("n.node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("violations"))
