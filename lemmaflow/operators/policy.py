"""Rules for groups of children and the summaries made of them: before the summary, on the summary (critic), and after it.

Every rule is there twice: as column expressions over arrays of children, for whole tables, and as plain functions for kernels.

Defined results: a missing complexity is the target; null texts are empty; a group without children has full evidence; texts without tokens that
count are fully covered; numbers that are null or NaN are out of their range.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.canon import Config, locale_key
from lemmaflow.functions.columns import ratio
from lemmaflow.functions.text import POLICY_STOP, SUMMARY_STOP, lexical, stems

#: Tokens that a statement has at least before its coverage is looked at.
LEAST_TOKENS = 4


# Plain functions.


@dataclass
class Child:
    id: str
    said: str
    complexity: float | None = None
    needs: list[str] = field(default_factory=list)


@dataclass
class Summary:
    said: str
    why: str
    terms: list[str]
    refs: list[str]
    complexity: float
    abstraction: float
    confidence: float


Summarizer = Callable[[list[Child], Config, int], Summary]


def joined(children: list[Child], config: Config, attempt: int = 0) -> Summary:
    """The children's statements by id, joined by 'and'; scores at their targets."""
    kids = sorted(children, key=lambda c: locale_key(c.id))
    said = " and ".join(c.said for c in kids)
    return Summary(said, said, [], [c.id for c in kids], float(config.complexity_level), float(config.abstraction_level), 1.0)


def bracketed(children: list[Child], config: Config, attempt: int = 0) -> Summary:
    """As joined, with each statement in brackets and scores of 3."""
    kids = sorted(children, key=lambda c: locale_key(c.id))
    said = " and ".join(f"({c.said})" for c in kids)
    return Summary(said, said, [], [c.id for c in kids], 3.0, 3.0, 0.99)


def stem_word(t: str) -> str:
    """The rules of functions.text.stem."""
    n = len(t)
    if t.endswith("ies") and n > 5:
        return t[:-3] + "y"
    if t.endswith("ing") and n > 6:
        return t[:-3]
    if t.endswith("ed") and n > 5:
        return t[:-2]
    if t.endswith("es") and n > 5:
        return t[:-2] if t[:-2].endswith(("s", "x", "z", "ch", "sh")) else t[:-1]
    return t[:-1] if t.endswith("s") and n > 4 else t


def stem_words(text: str) -> list[str]:
    return [stem_word(t) for t in re.split("[^a-z0-9_]+", text.lower()) if t]


def covered_share(own: list[str], known: set[str]) -> float:
    return sum(t in known for t in own) / len(own) if own else 1.0


def order_violations(children: list[Child]) -> int:
    """Needs within the group that stand after the child that has them."""
    place = {c.id: i for i, c in enumerate(children)}
    return sum(place.get(p, -1) > place[c.id] for c in children for p in c.needs)


def before(children: list[Child], config: Config) -> tuple[float, int, list[str]]:
    """Spread of complexity, order violations and the codes of broken rules."""
    cs = [c.complexity if c.complexity is not None else config.complexity_level for c in children]
    spread, late = max(cs) - min(cs), order_violations(children)
    return spread, late, ["sibling_complexity_spread"] * (spread > config.complexity_band) + ["prerequisite_order"] * (late > 0)


def criticize(s: Summary, children: list[Child], config: Config) -> list[str]:
    """The critic's codes, one a broken rule."""
    ok = lambda x, lo, hi: x is not None and math.isfinite(x) and lo <= x <= hi
    out = ["schema"] * (not (s.said and s.why)) + ["schema"] * (not ok(s.complexity, 1, 5)) + ["schema"] * (not ok(s.abstraction, 1, 5)) + ["schema"] * (not ok(s.confidence, 0, 1))
    ids = {c.id for c in children}
    out += ["evidence_refs"] * (not s.refs or any(r not in ids for r in s.refs)) + ["term_budget"] * (len(s.terms) > config.term_budget)
    lo, hi = max(1, config.complexity_level - config.complexity_band), min(5, config.complexity_level + config.complexity_band)
    out += ["complexity_band"] * (s.complexity is not None and (s.complexity < lo or s.complexity > hi))
    own = [t for t in stem_words(s.said) if len(t) >= 5 and t not in SUMMARY_STOP]
    known = {t for c in children for t in stem_words(c.said) if len(t) >= 4 and t not in SUMMARY_STOP} | {t for x in s.terms for t in stem_words(x)}
    out += ["unsupported_terms"] * (len(own) >= LEAST_TOKENS and covered_share(own, known) < config.coverage_floor())
    return out


#: What a critic's code is called among the rules after the summary (fixed values).
AS_POLICY = {"term_budget": "term_budget", "evidence_refs": "evidence_coverage", "schema": "vocabulary_continuity", "complexity_band": "vocabulary_continuity", "unsupported_terms": "entailment"}


def after(s: Summary, children: list[Child], config: Config) -> tuple[float, float, list[str]]:
    """Evidence coverage, continuity and the codes of broken rules."""
    word = lambda t: t.isascii() and t.isalpha()
    evidence = sum(c.id in s.refs for c in children) / len(children) if children else 1.0
    known = {t for c in children for t in stem_words(c.said) if word(t) and len(t) >= 4 and t not in POLICY_STOP} | {t for x in s.terms for t in stem_words(x) if word(t)}
    own = [t for t in stem_words(f"{s.said} {s.why}") if word(t) and len(t) >= 5 and t not in POLICY_STOP]
    share = covered_share(own, known)
    return evidence, share, ["evidence_coverage"] * (evidence < 1) + ["term_budget"] * (len(s.terms) > config.term_budget) + ["vocabulary_continuity"] * (share < config.continuity_floor())


# Column expressions.


def groups_of(tree: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """The parents of a tree table with kids, array<struct(at, id, said, complexity, needs)>: their children in order, those that aren't there left out. edge: (src, dst) of what each needs."""
    parents = tree.where("node_kind = 'parent'")
    one = tree.select("proof_id", F.col("node_id").alias("id"), F.col("statement_text").alias("said"), "complexity")
    places = parents.select("proof_id", "node_id", F.posexplode("child_ids").alias("at", "id"))
    kids = places.join(one, ["proof_id", "id"])
    none = F.array().cast("array<string>")
    if edge is None:
        kids = kids.withColumn("needs", none)
    else:  # only needs within the group count, so they are found by joins on the group's own ids
        inside = places.select("proof_id", "node_id", F.col("id").alias("dst")).distinct()
        need = places.select("proof_id", "node_id", F.col("id").alias("src")).distinct().join(edge.distinct(), "src").join(inside, ["proof_id", "node_id", "dst"])
        need = need.groupBy("proof_id", "node_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("needs"))
        kids = kids.join(need, ["proof_id", "node_id", "id"], "left").withColumn("needs", F.coalesce("needs", none))
    grouped = kids.groupBy("proof_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "said", "complexity", "needs"))).alias("kids"))
    empty = F.array().cast("array<struct<at:int,id:string,said:string,complexity:double,needs:array<string>>>")
    return parents.join(grouped, ["proof_id", "node_id"], "left").withColumn("kids", F.coalesce("kids", empty))


def _stems(texts: Column, least: int, stop: list[str], only: bool = False) -> Column:
    keep = lambda x: (F.length(x) >= least) & (~x.isin(*stop) if stop else F.lit(True)) & (lexical(x) if only else F.lit(True))
    return F.filter(F.flatten(F.transform(texts, stems)), keep)


def _share(own: Column, known: Column) -> Column:
    return ratio(F.size(F.filter(own, lambda x: F.array_contains(known, x))), F.size(own), 1.0)


def token_coverage(parent: Column, children: Column, terms: Column) -> Column:
    """struct(ratio, total): share of the parent's significant stems (five letters, repeats kept) that children or new terms have; 1 without any."""
    known, own = F.array_union(_stems(children, 4, SUMMARY_STOP), _stems(terms, 0, [])), _stems(F.array(parent), 5, SUMMARY_STOP)
    return F.struct(_share(own, known).alias("ratio"), F.size(own).alias("total"))


def continuity(parent: Column, why: Column, children: Column, terms: Column) -> Column:
    """Share of the lexical stems of statement and reason that children or new terms have; 1 without any."""
    known = F.array_union(_stems(children, 4, POLICY_STOP, True), _stems(terms, 0, [], True))
    return _share(_stems(F.array(F.concat_ws(" ", parent, why)), 5, POLICY_STOP, True), known)


def _codes(rules: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules)), lambda x: x.isNotNull())


def decisions(groups: DataFrame, config: Config) -> DataFrame:
    """proof_id, node_id, spread, order_violations, pre_codes, evidence, continuity, n_terms, post_codes of groups with their summary columns (statement_text, why, terms, refs)."""
    ids, target = F.transform("kids", lambda k: k["id"]), F.lit(float(config.complexity_level))
    cs = F.transform("kids", lambda k: F.coalesce(k["complexity"], target))
    spread = F.when(F.size("kids") > 0, F.array_max(cs) - F.array_min(cs)).otherwise(0.0)
    late = F.aggregate(F.transform("kids", lambda k, i: F.size(F.filter(k["needs"], lambda p: F.array_position(ids, p) > i + 1))), F.lit(0), lambda a, x: a + x)
    own_ids = F.col("child_ids")
    evidence = ratio(F.size(F.filter(own_ids, lambda c: F.array_contains("refs", c))), F.size(own_ids), 1.0)
    share = continuity(F.col("statement_text"), F.col("why"), F.transform("kids", lambda k: k["said"]), F.col("terms"))
    rows = groups.select("proof_id", "node_id", spread.alias("spread"), late.alias("order_violations"), evidence.alias("evidence"), share.alias("continuity"), F.size("terms").alias("n_terms"))
    pre = _codes([("sibling_complexity_spread", F.col("spread") > config.complexity_band), ("prerequisite_order", F.col("order_violations") > 0)])
    post = _codes([("evidence_coverage", F.col("evidence") < 1), ("term_budget", F.col("n_terms") > config.term_budget), ("vocabulary_continuity", F.col("continuity") < config.continuity_floor())])
    return rows.select("*", pre.alias("pre_codes"), post.alias("post_codes"))


def critic(groups: DataFrame, config: Config) -> DataFrame:
    """proof_id, node_id, code, policy_code of each parent's broken rules: schema, evidence_refs, term_budget, complexity_band, unsupported_terms; a code once a parent."""
    cover = token_coverage(F.col("statement_text"), F.transform("kids", lambda k: k["said"]), F.col("terms"))
    lo, hi = max(1, config.complexity_level - config.complexity_band), min(5, config.complexity_level + config.complexity_band)
    bad = lambda c, a, b: F.coalesce(~F.col(c).between(a, b) | F.isnan(c), F.lit(True))
    rules = [
        ("schema", (F.col("statement_text") == "") | (F.coalesce("why", F.lit("")) == "") | bad("complexity", 1, 5) | bad("abstraction", 1, 5) | bad("confidence", 0, 1)),
        ("evidence_refs", (F.size("refs") == 0) | (F.size(F.array_except("refs", "child_ids")) > 0)),
        ("term_budget", F.size("terms") > config.term_budget),
        ("complexity_band", (F.col("complexity") < lo) | (F.col("complexity") > hi)),
        ("unsupported_terms", (cover["total"] >= LEAST_TOKENS) & (cover["ratio"] < config.coverage_floor())),
    ]
    names = F.create_map(*(F.lit(x) for kv in AS_POLICY.items() for x in kv))
    return groups.select("proof_id", "node_id", F.explode(_codes(rules)).alias("code")).withColumn("policy_code", F.element_at(names, F.col("code")))
