"""Canonical texts and SHA-256 fingerprints, configuration and keys."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value: object) -> str:
    """Keys in code-unit order, no spaces, whole floats written without a fraction, None members dropped."""

    def tidy(v: object) -> object:
        if isinstance(v, dict):
            return {k: tidy(x) for k, x in v.items() if x is not None}
        if isinstance(v, (list, tuple)):
            return [tidy(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return json.dumps(tidy(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, fingerprint: the same for the same rows in any order or partitioning, by sums of two row hashes."""
    cols = columns or sorted(df.columns)
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols))
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", total(1), total(2)).alias("h")).select("rows", F.sha2("h", 256).alias("fingerprint"))


def ordered_hash(lines: Column, order: Column) -> Column:
    """Aggregate: SHA-256 of a group's lines, ordered and joined by newlines."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), lines.alias("l")))), lambda x: x["l"]), "\n"), 256)


#: The order of ASCII punctuation as people's dictionaries sort it, before digits and letters.
_PUNCTUATION = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"
_WEIGHT = {c: (1, i) for i, c in enumerate(_PUNCTUATION)} | {c: (0, i) for i, c in enumerate("\t\n\x0b\f\r ")}


def locale_key(text: str) -> tuple:
    """Order of ids and keys as people read them: punctuation, digits, letters without regard to case, and of equal ones the lower-case one first."""
    return tuple(_WEIGHT.get(c) or ((2, ord(c)) if c.isdigit() else (3, ord(c.lower()) if len(c.lower()) == 1 else ord(c))) for c in text), tuple(c.isupper() for c in text)


def stable_json(value: object) -> str:
    """As canonical_json, with keys in locale order and nulls kept, as requests are hashed; what is absent is left out by the caller."""

    def tidy(v: object) -> object:
        if isinstance(v, dict):
            return {k: tidy(v[k]) for k in sorted(v, key=locale_key)}
        if isinstance(v, (list, tuple)):
            return [tidy(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return json.dumps(tidy(value), separators=(",", ":"), ensure_ascii=False)


def request_hash(**members: object) -> str:
    """SHA-256 of a request; members that are None are absent."""
    return sha256(stable_json({k: v for k, v in members.items() if v is not None}))


def group_hash(lines: DataFrame, keys: list[str], order: list[str | Column], line: str = "line") -> DataFrame:
    """keys, lines, hash: SHA-256 of each group's lines in order, joined by newlines. The lines are sorted in their partition and hashed as they pass, so a
    group is never held, however long its text is; a group is one task's work, as the hash of an ordered text is sequential by nature."""
    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", lines long, hash string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, h = None, 0, hashlib.sha256()
        for pdf in parts:
            out = []
            for *key, text in zip(*(pdf[k].tolist() for k in keys), pdf[line].tolist()):
                if key != now:
                    if now is not None:
                        out.append((*now, n, h.hexdigest()))
                    now, n, h = key, 0, hashlib.sha256()
                h.update((("\n" if n else "") + text).encode())
                n += 1
            yield pd.DataFrame(out, columns=[*keys, "lines", "hash"])
        if now is not None:
            yield pd.DataFrame([(*now, n, h.hexdigest())], columns=[*keys, "lines", "hash"])

    placed = lines.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, line)
    return placed.mapInPandas(run, schema)


def json_text(c: Column) -> Column:
    """A string as JSON writes it, escapes of control characters in lower case."""
    raw = F.to_json(F.array(c))
    body = F.substring(raw, F.lit(2), F.length(raw) - 2)
    low = body
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        low = F.replace(low, F.lit(f"\\u00{code}"), F.lit(f"\\u00{code.lower()}"))
    return F.when(c.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), low).otherwise(body)


def source_fingerprint(sources: DataFrame, groups: int = 4096) -> DataFrame:
    """fingerprint of (file_path, content): SHA-256 over the sorted list of paths and content hashes, a hash a group of neighbouring paths first, so that no file list is gathered beyond `groups` hashes."""
    rows = sources.select("file_path", F.concat_ws("\x1f", F.col("file_path"), F.sha2(F.coalesce("content", F.lit("")), 256)).alias("l"))
    part = rows.groupBy(F.pmod(F.xxhash64("file_path"), F.lit(groups)).alias("p")).agg(ordered_hash(F.col("l"), F.col("file_path")).alias("h"))
    return part.agg(ordered_hash(F.col("h"), F.col("p")).alias("fingerprint"))


# What the knobs may be, from lowest to highest, the reading level an audience needs at least, and ranges.
AUDIENCES, READING_LEVELS = ("novice", "intermediate", "expert"), ("elementary", "middle_school", "high_school", "undergraduate", "graduate")
DETAILS, ENTAILMENTS = ("minimal", "balanced", "formal"), ("calibrated", "strict")
LEAST_READING = {"novice": "elementary", "intermediate": "middle_school", "expert": "high_school"}
RANGES = {
    "abstractionLevel": (1, 5), "complexityLevel": (1, 5), "maxChildrenPerParent": (2, 12), "complexityBandWidth": (0, 3), "termIntroductionBudget": (0, 8),
    "modelProvider.timeoutMs": (1000, 120000), "modelProvider.maxRetries": (0, 8), "modelProvider.retryBaseDelayMs": (50, 5000), "modelProvider.maxOutputTokens": (128, 16384),
}
#: Changes of these only bear on limits of generation; of any other field, the tree is built anew.
PARTIAL = ["modelProvider.timeoutMs", "modelProvider.maxRetries", "modelProvider.retryBaseDelayMs", "modelProvider.maxOutputTokens", "modelProvider.apiKeyEnvVar"]
REASONS = {
    "none": "Configuration unchanged.",
    "full": "Changes impact tree structure or generated language, requiring full regeneration.",
    "partial": "Changes affect generation constraints without altering grouping semantics.",
    "unknown": "Unknown field changes are treated as full regeneration for safety.",
}


@dataclass(frozen=True)
class Provider:
    """Where summaries come from; only its settings matter here, nothing is called."""

    provider: str = "openai-compatible"
    endpoint: str = "http://localhost:8080/v1"
    model: str = "gpt-4.1-mini"
    api_key_env_var: str | None = "OPENAI_API_KEY"
    timeout_ms: int = 30_000
    max_retries: int = 2
    retry_base_delay_ms: int = 250
    temperature: float = 0
    max_output_tokens: int = 1200


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


@dataclass(frozen=True)
class Config:
    """The knobs of tree construction and its checks."""

    audience: str = "intermediate"
    reading_level: str = "high_school"
    detail: str = "balanced"
    entailment: str = "calibrated"
    complexity_level: int = 3
    complexity_band: int = 1
    max_children: int = 5
    term_budget: int = 2
    abstraction_level: int = 3
    language: str = "en"
    provider: Provider = field(default_factory=Provider)

    def normalized(self) -> Config:
        """Language and provider names trimmed, the language and the provider's name in lower case."""
        p = self.provider
        p = replace(p, provider=p.provider.strip().lower(), endpoint=p.endpoint.strip(), model=p.model.strip(), api_key_env_var=p.api_key_env_var and p.api_key_env_var.strip(), temperature=math.floor(p.temperature * 1e4 + 0.5) / 1e4)
        return replace(self, language=self.language.strip().lower(), provider=p)

    def fields(self) -> dict[str, object]:
        """The knobs by the names under which they are hashed and stored."""
        names = {"audience": "audienceLevel", "reading_level": "readingLevelTarget", "detail": "proofDetailMode", "entailment": "entailmentMode", "complexity_band": "complexityBandWidth", "max_children": "maxChildrenPerParent", "term_budget": "termIntroductionBudget"}
        mine = {names.get(k, _camel(k)): v for k, v in asdict(self).items() if k != "provider"}
        return mine | {"modelProvider": {_camel(k): v for k, v in asdict(self.provider).items()}}

    def flat(self) -> dict[str, object]:
        """The fields with nested ones by path."""
        out = self.fields()
        return {k: v for k, v in out.items() if k != "modelProvider"} | {f"modelProvider.{k}": v for k, v in out["modelProvider"].items()}

    def errors(self) -> list[str]:
        """Paths of what is out of range."""
        f = self.flat()
        bad = [k for k, (lo, hi) in RANGES.items() if not (isinstance(f[k], int) and not isinstance(f[k], bool) and lo <= f[k] <= hi)]
        known = {"audienceLevel": AUDIENCES, "readingLevelTarget": READING_LEVELS, "proofDetailMode": DETAILS, "entailmentMode": ENTAILMENTS}
        bad += [k for k, values in known.items() if f[k] not in values]
        if not re.fullmatch("[a-z]{2}(-[a-z]{2})?", self.language or ""):
            bad.append("language")
        bad += [f"modelProvider.{k}" for k in ("provider", "endpoint", "model") if not f[f"modelProvider.{k}"]]
        t = self.provider.temperature
        if not (isinstance(t, (int, float)) and 0 <= t <= 1):
            bad.append("modelProvider.temperature")
        if self.audience in AUDIENCES and self.reading_level in READING_LEVELS and READING_LEVELS.index(self.reading_level) < READING_LEVELS.index(LEAST_READING[self.audience]):
            bad.append("readingLevelTarget")
        return sorted(bad)

    def text(self) -> str:
        return canonical_json(self.fields())

    def hash(self) -> str:
        return sha256(self.text())

    def changed(self, other: Config) -> list[str]:
        """Paths of the fields that differ."""
        a, b = self.flat(), other.flat()
        return sorted(k for k in a if a[k] != b[k])

    def regeneration_plan(self, other: Config) -> dict[str, object]:
        """scope (none, partial, full), changedFields and reason of going from this configuration to the other."""
        diff = self.changed(other)
        scope = "none" if not diff else "partial" if set(diff) <= set(PARTIAL) else "full"
        return {"scope": scope, "changedFields": diff, "reason": REASONS[scope]}

    def regeneration(self, other: Config) -> str:
        return self.regeneration_plan(other)["scope"]

    # floors that follow from the knobs
    def coverage_floor(self) -> float:
        """Share of a parent's words that its children must have."""
        base = {"formal": 0.75, "balanced": 0.65, "minimal": 0.55}[self.detail] + {"novice": -0.05, "expert": 0.05}.get(self.audience, 0) + (0.05 if self.term_budget == 0 else -0.05 if self.term_budget >= 3 else 0)
        return 1.0 if self.entailment == "strict" else min(0.95, max(0.45, base))

    def continuity_floor(self) -> float:
        base = {"novice": 0.72, "intermediate": 0.62, "expert": 0.52}[self.audience] + {"minimal": -0.04, "formal": 0.04}.get(self.detail, 0)
        return 1.0 if self.entailment == "strict" else min(0.86, max(0.4, base))

    def support_floor(self) -> float:
        base = 0.5 + {"novice": -0.05, "expert": 0.05}.get(self.audience, 0) + {"minimal": -0.05, "formal": 0.1}.get(self.detail, 0)
        return 1.0 if self.entailment == "strict" else min(0.75, max(0.35, base))

    def continuity_threshold(self) -> float:
        """The least mean continuity; strict entailment has no effect."""
        return min(0.8, max(0.4, {"minimal": 0.5, "balanced": 0.6, "formal": 0.7}[self.detail] + {"novice": -0.05, "expert": 0.05}.get(self.audience, 0)))


def tree_key(leaf_hash: str, config: Config) -> str:
    return ":".join([leaf_hash, config.hash(), config.language, config.audience])


@dataclass
class Profiles:
    """Named configurations by key; upserts tell what has to be built again."""

    rows: dict[str, tuple[str, Config]] = field(default_factory=dict)

    def key(self, project: str, user: str, profile: str) -> str:
        parts = [re.sub("[^a-z0-9_-]", "_", p.strip().lower()) for p in (project, user, profile)]
        if not all(parts):
            raise ValueError("blank key component")
        return "project:{}:user:{}:profile:{}".format(*parts)

    def upsert(self, project: str, user: str, profile: str, name: str, config: Config) -> str:
        """The regeneration that the change asks for; 'full' for a new profile."""
        if config.errors():
            raise ValueError(f"out of range: {config.errors()}")
        k = self.key(project, user, profile)
        before = self.rows.get(k)
        self.rows[k] = (name, replace(config))
        return before[1].regeneration(config) if before else "full"

    def delete(self, project: str, user: str, profile: str) -> bool:
        return self.rows.pop(self.key(project, user, profile), None) is not None

    def fingerprint(self) -> str:
        return sha256("\n".join(f"{k}|{n}|{c.hash()}" for k, (n, c) in sorted(self.rows.items())))
