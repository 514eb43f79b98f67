"""Mixing sources to target weights, by pivotal dependent rounding.

Every record of a source gets the same wanted number of copies, target size over the source's size. Its whole part is
given at once; the fractions are rounded by the pivotal method: two records at a time trade mass, in tokens, at random
and without bias until one of them is integral. Tasks round the records of a salted part of a source; the one fractional
record that each part leaves goes up a reduction tree whose levels join parts until one record a source is left, and
that one is rounded by chance. So a source's tokens miss its target by less than one record, and nothing is gathered.

A source that can't reach its target (few records, capped repeats) gives all it may; the rest of the mix grows in
proportion, so that the total is kept as far as the caps allow.

Defined results: sources match trimmed and in lower case; rows of a null source, mix or share, and shares that aren't
positive, take no part; repeated targets of a source add up, with the smallest cap; a null cap is none; null texts have no
tokens and are never chosen; a source without records has share 0; empty tables give empty results.
"""

from __future__ import annotations

import os
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.ids import SPACE
from lemmaflow.session import cut_lineage

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual split of byte-level BPE into pre-tokens (a fixed value of that vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of targets that one plan holds; a longer list is refused.
MOST_TARGETS = 100_000
ROWS = "mix_id string, source string, part int, doc_id long, tokens long, copies int, fraction double"


def _name(c: str):  # noqa: ANN202
    return F.nullif(F.lower(F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")), F.lit(""))


def token_counts(documents: DataFrame, tokenizer_path: str = DEFAULT_TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, tokens (of a tiktoken rank file); the file, of fixed size, travels with the tasks."""
    with open(tokenizer_path, "rb") as f:
        ranks = f.read()
    if len(ranks) > 16_000_000:
        raise ValueError("a vocabulary of over 16 MB")
    name = os.path.basename(tokenizer_path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        enc = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=known, special_tokens={})
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(enc.encode_ordinary(t)) for t in pdf["text"]]})

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", _name("source").alias("source"), "text").where("source IS NOT NULL")
    return rows.mapInPandas(run, "doc_id long, source string, tokens long").where("tokens > 0")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int) -> list[dict]:
    """mix_id, source, target_share, tokens and rate (copies a record) of each target. Runs on the targets, which are few, and one row a listed source."""
    t = targets.select(F.col("mix_id"), _name("source").alias("source"), "target_share", "max_repeats", "budget_ratio").where("mix_id IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND budget_ratio IS NOT NULL")
    t = t.groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap"), F.max("budget_ratio").alias("ratio"))
    rows = [r.asDict() for r in t.join(sizes, "source", "left").select("mix_id", "source", "share", "cap", "ratio", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()]
    out = []
    for mix in sorted({r["mix_id"] for r in rows}):
        mine = [r for r in rows if r["mix_id"] == mix]
        budget, weight = max(r["ratio"] for r in mine) * total_tokens, sum(r["share"] for r in mine)
        free, left = [r for r in mine if r["tokens"]], budget
        for r in mine:
            r["given"], r["target_share"] = 0.0, r["share"] / weight
        while free:  # sources over their cap give it all; the others share what is left
            scale = left / sum(r["share"] for r in free)
            over = [r for r in free if r["cap"] is not None and r["share"] * scale > r["tokens"] * r["cap"]]
            for r in over or free:
                r["given"] = float(r["tokens"] * r["cap"]) if over else r["share"] * scale
            left -= sum(r["given"] for r in over)
            free = [r for r in free if r not in over] if over else []
        for r in mine:
            out.append({"mix_id": mix, "source": r["source"], "target_share": r["target_share"], "tokens": r["tokens"], "rate": r["given"] / r["tokens"] if r["tokens"] else 0.0})
    return out


def round_part(rows: list[list], seed: str) -> list[list]:
    """Pivotal rounding of [doc_id, tokens, copies, fraction] rows, smallest first; at most one stays fractional."""
    rng = random.Random(seed)
    held = None
    for r in sorted(rows, key=lambda x: (x[1], x[0])):
        if not 1e-9 < r[3] < 1 - 1e-9:
            r[2], r[3] = r[2] + round(r[3]), 0.0
            continue
        if held is None:
            held = r
            continue
        a, b = held, r
        up = min((1 - a[3]) * a[1], b[3] * b[1])  # tokens from b to a
        down = min(a[3] * a[1], (1 - b[3]) * b[1])  # tokens from a to b
        move = up if rng.random() < down / (up + down) else -down
        a[3], b[3] = a[3] + move / a[1], b[3] - move / b[1]
        held = None
        for x in (a, b):
            if 1e-9 < x[3] < 1 - 1e-9:
                held = x
            else:
                x[2], x[3] = x[2] + round(x[3]), 0.0
    return rows


def _rounder(seed: int, level: int):  # noqa: ANN202
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mix, source, part = key
        rows = round_part([list(x) for x in zip(pdf["doc_id"].tolist(), pdf["tokens"].tolist(), pdf["copies"].tolist(), pdf["fraction"].tolist())], f"{seed}|{level}|{mix}|{source}|{part}")
        out = pd.DataFrame(rows, columns=["doc_id", "tokens", "copies", "fraction"])
        out.insert(0, "part", part)
        out.insert(0, "source", source)
        out.insert(0, "mix_id", mix)
        return out

    return run


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 0, part_rows: int = 20_000, fanout: int = 64, tokenizer_path: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection: mix_id, source, doc_id, tokens, copies; wanted: mix_id, source, target_share, tokens, rate)."""
    spark = documents.sparkSession
    if targets.count() > MOST_TARGETS:  # before anything is collected
        raise ValueError(f"over {MOST_TARGETS} targets: plan them in parts")
    counts = cut_lineage(token_counts(documents, tokenizer_path))
    sizes = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))
    # the corpus is every document, whether or not its source is listed
    nameless = token_counts(documents.where(_name("source").isNull()).withColumn("source", F.lit("-")), tokenizer_path)
    total = counts.unionByName(nameless).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted = plan(sizes, targets, int(total))
    schema = "mix_id string, source string, target_share double, tokens long, rate double"
    want = spark.createDataFrame([(w["mix_id"], w["source"], w["target_share"], w["tokens"], w["rate"]) for w in wanted], schema)
    most = sizes.agg(F.max("records")).first()[0] or 1
    parts = 1
    while parts * part_rows < most:
        parts *= fanout if parts * fanout * part_rows <= most * fanout else 2
    rows = counts.join(F.broadcast(want.where("rate > 0").select("mix_id", "source", "rate")), "source")
    rows = rows.select("mix_id", "source", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "tokens", F.floor(F.col("rate") + 1e-12).cast("int").alias("copies"), F.greatest(F.col("rate") - F.floor(F.col("rate") + 1e-12), F.lit(0.0)).alias("fraction"))
    done, level = None, 0
    while True:
        rows = cut_lineage(rows.groupBy("mix_id", "source", "part").applyInPandas(_rounder(seed, level), ROWS))
        settled = rows.where("fraction = 0")
        done = settled if done is None else done.unionByName(settled)
        left = rows.where("fraction > 0")
        if parts == 1:
            break
        parts, level = max(1, parts // fanout), level + 1
        rows = left.withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "source", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = left.withColumn("copies", F.col("copies") + (chance < F.col("fraction")).cast("int"))
    out = done.unionByName(last).where("copies > 0").select("mix_id", "source", "doc_id", "tokens", "copies")
    return out, want


def shares(selection: DataFrame, wanted: DataFrame) -> DataFrame:
    """mix_id, source, target_share, records, copies, tokens, actual_share, max_used of each target."""
    got = selection.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("max_used"))
    j = wanted.select("mix_id", "source", "target_share").join(got, ["mix_id", "source"], "left")
    j = j.select("mix_id", "source", F.round("target_share", 6).alias("target_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "copies", "tokens", "max_used")))
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return j.withColumn("actual_share", F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6))
