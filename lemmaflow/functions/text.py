"""Text functions as column builders; nulls give empty token lists unless a function says otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lemmaflow.functions.columns import let
from lemmaflow.functions.ids import squash_space, strip_space

# Words that the token filters leave out; each filter has its own list.
GROUPING_STOP = ["a", "an", "and", "are", "as", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "to", "with"]
SUMMARY_STOP = [
    "about", "after", "again", "because", "before", "being", "between", "could", "every", "first", "from", "have", "into",
    "their", "there", "these", "those", "through", "under", "using", "where", "which", "while", "with", "without",
]
POLICY_STOP = [*SUMMARY_STOP, "parent", "claim", "jointly", "entail"]
QUALITY_STOP = [*SUMMARY_STOP, "this", "that", "therefore", "thus"]


def tokens(c: Column | str) -> Column:
    """Lower-case runs of [a-z0-9_], with repeats."""
    low = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.filter(F.split(low, "[^a-z0-9_]+"), lambda x: x != "")


def stem(t: Column) -> Column:
    """A token without its suffix: the first rule that fits by ending and length."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(t.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("ing") & (n > 6), cut(3))
        .when(t.endswith("ed") & (n > 5), cut(2))
        .when(t.endswith("es") & (n > 5) & t.rlike("(?:s|x|z|ch|sh)es$"), cut(2))
        .when(t.endswith("es") & (n > 5), cut(1))
        .when(t.endswith("s") & (n > 4), cut(1))
        .otherwise(t)
    )


def stems(c: Column | str) -> Column:
    return F.transform(tokens(c), stem)


def _without(a: Column, least: int, stop: list[str]) -> Column:
    return F.filter(a, lambda x: (F.length(x) >= least) & ~x.isin(*stop))


def grouping_tokens(c: Column | str) -> Column:
    """The set of unstemmed tokens of three letters or more."""
    return F.array_distinct(_without(tokens(c), 3, GROUPING_STOP))


def meaningful_stems(c: Column | str) -> Column:
    """The set of stems of three letters or more."""
    return F.array_distinct(_without(stems(c), 3, QUALITY_STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def lexical(t: Column) -> Column:
    return t.rlike("^[a-z]+$")


def key_component(c: Column | str) -> Column:
    """Trimmed, lower case, anything but letters, digits, '-' and '_' as '_'."""
    return F.regexp_replace(F.lower(strip_space(c)), "[^a-z0-9_-]", "_")


def display_text(c: Column | str) -> Column:
    """White space squashed and one final full stop dropped."""
    return F.regexp_replace(squash_space(c), r"\.$", "")


def humanize(c: Column | str) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "_", " ")


def statement_delta(a: Column, b: Column) -> Column:
    """struct(prefix, before, after, suffix): the longest common beginning and end of two texts, and what lies between."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    n = F.least(F.length(x), F.length(y))
    same = lambda s, t, k: F.substring(s, F.lit(1), k) == F.substring(t, F.lit(1), k)

    def common(s: Column, t: Column, most: Column) -> Column:  # by halving: the answer is monotone in k
        span = F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.struct(F.lit(0).alias("lo"), most.alias("hi")), lambda acc, _: let(F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int"), lambda m: F.when((m <= most) & same(s, t, m), F.struct(m.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), (m - 1).alias("hi")))))
        return span["lo"]

    head = common(x, y, n)
    return let(head, lambda p: let(common(F.reverse(x), F.reverse(y), n - p), lambda s: F.struct(F.substring(x, F.lit(1), p).alias("prefix"), F.substring(x, p + 1, F.length(x) - p - s).alias("before"), F.substring(y, p + 1, F.length(y) - p - s).alias("after"), F.substring(x, F.length(x) - s + 1, s).alias("suffix"))))


def fnv1a(text: str | None) -> int:
    """FNV-1a, 32 bits, over UTF-16 code units."""
    h = 0x811C9DC5
    raw = (text or "").encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return h


def fnv1a_column(c: Column | str) -> Column:
    """fnv1a of a text column without Python: a fold over its code units (of two bytes, big end first)."""
    x = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))

    def fold(hexes: Column) -> Column:
        n = (F.length(hexes) / 4).cast("int")
        unit = lambda i: F.conv(F.substring(hexes, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
        step = lambda h, i: F.pmod(h.bitwiseXOR(unit(i)) * F.lit(0x01000193), F.lit(1 << 32))
        return F.when(n == 0, F.lit(0x811C9DC5).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0x811C9DC5).cast("long"), step))

    return let(F.hex(F.encode(x, "UTF-16BE")), fold)


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
_BRACES = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.S)


def first_json_object(text: str | None) -> str | None:
    """What a reply holds as JSON: the content of its first code fence, else its first balanced object (braces in strings don't count), else the whole, trimmed; null stays null. Nothing is parsed here."""
    if text is None:
        return None
    whole = text.strip()
    fence = _FENCE.search(whole)
    if fence:
        return fence.group(1).strip()
    start, depth = whole.find("{"), 0
    for m in _BRACES.finditer(whole, start) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0 and m.group() == "}":
            return whole[start : m.end()]
    return whole


def json_object_column(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(first_json_object)

    return run(c)


def parent_summary(c: Column) -> Column:
    """The summary in a JSON text, null where it is no object: members as texts however they are written and trimmed, '' where missing; lists without blanks, empty where they are no list;
    numbers also from texts, NaN where there is none (and 0 for null and '', as numbers are made of these)."""
    v = F.try_parse_json(c)
    get = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
    said = lambda x: F.try_variant_get(x, "$", "string")
    text = lambda n: F.coalesce(strip_space(said(get(n))), F.lit(""))
    listed = lambda n: F.filter(F.transform(F.coalesce(F.try_variant_get(get(n), "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(strip_space(said(x)), F.lit("null"))), lambda x: x != "")

    def number(n: str) -> Column:
        t = strip_space(said(get(n)))
        nan = F.lit(float("nan"))
        return F.when(get(n).isNull(), nan).when(t.isNull() | (t == ""), F.lit(0.0)).when(t == "true", F.lit(1.0)).when(t == "false", F.lit(0.0)).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.cast("double")).otherwise(nan)

    members = [text("parent_statement").alias("parent_statement"), text("why_true_from_children").alias("why_true_from_children"), listed("new_terms_introduced").alias("new_terms_introduced"), listed("evidence_refs").alias("evidence_refs")]
    members += [number(n).alias(n) for n in ("complexity_score", "abstraction_score", "confidence")]
    return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.struct(*members))
