"""Texts that end before their author's text does, by a backward character n-gram model.

The model is trained on the corpus itself, over all distinct texts: for the context that ends a value, read backwards at
several lengths, it holds how often a value ends there and how often the text goes on. Three views of the text give
contexts: the characters themselves (does the word go on?), the characters with names and numbers as one symbol each, and
the same with words over three letters as one symbol each, the last word once as it is and once as a symbol (does the sentence, list or code
go on?). Longer contexts refine shorter
ones with a prior of two ends. A value is cut if its log-odds of ending fall under the threshold of its language and
column, which follows from the mean length there (the chance that a cut falls on a given place).

Contexts are 64-bit hashes; only those that some value ends with are counted, found by a bitmap of fixed size and then
joined exactly, so what is shuffled grows with the values, not with their characters.

Defined results: null texts, and texts of white space or of a cut mark only, are no case; equal texts under several ids train once and
are all reported; a mark of cutting ('...' and the like) is taken off first and decides nothing; languages are compared by their
two-letter code, null counts as one language of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.columns import let
from lemmaflow.functions.ids import SPACE
from lemmaflow.session import cut_lineage

# Marks that are put where a text was cut, and codes of languages.
MARKS = rf"(?:[{SPACE}]*(?:…|\.\.\.+|[\[(<](?:…|\.\.\.)[\])>]|[\[(<]\s*(?i:truncated|cut|continued|more|snip|read more)[^\])>]{{0,20}}[\])>]|�))+[{SPACE}]*$"
LANGUAGES = {"eng": "en", "ger": "de", "deu": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl"}

VIEWS = {"word": (2, 4, 6, 9), "masked": (3, 6, 10, 16, 24), "shape": (3, 6, 10, 16, 24), "last": (3, 6, 10, 16, 24)}
CONTEXTS = [(view, n) for view, sizes in VIEWS.items() for n in sizes]
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_BLOCK = 200_000
#: Languages (two letters each) whose means are sent to every task; more are joined.
MOST_LANGUAGES = 10_000


def masked(c: Column) -> Column:
    """Names (joined by underscores or dots) and numbers as one symbol each."""
    name = r"(?<![A-Za-z0-9_.])(?:[A-Za-z0-9.]++_(?:[A-Za-z0-9_]|\.(?=[A-Za-z0-9_]))*+|[A-Z][a-z]++\.[A-Za-z0-9_]++)"
    return F.regexp_replace(F.regexp_replace(c, name, "\x01"), r"\p{Nd}+", "0")


def shape(c: Column) -> Column:
    """A masked text with words over three letters as one symbol each."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<!\p{L})\p{Lu}\p{L}{3,}", "W"), r"(?<!\p{L})\p{L}{4,}", "w")


def language(c: Column | str) -> Column:
    """The two-letter code of a language however it is spelled; '' for null."""
    low = F.lower(F.regexp_replace(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), f"[{SPACE}]+", ""))
    first = F.regexp_extract(low, r"^\p{L}+", 0)
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.element_at(known, first), F.substring(first, 1, 2))


def distinct_texts(documents: DataFrame, column: str) -> DataFrame:
    """a, b (two hashes of the text), lang, chars and the views of each distinct text."""
    # a mark is looked for in the last 100 characters, which hold any of them
    bare = let(F.col("t"), lambda x: F.concat(F.substring(x, F.lit(1), F.greatest(F.length(x) - 100, F.lit(0))), F.regexp_replace(F.regexp_replace(F.substring(x, -100, 100), MARKS, ""), f"[{SPACE}]+$", "")))
    rows = documents.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(3), column).alias("b"), language("lang").alias("lang"), F.length(column).alias("chars"), F.col(column).alias("t"))
    rows = rows.groupBy("a", "b").agg(F.min("lang").alias("lang"), F.first("chars").alias("chars"), F.first("t").alias("t"))
    rows = rows.select("a", "b", "lang", "chars", bare.alias("word")).where("word <> ''").withColumn("masked", masked(F.col("word")))
    rows = rows.withColumn("shape", shape(F.col("masked")))
    # the last word of a value may be part of a longer one, so that it is a symbol whatever its length
    last = F.regexp_replace(F.regexp_replace("shape", r"(?<!\p{L})\p{Lu}\p{L}*$", "W"), r"(?<!\p{L})\p{Ll}\p{L}*$", "w")
    return rows.withColumn("last", last)


class Windows:
    """Hashes of all windows of texts put one after the other."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.code)
        self.end = np.cumsum(self.sizes)
        self.start = np.repeat(self.end - self.sizes, self.sizes)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _B, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INV, np.uint64)]))
            self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.code + np.uint32(1)).astype(np.uint64) * power[:n])])

    def hashes(self, at: np.ndarray, size: int, salt: int) -> np.ndarray:
        """Of the windows of `size` characters that end before the places `at`."""
        with np.errstate(over="ignore"):
            h = (self.sum[at] - self.sum[at - size]) * self.inverse[at - size]
            h = (h ^ np.uint64(salt * 0x2545F4914F6CDD1D % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(29))


def _end_contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for k, (view, size) in enumerate(CONTEXTS):
            texts = [t[-size:] if len(t) >= size else "" for t in pdf[view]]
            has = np.array([bool(t) for t in texts])
            if not has.any():
                continue
            w = Windows([t for t in texts if t])
            out.append(pd.DataFrame({"a": pdf["a"].to_numpy()[has], "b": pdf["b"].to_numpy()[has], "k": np.int32(k), "h": w.hashes(w.end, size, k + 1).view(np.int64)}))
        if out:
            yield pd.concat(out)


def _word_table() -> np.ndarray:
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x10000)])


def _counter(bits: np.ndarray):  # noqa: ANN202
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _word_table()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            nonlocal keys, counts, fresh
            both, weight = np.concatenate([keys, *(k for k, _ in fresh)]), np.concatenate([counts, *(n for _, n in fresh)])
            order = np.argsort(both, kind="stable")
            both, weight = both[order], weight[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            keys, counts, fresh = both[first], np.add.reduceat(weight, first) if len(first) else weight, []

        def block(texts: list[str], view: str) -> None:
            w = Windows(texts)
            if not len(w.code):
                return
            at = np.arange(len(w.code))  # the character at this place follows the window
            room = at - w.start
            goes_on = table[np.minimum(w.code, 0xFFFF)] if view == "word" else None
            for k, (v, size) in enumerate(CONTEXTS):
                if v != view and not (view == "shape" and v == "last"):
                    continue
                ok = room >= size
                if goes_on is not None:
                    ok &= goes_on
                h = w.hashes(at[ok], size, k + 1)
                fresh.append(np.unique(h[((bits[(h >> np.uint64(44)).astype(np.int64)] >> ((h >> np.uint64(38)) & np.uint64(63))) & np.uint64(1)) == 1], return_counts=True))
            if sum(len(k) for k, _ in fresh) > 500_000:
                merge()

        for pdf in parts:
            for view in ("word", "masked", "shape"):
                held, size = [], 0
                for t in pdf[view]:
                    held.append(t)
                    size += len(t)
                    if size > _BLOCK:
                        block(held, view)
                        held, size = [], 0
                if held:
                    block(held, view)
            if len(keys) > 1_500_000:  # what a task holds stays bounded; the rest is summed after the shuffle
                yield pd.DataFrame({"h": keys.view(np.int64), "n": counts})
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        merge()
        yield pd.DataFrame({"h": keys.view(np.int64), "n": counts})

    return run


def _refined(stats: list[tuple[Column, Column]], first: float) -> Column:
    """P(end) from the shortest to the longest context; the value's own end is left out, and a longer context with the same counts tells
    nothing new. The prior weighs two ends, but no more than 30 places where a longer context has ends of its own."""

    def step(e: Column, c: Column):  # noqa: ANN202
        return lambda p: F.when(e > 0, (e + F.least(F.lit(2.0), 30 * p)) / (e + c + F.least(2 / p, F.lit(30.0)))).otherwise(2 / (c + 2 / p))

    p: Column = F.lit(first)
    before = (F.lit(-1), F.lit(-1))
    for ends, on in stats:
        e, c = F.greatest(F.coalesce(ends, F.lit(0)) - 1, F.lit(0)), F.coalesce(on, F.lit(0))
        new = ((e != before[0]) | (c != before[1])).cast("int")
        p = let(p, step(e * new, c * new))
        before = (e, c)
    return p


def scores(documents: DataFrame, column: str = "text") -> DataFrame:
    """a, b (the text's hashes), lang, p_word and p_end: the chances that a word, and the text, ends with the value's last context."""
    texts = cut_lineage(distinct_texts(documents, column))
    own = cut_lineage(texts.select("a", "b", "word", "masked", "shape", "last").mapInPandas(_end_contexts, "a long, b long, k int, h long"))
    ends = own.groupBy("h").agg(F.count(F.lit(1)).alias("ends"))
    # a bitmap of 2 ** 26 places: at most 2 ** 20 rows come to the driver, however large the corpus is
    cells = ends.groupBy(F.shiftrightunsigned("h", 44).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 38) & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << 20, np.uint64)
    bits[cells["at"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    on = texts.select("word", "masked", "shape").mapInPandas(_counter(bits), "h long, n long").groupBy("h").agg(F.sum("n").alias("goes_on"))
    stats = cut_lineage(ends.join(on, "h", "left"))
    # contexts that many values share: at most 1000 rows can hold a thousandth of all
    least = max(1000, own.count() // 1000)
    heavy = stats.where(F.col("ends") >= least).select("h", F.col("ends").alias("he"), F.col("goes_on").alias("hg"))
    rows = own.join(F.broadcast(heavy), "h", "left")
    common = rows.where("he IS NOT NULL").select("a", "b", "k", F.col("he").alias("ends"), F.col("hg").alias("goes_on"))
    rest = rows.where("he IS NULL").select("a", "b", "k", "h").join(stats.where(F.col("ends") < least), "h", "left").select("a", "b", "k", "ends", "goes_on")
    pick = [F.max(F.when(F.col("k") == k, F.struct("ends", "goes_on"))).alias(f"s{k}") for k in range(len(CONTEXTS))]
    wide = common.unionByName(rest).groupBy("a", "b").agg(*pick)
    of = lambda view: [(F.col(f"s{k}.ends"), F.col(f"s{k}.goes_on")) for k, (v, _) in enumerate(CONTEXTS) if v == view]
    p = wide.select("a", "b", _refined(of("word"), 0.3).alias("p_word"), _refined(of("masked"), 0.01).alias("p_masked"), F.least(_refined(of("shape"), 0.01), _refined(of("last"), 0.01)).alias("p_shape"))
    p = p.select("a", "b", "p_word", F.greatest("p_masked", "p_shape").alias("p_end"))
    last = texts.select("a", "b", "lang", "chars", F.col("word").rlike(r"[\p{L}\p{Nd}_]$").alias("in_word"))
    return last.join(p, ["a", "b"], "left").select("a", "b", "lang", "chars", F.when(F.col("in_word"), F.coalesce("p_word", F.lit(0.3))).otherwise(F.lit(1.0)).alias("p_word"), F.coalesce("p_end", F.lit(0.01)).alias("p_end"))


def log_odds(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-12)) / F.greatest(1 - p, F.lit(1e-12)))


def truncated_texts(documents: DataFrame, column: str = "text", end_chance: float = 0.3) -> DataFrame:
    """a, b, lang, column_name, word_odds, end_odds, truncated of each distinct text.

    The threshold of a language and column lies midway (in log-odds) between the chance of ending at a usual end
    (`end_chance`, or 1 for a word) and that of a cut at a given place, one in the mean length.
    """
    s = cut_lineage(scores(documents, column))  # read for the mean and for the values
    mean = s.groupBy("lang").agg(F.greatest(F.avg("chars"), F.lit(100.0)).alias("mean_chars"))
    few = mean.count() <= MOST_LANGUAGES
    s = s.join(F.broadcast(mean) if few else mean, "lang")
    end_at = log_odds(F.sqrt(F.lit(end_chance) / F.col("mean_chars")))
    word_at = log_odds(F.sqrt(F.lit(1.0) / F.col("mean_chars")))
    word, end = log_odds(F.col("p_word")), log_odds(F.col("p_end"))
    sure = F.col("p_end") >= end_chance
    return s.select("a", "b", "lang", F.lit(column).alias("column_name"), word.alias("word_odds"), end.alias("end_odds"), ((end < end_at) | ((word < word_at) & ~sure)).alias("truncated"))


def truncated_documents(documents: DataFrame, column: str = "text", end_chance: float = 0.3) -> DataFrame:
    """doc_id and source of every document whose text is cut; hot groups of copies stay small rows of hashes."""
    t = truncated_texts(documents, column, end_chance).where("truncated").select("a", "b")
    docs = documents.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "source", F.xxhash64(column).alias("a"), F.xxhash64(F.lit(3), column).alias("b"))
    return docs.join(t, ["a", "b"]).select("doc_id", "source")


def found(cut: DataFrame) -> DataFrame:
    """doc_id of each cut document."""
    return cut.select("doc_id").distinct()


def truncation_report(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """source, documents, truncated, share: how often each source truncates; sources are compared trimmed and in lower case."""
    name = lambda: F.coalesce(F.lower(F.regexp_replace("source", f"^[{SPACE}]+|[{SPACE}]+$", "")), F.lit(""))
    a = documents.groupBy(name().alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    b = cut.groupBy(name().alias("source")).agg(F.count(F.lit(1)).alias("truncated"))
    j = a.join(b, "source", "left").withColumn("truncated", F.coalesce("truncated", F.lit(0)))
    return j.withColumn("share", F.round(F.col("truncated") / F.col("documents"), 6))
