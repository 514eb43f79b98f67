"""Evaluation passages inside a training corpus, by an FM-index a shard of documents.

Each task normalizes its documents to word pieces, builds FM-indexes over shards of a fixed number of pieces (suffix
array, Burrows-Wheeler transform, wavelet matrix with ranks, sampled suffix positions) and searches all passages'
`seed_words`-word phrases backwards. All occurrences are located; for each document and item the seeds are then
followed over the passage, exactly and past single replaced or dropped words, and the spans to remove are merged.
The corpus is never shuffled. The evaluation items are a stated query set of bounded size: they are sent to every task
in blocks, and a set larger than `max_item_chars` is refused rather than cut.

Defined results: a null text or passage matches nothing; an empty passage, or one shorter than 12 words, matches
nothing; equal texts under several ids are each reported; repeated items are each reported; an empty corpus or item
set gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "doc_id long, item_id long, first_char int, last_char int, run_words int, span_words int, matched_words int"

_HIDDEN = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
_BLOCK = re.compile(r"</?(?:br|p|div|td|tr|th|table|ul|ol|li|h[1-6]|hr|pre|blockquote)\b[^<>]*>", re.I)
_INLINE = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_MARKER = re.compile(r"(?m)^([ \t]*(?:[-*+>|#]+[ \t]*)*)\[[ xX]\](?=\s)")
_PIECE = re.compile(r"[^\W_]+")


def normalize(text: str) -> str:
    """Lower-case text without markup, hidden characters and entities; its pieces are what matters."""
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    return _MARKER.sub(r"\1", unicodedata.normalize("NFKC", text).translate(_HIDDEN)).lower()


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes, by prefix doubling over the ties that are left; sym's zeros are all different, ordered by place."""
    n = len(sym)
    start = np.where(sym == 0, 0, sym.astype(np.int64) + n)
    zeros = np.flatnonzero(sym == 0)
    start[zeros] = np.arange(len(zeros))
    sa = np.argsort(start, kind="stable")
    key = start[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(np.append(first, n)))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    h = 1
    tied = np.flatnonzero(np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n))))
    while len(tied):
        at = sa[tied]
        ahead = at + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        g = rank[at]
        order = np.lexsort((second, g))
        at, g, second = at[order], g[order], second[order]
        sa[tied] = at
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (second[1:] != second[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat(tied[starts], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


class FMIndex:
    """Backward search over symbols 1.. of a text whose zeros separate documents."""

    def __init__(self, sym: np.ndarray, sample: int = 8, largest: int = 1) -> None:
        n = len(sym)
        sa = suffix_array(sym)
        bwt = sym[sa - 1]
        self.n, self.bits = n, max(largest, int(sym.max())).bit_length()
        counts = np.bincount(sym, minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.ones, self.zeros, now = [], [], bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (now >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.base = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))
        # sampled: every `sample`-th place, and every document's first, so that no walk crosses a separator
        keep = (np.arange(n) % sample == 0) | np.concatenate([[True], sym[:-1] == 0])
        self.sampled = np.where(keep[sa], sa, -1).astype(np.int32)

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level][at]
            at = np.where((c >> b) & 1, self.zeros[level] + ones, at - ones)
        return at

    def step(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first row of c's suffixes plus the rank of c before row `at`."""
        return self.first[c] + self._down(c, at) - self.base[c]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases, rows of an array that hold each phrase from its last symbol backwards."""
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        for k in range(phrases.shape[1] if len(sizes) else 0):
            on = np.flatnonzero((sizes > k) & (lo < hi))
            c = phrases[on, k]
            lo[on], hi[on] = self.step(c, lo[on]), self.step(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walks to the next sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            found = self.sampled[at]
            done = found >= 0
            out[left[done]] = found[done] + steps
            left, at = left[~done], at[~done]
            c, place = np.zeros(len(at), np.int64), at
            for level in range(self.bits):
                ones = self.ones[level][place]
                bit = self.ones[level][place + 1] - ones
                c = (c << 1) | bit
                place = np.where(bit == 1, self.zeros[level] + ones, place - ones)
            at = self.first[c] + place - self.base[c]
            steps += 1
        return out


class Passages:
    """The items' pieces, their words, the pieces' numbers and all seeds."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int], list[int]]] = []  # id, pieces, first piece of each word (and the end)
        seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        self.seed_words = seed_words
        for item_id, passage in items:
            pieces, starts = [], []
            for word in normalize(passage).split():
                found = _PIECE.findall(word)
                if found:
                    starts.append(len(pieces))
                    pieces.extend(self.vocabulary.setdefault(p, len(self.vocabulary) + 2) for p in found)
            k = len(self.items)
            starts.append(len(pieces))
            self.items.append((item_id, pieces, starts))
            for w in range(len(starts) - seed_words):
                seeds[tuple(pieces[starts[w] : starts[w + seed_words]])].append((k, w))
        self.seeds = list(seeds)
        self.sizes = np.array([len(s) for s in self.seeds], np.int64)
        self.phrases = np.zeros((len(self.seeds), int(self.sizes.max()) if len(self.seeds) else 0), np.int64)
        for i, s in enumerate(self.seeds):
            self.phrases[i, : len(s)] = s[::-1]
        uses = [u for s in self.seeds for u in seeds[s]]
        self.use_at = np.concatenate([[0], np.cumsum([len(seeds[s]) for s in self.seeds])]).astype(np.int64)
        self.use_item = np.array([u[0] for u in uses], np.int64)
        self.use_word = np.array([u[1] for u in uses], np.int64)


def _runs(lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... of each interval in turn."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)


def follow(pieces: list[int], starts: list[int], doc: list[int], word: int, at: int, seed_words: int, max_piece_gap: int = 8) -> tuple[int, int, int, int, int, int]:
    """The alignment through one seed: longest exact run, first and last word (exclusive), matched words, first and last piece of the document (exclusive)."""
    n_words, n = len(starts) - 1, len(doc)

    def equal(w: int, j: int) -> int:
        """Pieces of word w if the document has them at j, else 0."""
        a, b = starts[w], starts[w + 1]
        if j < 0 or j + b - a > n or doc[j] != pieces[a]:
            return 0
        return b - a if b - a == 1 or doc[j : j + b - a] == pieces[a:b] else 0

    def ahead(w: int, j: int) -> bool:
        """Two words in a row from here on, or one, a single altered one, and two more."""
        if w >= n_words or not (size := equal(w, j)):
            return False
        if w + 1 >= n_words or equal(w + 1, j + size):
            return True
        return any(w + 3 < n_words and (more := equal(w + 2, j + size + g)) and equal(w + 3, j + size + g + more) for g in range(max_piece_gap + 1))

    def behind(w: int, j: int) -> bool:
        """The same backwards, with word w - 1 ending at j."""
        if w <= 0 or not (size := equal(w - 1, j - (starts[w] - starts[w - 1]))):
            return False
        if w == 1:
            return True
        back = lambda x, k: equal(x - 1, k - (starts[x] - starts[x - 1]))
        if back(w - 1, j - size):
            return True
        return any(w - 4 >= 0 and (more := back(w - 2, j - size - g)) and back(w - 3, j - size - g - more) for g in range(max_piece_gap + 1))

    w, j, run, best, matched = word, at, 0, 0, 0
    edges = []
    while w < n_words:
        size = equal(w, j)
        if size:
            w, j, run, matched = w + 1, j + size, run + 1, matched + 1
            continue
        edges.append(run)
        hop = next(((s, g) for s in (1, 2) for g in range(max_piece_gap * s + 1) if w + s < n_words and ahead(w + s, j + g)), None)
        if hop is None:
            break
        w, j, run = w + hop[0], j + hop[1], 0
    else:
        edges.append(run)
    last_w, last_j = w, j
    first_run = edges[0]
    best = max(edges)
    w, j, run = word, at, first_run
    while w > 0:
        size = starts[w] - starts[w - 1]
        if equal(w - 1, j - size):
            w, j, run, matched = w - 1, j - size, run + 1, matched + 1
            best = max(best, run)
            continue
        hop = next(((s, g) for s in (1, 2) for g in range(max_piece_gap * s + 1) if w - s > 0 and behind(w - s, j - g)), None)
        if hop is None:
            break
        w, j, run = w - hop[0], j - hop[1], 0
    return best, w, last_w, matched, j, last_j


def search_shard(docs: list[tuple[int, str]], passages: Passages, exact_words: int, altered_words: int, least_share: float) -> list[tuple]:
    """Rows of SPANS for one shard."""
    if not passages.seeds:
        return []
    vocabulary = passages.vocabulary
    parts, bounds = [], [0]
    for _, text in docs:
        parts.append(np.array([vocabulary.get(p, 1) for p in _PIECE.findall(text)] + [0], np.int32))
        bounds.append(bounds[-1] + len(parts[-1]))
    sym = np.concatenate(parts)
    index = FMIndex(sym, largest=len(vocabulary) + 1)
    lo, hi = index.search(passages.phrases, passages.sizes)
    n = hi - lo
    at = index.locate(_runs(lo, n))
    seed = np.repeat(np.arange(len(n)), n)
    uses = np.diff(passages.use_at)[seed]
    use = _runs(passages.use_at[seed], uses)
    at, item, word = np.repeat(at, uses), passages.use_item[use], passages.use_word[use]
    if not len(at):
        return []
    doc = np.searchsorted(np.array(bounds), at, side="right") - 1
    order = np.lexsort((at, word, item, doc))
    doc, item, word, at = doc[order], item[order], word[order], at[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    first = np.flatnonzero(new)
    # words of the passage that the pair's seeds cover: a pair of fewer than 2 seeds' worth can't be a case
    reach = np.full(len(word), passages.seed_words, np.int64)
    reach[:-1] = np.where(new[1:], passages.seed_words, np.minimum(word[1:] - word[:-1], passages.seed_words))
    covered = np.add.reduceat(reach, first)
    rows, last, text = [], -1, []
    for a, b in [(int(first[k]), int(first[k + 1]) if k + 1 < len(first) else len(doc)) for k in np.flatnonzero(covered >= 2 * passages.seed_words)]:
        d, (item_id, pieces, starts) = int(doc[a]), passages.items[item[a]]
        begin = bounds[d]
        if d != last:
            last, text = d, parts[d][:-1].tolist()
        seen: list[tuple[int, int, int, int]] = []
        spans = []
        for w, j in sorted(zip(word[a:b].tolist(), (at[a:b] - begin).tolist()), key=lambda x: (x[1], x[0])):
            if any(w0 <= w < w1 and j0 <= j < j1 for w0, w1, j0, j1 in seen):
                continue
            best, w0, w1, matched, j0, j1 = follow(pieces, starts, text, w, j, passages.seed_words)
            seen.append((w0, w1, j0, j1))
            if best >= exact_words or (w1 - w0 >= altered_words and matched >= least_share * (w1 - w0)):
                spans.append([j0, j1, best, w1 - w0, matched])
        merged: list[list[int]] = []
        for s in sorted(spans):
            if merged and s[0] <= merged[-1][1]:
                m = merged[-1]
                m[1], m[2], m[3], m[4] = max(m[1], s[1]), max(m[2], s[2]), max(m[3], s[3]), max(m[4], s[4])
            else:
                merged.append(s)
        places = [(m.start(), m.end()) for m in _PIECE.finditer(docs[d][1])] if merged else []  # only of documents with a span
        for j0, j1, best, span, matched in merged:
            rows.append((docs[d][0], item_id, places[j0][0], places[j1 - 1][1], best, span, matched))
    return rows


def leaked_spans(
    documents: DataFrame, items: DataFrame, exact_words: int = 12, altered_words: int = 30, least_share: float = 0.8, seed_words: int = 5, shard_pieces: int = 1_000_000, max_item_chars: int = 20_000_000
) -> DataFrame:
    """Merged spans (in characters of the normalized text) of each document and item.

    exact_words: words in a row that make a case. altered_words, least_share: words that an altered copy spans at
    least, and the share of them that is unaltered. seed_words: words of a seed; a case has two seeds at least.
    """
    size = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    if size > max_item_chars:
        raise ValueError(f"the query set has {size} characters, over max_item_chars={max_item_chars}: search it in parts")
    held = [(int(r[0]), r[1]) for r in items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage").orderBy("item_id").collect()]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages = Passages(held, seed_words)
        columns = ["doc_id", "item_id", "first_char", "last_char", "run_words", "span_words", "matched_words"]
        shard: list[tuple[int, str]] = []
        room = shard_pieces * 5  # characters: a piece and its gap take about five or more
        for pdf in parts:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                shard.append((int(doc_id), normalize(text)))
                room -= len(shard[-1][1]) + 5
                if room < 0:
                    yield pd.DataFrame(search_shard(shard, passages, exact_words, altered_words, least_share), columns=columns)
                    shard, room = [], shard_pieces * 5
        if shard:
            yield pd.DataFrame(search_shard(shard, passages, exact_words, altered_words, least_share), columns=columns)

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(run, SPANS)


def found(spans: DataFrame) -> DataFrame:
    """doc_id, item_id of each leak."""
    return spans.select("doc_id", "item_id").distinct()


def leak_report(spans: DataFrame) -> DataFrame:
    """A row per item that leaked: documents and longest run."""
    return spans.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("run_words").alias("longest_run"))
