"""Semi-structured log lines to entries with time, level, component and message.

A fixed-depth template tree reads the layouts off the data. Lines are masked (digits and names lose their value), equal ones are
counted once, and each distinct line goes down the tree: by its token count, then by its leading tokens, where only constants
are keys and whatever carries a time, level, position or number takes the wildcard branch. At a leaf it joins the most similar template or founds
one. A template knows how many of its lines have which head, and the head that most of them have is the
template's: it says whether the template's lines begin an entry and at which tokens component and message stand. So a line whose own
time is damaged follows its template, and a bare word of level is a level only where its template shows several levels at that place.

Routes are split by a salt of the text into pieces of bounded size; the pieces' templates are merged by route afterwards.

Defined results: lines are ordered by line_index within job and stream, equal indices by message; null messages are
blank lines; lines whose index or stream is null, and null elements, are left out; every line of stream `system` is an
entry; lines before a stream's first entry belong to none; repeated rows of a job count once; a null or blank job_id makes no
case; of heads that equally many lines of a template have, the smallest counts; other columns of the table are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.columns import let
from lemmaflow.functions.ids import clean_id, strip_space
from lemmaflow.session import cut_lineage

FOUND = ["job_id", "first_index", "last_index"]

# What counts as a time, a level and a source position at the head of a line.
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_DAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
_LEVELS = "trace|debug|verbose|info|information|notice|warn|warning|error|err|fatal|critical|crit|severe|alert|emerg|panic"
TIME = (
    r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
    r"|\d{1,2}[-/.]\d{1,2}[-/.]\d{4},? \d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
    rf"|(?:(?:{_DAYS}),? )?(?:{_MONTHS}) {{1,2}}\d{{1,2}}(?:,? \d{{4}})? \d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?"
    rf"|\d{{1,2}}[-/ ](?:{_MONTHS})[-/ ]\d{{4}}[ :]\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?"
    r"|\d{8}T\d{6}(?:[.,]\d+)?Z?"
    r"|(?<![\d.])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\d:])"
    r"|(?<![\w.:/])[01]\d{9}(?:\d{3}){0,2}(?:\.\d+)?(?=[\s|,;\]:]|$))"
)
GLOG = r"^([TDIWEFC])(\d{4} \d{2}:\d{2}:\d{2}(?:\.\d+)?)(?= )"
POSITION = r"^[\w./\\@+-]*[\w@+-]\.\w+:\d+(?::\d+)?(?=:|\s|$)|^[\w./\\@+-]*[\w@+-]\.\w+\(\d+(?:,\d+)?\)(?=:|\s|$)"
#: A level is a word in capitals, or one in any case that stands in brackets, between bars, before a colon or after `level=`.
LEVEL = (
    rf"(?<![\w.])(?:{_LEVELS.upper()})(?![\w.])"
    rf"|(?<=[\[(<|])(?i:{_LEVELS})(?=[\])>|])"
    rf"|(?<=\b(?:level|lvl|severity)[=:]\"?)(?i:{_LEVELS})\b"
    rf"|(?<=^|‹T› |‹P›:? |‹T›\] |\] )(?i:{_LEVELS})(?=:|\s\(|\s\[)"
    r"|(?<=\|)[TDIWEFC](?=\|)"
)
_ANSI = "\x1b" + r"\[[0-9;?]*[ -/]*[@-~]|" + "\x1b" + r"\][^\x07]*\x07"
_NAME = r"[A-Za-z]+(?:[._'][A-Za-z0-9]+)+'?|(?<!\w)[A-Za-z_]{2,}0[\w.]*"
#: Leading tokens that a route is made of, besides the token count.
LEAD_TOKENS = 2
#: Distinct lines of a route that one piece of work holds, about.
PIECE = 20_000
#: Line indices that one block of a stream spans.
BLOCK = 65_536


def clean_line(c: Column) -> Column:
    """Without terminal colours and line-end characters; null is blank."""
    text = F.coalesce(c, F.lit(""))
    bare = F.when(F.instr(text, "\x1b") > 0, F.regexp_replace(text, _ANSI, "")).otherwise(text)
    return F.rtrim(bare, F.lit("\r\n"))


def masked(line: Column) -> Column:
    """The line with every digit as 0, the position at its head as one slot, and names (dotted, underscored or numbered) as one symbol."""
    zeros = F.translate(line, "123456789", "000000000")
    return F.regexp_replace(F.regexp_replace(zeros, POSITION, "‹P›"), _NAME, "‹N›")


def lines_of(jobs: DataFrame) -> DataFrame:
    """job_id, stream_name, line_index, message, line (cleaned), text (masked) and h (its hash) of each log line; text is null where a line can't begin an entry by its head."""
    rows = jobs.select(clean_id("job_id").alias("job_id"), F.explode("logs").alias("l")).where("job_id IS NOT NULL AND l IS NOT NULL")
    rows = rows.select("job_id", F.lower(strip_space("l.stream_name")).alias("stream_name"), "l.line_index", "l.message").where("stream_name IS NOT NULL AND line_index IS NOT NULL")
    rows = rows.withColumn("line", clean_line(F.col("message")))
    head = (F.col("stream_name") != "system") & ~F.substring("line", 1, 1).rlike(r"^\s|^$")
    rows = rows.withColumn("text", F.when(head, masked(F.col("line"))))
    return rows.withColumn("h", F.when(head, F.xxhash64("text")).otherwise(F.xxhash64("job_id", "line_index")))


class Patterns:
    """What a masked line's head says. The patterns need lookbehinds of any length."""

    def __init__(self) -> None:
        import regex

        self.time, self.glog, self.level = regex.compile(TIME), regex.compile(GLOG), regex.compile(LEVEL)
        self.lead = regex.compile(r"^(?:[\[(<|\"]|\w+[=:])*‹[TLP]›")
        self.mark = regex.compile(r"^[\[(<].*[\])>]:?$|^[\w.‹›\[\]-]+:$")
        self.slot = regex.compile(r"^[\[(<|\"]*‹[TLP]›[\])>|:\"]*")
        self.pure = regex.compile(r"^[-–|\[(<\"]*(?:‹[TLP]›[|\])>:,;\"]*)+$|^[-–|]$")
        self.pairs, self.bars = regex.compile(r"^\w+=\S*‹"), regex.compile(r"\|.*\|")
        self.marked = regex.compile(r"[\]):]$|^\(.*\)$|^\[.*\]$")
        self.bare = regex.compile(rf"^(?i:{_LEVELS})$")
        self.variable = regex.compile(r"[‹\d]")

    def slots(self, text: str) -> list[str]:
        """The tokens with time, levels and position as slots; a time of several words is one token."""
        half = self.glog.sub(r"|\1|‹T›", text) if self.glog.search(text) else self.time.sub("‹T›", text, count=1)
        return self.level.sub("‹L›", half).split(" ")

    def head(self, text: str, tokens: list[str]) -> tuple[str, int, int]:
        """layout ('' if no entry begins here, 'level' if it does where the word is a level), token of the component and of the message (one-based, in the line's own tokens; 0: none)."""
        first, second = tokens[0], tokens[1] if len(tokens) > 1 else ""
        begins = bool(self.lead.search(first)) or bool(self.mark.search(first) and self.slot.search(second))
        kind = "record" if first.startswith("{") else "pairs" if self.pairs.search(first) else "bars" if self.bars.search(first) else "tokens" if begins else "level" if self.bare.search(first) else ""
        if kind in ("", "record", "pairs", "bars"):
            return kind, 0, 0
        n = 1 if kind == "level" else next((i for i, t in enumerate(tokens) if not self.pure.search(t)), len(tokens))
        after, dash = tokens[n] if n < len(tokens) else "", tokens[n + 1] if n + 1 < len(tokens) else ""
        dashed = dash in ("-", "–", "|")
        named = dashed or bool(self.marked.search(after))
        skip = 2 if dashed else 1 if named else 0
        more = text.count(" ") + 1 - len(tokens)  # words within the time
        return kind, (n + 1 + more if named else 0), n + skip + 1 + more

    def route(self, tokens: list[str]) -> list[str]:
        """The keys of the tree's inner nodes: constants, or the wildcard."""
        return ["<*>" if self.variable.search(t) or self.bare.search(t) else t for t in tokens[:LEAD_TOKENS]]


def similarity(a: list[str], b: list[str]) -> float:
    """Share of equal tokens of two templates of one length; wildcards count as equal."""
    return sum(x == y or x == "<*>" or y == "<*>" for x, y in zip(a, b)) / max(len(a), 1) if len(a) == len(b) else 0.0


class Template:
    """Tokens, the number of lines a head, and the bare levels seen at the first token."""

    def __init__(self, tokens: list[str]) -> None:
        self.tokens, self.heads, self.levels = list(tokens), Counter(), set()

    def learn(self, tokens: list[str], heads: Counter, levels: set[str]) -> None:
        self.tokens = [x if x == y else "<*>" for x, y in zip(self.tokens, tokens)]
        self.heads.update(heads)
        self.levels |= levels

    def decision(self) -> tuple[str, int, int]:
        """The head of most lines; bare words of level are levels where there are several of them and nothing else."""
        most = max(self.heads.values())
        head = min(h for h, n in self.heads.items() if n == most)
        if head[0] == "level":
            return ("tokens", *head[1:]) if len(self.levels) > 1 and all(h[0] == "level" for h in self.heads) else ("", 0, 0)
        return head


class TemplateTree:
    """Templates by route; a line joins the most similar one of its route from `least` on (the oldest of equals), else it founds one.

    A leaf is indexed by (place, token): a template that is alike enough agrees, or has a wildcard, at one of the line's rarest places at least."""

    def __init__(self, least: float = 0.6) -> None:
        self.least, self.leaves, self.index = least, {}, {}

    def _alike(self, route: str, tokens: list[str]) -> list[int]:
        index = self.index.get(route, {})
        lists = sorted(((index.get((i, t), ()), index.get((i, "<*>"), ())) for i, t in enumerate(tokens)), key=lambda p: len(p[0]) + len(p[1]))
        spare = len(tokens) - math.ceil(self.least * len(tokens) - 1e-9) + 1
        return sorted({k for a, b in lists[: max(spare, 1)] for k in (*a, *b)})

    def add(self, route: str, tokens: list[str], heads: Counter | None = None, levels: frozenset[str] = frozenset()) -> int:
        """The place of the line's template in its leaf."""
        leaf, index = self.leaves.setdefault(route, []), self.index.setdefault(route, {})
        scored = [(similarity(leaf[k].tokens, tokens), -k) for k in self._alike(route, tokens)]
        best, k = max(scored, default=(0.0, 0))
        if not scored or best < self.least:
            k = -len(leaf)
            leaf.append(Template(tokens))
            for place in enumerate(tokens):
                index.setdefault(place, []).append(-k)
        k, t = -k, leaf[-k]
        before = t.tokens
        t.learn(tokens, heads or Counter(), set(levels))
        for i, (x, y) in enumerate(zip(before, t.tokens)):
            if x != y:
                index[(i, x)].remove(k)
                index.setdefault((i, "<*>"), []).append(k)
        return k


def _routed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Route, tokens and head of each distinct masked line."""
    p = Patterns()
    for pdf in parts:
        out = []
        for h, text, n in zip(pdf["h"], pdf["text"], pdf["n"]):
            tokens = p.slots(text)
            layout, comp, msg = p.head(text, tokens)
            out.append((h, n, "\x1f".join([str(text.count(" ")), *p.route(tokens)]), "\x1f".join(tokens), layout, comp, msg, tokens[0].lower() if layout == "level" else ""))
        yield pd.DataFrame(out, columns=["h", "n", "route", "tokens", "layout", "comp_at", "msg_at", "bare"])


def _by_route(work):  # noqa: ANN001, ANN202
    """mapInPandas over rows sorted by their first column `piece`: work(rows of a piece) gives tuples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out, columns = [], [], None
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                if held and held[0].piece != r.piece:
                    columns = work(held, out)
                    held = []
                    if len(out) > 20_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                held.append(r)
        if held:
            columns = work(held, out)
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _grow(least: float):  # noqa: ANN202
    def work(rows: list, out: list) -> list[str]:
        tree = TemplateTree(least)
        went = [tree.add("", r.tokens.split("\x1f"), Counter({(r.layout, r.comp_at, r.msg_at): r.n}), frozenset([r.bare] if r.bare else [])) for r in rows]
        out += [(r.route, f"{r.piece}#{k}", r.h, "\x1f".join(tree.leaves[""][k].tokens), r.n, r.layout, r.comp_at, r.msg_at, r.bare) for r, k in zip(rows, went)]
        return ["route", "template_id", "h", "template", "n", "layout", "comp_at", "msg_at", "bare"]

    return work


def _decide(least: float):  # noqa: ANN202
    def work(rows: list, out: list) -> list[str]:
        tree, held = TemplateTree(least), {}
        for r in rows:  # rows of one template follow each other
            held.setdefault((r.template_id, r.template), []).append(r)
        went = {}
        for (tid, text), mine in held.items():
            heads = Counter()
            for r in mine:
                heads[(r.layout, r.comp_at, r.msg_at)] += r.n
            went[tid] = tree.add("", text.split("\x1f"), heads, frozenset(r.bare for r in mine if r.bare))
        out += [(tid, " ".join(tree.leaves[""][k].tokens), int(sum(tree.leaves[""][k].heads.values())), *tree.leaves[""][k].decision()) for tid, k in went.items()]
        return ["template_id", "template", "n", "layout", "comp_at", "msg_at"]

    return work


def templates_of(lines: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(h, template_id) of each distinct masked line, and (template_id, template, n, layout, comp_at, msg_at) of the merged templates; layout is null where no entry begins."""
    texts = lines.where("text IS NOT NULL").groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"))
    routed = cut_lineage(texts.mapInPandas(_routed, "h long, n long, route string, tokens string, layout string, comp_at int, msg_at int, bare string"))
    size = routed.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    rows = routed.join(size, "route").withColumn("piece", F.concat_ws("\x1f", "route", F.pmod(F.col("h"), F.col("pieces")).cast("string"))).drop("pieces")
    grown = rows.repartition("piece").sortWithinPartitions("piece", F.desc("n"), "tokens", "h").mapInPandas(_by_route(_grow(least)), "route string, template_id string, h long, template string, n long, layout string, comp_at int, msg_at int, bare string")
    grown = cut_lineage(grown)
    parts = grown.groupBy(F.col("route").alias("piece"), "template_id", "template", "layout", "comp_at", "msg_at", "bare").agg(F.sum("n").alias("n"))
    merged = parts.repartition("piece").sortWithinPartitions("piece", "template_id", F.desc("n"), "layout", "comp_at", "msg_at").mapInPandas(_by_route(_decide(least)), "template_id string, template string, n long, layout string, comp_at int, msg_at int")
    return grown.select("h", "template_id"), merged.withColumn("layout", F.nullif("layout", F.lit("")))


def placed_lines(jobs: DataFrame, least: float = 0.6) -> DataFrame:
    """Every distinct line with the layout of its template and `entry`, the line_index of the first line of its entry; lines of no entry are left out."""
    lines = cut_lineage(lines_of(jobs))
    went, templates = templates_of(lines, least)
    heads = went.join(templates.where("layout IS NOT NULL"), "template_id").select("h", "layout", "comp_at", "msg_at")
    rows = lines.drop("text").join(heads, "h", "left").drop("h")
    begins = (F.col("stream_name") == "system") | F.col("layout").isNotNull()
    rows = rows.withColumn("starts", F.when(begins, F.col("line_index"))).withColumn("block", F.floor(F.col("line_index") / BLOCK))
    # a stream is worked on in blocks of its indices, so that a hot one isn't one task; a block's first lines belong to the last entry before it
    place = ["job_id", "stream_name", "block"]
    rows = rows.repartition(*place).dropDuplicates(["job_id", "stream_name", "block", "line_index", "message"])
    w = Window.partitionBy(*place).orderBy("line_index", "message").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("entry", F.max("starts").over(w))
    ends = lines.agg(F.min("line_index"), F.max("line_index")).first()
    if ends[0] is not None and ends[0] // BLOCK != ends[1] // BLOCK:  # else every stream is one block
        rows = _carried(rows, lines, heads, place)
    return rows.where("entry IS NOT NULL").drop("block", "starts")


def _carried(rows: DataFrame, lines: DataFrame, heads: DataFrame, place: list[str]) -> DataFrame:
    """The rows with the entries that go on over the beginning of a block, from one row a block."""
    before = Window.partitionBy("job_id", "stream_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.col("line_index") / BLOCK).alias("block")
    starts = lines.select("job_id", "stream_name", "line_index", "h").join(heads.select("h", F.lit(True).alias("is_head")), "h", "left")
    last = starts.groupBy("job_id", "stream_name", block).agg(F.max(F.when((F.col("stream_name") == "system") | F.col("is_head"), F.col("line_index"))).alias("last"))
    carried = last.withColumn("carried", F.max("last").over(before)).where("carried IS NOT NULL").drop("last")
    return rows.join(carried, place, "left").withColumn("entry", F.coalesce("entry", "carried")).drop("carried")


def found(placed: DataFrame) -> DataFrame:
    """job_id, first_index, last_index of each entry."""
    out = placed.groupBy("job_id", "stream_name", "entry").agg(F.max("line_index").alias("last_index"))
    return out.select("job_id", F.col("entry").alias("first_index"), "last_index").distinct()


def _field(text: Column, names: str) -> Column:
    """The value of the first of the names in `name=value`, `"name": value` or `name="value"`."""
    hit = F.regexp_extract(text, rf"(?:^|[\s,{{])\"?(?:{names})\"?\s*[=:]\s*(?:\"((?:[^\"\\]|\\.)*)\"|([^\s,}}\"]+))", 0)
    body = F.regexp_replace(hit, rf"^[\s,{{]?\"?(?:{names})\"?\s*[=:]\s*", "")
    return F.nullif(F.regexp_replace(body, '^"|"$', ""), F.lit(""))


def entries(placed: DataFrame) -> DataFrame:
    """One row an entry: job_id, stream_name, first_index, last_index, time_text, level, component, message. The fields stand where the entry's template has them, in the line as it is."""
    head = F.min_by(F.struct("line", "layout", "comp_at", "msg_at"), F.struct("line_index", "message"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "message", "line"))), lambda s: s["line"]), "\n")
    e = placed.groupBy("job_id", "stream_name", "entry").agg(F.max("line_index").alias("last_index"), head.alias("h"), body.alias("body"))
    h = lambda c: F.col(f"h.{c}")
    line = h("line")
    glog = line.rlike(GLOG)
    time_text = F.when(glog, F.regexp_extract(line, GLOG, 2)).otherwise(F.nullif(F.regexp_extract(line, TIME.replace("[01]", "1"), 0), F.lit("")))
    keyed, barred = h("layout").isin("record", "pairs"), (h("layout") == "bars") & ~glog
    half = F.when(glog, F.regexp_replace(line, GLOG, "|$1|‹T›")).when(time_text.isNotNull(), F.overlay(line, F.lit("‹T›"), F.instr(line, time_text), F.length(time_text))).otherwise(line)
    level_head = F.regexp_extract(F.regexp_replace(half, POSITION, "‹P›"), LEVEL, 0)
    toks = F.split(line, " ")
    bare = F.when(F.lower(F.get(toks, F.lit(0))).rlike(f"^(?:{_LEVELS})$"), F.get(toks, F.lit(0)))
    level = F.upper(F.when(keyed, _field(F.col("body"), "level|lvl|severity")).otherwise(F.coalesce(F.nullif(level_head, F.lit("")), bare)))
    # One spelling a level.
    short = {"T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARNING", "E": "ERROR", "F": "FATAL", "C": "CRITICAL", "WARN": "WARNING", "ERR": "ERROR"}
    level = let(level, lambda x: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in short.items() for v in kv)), F.coalesce(x, F.lit(""))), x))
    comp = F.when(keyed, _field(F.col("body"), "component|logger|module|name|target|src"))
    comp = comp.when(barred, F.get(F.split(line, r"\|"), F.lit(2)))
    comp = comp.when(glog, F.nullif(F.regexp_extract(line, r"^\S+ \S+ +\d+ ([\w.]+?)\.\w+:\d+\] ", 1), F.lit("")))
    comp = comp.when(h("comp_at") > 0, F.regexp_replace(F.regexp_replace(F.get(toks, h("comp_at") - 1), r"^[\[(<]+|[\])>:]+$", ""), r"\[\d+\]?$", ""))
    plain = F.when(h("msg_at") > 0, F.array_join(F.slice(toks, h("msg_at"), F.size(toks)), " ")).otherwise(line)
    first = F.when(barred, F.regexp_replace(line, r"^[^|]*\|[^|]*\|[^|]*\|", "")).when(glog, F.regexp_replace(line, r"^\S+ \S+ +(?:\d+ +)?[\w.]+:\d+\] ", ""))
    first = first.otherwise(F.regexp_replace(plain, rf"^[\[(<](?i:{_LEVELS})[\])>]:?\s+", ""))
    message = F.when(keyed, F.coalesce(_field(F.col("body"), "msg|message|event"), F.col("body"))).when(F.col("stream_name") == "system", F.col("body"))
    rest = F.when(F.instr("body", "\n") > 0, F.expr("substring(body, instr(body, '\n'))")).otherwise("")
    message = message.otherwise(F.concat(first, rest))
    system = F.col("stream_name") == "system"
    return e.select("job_id", "stream_name", F.col("entry").alias("first_index"), "last_index", F.when(~system, time_text).alias("time_text"), F.when(~system, level).alias("level"), F.when(~system, comp).alias("component"), message.alias("message"))
