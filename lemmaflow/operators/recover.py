"""A built tree brought up to date with changed leaves, by the cheapest way that keeps its rules.

Ways, in the order in which they are tried: the tree as it is (`rebased`), ancestors of blocked leaves summarized again (`blocked_subtree`), removed leaves pruned away (`removal`), added leaves inserted beside what they
depend on (`insertion`), pruned and then grouped anew with old summaries reused (`mixed`), grouped anew with reuse (`regeneration`), built anew (`rebuild`, with the reason). A way that meets a broken rule is given up for the next.

A tree is one kernel's work, as its ways follow one another; over `kernel_rows` rows a tree is refused. Plans over whole tables, without a tree, are in change.py.

Defined results: ids are compared trimmed; a tree without cached nodes is built; of a stored tree without root or with a cycle only summaries are reused; one without current leaves has no rows but its status; repeated leaves count once, the one with the smallest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.canon import Config, locale_key, request_hash
from lemmaflow.functions.groups import by_group
from lemmaflow.functions.ids import clean_id, clean_ids
from lemmaflow.operators import policy
from lemmaflow.operators.trees import build_tree
from lemmaflow.session import cut_lineage

OUT = (
    "tree_id string, part string, way string, node_id string, node_kind string, statement_text string, child_ids array<string>, node_depth int, complexity_score double, evidence_refs array<string>, is_root boolean, "
    "reason string, plan_hash string, changed array<string>, blocked array<string>, recomputed array<string>, collapsed array<string>, dropped array<string>, inserted array<string>, reused_by_grounding int, reused_by_signature int, generated int, skipped_ambiguous int, skipped_unrebasable int"
)
_NAMES = [c.split()[0] for c in OUT.split(", ")]


class GivenUp(Exception):
    """A way meets a rule that it can't keep."""


@dataclass
class Node:
    id: str
    kind: str
    said: str
    kids: list[str] = field(default_factory=list)
    depth: int = 0
    complexity: float | None = None
    why: str = ""
    refs: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    abstraction: float | None = None
    confidence: float | None = None


@dataclass
class Leaf:
    id: str
    said: str
    needs: list[str]
    print: str


@dataclass
class Plan:
    """What changed between two sets of leaves, and what has to wait for it."""

    added: list[str]
    removed: list[str]
    changed: list[str]
    blocked: list[str]
    batches: list[list[str]]
    cyclic: int

    @property
    def reshaped(self) -> bool:
        return bool(self.added or self.removed)

    @property
    def needs_work(self) -> bool:
        return bool(self.blocked or self.removed)

    def hash(self) -> str:
        return request_hash(added=self.added, removed=self.removed, changed=self.changed, blocked=self.blocked, batches=self.batches)


def plan_of(old: dict[str, Leaf], new: dict[str, Leaf]) -> Plan:
    added, removed = [i for i in new if i not in old], [i for i in old if i not in new]
    changed = added + removed + [i for i in new if i in old and new[i].print != old[i].print]
    users: dict[str, list[str]] = {}
    for x in new.values():
        for n in x.needs:
            users.setdefault(n, []).append(x.id)
    reach, stack = set(), list(changed)
    while stack:
        i = stack.pop()
        if i not in reach:
            reach.add(i)
            stack += users.get(i, ())
    blocked = {i for i in reach if i in new}
    waits = {i: {n for n in new[i].needs if n in blocked} for i in blocked}
    batches, cyclic = [], 0
    while waits:
        ready = [i for i, w in waits.items() if not w]
        if not ready:
            ready, cyclic = list(waits), 1
        batches.append(sorted(ready, key=locale_key))
        for i in ready:
            del waits[i]
        for w in waits.values():
            w.difference_update(ready)
    order = lambda xs: sorted(xs, key=locale_key)
    return Plan(order(added), order(removed), order(changed), order(blocked), batches, cyclic)


class Tree:
    """The nodes of one tree by id, its root, the current leaves, and the rules."""

    def __init__(self, nodes: dict[str, Node], root: str, leaves: dict[str, Leaf], config: Config, summarize: policy.Summarizer) -> None:
        self.nodes, self.root, self.leaves, self.config, self.summarize = {k: replace(v, kids=list(v.kids), refs=list(v.refs)) for k, v in nodes.items()}, root, leaves, config, summarize
        self.recomputed: set[str] = set()
        self.collapsed: set[str] = set()
        self.dropped: set[str] = set()
        self.inserted: list[str] = []
        self.counts = dict.fromkeys(("grounding", "signature", "generated", "ambiguous", "unrebasable"), 0)

    def parents(self) -> dict[str, list[str]]:
        up: dict[str, list[str]] = {}
        for n in self.nodes.values():
            if n.kind == "parent":
                for k in n.kids:
                    up.setdefault(k, []).append(n.id)
        return {k: sorted(v, key=locale_key) for k, v in up.items()}

    def leaf_ids(self) -> set[str]:
        return {i for i, n in self.nodes.items() if n.kind == "leaf"}

    def set_leaves(self, leaves: dict[str, Leaf]) -> None:
        """Current statements for the leaves; one that is no leaf of the tree ends the way."""
        for x in leaves.values():
            n = self.nodes.get(x.id)
            if n is None or n.kind != "leaf":
                raise GivenUp
            n.said, n.refs = x.said, [x.id]

    def children(self, ids: list[str]) -> list[policy.Child]:
        if any(i not in self.nodes for i in ids):
            raise GivenUp
        return [policy.Child(i, self.nodes[i].said, self.nodes[i].complexity, self.leaves[i].needs if i in self.leaves else []) for i in ids]

    def summary(self, ids: list[str]) -> policy.Summary:
        """A summary that keeps every rule, or the way ends."""
        kids = self.children(ids)
        if policy.before(kids, self.config)[2]:
            raise GivenUp
        s = self.summarize(kids, self.config, 0)
        if policy.criticize(s, kids, self.config) or policy.after(s, kids, self.config)[2]:
            raise GivenUp
        return s

    def fill(self, n: Node, ids: list[str]) -> None:
        s = self.summary(ids)
        n.kids, n.said, n.why, n.terms, n.refs, n.complexity, n.abstraction, n.confidence = list(ids), s.said, s.why, list(s.terms), list(s.refs), s.complexity, s.abstraction, s.confidence
        self.recomputed.add(n.id)

    def reached(self) -> set[str]:
        seen, stack = set(), [self.root]
        while stack:
            i = stack.pop()
            if i not in seen and i in self.nodes:
                seen.add(i)
                stack += self.nodes[i].kids
        return seen

    def set_depths(self) -> None:
        """Depths are heights over the deepest level that a walk by levels meets."""
        level, queue, seen = {self.root: 0}, [self.root], set()
        for i in queue:
            if i in seen or i not in self.nodes:
                continue
            seen.add(i)
            for k in self.nodes[i].kids:
                if k in self.nodes:
                    level[k] = level[i] + 1
                    queue.append(k)
        top = max(level.values(), default=0)
        for i, d in level.items():
            if i in self.nodes:
                self.nodes[i].depth = top - d

    def check(self) -> None:
        """Every current leaf is reached, nothing else is left, and no parent has too many children."""
        seen = self.reached()
        if self.root not in self.nodes or seen != set(self.nodes) or not set(self.leaves) <= seen:
            raise GivenUp
        if any(len(n.kids) > self.config.max_children or any(k not in self.nodes for k in n.kids) for n in self.nodes.values()):
            raise GivenUp

    def of_height(self, ids: set[str], top_first: bool = False) -> str:
        return min(ids, key=lambda i: ((-1 if top_first else 1) * (self.nodes[i].depth if i in self.nodes else 0), locale_key(i)))


def blocked_subtree(t: Tree, plan: Plan) -> None:
    """The leaves are the same: what is above blocked ones is summarized again, from the bottom."""
    if not plan.needs_work or plan.cyclic or not plan.batches or t.leaf_ids() != set(t.leaves):
        raise GivenUp
    t.set_leaves(t.leaves)
    up, above, stack = t.parents(), set(), list(plan.blocked)
    while stack:
        for p in up.get(stack.pop(), ()):
            if p not in above:
                above.add(p)
                stack.append(p)
    for p in sorted(above, key=lambda i: (t.nodes[i].depth, locale_key(i))):
        t.fill(t.nodes[p], t.nodes[p].kids)


def removal(t: Tree, removed: list[str]) -> None:
    """Removed leaves are taken out; a parent without children goes, one with a single child gives way to it, the others are summarized again."""
    gone = set(removed)
    if t.leaf_ids() - gone != set(t.leaves):
        raise GivenUp
    pending = {p for i in gone for p in t.parents().get(i, ())}
    for i in gone:
        t.nodes.pop(i, None)
    t.set_leaves(t.leaves)
    while pending:
        p = t.of_height(pending)
        pending.discard(p)
        n = t.nodes.get(p)
        if n is None or n.kind != "parent":
            continue
        above = t.parents().get(p, [])
        kids = list(dict.fromkeys(k for k in n.kids if k in t.nodes))
        if not kids:
            if t.root == p:
                raise GivenUp
            del t.nodes[p]
            t.dropped.add(p)
        elif len(kids) == 1:
            for g in above:
                t.nodes[g].kids = list(dict.fromkeys(kids[0] if k == p else k for k in t.nodes[g].kids))
            if t.root == p:
                t.root = kids[0]
            del t.nodes[p]
            t.collapsed.add(p)
        else:
            t.fill(n, kids)
        pending |= set(above)
    for i in set(t.nodes) - t.reached():
        del t.nodes[i]
        t.dropped.add(i)
    t.set_depths()


def _groups_of_added(added: dict[str, Leaf], old: set[str]) -> list[tuple[str, list[str], list[str]]]:
    """(key, the old leaves that it needs, its leaves) of each set of added leaves that depend on one another."""
    near: dict[str, set[str]] = {i: set() for i in added}
    for x in added.values():
        for n in x.needs:
            if n in near:
                near[x.id].add(n)
                near[n].add(x.id)
    seen, out = set(), []
    for i in sorted(added, key=locale_key):
        if i in seen:
            continue
        mine, stack = set(), [i]
        while stack:
            j = stack.pop()
            if j not in mine:
                mine.add(j)
                stack += near[j]
        seen |= mine
        ids = sorted(mine, key=locale_key)
        needs = sorted({n for j in ids for n in added[j].needs if n in old}, key=locale_key)
        out.append((("deps:" + "|".join(needs) + "::" if needs else "") + "component:" + "|".join(ids), needs, ids))
    return sorted(out, key=lambda g: locale_key(g[0]))


def anchor(t: Tree, leaves: list[str]) -> str | None:
    """The lowest node that all leaves' chains of first parents share, the leaf itself if it is one; the root without leaves; None if a chain doesn't reach it."""
    if not leaves:
        return t.root
    up, chains = t.parents(), []
    for i in leaves:
        chain = [i]
        while chain[-1] != t.root:
            above = up.get(chain[-1])
            if not above or above[0] in chain:
                return None
            chain.append(above[0])
        chains.append(chain)
    return next((c for c in chains[0] if all(c in x for x in chains)), t.root)


def insertion(t: Tree, plan: Plan) -> None:
    """Each set of added leaves becomes a subtree that a new parent joins to what it depends on; ancestors are summarized again."""
    added = {i: t.leaves[i] for i in plan.added}
    old = set(t.leaves) - set(added)
    if t.leaf_ids() != old:
        raise GivenUp
    groups, tops = _groups_of_added(added, old), []
    for _, _, ids in groups:
        rows = build_tree([(i, added[i].said, None, set(added[i].needs)) for i in ids], t.config, t.summarize, strict=True)
        if any(r["part"] == "issue" for r in rows):
            raise GivenUp
        made = [Node(i, "leaf", added[i].said, refs=[i]) for i in ids]
        made += [Node(r["node_id"], "parent", r["statement_text"], r["ids"], r["depth"], r["complexity_score"], r["why"], r["refs"], r["terms"], r["abstraction_score"], r["confidence"]) for r in rows if r["part"] == "node"]
        if any(n.id in t.nodes for n in made):
            raise GivenUp
        t.nodes.update({n.id: n for n in made})
        tops.append(made[-1].id if len(ids) > 1 else ids[0])
    t.set_leaves(t.leaves)
    pending: set[str] = set()
    for at, ((key, needs, _), top) in enumerate(zip(groups, tops)):
        up, base = t.parents(), anchor(t, needs)
        if base is None or base not in t.nodes or base == top:
            raise GivenUp
        new = f"p_addition_{request_hash(planHash=plan.hash(), frontierKey=key, frontierIndex=at, anchorNodeId=base, frontierRootId=top)[:16]}"
        if new in t.nodes:
            raise GivenUp
        n = Node(new, "parent", "")
        t.fill(n, [base, top])
        t.recomputed.discard(new)
        t.nodes[new] = n
        t.inserted.append(new)
        above = up.get(base, [])
        if not above:
            t.root = new
        for p in above:
            t.nodes[p].kids = list(dict.fromkeys(new if k == base else k for k in t.nodes[p].kids))
            pending.add(p)
    while pending:
        p = t.of_height(pending, top_first=True)
        pending.discard(p)
        kids = list(dict.fromkeys(k for k in t.nodes[p].kids if k in t.nodes))
        if len(kids) < 2:
            raise GivenUp
        t.fill(t.nodes[p], kids)
        pending |= set(t.parents().get(p, ()))
    # from the bottom once more, so that every ancestor is made of its children's last words
    height = _heights(t)
    for p in sorted(t.recomputed, key=lambda i: (height[i], locale_key(i))):
        t.fill(t.nodes[p], t.nodes[p].kids)
    t.set_depths()


def _heights(t: Tree) -> dict[str, int]:
    """Levels below each node of a tree without cycles."""
    out: dict[str, int] = {}
    for i in _children_first(t.nodes):
        out[i] = 1 + max((out[k] for k in t.nodes[i].kids if k in out), default=-1)
    return out


def _children_first(nodes: dict[str, Node]) -> list[str]:
    """The nodes, each after its children; those on a cycle, and what leads to them, are left out."""
    waits = {i: len({k for k in n.kids if k in nodes}) for i, n in nodes.items()}
    up: dict[str, list[str]] = {}
    for n in nodes.values():
        for k in set(n.kids):
            if k in nodes:
                up.setdefault(k, []).append(n.id)
    out = [i for i, w in waits.items() if not w]
    for i in out:
        for p in up.get(i, ()):
            waits[p] -= 1
            if not waits[p]:
                out.append(p)
    return out


class Reuse:
    """Old summaries by what they were made of: children with their statements, else the statements alone if one old parent only has them."""

    def __init__(self, t: Tree) -> None:
        self.exact: dict[str, Node] = {}
        self.kids: dict[str, list[tuple[str, str]]] = {}
        for n in sorted((n for n in t.nodes.values() if n.kind == "parent"), key=lambda n: locale_key(n.id)):
            if n.said and n.why and n.refs and all(k in t.nodes for k in n.kids):
                kids = [(k, t.nodes[k].said) for k in n.kids]
                key = self._key(sorted(kids, key=lambda k: locale_key(k[0])))
                if key not in self.exact:
                    self.exact[key], self.kids[n.id] = n, kids
        self.alike: dict[str, list[Node]] = {}
        for n in self.exact.values():
            self.alike.setdefault(self._key(sorted(s for _, s in self.kids[n.id])), []).append(n)

    @staticmethod
    def _key(x: object) -> str:
        return hashlib.sha256(repr(x).encode()).hexdigest()

    def rebased(self, old: Node, kids: list[policy.Child]) -> list[str] | None:
        """The old references as present children of the same statements, each child once."""
        said, free, out = dict(self.kids[old.id]), {}, []
        for c in sorted(kids, key=lambda c: locale_key(c.id)):
            free.setdefault(c.said, []).append(c.id)
        for r in old.refs:
            if not free.get(said.get(r, "")):
                return None
            out.append(free[said[r]].pop(0))
        return out


def regeneration(t: Tree) -> Tree:
    """The leaves grouped anew; summaries that were made of the same children, or of the same statements, are taken over."""
    old = Reuse(t)
    if not old.exact:
        raise GivenUp
    used: dict[str, set[str]] = {"grounding": set(), "signature": set()}
    out = Tree({}, "", t.leaves, t.config, t.summarize)

    def summarize(kids: list[policy.Child], config: Config, attempt: int) -> policy.Summary:
        as_summary = lambda n, refs: policy.Summary(n.said, n.why, list(n.terms), refs, 3.0 if n.complexity is None else n.complexity, 3.0 if n.abstraction is None else n.abstraction, 1.0 if n.confidence is None else n.confidence)
        hit = old.exact.get(Reuse._key(sorted(((c.id, c.said) for c in kids), key=lambda k: locale_key(k[0]))))
        if hit is not None:
            used["grounding"].add(hit.id)
            return as_summary(hit, list(hit.refs))
        alike = old.alike.get(Reuse._key(sorted(c.said for c in kids)), [])
        if len(alike) == 1:
            refs = old.rebased(alike[0], kids)
            if refs is not None:
                used["signature"].add(alike[0].id)
                return as_summary(alike[0], refs)
            out.counts["unrebasable"] += 1
        elif alike:
            out.counts["ambiguous"] += 1
        out.counts["generated"] += 1
        return t.summarize(kids, config, attempt)

    _built(out, summarize)
    out.counts["grounding"], out.counts["signature"] = len(used["grounding"]), len(used["signature"])
    return out


def _built(out: Tree, summarize: policy.Summarizer) -> None:
    rows = build_tree([(x.id, x.said, None, set(x.needs)) for x in out.leaves.values()], out.config, summarize, strict=True)
    if any(r["part"] == "issue" for r in rows):
        raise GivenUp
    out.nodes = {x.id: Node(x.id, "leaf", x.said, refs=[x.id]) for x in out.leaves.values()}
    for r in rows:
        if r["part"] == "node":
            out.nodes[r["node_id"]] = Node(r["node_id"], "parent", r["statement_text"], r["ids"], r["depth"], r["complexity_score"], r["why"], r["refs"], r["terms"], r["abstraction_score"], r["confidence"])
            out.root = r["node_id"]
    if len(out.leaves) == 1:
        out.root = next(iter(out.leaves))


def rebuild_reason(plan: Plan, same_graph: bool) -> str:
    """Why a tree had to be built anew."""
    return "topology_shape_changed" if plan.reshaped else "cyclic_blocked_subtree" if plan.cyclic else "dependency_graph_changed" if not same_graph else "recovery_preconditions_failed"


def recovered(nodes: dict[str, Node], root: str, old: dict[str, Leaf], new: dict[str, Leaf], config: Config, summarize: policy.Summarizer = policy.joined) -> tuple[str, str, Plan, Tree]:
    """(way, reason, plan, tree): the first way that keeps all rules; way 'failed' with an empty tree if even a new one can't be built by them."""
    plan = plan_of(old, new)
    same_graph = {i: sorted(x.needs) for i, x in old.items()} == {i: sorted(x.needs) for i, x in new.items()}
    fresh = lambda leaves=new: Tree(nodes, root, leaves, config, summarize)

    def rebased() -> Tree:
        if plan.needs_work or not same_graph:
            raise GivenUp
        return fresh()

    def upward() -> Tree:
        t = fresh()
        blocked_subtree(t, plan)
        return t

    def pruned() -> Tree:
        if plan.added or not plan.removed or set(plan.changed) != set(plan.removed):
            raise GivenUp
        t = fresh()
        removal(t, plan.removed)
        return t

    def grown() -> Tree:
        if plan.removed or not plan.added or set(plan.changed) != set(plan.added):
            raise GivenUp
        t = fresh()
        insertion(t, plan)
        return t

    def mixed() -> Tree:
        if not plan.added or not plan.removed:
            raise GivenUp
        t = fresh({i: x for i, x in new.items() if i not in set(plan.added)})
        removal(t, plan.removed)
        t.check()
        out = regeneration(replace_leaves(t, new))
        out.recomputed, out.collapsed, out.dropped = t.recomputed, t.collapsed, t.dropped
        return out

    def anew() -> Tree:
        t = Tree({}, "", new, config, summarize)
        _built(t, summarize)
        return t

    ways = [("rebased", rebased), ("blocked_subtree", upward), ("removal", pruned), ("insertion", grown), ("mixed", mixed), ("regeneration", lambda: regeneration(fresh())), ("rebuild", anew)]
    # a stored tree with a cycle can't be followed up; only its summaries may be of use
    usable = 0 if nodes and root in nodes and len(_children_first(nodes)) == len(nodes) else -2 if nodes else -1
    for way, run in ways[usable:]:
        try:
            t = run()
            t.check()
            return way, rebuild_reason(plan, same_graph) if way == "rebuild" and nodes else "", plan, t
        except GivenUp:
            continue
    return "failed", rebuild_reason(plan, same_graph), plan, Tree({}, "", new, config, summarize)


def replace_leaves(t: Tree, leaves: dict[str, Leaf]) -> Tree:
    t.leaves = leaves
    return t


def _kernel(config: Config, summarize: policy.Summarizer):  # noqa: ANN202
    def run(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
        nodes, old, new, root = {}, {}, {}, ""
        num = lambda x: None if x is None or x != x else float(x)
        for part, i, kind, said, ids, depth, c, why, refs, terms, a, f, fp, top in zip(*(cols[n] for n in ("part", "node_id", "node_kind", "statement_text", "ids", "node_depth", "complexity", "why", "refs", "terms", "abstraction", "confidence", "fp", "is_root"))):
            if part == "node":
                nodes[i] = Node(i, kind, said, list(ids), int(depth or 0) if depth == depth else 0, num(c), why or "", list(refs), list(terms), num(a), num(f))
                root = i if top else root
            else:
                (old if part == "old" else new)[i] = Leaf(i, said, list(ids), fp)
        way, reason, plan, t = recovered(nodes, root, old, new, config, summarize)
        order = lambda xs: sorted(xs, key=locale_key)
        c = t.counts
        status = {"part": "status", "way": way, "reason": reason, "plan_hash": plan.hash(), "changed": plan.changed, "blocked": plan.blocked, "recomputed": order(t.recomputed), "collapsed": order(t.collapsed), "dropped": order(t.dropped), "inserted": order(t.inserted)}
        status |= {"reused_by_grounding": c["grounding"], "reused_by_signature": c["signature"], "generated": c["generated"], "skipped_ambiguous": c["ambiguous"], "skipped_unrebasable": c["unrebasable"]}
        yield tuple(key[0] if n == "tree_id" else status.get(n) for n in _NAMES)
        for n in t.nodes.values():
            row = {"part": "node", "way": way, "node_id": n.id, "node_kind": n.kind, "statement_text": n.said, "child_ids": n.kids, "node_depth": n.depth, "complexity_score": n.complexity, "evidence_refs": n.refs, "is_root": n.id == t.root}
            yield tuple(key[0] if x == "tree_id" else row.get(x) for x in _NAMES)

    return run


def fingerprint(c: dict[str, Column]) -> Column:
    """Hash of what a leaf says and depends on, without its place: id, kind, module, name, statements, and the sets of needs and tags."""
    parts = [F.coalesce(c[n], F.lit("")) for n in ("leaf_id", "theorem_kind", "module_path", "declaration_name", "statement_text", "pretty_statement")]
    return F.sha2(F.concat_ws("\x1f", *parts, F.array_join(F.array_sort(c["dependency_ids"]), "\x1e"), F.array_join(F.array_sort(c["tags"]), "\x1e")), 256)


def recover(tree: DataFrame, roots: DataFrame, old: DataFrame, new: DataFrame, config: Config, summarize: policy.Summarizer = policy.joined, kernel_rows: int = 400_000) -> DataFrame:
    """OUT rows of each tree: one `status`, and its `node` rows. tree: a tree table (proof_id, node_id, node_kind, statement_text, child_ids, complexity, refs, terms, why, abstraction, confidence, depth); roots: (proof_id,
    root_id); old, new: leaf-shaped rows with proof_id."""
    none = lambda t: F.lit(None).cast(t)
    cached = tree.join(roots.select("proof_id", F.col("root_id").alias("_root")), "proof_id", "left").select(
        F.col("proof_id").alias("tree_id"), F.lit("node").alias("part"), "node_id", "node_kind", "statement_text", F.col("child_ids").alias("ids"), F.col("depth").alias("node_depth"), "complexity", "why", "refs", "terms", "abstraction", "confidence", none("string").alias("fp"), F.col("node_id").eqNullSafe(F.col("_root")).alias("is_root"),
    )
    cols = {n: F.col(n) for n in ("leaf_id", "theorem_kind", "module_path", "declaration_name", "statement_text", "pretty_statement", "dependency_ids", "tags")}
    empty = F.array().cast("array<string>")
    side = lambda df, k: df.groupBy("proof_id", "leaf_id").agg(F.min(F.struct("pretty_statement", "dependency_ids", fingerprint(cols).alias("fp"))).alias("v")).select(
        clean_id("proof_id").alias("tree_id"), F.lit(k).alias("part"), F.col("leaf_id").alias("node_id"), F.lit("leaf").alias("node_kind"), F.col("v.pretty_statement").alias("statement_text"), clean_ids("v.dependency_ids").alias("ids"), none("int").alias("node_depth"), none("double").alias("complexity"), none("string").alias("why"),
        empty.alias("refs"), empty.alias("terms"), none("double").alias("abstraction"), none("double").alias("confidence"), F.col("v.fp").alias("fp"), F.lit(False).alias("is_root"),
    )
    rows = cut_lineage(cached.unionByName(side(old, "old")).unionByName(side(new, "new")).where("tree_id IS NOT NULL AND node_id IS NOT NULL"))
    if not rows.groupBy("tree_id").count().where(F.col("count") > kernel_rows).isEmpty():
        raise ValueError(f"a tree has more than {kernel_rows} rows; its ways follow one another in one task: raise kernel_rows")
    return by_group(rows, ["tree_id"], ["part", "node_id"], _kernel(config, summarize), OUT)
