"""The queries in SQL, for those that SQL can express on whole tables; the others are tested against brute force."""

from __future__ import annotations

from lemmaflow.functions.text import GROUPING_STOP, POLICY_STOP, QUALITY_STOP, SUMMARY_STOP
from lemmaflow.operators import views
from lemmaflow.operators.leaf import KINDS
from lemmaflow.operators.tagging import FALLBACK_EVIDENCE, SIGNALS

_W = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def cid(x: str) -> str:
    """Trimmed, null if blank."""
    return f"nullif({strip(x)}, '')"


def cids(x: str) -> str:
    return f"list_filter(list_transform(coalesce({x}, []::varchar[]), lambda e: {cid('e')}), lambda e: e IS NOT NULL)"


def idset(x: str) -> str:
    return f"list_sort(list_distinct({cids(x)}))"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9_]+'), lambda e: e <> '')"


def stem(t: str) -> str:
    cut = lambda k: f"left({t}, length({t}) - {k})"
    return f"""CASE WHEN {t} LIKE '%ies' AND length({t}) > 5 THEN {cut(3)} || 'y' WHEN {t} LIKE '%ing' AND length({t}) > 6 THEN {cut(3)} WHEN {t} LIKE '%ed' AND length({t}) > 5 THEN {cut(2)}
        WHEN {t} LIKE '%es' AND length({t}) > 5 AND regexp_matches({t}, '(?:s|x|z|ch|sh)es$') THEN {cut(2)} WHEN {t} LIKE '%es' AND length({t}) > 5 THEN {cut(1)} WHEN {t} LIKE '%s' AND length({t}) > 4 THEN {cut(1)} ELSE {t} END"""


_words = lambda xs: ", ".join(f"'{x}'" for x in xs)
_QUALITY, _GROUPING, _SUMMARY, _POLICY = map(_words, (QUALITY_STOP, GROUPING_STOP, SUMMARY_STOP, POLICY_STOP))


def mstems(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({toks(x)}, lambda e: {stem('e')}), lambda e: length(e) >= 3 AND e NOT IN ({_QUALITY})))"


def half_up(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def leaf_cte(name: str = "leaf", where: str = "true") -> str:
    kind = f"lower({cid('theorem_kind')})"
    return f"""{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT {cid("declaration_id")} AS leaf_id, regexp_replace(coalesce({cid("module_path")}, ''), '{_W}+', ' ', 'g') AS module_path, coalesce({cid("declaration_name")}, '') AS declaration_name,
      CASE WHEN {kind} IN ({_words(KINDS)}) THEN {kind} ELSE 'unknown' END AS theorem_kind, coalesce({cid("statement_text")}, '') AS statement_text,
      coalesce({cid("pretty_statement")}, {cid("statement_text")}, '') AS pretty_statement, source_span, {idset("tags")} AS tags, {idset("dependency_ids")} AS dependency_ids,
      row_number() OVER (PARTITION BY {cid("declaration_id")} ORDER BY indexed_at DESC NULLS LAST, coalesce(source_text_hash, '') DESC) AS rn FROM lean_declarations WHERE {where}) WHERE rn = 1)"""


LEAF = leaf_cte()
EDGE = "edge AS (SELECT DISTINCT leaf_id AS src, unnest(dependency_ids) AS dst FROM leaf)"
NODE = "node AS (SELECT leaf_id AS id, 'indexed' AS category FROM leaf UNION ALL SELECT DISTINCT dst, 'external' FROM edge WHERE dst NOT IN (SELECT leaf_id FROM leaf))"
LINK = f"link AS (SELECT DISTINCT {cid('parent_id')} AS src, {cid('child_id')} AS dst FROM tree_edges WHERE {cid('parent_id')} IS NOT NULL AND {cid('child_id')} IS NOT NULL)"
TREE = f"""tree AS (SELECT * EXCLUDE (rn) FROM (SELECT {cid("proof_id")} AS proof_id, {cid("node_id")} AS node_id, node_kind, coalesce(statement_text, '') AS statement_text, {cids("child_ids")} AS child_ids, complexity_score AS complexity,
  {cids("evidence_refs")} AS refs, {cids("new_terms_introduced")} AS terms, coalesce(why_true_from_children, '') AS why, abstraction_score AS abstraction, confidence, node_depth AS depth, row_number() OVER (PARTITION BY {cid("proof_id")}, {cid("node_id")} ORDER BY ingested_at DESC NULLS LAST) AS rn FROM tree_nodes) WHERE rn = 1 AND proof_id IS NOT NULL AND node_id IS NOT NULL)"""
TEDGE = "tedge AS (SELECT proof_id, parent_id, child_id, min(o) - 1 AS child_order FROM (SELECT proof_id, node_id AS parent_id, unnest(child_ids) AS child_id, generate_subscripts(child_ids, 1) AS o FROM tree) GROUP BY ALL)"
# the links by child_ids of the tree table, and what each node reaches over them
ALLK = "allk AS (SELECT DISTINCT proof_id, node_id AS src, unnest(child_ids) AS dst FROM tree)"
PAIR = "pair AS (SELECT proof_id, src AS node_id, dst AS descendant_id FROM allk UNION SELECT p.proof_id, p.node_id, k.dst FROM pair p JOIN allk k ON k.proof_id = p.proof_id AND k.src = p.descendant_id)"
JOB = f"""job AS (SELECT * EXCLUDE (rn) FROM (SELECT {cid("job_id")} AS job_id, {cid("job_target.leaf_id")} AS leaf_id, job_status, queue_sequence, row_number() OVER (PARTITION BY {cid("job_id")} ORDER BY updated_at DESC NULLS LAST) AS rn FROM verification_jobs) WHERE rn = 1)"""
# policy decisions on the children that are there, in order
KIDS = "kid AS (SELECT proof_id, node_id, unnest(child_ids) AS id, generate_subscripts(child_ids, 1) AS o FROM tree WHERE node_kind = 'parent'), kc AS (SELECT k.proof_id, k.node_id, k.id, t.statement_text AS said, t.complexity, row_number() OVER (PARTITION BY k.proof_id, k.node_id ORDER BY k.o) AS pos FROM kid k JOIN tree t ON t.proof_id = k.proof_id AND t.node_id = k.id)"


def _stem_list(x: str, least: int, stop: str = "", only: bool = False) -> str:
    keep = [f"length(e) >= {least}"] + ([f"e NOT IN ({stop})"] if stop else []) + (["regexp_full_match(e, '[a-z]+')"] if only else [])
    return f"list_filter(list_transform({toks(x)}, lambda e: {stem('e')}), lambda e: {' AND '.join(keep)})"


def _share(own: str, known: str) -> str:
    return f"CASE WHEN len({own}) = 0 THEN 1.0 ELSE len(list_filter({own}, lambda e: list_contains({known}, e))) / len({own}) END"


DECIDED = f"""{KIDS}, firsts AS (SELECT proof_id, node_id, id, min(pos) AS pos FROM kc GROUP BY ALL),
  late AS (SELECT a.proof_id, a.node_id, count(*)::int AS n FROM kc a JOIN edge e ON e.src = a.id JOIN firsts b ON b.proof_id = a.proof_id AND b.node_id = a.node_id AND b.id = e.dst AND b.pos > a.pos GROUP BY ALL),
  sp AS (SELECT proof_id, node_id, max(coalesce(complexity, 3.0)) - min(coalesce(complexity, 3.0)) AS spread, list_distinct(flatten(list({_stem_list("said", 4, _POLICY, True)}))) AS known, list_distinct(flatten(list({_stem_list("said", 4, _SUMMARY)}))) AS known2 FROM kc GROUP BY ALL),
  raw AS (SELECT t.*, coalesce(s.spread, 0.0) AS spread, coalesce(l.n, 0) AS order_violations, CASE WHEN len(child_ids) = 0 THEN 1.0 ELSE len(list_filter(child_ids, lambda e: list_contains(refs, e))) / len(child_ids) END AS evidence, len(terms)::int AS n_terms,
    list_concat(coalesce(s.known, []::varchar[]), flatten(list_transform(terms, lambda y: {_stem_list("y", 0, "", True)}))) AS known, list_concat(coalesce(s.known2, []::varchar[]), flatten(list_transform(terms, lambda y: {_stem_list("y", 0)}))) AS known2, {_stem_list("statement_text || ' ' || why", 5, _POLICY, True)} AS own, {_stem_list("statement_text", 5, _SUMMARY)} AS own2
    FROM tree t LEFT JOIN sp s ON s.proof_id = t.proof_id AND s.node_id = t.node_id LEFT JOIN late l ON l.proof_id = t.proof_id AND l.node_id = t.node_id WHERE t.node_kind = 'parent'),
  dec AS (SELECT proof_id, node_id, spread, order_violations, evidence, {_share("own", "known")} AS continuity, n_terms, list_filter([CASE WHEN spread > 1 THEN 'sibling_complexity_spread' END, CASE WHEN order_violations > 0 THEN 'prerequisite_order' END], lambda e: e IS NOT NULL) AS pre_codes,
    list_filter([CASE WHEN evidence < 1 THEN 'evidence_coverage' END, CASE WHEN n_terms > 2 THEN 'term_budget' END, CASE WHEN {_share("own", "known")} < 0.62 THEN 'vocabulary_continuity' END], lambda e: e IS NOT NULL) AS post_codes FROM raw)"""
SAMPLES = f"""word AS (SELECT proof_id, node_id, {mstems("statement_text")} AS w FROM tree),
  below AS (SELECT DISTINCT p.proof_id, p.node_id, unnest(w.w) AS stem FROM pair p JOIN word w ON w.proof_id = p.proof_id AND w.node_id = p.descendant_id WHERE p.node_id <> p.descendant_id),
  fresh AS (SELECT DISTINCT proof_id, node_id, unnest({mstems("t")}) AS stem FROM (SELECT proof_id, node_id, array_to_string(terms, ' ') AS t FROM tree WHERE node_kind = 'parent')),
  known AS (SELECT * FROM below UNION SELECT * FROM fresh),
  own AS (SELECT proof_id, node_id, unnest(w) AS stem FROM word WHERE (proof_id, node_id) IN (SELECT (proof_id, node_id) FROM tree WHERE node_kind = 'parent')),
  sup AS (SELECT o.proof_id, o.node_id, count(*) AS n, count(k.stem) AS k FROM own o LEFT JOIN known k ON k.proof_id = o.proof_id AND k.node_id = o.node_id AND k.stem = o.stem GROUP BY ALL),
  {DECIDED}, sample AS (SELECT t.proof_id, t.node_id, t.depth, len(t.child_ids)::int AS child_count, d.spread AS complexity_spread, d.order_violations AS prerequisite_order_violations, d.evidence AS evidence_coverage_ratio, d.continuity AS vocabulary_continuity_ratio,
    CASE WHEN coalesce(s.n, 0) = 0 THEN 1.0 ELSE s.k / s.n END AS supported_claim_ratio, len(t.terms)::int AS introduced_term_count, CASE WHEN coalesce(s.n, 0) = 0 THEN 0.0 ELSE len(t.terms) / s.n END AS introduced_term_rate, (len(d.pre_codes) + len(d.post_codes))::int AS policy_violation_count
    FROM tree t JOIN dec d ON d.proof_id = t.proof_id AND d.node_id = t.node_id LEFT JOIN sup s ON s.proof_id = t.proof_id AND s.node_id = t.node_id)"""
METRICS = """count(*) AS parent_count, count(*) FILTER (supported_claim_ratio < 0.5) AS unsupported_parent_count, count(*) FILTER (prerequisite_order_violations > 0) AS prerequisite_violation_parent_count, count(*) FILTER (policy_violation_count > 0) AS policy_violation_parent_count,
  count(*) FILTER (introduced_term_rate > 1) AS introduced_term_overflow_parent_count, round(coalesce(avg((supported_claim_ratio < 0.5)::int), 0), 6) AS unsupported_parent_rate, round(coalesce(avg((prerequisite_order_violations > 0)::int), 0), 6) AS prerequisite_violation_rate, round(coalesce(avg((policy_violation_count > 0)::int), 0), 6) AS policy_violation_rate,
  round(coalesce(avg(complexity_spread), 0), 6) AS mean_complexity_spread, round(coalesce(max(complexity_spread), 0), 6) AS max_complexity_spread, round(coalesce(avg(evidence_coverage_ratio), 1), 6) AS mean_evidence_coverage, round(coalesce(avg(vocabulary_continuity_ratio), 1), 6) AS mean_vocabulary_continuity,
  round(coalesce(avg(introduced_term_rate), 0), 6) AS mean_term_jump_rate, 0.5::double AS support_coverage_floor"""
QUALITY = f"{LEAF}, {EDGE}, {TREE}, {ALLK}, {PAIR}, {SAMPLES}"
# a root a tree, what it leads to, and the children that are there in order
TOP = "top AS (SELECT proof_id, arg_min(node_id, (-len(child_ids), node_id)) AS root_id FROM tree WHERE node_kind = 'parent' AND (proof_id, node_id) NOT IN (SELECT (proof_id, dst) FROM allk) GROUP BY proof_id)"
REACH = "reach AS (SELECT proof_id, root_id AS id FROM top UNION SELECT r.proof_id, k.dst FROM reach r JOIN allk k ON k.proof_id = r.proof_id AND k.src = r.id), reached AS (SELECT r.proof_id, r.id FROM reach r JOIN tree t ON t.proof_id = r.proof_id AND t.node_id = r.id)"
CHILD = "child AS (SELECT c.*, t.node_id IS NOT NULL AS there FROM (SELECT proof_id, node_id AS parent_id, unnest(child_ids) AS child_id, generate_subscripts(child_ids, 1) - 1 AS o FROM tree) c LEFT JOIN tree t ON t.proof_id = c.proof_id AND t.node_id = c.child_id)"
# shortest paths from the root, of equal ones the first by the children's order
PATHS = """step AS (SELECT proof_id, parent_id, child_id, min(o) AS o FROM child WHERE there GROUP BY ALL), hop AS (SELECT proof_id, root_id AS id, 0 AS h FROM top UNION SELECT a.proof_id, s.child_id, a.h + 1 FROM hop a JOIN step s ON s.proof_id = a.proof_id AND s.parent_id = a.id WHERE a.h < 300),
  near AS (SELECT proof_id, id, min(h) AS h FROM hop GROUP BY ALL),
  way AS (SELECT proof_id, root_id AS id, [root_id] AS path, []::bigint[] AS place FROM top UNION ALL SELECT w.proof_id, s.child_id, list_append(w.path, s.child_id), list_append(w.place, s.o) FROM way w JOIN step s ON s.proof_id = w.proof_id AND s.parent_id = w.id JOIN near n ON n.proof_id = s.proof_id AND n.id = s.child_id AND n.h = len(w.path)),
  paths AS (SELECT proof_id, id AS node_id, arg_min(path, place) AS path FROM way GROUP BY ALL)"""
# each proof's last snapshot
LAST = f"""hs AS (SELECT *, {cid("proof_id")} AS p, {cid("snapshot_id")} AS s, coalesce(delivery_no, -1) AS dn, {cid("root_id")} AS r FROM tree_snapshots), lh AS (SELECT p AS proof_id, s AS snapshot_id, dn AS delivery_no, schema_version, r AS root_id, config_hash FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY taken_at DESC NULLS LAST, s DESC, dn DESC, r DESC) AS rn FROM hs WHERE p IS NOT NULL AND s IS NOT NULL) WHERE rn = 1)"""
RAWL = f"rawl AS (SELECT * FROM (SELECT {cid('proof_id')} AS proof_id, {cid('parent_id')} AS parent_id, {cid('child_id')} AS child_id, child_order FROM tree_edges) WHERE proof_id IS NOT NULL AND parent_id IS NOT NULL AND child_id IS NOT NULL)"
# the first and the last snapshot of each proof, of repeated rows the one delivered last
ENDS = f"""h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proof_id, snapshot_id ORDER BY delivery_no DESC) AS rn FROM tree_snapshots) WHERE rn = 1),
  f AS (SELECT *, row_number() OVER (PARTITION BY proof_id ORDER BY taken_at, snapshot_id) AS a, row_number() OVER (PARTITION BY proof_id ORDER BY taken_at DESC, snapshot_id DESC) AS z FROM h),
  ends AS (SELECT proof_id, snapshot_id, delivery_no, 'old' AS side FROM f WHERE a = 1 UNION ALL SELECT proof_id, snapshot_id, delivery_no, 'new' FROM f WHERE z = 1),
  n AS (SELECT * EXCLUDE (rn) FROM (SELECT e.side, e.proof_id, {cid("s.node_id")} AS node_id, s.node_kind, s.statement_text, s.node_depth, {cids("s.child_ids")} AS child_ids, row_number() OVER (PARTITION BY e.side, e.proof_id, {cid("s.node_id")} ORDER BY s.delivered_at DESC NULLS LAST, s.node_kind DESC NULLS LAST, s.statement_text DESC NULLS LAST, s.node_depth DESC NULLS LAST) AS rn
    FROM snapshot_nodes s JOIN ends e ON e.proof_id = s.proof_id AND e.snapshot_id = s.snapshot_id AND e.delivery_no = s.delivery_no WHERE {cid("s.node_id")} IS NOT NULL) WHERE rn = 1),
  ak AS (SELECT DISTINCT side, proof_id, node_id AS src, unnest(child_ids) AS dst FROM n WHERE node_kind IS DISTINCT FROM 'leaf'), pr AS (SELECT side, proof_id, src, dst FROM ak UNION SELECT p.side, p.proof_id, p.src, k.dst FROM pr p JOIN ak k ON k.side = p.side AND k.proof_id = p.proof_id AND k.src = p.dst),
  su AS (SELECT p.side, p.proof_id, p.src, string_agg(DISTINCT p.dst, ',' ORDER BY p.dst) AS support FROM pr p JOIN n l ON l.side = p.side AND l.proof_id = p.proof_id AND l.node_id = p.dst AND l.node_kind = 'leaf' GROUP BY ALL)"""
CHANGES = f"""{ENDS}, tp AS (SELECT side, proof_id, arg_min(node_id, (-len(child_ids), node_id)) AS root_id FROM n WHERE node_kind = 'parent' AND (side, proof_id, node_id) NOT IN (SELECT (side, proof_id, dst) FROM (SELECT side, proof_id, unnest(child_ids) AS dst FROM n)) GROUP BY ALL),
  rc AS (SELECT side, proof_id, root_id AS id FROM tp UNION SELECT r.side, r.proof_id, k.dst FROM rc r JOIN (SELECT side, proof_id, node_id AS src, unnest(child_ids) AS dst FROM n) k ON k.side = r.side AND k.proof_id = r.proof_id AND k.src = r.id),
  cm AS (SELECT n.side, n.proof_id, CASE WHEN n.node_kind = 'leaf' THEN 'leaf:' || n.node_id ELSE 'parent:' || coalesce(su.support, '') END AS key, n.node_id, n.node_kind, CASE WHEN n.node_kind = 'leaf' THEN n.node_id ELSE coalesce(su.support, '') END AS support, coalesce(n.statement_text, '') AS said, n.node_depth AS depth
    FROM n JOIN rc ON rc.side = n.side AND rc.proof_id = n.proof_id AND rc.id = n.node_id LEFT JOIN su ON su.side = n.side AND su.proof_id = n.proof_id AND su.src = n.node_id),
  pl AS (SELECT *, row_number() OVER (PARTITION BY side, proof_id, key ORDER BY node_id) - 1 AS "at" FROM cm), x AS (SELECT * FROM pl WHERE side = 'old'), y AS (SELECT * FROM pl WHERE side = 'new'),
  ch AS (SELECT coalesce(x.proof_id, y.proof_id) AS proof_id, coalesce(x.key, y.key) || '#' || coalesce(x."at", y."at") AS key, CASE WHEN x.key IS NULL THEN 'added' WHEN y.key IS NULL THEN 'removed' ELSE 'changed' END AS type, coalesce(x.node_kind, y.node_kind) AS node_kind, coalesce(x.support, y.support) AS support, x.node_id AS baseline_node_id, x.said AS baseline_statement,
    x.depth AS baseline_depth, y.node_id AS candidate_node_id, y.said AS candidate_statement, y.depth AS candidate_depth FROM x FULL JOIN y ON x.proof_id = y.proof_id AND x.key = y.key AND x."at" = y."at" WHERE x.key IS NULL OR y.key IS NULL OR x.said IS DISTINCT FROM y.said OR x.depth IS DISTINCT FROM y.depth)"""

_SAID = "module_path || chr(10) || declaration_name || chr(10) || statement_text || chr(10) || pretty_statement"
_HIT = lambda i: ", ".join(f"CASE WHEN regexp_matches({_SAID}, '(?i)(^|[^A-Za-z0-9_])({w[0]})($|[^A-Za-z0-9_])') THEN '{(t, w[1])[i]}' END" for t, w in SIGNALS.items())
TAGGED = rf"""hit AS (SELECT leaf_id, theorem_kind, regexp_matches(module_path, '(^|\.)Kernel(\.|$)') OR regexp_matches(declaration_name, '(?i)(^|[^A-Za-z0-9_])kernel($|[^A-Za-z0-9_])') AS own, list_filter([{_HIT(0)}], lambda e: e IS NOT NULL) AS sig, list_filter([{_HIT(1)}], lambda e: e IS NOT NULL) AS ev FROM leaf),
  conf AS (SELECT *, {half_up("least(0.95, 0.1 + CASE WHEN own THEN 0.45 ELSE 0.0 END + len(sig) * 0.1)")} AS c, list_sort(list_concat(sig, CASE WHEN own THEN ['domain:kernel'] ELSE [] END)) AS own_tags, list_sort(list_concat(ev, CASE WHEN own THEN ['module/name signal'] ELSE [] END)) AS own_ev, list_sort(['domain:lean/general', 'kind:' || theorem_kind]) AS gen_tags FROM hit),
  tagged AS (SELECT leaf_id, CASE WHEN c >= 0.55 THEN 'kernel' ELSE 'lean-generic' END AS adapter_id, CASE WHEN c >= 0.55 THEN c ELSE 0.55 END AS confidence, CASE WHEN c >= 0.55 THEN own_tags ELSE gen_tags END AS tags, CASE WHEN c >= 0.55 THEN own_ev ELSE ['{FALLBACK_EVIDENCE}'] END AS evidence FROM conf)"""
TAGM = f"""said AS (SELECT leaf_id, list_distinct(flatten(list(t))) AS expected FROM (SELECT {cid("declaration_id")} AS leaf_id, {idset("domain_classification.tags")} AS t FROM lean_declarations) WHERE len(t) > 0 GROUP BY leaf_id),
  e AS (SELECT leaf_id, unnest(expected) AS tag FROM said), p AS (SELECT leaf_id, unnest(tags) AS tag FROM tagged WHERE leaf_id IN (SELECT leaf_id FROM said)),
  n AS (SELECT coalesce(e.tag, p.tag) AS tag, count(*) FILTER (e.tag IS NOT NULL AND p.tag IS NOT NULL) AS tp, count(*) FILTER (e.tag IS NULL) AS fp, count(*) FILTER (p.tag IS NULL) AS fn FROM e FULL JOIN p ON e.leaf_id = p.leaf_id AND e.tag = p.tag GROUP BY 1),
  pr AS (SELECT *, {half_up("CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END")} AS precision, {half_up("CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END")} AS recall FROM n),
  m AS (SELECT *, {half_up("CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END")} AS f1 FROM pr)"""
NAME = r"(?:«[^»]+»|[A-Za-z_][A-Za-z0-9_'']*(?:\.[A-Za-z_][A-Za-z0-9_'']*)*)"
# hops from the roots of each proof over the links lk, and the nodes nd
LEVELS = """lv AS (SELECT proof_id, node_id, node_id AS root_id, 0 AS hops FROM nd WHERE (proof_id, node_id) NOT IN (SELECT (proof_id, dst) FROM lk)
  UNION SELECT l.proof_id, k.dst, l.root_id, l.hops + 1 FROM lv l JOIN lk k ON k.proof_id = l.proof_id AND k.src = l.node_id WHERE l.hops < 300),
  best AS (SELECT proof_id, node_id, min((hops, root_id)) AS b FROM lv GROUP BY ALL)"""
BOTH = f"""lk AS (SELECT DISTINCT * FROM (SELECT {cid("proof_id")} AS proof_id, {cid("parent_id")} AS src, {cid("child_id")} AS dst FROM tree_edges UNION ALL SELECT {cid("proof_id")}, {cid("node_id")}, unnest({cids("child_ids")}) FROM tree_nodes) WHERE src IS NOT NULL AND dst IS NOT NULL AND proof_id IS NOT NULL),
  nd AS (SELECT DISTINCT {cid("proof_id")} AS proof_id, {cid("node_id")} AS node_id FROM tree_nodes WHERE {cid("node_id")} IS NOT NULL UNION SELECT proof_id, src FROM lk UNION SELECT proof_id, dst FROM lk)"""
# a line's head: the layouts' times, levels and positions
_LV = "trace|debug|verbose|info|information|notice|warn|warning|error|err|fatal|critical|crit|severe|alert|emerg|panic"
_STARTS = "|".join([
    r"\[?[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}[T ][0-9]{1,2}:[0-9]{2}", r"\[?[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4},? [0-9]{1,2}:[0-9]{2}:[0-9]{2}", r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}",
    r"\[?[0-9]{1,2}:[0-9]{2}:[0-9]{2}", r"1[0-9]{9,12}[|]", r"[TDIWEFC][0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}", r"(ts|time|level)=", r"[{]", r"[[<(](" + _LV + "|" + _LV.upper() + r")[\])>]", "(" + _LV + "|" + _LV.upper() + "):? ", r"[A-Za-z0-9_./-]+[.][a-z]+:[0-9]+(:[0-9]+)?: ",
])
_TIME = "TIMESTAMP '2025-07-01 00:00:00'"
_FP = "concat_ws(chr(31), module_path, declaration_name, theorem_kind, statement_text, pretty_statement, array_to_string(tags, ','), array_to_string(dependency_ids, ','))"

ORACLE: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE {BOTH}, {LEVELS}, rc AS (SELECT proof_id, src, dst FROM lk UNION SELECT r.proof_id, r.src, k.dst FROM rc r JOIN lk k ON k.proof_id = r.proof_id AND k.src = r.dst)
      SELECT n.proof_id, n.node_id, coalesce(b.b[2], '') AS root_id, coalesce(b.b[1], -1)::int AS hops, ((n.proof_id, n.node_id) IN (SELECT (proof_id, src) FROM rc WHERE src = dst))::int AS in_cycle FROM nd n LEFT JOIN best b ON b.proof_id = n.proof_id AND b.node_id = n.node_id""",
    "p2_descendants": f"""WITH RECURSIVE {BOTH}, rc AS (SELECT proof_id, src, dst FROM lk UNION SELECT r.proof_id, r.src, k.dst FROM rc r JOIN lk k ON k.proof_id = r.proof_id AND k.src = r.dst) SELECT proof_id, src AS node_id, dst AS descendant_id FROM rc""",
    "p4_found": rf"""WITH l AS (SELECT DISTINCT job_id, lower({strip("l.stream_name")}) AS s, l.line_index AS i, l.message AS m FROM (SELECT {cid("job_id")} AS job_id, unnest(logs) AS l FROM verification_jobs) WHERE l IS NOT NULL AND job_id IS NOT NULL),
      b AS (SELECT *, s = 'system' OR regexp_matches(regexp_replace(coalesce(m, ''), '\x1b\[[0-9;?]*[a-zA-Z]', '', 'g'), '^({_STARTS})') AS starts FROM l WHERE s IS NOT NULL AND i IS NOT NULL),
      g AS (SELECT *, last_value(CASE WHEN starts THEN i END IGNORE NULLS) OVER (PARTITION BY job_id, s ORDER BY i, m ROWS UNBOUNDED PRECEDING) AS e FROM b) SELECT job_id, e AS first_index, max(i) AS last_index FROM g WHERE e IS NOT NULL GROUP BY job_id, s, e""",
    "p3_found": f"""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proof_id, snapshot_id ORDER BY delivery_no DESC) AS rn FROM tree_snapshots) WHERE rn = 1),
      nb AS (SELECT proof_id, lag(snapshot_id) OVER w AS a, snapshot_id AS b FROM h WINDOW w AS (PARTITION BY proof_id ORDER BY taken_at, snapshot_id)),
      n AS (SELECT DISTINCT s.proof_id, s.snapshot_id, {cid("s.node_id")} AS id, s.node_kind AS k, trim(regexp_replace(s.statement_text, '{_W}+', ' ', 'g')) AS t, s.node_depth AS d, {cids("s.child_ids")} AS c, {idset("s.evidence_refs")} AS e, round(s.complexity_score, 6) AS x
        FROM snapshot_nodes s JOIN h USING (proof_id, snapshot_id, delivery_no)),
      l AS (SELECT DISTINCT proof_id, snapshot_id, unnest({idset("leaf_ids")}) AS id FROM h),
      o AS (SELECT nb.proof_id, nb.a, nb.b, n.* EXCLUDE (proof_id, snapshot_id) FROM nb JOIN n ON n.proof_id = nb.proof_id AND n.snapshot_id = nb.a), w AS (SELECT nb.proof_id, nb.a, nb.b, n.* EXCLUDE (proof_id, snapshot_id) FROM nb JOIN n ON n.proof_id = nb.proof_id AND n.snapshot_id = nb.b WHERE nb.a IS NOT NULL),
      lo AS (SELECT nb.proof_id, nb.a, nb.b, l.id FROM nb JOIN l ON l.proof_id = nb.proof_id AND l.snapshot_id = nb.a), lw AS (SELECT nb.proof_id, nb.a, nb.b, l.id FROM nb JOIN l ON l.proof_id = nb.proof_id AND l.snapshot_id = nb.b WHERE nb.a IS NOT NULL)
      SELECT coalesce(o.proof_id, w.proof_id) AS proof_id, coalesce(o.a, w.a) AS from_snapshot_id, coalesce(o.b, w.b) AS to_snapshot_id, 'node' AS record_kind, coalesce(o.id, w.id) AS record_id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS change_type
      FROM o FULL JOIN w ON o.proof_id = w.proof_id AND o.a = w.a AND o.b = w.b AND o.id = w.id WHERE o.id IS NULL OR w.id IS NULL OR (o.k, o.t, o.d, o.c, o.e, o.x) IS DISTINCT FROM (w.k, w.t, w.d, w.c, w.e, w.x)
      UNION ALL SELECT coalesce(o.proof_id, w.proof_id), coalesce(o.a, w.a), coalesce(o.b, w.b), 'leaf', coalesce(o.id, w.id), CASE WHEN o.id IS NULL THEN 'added' ELSE 'removed' END FROM lo o FULL JOIN lw w ON o.proof_id = w.proof_id AND o.a = w.a AND o.b = w.b AND o.id = w.id WHERE o.id IS NULL OR w.id IS NULL""",
    "p5_found": f"""WITH d AS (SELECT {cid("declaration_id")} AS id, indexed_at, deleted_at FROM lean_declarations),
      r AS (SELECT DISTINCT * FROM (SELECT 'lean_declarations' AS ref_table, coalesce({strip("declaration_id")}, '') AS src_key, unnest({cids("dependency_ids")}) AS ref_key, indexed_at AS t FROM lean_declarations
        UNION ALL SELECT 'missing_dependency_refs', coalesce({strip("declaration_id")}, ''), {cid("dependency_id")}, reported_at FROM missing_dependency_refs UNION ALL SELECT 'tree_provenance', coalesce({strip("node_id")}, ''), {cid("leaf_id")}, recorded_at FROM tree_provenance) WHERE ref_key IS NOT NULL),
      f AS (SELECT id, min(indexed_at) AS first FROM d GROUP BY id)
      SELECT DISTINCT ref_table, src_key, ref_key, coalesce(strftime(t, '%Y-%m'), '') AS period, CASE WHEN f.id IS NULL THEN 'missing' WHEN f.first > t OR f.first IS NULL OR t IS NULL THEN 'late' ELSE 'deleted' END AS reason FROM r LEFT JOIN f ON f.id = r.ref_key
      WHERE ref_key NOT IN (SELECT {cid("symbol_id")} FROM shared_symbols) AND NOT EXISTS (SELECT 1 FROM d WHERE d.id = r.ref_key AND d.indexed_at <= r.t AND (d.deleted_at IS NULL OR r.t < d.deleted_at))""",
    "text_tokens": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {toks('text')} AS t FROM documents)",
    "text_stems": f"SELECT {stem('t')} AS stem, count(*) AS n FROM (SELECT unnest({toks('text')}) AS t FROM documents) GROUP BY 1",
    "text_keys": f"SELECT regexp_replace(lower({strip('source')}), '[^a-z0-9_-]', '_', 'g') AS source_key, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "leaf_map": f"WITH {LEAF} SELECT leaf_id, module_path, declaration_name, theorem_kind, statement_text, pretty_statement, array_to_string(tags, ',') AS tags, array_to_string(dependency_ids, ',') AS dependency_ids FROM leaf",
    "tag_eval": f"WITH {LEAF}, {TAGGED}, {TAGM} SELECT * FROM m",
    "tag_eval_macro": f"WITH {LEAF}, {TAGGED}, {TAGM} SELECT {half_up('coalesce(avg(precision), 0)')} AS macro_precision, {half_up('coalesce(avg(recall), 0)')} AS macro_recall, {half_up('coalesce(avg(f1), 0)')} AS macro_f1 FROM m",
    "dedupe_first": "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "graph_edges": f"WITH {LEAF}, {EDGE} SELECT * FROM edge",
    "graph_nodes": f"WITH {LEAF}, {EDGE}, {NODE} SELECT * FROM node",
    "graph_missing": f"WITH {LEAF}, {EDGE} SELECT src, dst FROM edge WHERE dst NOT IN (SELECT leaf_id FROM leaf)",
    "graph_degree": f"WITH {LEAF}, {EDGE}, {NODE} SELECT id, category, (SELECT count(*) FROM edge WHERE src = id) AS dependencies, (SELECT count(*) FROM edge WHERE dst = id) AS dependents FROM node",
    "graph_totals": f"""WITH {LEAF}, {EDGE}, {NODE} SELECT (SELECT count(*) FROM node) AS node_count, (SELECT count(*) FROM node WHERE category = 'indexed') AS indexed_count, (SELECT count(*) FROM node WHERE category = 'external') AS external_count,
      (SELECT count(*) FROM edge) AS edge_count, (SELECT count(*) FROM edge WHERE dst NOT IN (SELECT leaf_id FROM leaf)) AS missing_count""",
    "graph_closure": f"WITH RECURSIVE {LEAF}, {EDGE}, c AS (SELECT src, dst FROM edge UNION SELECT c.src, e.dst FROM c JOIN edge e ON e.src = c.dst) SELECT src, dst FROM c WHERE src <> dst",
    "graph_closure_no_external": f"WITH RECURSIVE {LEAF}, {EDGE}, i AS (SELECT * FROM edge WHERE dst IN (SELECT leaf_id FROM leaf)), c AS (SELECT src, dst FROM i UNION SELECT c.src, e.dst FROM c JOIN i e ON e.src = c.dst) SELECT src, dst FROM c WHERE src <> dst",
    "graph_scc": f"""WITH RECURSIVE {LINK}, c AS (SELECT src, dst FROM link UNION SELECT c.src, e.dst FROM c JOIN link e ON e.src = c.dst), ids AS (SELECT src AS id FROM link UNION SELECT dst FROM link)
      SELECT i.id, least(i.id, coalesce((SELECT min(a.dst) FROM c a JOIN c b ON b.src = a.dst AND b.dst = a.src WHERE a.src = i.id), i.id)) AS scc FROM ids i""",
    "graph_cyclic": f"""WITH RECURSIVE {LINK}, c AS (SELECT src, dst FROM link UNION SELECT c.src, e.dst FROM c JOIN link e ON e.src = c.dst), m AS (SELECT DISTINCT a.src AS id, a.dst AS other FROM c a JOIN c b ON b.src = a.dst AND b.dst = a.src),
      s AS (SELECT id, min(other) AS scc FROM m GROUP BY id) SELECT scc, string_agg(id, ',' ORDER BY id) AS members, count(*) AS size FROM s GROUP BY scc""",
    "graph_components": f"""WITH RECURSIVE {LINK}, u AS (SELECT src, dst FROM link UNION SELECT dst, src FROM link), c AS (SELECT src, dst FROM u UNION SELECT c.src, u.dst FROM c JOIN u ON u.src = c.dst) SELECT src AS id, least(src, min(dst)) AS component FROM c GROUP BY src""",
    "tree_edges": f"WITH {TREE}, {TEDGE} SELECT * FROM tedge",
    "children_page": f"""WITH {TREE}, {TEDGE}, r AS (SELECT proof_id, parent_id, child_id, row_number() OVER (PARTITION BY proof_id, parent_id ORDER BY child_order, child_id) - 1 AS "at", count(*) OVER (PARTITION BY proof_id, parent_id) AS total FROM tedge)
      SELECT *, total > 3 AS has_more FROM r WHERE "at" >= 1 AND "at" < 3""",
    "ancestry_path": f"""WITH RECURSIVE {TREE}, {TEDGE}, f AS (SELECT proof_id, child_id, min(parent_id) AS up FROM tedge GROUP BY ALL), s AS (SELECT proof_id, parent_id AS id FROM tedge UNION SELECT proof_id, child_id FROM tedge),
      a AS (SELECT proof_id, id AS node_id, id AS top, [id] AS path FROM s UNION ALL SELECT a.proof_id, a.node_id, f.up, list_prepend(f.up, a.path) FROM a JOIN f ON f.proof_id = a.proof_id AND f.child_id = a.top WHERE NOT list_contains(a.path, f.up))
      SELECT a.proof_id, a.node_id, array_to_string(a.path, '>') AS path, f.up IS NOT NULL AS cut FROM a LEFT JOIN f ON f.proof_id = a.proof_id AND f.child_id = a.top WHERE f.up IS NULL OR list_contains(a.path, f.up)""",
    "support_leaf_sets": f"""WITH RECURSIVE {TREE}, {ALLK}, {PAIR}, lf AS (SELECT proof_id, node_id FROM tree WHERE node_kind = 'leaf'),
      b AS (SELECT p.proof_id, p.node_id, p.descendant_id FROM pair p JOIN tree t ON t.proof_id = p.proof_id AND t.node_id = p.node_id AND t.node_kind = 'parent' JOIN lf ON lf.proof_id = p.proof_id AND lf.node_id = p.descendant_id UNION SELECT proof_id, node_id, node_id FROM lf)
      SELECT proof_id, node_id, count(*) AS n_leaves, string_agg(descendant_id, ',' ORDER BY descendant_id) AS support FROM b GROUP BY ALL""",
    "spread_policy": f"""WITH {TREE}, k AS (SELECT proof_id, node_id, unnest(list_distinct(child_ids)) AS child FROM tree WHERE node_kind = 'parent'), s AS (SELECT k.proof_id, k.node_id, max(coalesce(t.complexity, 3.0)) - min(coalesce(t.complexity, 3.0)) AS spread FROM k LEFT JOIN tree t ON t.proof_id = k.proof_id AND t.node_id = k.child GROUP BY ALL)
      SELECT *, spread <= 1 AS ok FROM s""",
    "change_plan": f"""WITH RECURSIVE {leaf_cte("o", f"coalesce(indexed_at < {_TIME}, true)")}, {leaf_cte("w", "deleted_at IS NULL")}, oa AS (SELECT leaf_id, {_FP} AS fp FROM o), wa AS (SELECT leaf_id, {_FP} AS fp FROM w),
      c AS (SELECT coalesce(oa.leaf_id, wa.leaf_id) AS id, CASE WHEN oa.fp IS NULL THEN 'added' WHEN wa.fp IS NULL THEN 'removed' WHEN oa.fp <> wa.fp THEN 'changed' ELSE 'same' END AS change_type FROM oa FULL JOIN wa ON oa.leaf_id = wa.leaf_id),
      e AS (SELECT DISTINCT leaf_id AS src, unnest(dependency_ids) AS dst FROM w), b AS (SELECT id FROM c WHERE change_type <> 'same' UNION SELECT e.src FROM b JOIN e ON e.dst = b.id)
      SELECT coalesce(c.id, b.id) AS id, coalesce(c.change_type, 'external') AS change_type, b.id IS NOT NULL AS is_blocked FROM c FULL JOIN b ON b.id = c.id""",
    "next_queued": f"WITH {JOB} SELECT queue_sequence, job_id FROM job WHERE job_status = 'queued' ORDER BY queue_sequence, job_id LIMIT 1",
}

# One entry a query, as above, of the operators on leaves, tags and texts.
_PLAN = f"""{leaf_cte("o", f"coalesce(indexed_at < {_TIME}, true)")}, {leaf_cte("w", "deleted_at IS NULL")}, oa AS (SELECT leaf_id, {_FP} AS fp FROM o), wa AS (SELECT leaf_id, {_FP} AS fp FROM w),
  c AS (SELECT coalesce(oa.leaf_id, wa.leaf_id) AS id, CASE WHEN oa.fp IS NULL THEN 'added' WHEN wa.fp IS NULL THEN 'removed' WHEN oa.fp <> wa.fp THEN 'changed' ELSE 'same' END AS change_type FROM oa FULL JOIN wa ON oa.leaf_id = wa.leaf_id),
  e AS (SELECT DISTINCT leaf_id AS src, unnest(dependency_ids) AS dst FROM w), b AS (SELECT id FROM c WHERE change_type <> 'same' UNION SELECT e.src FROM b JOIN e ON e.dst = b.id),
  nd AS (SELECT c.id FROM c JOIN b ON b.id = c.id WHERE change_type <> 'removed'), ed AS (SELECT * FROM e WHERE src IN (SELECT id FROM nd) AND dst IN (SELECT id FROM nd))"""
# layers over nd(id) and ed(src, dst): what waits for a cycle is one last layer
_LAYERS = """cl AS (SELECT src, dst FROM ed UNION SELECT cl.src, ed.dst FROM cl JOIN ed ON ed.src = cl.dst), bad AS (SELECT DISTINCT src AS id FROM cl WHERE src = dst), stuck AS (SELECT id FROM bad UNION SELECT src FROM cl WHERE dst IN (SELECT id FROM bad)),
  lay AS (SELECT id, 0 AS n FROM nd WHERE id NOT IN (SELECT src FROM ed) UNION SELECT ed.src, lay.n + 1 FROM lay JOIN ed ON ed.dst = lay.id WHERE ed.src NOT IN (SELECT id FROM stuck)),
  ly AS (SELECT id, max(n) AS batch, false AS cyclic FROM lay GROUP BY id UNION ALL SELECT id, (SELECT coalesce(max(n) + 1, 0) FROM lay), true FROM stuck)"""
_Q = lambda x: f"to_json({x})"
_SPAN = "coalesce(source_span.file_path || ':' || source_span.start_line || ':' || source_span.start_column || '-' || source_span.end_line || ':' || source_span.end_column, '')"
_LIST = lambda x: f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, ',') ELSE 'none' END"
_RAW = "(SELECT schema_version, declaration_id AS leaf_id, module_path, declaration_name, theorem_kind, statement_text, pretty_statement, source_span AS s, tags, dependency_ids FROM lean_declarations)"
_BLANK = lambda x: f"coalesce({strip(x)} = '', true)"
_RULES = [("schemaVersion", "schemaVersion is required.", _BLANK("schema_version")), ("id", "id is required.", _BLANK("leaf_id")), *((n, f"{n} is required.", _BLANK(c)) for n, c in (("modulePath", "module_path"), ("declarationName", "declaration_name"), ("statementText", "statement_text"), ("prettyStatement", "pretty_statement"))),
  ("theoremKind", "Unsupported theorem kind.", f"coalesce(theorem_kind NOT IN ({_words(KINDS)}), true)"), *((n, f"{n} must be an array of non-empty strings.", f"{c} IS NULL OR len(list_filter({c}, lambda e: {_BLANK('e')})) > 0") for n, c in (("tags", "tags"), ("dependencyIds", "dependency_ids"))), ("sourceSpan.filePath", "filePath is required.", _BLANK("s.file_path")),
  *((f"sourceSpan.{n}", "must be a positive integer.", f"coalesce(s.{c} <= 0, true)") for n, c in (("startLine", "start_line"), ("startColumn", "start_column"), ("endLine", "end_line"), ("endColumn", "end_column"))), ("sourceSpan.endLine", "endLine must be >= startLine.", "s.end_line < s.start_line"),
  ("sourceSpan.endColumn", "endColumn must be >= startColumn when startLine=endLine.", "s.end_line = s.start_line AND s.end_column < s.start_column")]
_FNV = lambda x: f"list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({x}, ''), lambda e: ord(e)::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_MAP = lambda d, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"

ORACLE |= {
    "text_labels": f"SELECT DISTINCT regexp_replace(trim(regexp_replace(statement_text, '{_W}+', ' ', 'g')), '\\.$', '') AS display, replace(node_id, '_', ' ') AS label, CASE WHEN coalesce(node_id, '') = '' THEN 2166136261 ELSE {_FNV('node_id')} END AS fnv FROM tree_nodes",
    "text_replies": f"WITH {TREE} SELECT proof_id, node_id, {strip('statement_text')} AS parent_statement, {strip('why')} AS why_true_from_children, len(refs)::int AS n_refs, complexity AS complexity_score FROM tree WHERE node_kind = 'parent'",
    "jaccard_pairs": f"""WITH {LEAF}, g AS (SELECT DISTINCT module_path AS tree_id, leaf_id, list_distinct(list_filter({toks("statement_text")}, lambda e: length(e) >= 3 AND e NOT IN ({_GROUPING}))) AS w FROM leaf),
      p AS (SELECT a.tree_id, a.leaf_id AS a, b.leaf_id AS b, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS j FROM g a JOIN g b ON a.tree_id = b.tree_id AND a.leaf_id < b.leaf_id) SELECT tree_id, a, b, round(j, 6) AS jaccard FROM p WHERE round(j, 6) >= 0.2""",
    "leaf_problems": "SELECT leaf_id, path, message, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT leaf_id, '{p}' AS path, '{m}' AS message FROM {_RAW} WHERE {c}" for p, m, c in _RULES) + ") GROUP BY ALL",
    "leaf_hashes": f"""WITH {LEAF} SELECT leaf_id, sha256('schema=1.0.0' || chr(10) || 'id=' || leaf_id || chr(10) || 'module=' || module_path || chr(10) || 'declaration=' || declaration_name || chr(10) || 'kind=' || theorem_kind || chr(10) || 'span=' || {_SPAN} || chr(10) || 'statement=' || {_Q("statement_text")} || chr(10) || 'pretty=' || {_Q("pretty_statement")}
      || chr(10) || 'dependencies=' || {_LIST("dependency_ids")} || chr(10) || 'tags=' || {_LIST("tags")} || chr(10) || 'source_url=none') AS hash FROM leaf""",
    "leaf_urls": f"""WITH {LEAF} SELECT leaf_id, 'https://example.org/src/' || array_to_string(list_transform(list_filter(string_split(source_span.file_path, '/'), lambda e: e <> ''), lambda e: url_encode(e)), '/') || '#L' || source_span.start_line || 'C' || source_span.start_column || '-L' || source_span.end_line || 'C' || source_span.end_column AS source_url FROM leaf""",
    "classify_rules": f"WITH {LEAF}, {TAGGED} SELECT leaf_id, adapter_id, confidence, array_to_string(tags, ',') AS tags, array_to_string(evidence, ',') AS evidence FROM tagged",
    "tag_overrides": f"""WITH {LEAF}, {TAGGED}, x AS (SELECT c.*, l.theorem_kind = 'lemma' AS forced, l.theorem_kind IN ('lemma', 'definition') AS manual, CASE WHEN l.theorem_kind = 'lemma' THEN c < 0.3 ELSE c < 0.55 END AS other FROM conf c JOIN leaf l USING (leaf_id))
      SELECT leaf_id, CASE WHEN other THEN 'lean-generic' ELSE 'kernel' END AS adapter_id, CASE WHEN other THEN 0.55 ELSE c END AS confidence, CASE WHEN forced AND other THEN 'kernel' END AS downgraded_from,
      array_to_string(CASE WHEN manual THEN list_sort(list_distinct(list_filter(list_append(CASE WHEN other THEN gen_tags ELSE own_tags END, 'concept:reviewed'), lambda e: e <> 'concept:loop'))) ELSE CASE WHEN other THEN gen_tags ELSE own_tags END END, ',') AS tags,
      array_to_string(list_filter([CASE WHEN forced AND other THEN 'low_confidence_downgrade' END, CASE WHEN manual THEN 'manual_override_applied' END], lambda e: e IS NOT NULL), ',') AS warnings FROM x""",
    "tag_report_hash": f"""WITH {LEAF}, {TAGGED}, {TAGM}, four AS (SELECT *, printf('%.4f', precision) AS a, printf('%.4f', recall) AS b, printf('%.4f', f1) AS c FROM m), mac AS (SELECT {half_up('coalesce(avg(precision), 0)')} AS a, {half_up('coalesce(avg(recall), 0)')} AS b, {half_up('coalesce(avg(f1), 0)')} AS c FROM m)
      SELECT 4 + (SELECT count(*) FROM m) AS lines, sha256('samples=' || (SELECT count(*) FROM tagged WHERE leaf_id IN (SELECT leaf_id FROM said)) || chr(10) || 'macro_precision=' || printf('%.4f', a) || chr(10) || 'macro_recall=' || printf('%.4f', b) || chr(10) || 'macro_f1=' || printf('%.4f', c) || chr(10)
      || (SELECT string_agg('tag=' || tag || '|tp=' || tp || '|fp=' || fp || '|fn=' || fn || '|precision=' || a || '|recall=' || b || '|f1=' || c, chr(10) ORDER BY tag) FROM four)) AS hash FROM mac""",
    "symbol_links": rf"""WITH {LEAF}, w AS (SELECT DISTINCT doc_id::varchar AS src, unnest(regexp_extract_all(text, '{NAME}')) AS word FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT leaf_id AS dst, declaration_name AS word FROM leaf WHERE declaration_name <> '' UNION SELECT leaf_id, string_split(declaration_name, '.')[-1] FROM leaf WHERE declaration_name <> '')
      SELECT DISTINCT src, dst FROM w JOIN s USING (word) WHERE src <> dst""",
    # graphs
    "graph_batches": f"WITH RECURSIVE {LEAF}, {EDGE}, nd AS (SELECT leaf_id AS id FROM leaf), ed AS (SELECT * FROM edge WHERE dst IN (SELECT id FROM nd)), {_LAYERS} SELECT id, batch, cyclic FROM ly",
    "graph_lookups": f"""WITH RECURSIVE {LEAF}, {EDGE}, {NODE}, q AS (SELECT DISTINCT {cid("declaration_id")} AS asked FROM missing_dependency_refs WHERE {cid("declaration_id")} IS NOT NULL), th AS (SELECT asked FROM q WHERE asked IN (SELECT id FROM node)), c AS (SELECT src, dst FROM edge UNION SELECT c.src, e.dst FROM c JOIN edge e ON e.src = c.dst)
      SELECT asked, 'declaration_not_found' AS kind, asked AS id FROM q WHERE asked NOT IN (SELECT asked FROM th) UNION ALL SELECT asked, 'dependency', dst FROM th JOIN edge ON src = asked UNION ALL SELECT asked, 'dependent', src FROM th JOIN edge ON dst = asked UNION ALL SELECT asked, 'support', dst FROM th JOIN c ON src = asked WHERE dst <> asked
      UNION ALL SELECT DISTINCT asked, 'cycle', a.dst FROM th JOIN c a ON a.src = asked JOIN c b ON b.src = a.dst AND b.dst = asked""",
    "graph_fingerprint": f"""WITH {LEAF}, {EDGE}, {NODE}, l AS (SELECT 'n|' || id || '|' || category AS l FROM node UNION ALL SELECT 'e|' || src || '|' || dst FROM edge), p AS (SELECT left(sha256(l), 3) AS p, sha256(string_agg(l, chr(10) ORDER BY l)) AS h FROM l GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY p)) AS graph_hash FROM p""",
    "graph_hash": f"""WITH RECURSIVE {LEAF}, {EDGE}, {NODE}, c AS (SELECT src, dst FROM edge UNION SELECT c.src, e.dst FROM c JOIN edge e ON e.src = c.dst), sc AS (SELECT i.id, least(i.id, coalesce((SELECT min(a.dst) FROM c a JOIN c b ON b.src = a.dst AND b.dst = a.src WHERE a.src = i.id), i.id)) AS scc FROM node i),
      g AS (SELECT string_agg(id, ',' ORDER BY id) AS m, string_agg(id, chr(1) ORDER BY id) AS o, count(*) AS n, bool_or(id IN (SELECT src FROM edge WHERE src = dst)) AS lp FROM sc GROUP BY scc),
      l AS (SELECT 0 AS k, 0 AS i, '' AS o, 'schema=1.0.0' || chr(10) || 'nodes=' || (SELECT count(*) FROM node) || chr(10) || 'edges=' || (SELECT count(*) FROM edge) || chr(10) || 'indexed=' || (SELECT count(*) FROM node WHERE category = 'indexed') || chr(10) || 'external=' || (SELECT count(*) FROM node WHERE category = 'external') || chr(10) || 'missing_refs=' || (SELECT count(*) FROM edge WHERE dst NOT IN (SELECT leaf_id FROM leaf)) AS t
        UNION ALL SELECT 1, 0, id, 'node=' || id || '|category=' || category || '|deps=' || coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edge WHERE src = id), 'none') || '|dependents=' || coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM edge WHERE dst = id), 'none') FROM node
        UNION ALL SELECT 2, rn, '', 'scc[' || rn || ']=' || m FROM (SELECT m, row_number() OVER (ORDER BY o) - 1 AS rn FROM g) UNION ALL SELECT 3, rn, '', 'cyclic_scc[' || rn || ']=' || m FROM (SELECT m, row_number() OVER (ORDER BY o) - 1 AS rn FROM g WHERE n > 1 OR lp))
      SELECT count(*) + 5 AS lines, sha256(string_agg(t, chr(10) ORDER BY k, i, o)) AS hash FROM l""",
    "graph_synthetic": "WITH RECURSIVE e AS (SELECT i AS src, i - 1 AS dst FROM range(1, 5000) r(i) UNION ALL SELECT i, i - 5 FROM range(6, 5000) r(i) WHERE i % 3 = 0), c AS (SELECT dst FROM e WHERE src = 4999 UNION SELECT e.dst FROM c JOIN e ON e.src = c.dst) SELECT (SELECT count(*) FROM e) AS edge_count, 5000::bigint AS node_count, 0::bigint AS cyclic_count, (SELECT count(*) FROM c) AS closure_size",
    # trees
    "tree_validation": f"""WITH RECURSIVE {TREE}, {ALLK}, {TOP}, {REACH} SELECT proof_id AS tree_id, 'missing_root' AS code, '' AS node_id FROM (SELECT DISTINCT proof_id FROM tree) WHERE proof_id NOT IN (SELECT proof_id FROM top) UNION ALL SELECT r.proof_id, 'missing_node', r.id FROM reach r LEFT JOIN tree t ON t.proof_id = r.proof_id AND t.node_id = r.id WHERE t.node_id IS NULL
      UNION ALL SELECT t.proof_id, 'branching_factor', t.node_id FROM tree t JOIN reached r ON r.proof_id = t.proof_id AND r.id = t.node_id WHERE t.node_kind = 'parent' AND len(t.child_ids) > 5 UNION ALL SELECT proof_id, 'not_connected', node_id FROM tree WHERE (proof_id, node_id) NOT IN (SELECT (proof_id, id) FROM reached)
      UNION ALL SELECT proof_id, 'leaf_not_preserved', node_id FROM tree WHERE node_kind = 'leaf' AND (proof_id, node_id) NOT IN (SELECT (proof_id, id) FROM reached)""",
    "children_asked": f"""WITH {TREE}, {RAWL}, {CHILD}, q AS (SELECT proof_id, node_id FROM tree UNION SELECT proof_id, child_id FROM rawl), k AS (SELECT proof_id, parent_id, child_id, row_number() OVER (PARTITION BY proof_id, parent_id ORDER BY o, child_id) - 1 AS "at", count(*) OVER (PARTITION BY proof_id, parent_id) AS total FROM child WHERE there),
      p AS (SELECT q.proof_id, q.node_id, t.node_kind, coalesce((SELECT max(total) FROM k WHERE k.proof_id = q.proof_id AND k.parent_id = q.node_id), 0) AS total FROM q LEFT JOIN tree t ON t.proof_id = q.proof_id AND t.node_id = q.node_id)
      SELECT p.proof_id, p.node_id, least(1, p.total)::int AS page_offset, 2 AS page_limit, p.total, least(1, p.total) + 2 < p.total AS has_more, CASE WHEN p.node_kind IS NULL THEN 'node_not_found' WHEN p.node_kind <> 'parent' THEN 'not_a_parent' END AS code, k."at"::int AS "at", k.child_id FROM p LEFT JOIN k ON k.proof_id = p.proof_id AND k.parent_id = p.node_id AND k."at" >= least(1, p.total) AND k."at" < least(1, p.total) + 2""",
    "tree_roots": f"WITH {TREE}, {LAST} SELECT l.proof_id, l.root_id, t.node_kind, t.statement_text, CASE WHEN t.node_kind IS NULL THEN 'missing_root' END AS code FROM lh l LEFT JOIN tree t ON t.proof_id = l.proof_id AND t.node_id = l.root_id",
    "ancestry_checked": f"""WITH RECURSIVE {TREE}, {ALLK}, {TOP}, {TEDGE}, f AS (SELECT proof_id, child_id, min(parent_id) AS up FROM tedge GROUP BY ALL), s AS (SELECT proof_id, parent_id AS id FROM tedge UNION SELECT proof_id, child_id FROM tedge),
      a AS (SELECT proof_id, id AS node_id, id AS top, [id] AS path FROM s UNION ALL SELECT a.proof_id, a.node_id, f.up, list_prepend(f.up, a.path) FROM a JOIN f ON f.proof_id = a.proof_id AND f.child_id = a.top WHERE NOT list_contains(a.path, f.up)),
      e AS (SELECT a.proof_id, a.node_id, a.path, f.up IS NOT NULL AS cut FROM a LEFT JOIN f ON f.proof_id = a.proof_id AND f.child_id = a.top WHERE f.up IS NULL OR list_contains(a.path, f.up)), c AS (SELECT e.*, CASE WHEN cut THEN 'cycle_detected' WHEN path[1] IS DISTINCT FROM top.root_id THEN 'leaf_not_reachable' END AS code FROM e LEFT JOIN top ON top.proof_id = e.proof_id)
      SELECT proof_id, node_id, array_to_string(path, ',') AS path, code IS NULL AS ok, code FROM c""",
    "provenance_join": f"WITH {LEAF}, {TREE}, r AS (SELECT proof_id, node_id, unnest(list_distinct(refs)) AS leaf_id FROM tree) SELECT r.proof_id, r.node_id, r.leaf_id, r.leaf_id AS declaration_id, l.module_path, l.declaration_name, l.theorem_kind, NULL::varchar AS source_url FROM r JOIN leaf l USING (leaf_id)",
    "provenance_paths": f"WITH RECURSIVE {TREE}, {ALLK}, {TOP}, {CHILD}, {PATHS} SELECT proof_id, node_id, array_to_string(path, '>') AS path FROM paths",
    "snapshot_violations": f"""WITH {TREE}, {RAWL}, {LAST}, e AS (SELECT DISTINCT proof_id, parent_id, child_id FROM rawl), i AS (SELECT proof_id, node_id FROM tree)
      SELECT proof_id, 'unknown_edge_parent' AS code, parent_id, child_id FROM e WHERE (proof_id, parent_id) NOT IN (SELECT (proof_id, node_id) FROM i) UNION ALL SELECT proof_id, 'unknown_edge_child', parent_id, child_id FROM e WHERE (proof_id, child_id) NOT IN (SELECT (proof_id, node_id) FROM i)
      UNION ALL SELECT DISTINCT proof_id, 'duplicate_edge', parent_id, child_id FROM (SELECT proof_id, parent_id, child_id, child_order FROM rawl GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT proof_id, 'unsupported_schema_version', '', '' FROM lh WHERE schema_version IS DISTINCT FROM '1.0.0'
      UNION ALL SELECT l.proof_id, 'missing_root', l.root_id, '' FROM lh l LEFT JOIN i ON i.proof_id = l.proof_id AND i.node_id = l.root_id WHERE i.node_id IS NULL""",
    "snapshot_import": f"""WITH {LAST}, n AS (SELECT DISTINCT l.proof_id, {cid("s.node_id")} AS node_id FROM snapshot_nodes s JOIN lh l ON l.proof_id = {cid("s.proof_id")} AND l.snapshot_id = {cid("s.snapshot_id")} AND l.delivery_no = coalesce(s.delivery_no, -1) WHERE {cid("s.node_id")} IS NOT NULL),
      e AS (SELECT DISTINCT l.proof_id, {cid("s.node_id")} AS a, unnest({cids("s.child_ids")}) AS b FROM snapshot_nodes s JOIN lh l ON l.proof_id = {cid("s.proof_id")} AND l.snapshot_id = {cid("s.snapshot_id")} AND l.delivery_no = coalesce(s.delivery_no, -1)),
      bad AS (SELECT proof_id FROM e WHERE (proof_id, b) NOT IN (SELECT (proof_id, node_id) FROM n) UNION SELECT proof_id FROM lh WHERE schema_version IS DISTINCT FROM '1.0.0' UNION SELECT l.proof_id FROM lh l LEFT JOIN n ON n.proof_id = l.proof_id AND n.node_id = l.root_id WHERE n.node_id IS NULL)
      SELECT proof_id, count(*) AS nodes FROM n WHERE proof_id NOT IN (SELECT proof_id FROM bad) GROUP BY 1""",
    "snapshot_header": f"""WITH {TREE}, {ALLK}, {TOP}, g AS (SELECT proof_id, string_agg(DISTINCT node_id, ',' ORDER BY node_id) FILTER (node_kind = 'leaf') AS leaf_ids, max(depth) AS max_depth FROM tree GROUP BY 1)
      SELECT '1.0.0' AS schema_version, t.proof_id, t.root_id, coalesce(g.leaf_ids, '') AS leaf_ids, g.max_depth, 'a75632c3c71bea58a13445a49951b87763ebd9e868fb4f51ac128e6c783e8af7' AS config_hash FROM top t JOIN g ON g.proof_id = t.proof_id""",
    "drilldown": f"""WITH RECURSIVE {TREE}, {ALLK}, {TOP}, {CHILD}, fx AS (SELECT proof_id, node_id, node_kind, len(child_ids)::int AS n, coalesce(node_kind = 'parent' AND len(child_ids) > 0, false) AS ex, coalesce(node_kind = 'parent' AND len(child_ids) BETWEEN 1 AND 4, false) AS op FROM tree),
      v AS (SELECT proof_id, root_id AS node_id, NULL::varchar AS parent_id, 0 AS d, [root_id] AS trail, '0000000000' AS place FROM top UNION ALL SELECT v.proof_id, c.child_id, v.node_id, v.d + 1, list_append(v.trail, c.child_id), v.place || '.' || lpad(c.o::varchar, 10, '0') FROM v JOIN fx ON fx.proof_id = v.proof_id AND fx.node_id = v.node_id AND fx.op JOIN child c ON c.proof_id = v.proof_id AND c.parent_id = v.node_id WHERE c.there AND c.o < 3 AND NOT list_contains(v.trail, c.child_id))
      SELECT v.proof_id, v.place, v.node_id, f.node_kind, v.d AS depth_from_root, v.parent_id, f.op AS is_expanded, f.ex AS is_expandable, f.n AS child_count, CASE WHEN f.op THEN least(f.n, 3) ELSE 0 END AS visible_count, f.n - CASE WHEN f.op THEN least(f.n, 3) ELSE 0 END AS hidden_count FROM v JOIN fx f ON f.proof_id = v.proof_id AND f.node_id = v.node_id""",
    "drilldown_codes": f"""WITH RECURSIVE {TREE}, {ALLK}, {TOP}, {REACH}, {RAWL}, q AS (SELECT proof_id, parent_id AS node_id FROM rawl UNION SELECT proof_id, child_id FROM rawl), x AS (SELECT q.*, CASE WHEN t.node_kind IS NULL THEN 'expanded_node_missing' WHEN r.id IS NULL THEN 'expanded_node_not_reachable' WHEN t.node_kind <> 'parent' THEN 'expanded_node_not_parent' END AS code
      FROM q LEFT JOIN tree t ON t.proof_id = q.proof_id AND t.node_id = q.node_id LEFT JOIN reached r ON r.proof_id = q.proof_id AND r.id = q.node_id) SELECT * FROM x WHERE code IS NOT NULL""",
    "drilldown_window": f"""WITH RECURSIVE {TREE}, {ALLK}, {TOP}, {CHILD}, fx AS (SELECT proof_id, node_id, coalesce(node_kind = 'parent' AND len(child_ids) BETWEEN 1 AND 4, false) AS op FROM tree),
      v AS (SELECT proof_id, root_id AS node_id, [root_id] AS trail, '0000000000' AS place FROM top UNION ALL SELECT v.proof_id, c.child_id, list_append(v.trail, c.child_id), v.place || '.' || lpad(c.o::varchar, 10, '0') FROM v JOIN fx ON fx.proof_id = v.proof_id AND fx.node_id = v.node_id AND fx.op JOIN child c ON c.proof_id = v.proof_id AND c.parent_id = v.node_id WHERE c.there AND NOT list_contains(v.trail, c.child_id)),
      r AS (SELECT proof_id, place, node_id, row_number() OVER (PARTITION BY proof_id ORDER BY place) - 1 AS "at", count(*) OVER (PARTITION BY proof_id) AS n FROM v), w AS (SELECT *, least(greatest(0, least(10, n - 1) - 3), n - 6) AS core FROM r) SELECT proof_id, place, node_id, "at" FROM w WHERE n <= 6 OR "at" BETWEEN core - 2 AND core + 7""",
    "tree_diff": f"""WITH RECURSIVE {ENDS}, k AS (SELECT n.side, n.proof_id || '|' || CASE WHEN n.node_kind = 'leaf' THEN 'leaf:' || n.node_id ELSE 'parent:' || coalesce(su.support, '') END AS key, n.node_id, trim(regexp_replace(n.statement_text, '{_W}+', ' ', 'g')) AS t, n.node_depth AS d FROM n LEFT JOIN su ON su.side = n.side AND su.proof_id = n.proof_id AND su.src = n.node_id AND n.node_kind IS DISTINCT FROM 'leaf'),
      p AS (SELECT side, key, row_number() OVER (PARTITION BY side, key ORDER BY node_id) AS place, t, d FROM k), o AS (SELECT * FROM p WHERE side = 'old'), w AS (SELECT * FROM p WHERE side = 'new')
      SELECT coalesce(o.key, w.key) AS key, coalesce(o.place, w.place) AS place, CASE WHEN o.key IS NULL THEN 'added' WHEN w.key IS NULL THEN 'removed' ELSE 'changed' END AS change_type FROM o FULL JOIN w ON o.key = w.key AND o.place = w.place WHERE o.key IS NULL OR w.key IS NULL OR o.t IS DISTINCT FROM w.t OR o.d IS DISTINCT FROM w.d""",
    "diff_report": f"WITH RECURSIVE {CHANGES} SELECT * FROM ch",
    "diff_summary": f"WITH RECURSIVE {CHANGES} SELECT proof_id, count(*) AS total, count(*) FILTER (type = 'added') AS added, count(*) FILTER (type = 'removed') AS removed, count(*) FILTER (type = 'changed') AS changed FROM ch GROUP BY 1",
    "diff_panel": f"""WITH RECURSIVE {CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY proof_id ORDER BY key) - 1 AS "at", count(*) OVER (PARTITION BY proof_id) AS total FROM ch), v AS (SELECT *, coalesce(baseline_statement, '') AS b, coalesce(candidate_statement, '') AS c FROM r WHERE "at" < 24),
      p AS (SELECT *, list_max(list_filter(range(0, least(length(b), length(c)) + 1), lambda k: left(b, k) = left(c, k))) AS pre FROM v), q AS (SELECT *, list_max(list_filter(range(0, least(length(b), length(c)) - pre + 1), lambda k: right(b, k) = right(c, k))) AS suf FROM p)
      SELECT proof_id, "at", key, type, node_kind, CASE WHEN support = '' THEN 0 ELSE len(string_split(support, ',')) END AS support_count, CASE WHEN type = 'changed' THEN substr(b, pre + 1, length(b) - pre - suf) END AS before, CASE WHEN type = 'changed' THEN substr(c, pre + 1, length(c) - pre - suf) END AS after, total, greatest(total - 24, 0) AS hidden FROM q""",
    # policy and quality
    "policy_decisions": f"WITH {LEAF}, {EDGE}, {TREE}, {DECIDED} SELECT proof_id, node_id, round(spread, 6) AS spread, order_violations, array_to_string(pre_codes, ',') AS pre_codes, round(evidence, 6) AS evidence, round(continuity, 6) AS continuity, n_terms, array_to_string(post_codes, ',') AS post_codes FROM dec",
    "quality_critic": f"""WITH {LEAF}, {EDGE}, {TREE}, {DECIDED}, c AS (SELECT proof_id, node_id, unnest(list_filter([CASE WHEN statement_text = '' OR why = '' OR coalesce(complexity NOT BETWEEN 1 AND 5, true) OR coalesce(abstraction NOT BETWEEN 1 AND 5, true) OR coalesce(confidence NOT BETWEEN 0 AND 1, true) THEN 'schema' END,
      CASE WHEN len(refs) = 0 OR len(list_filter(refs, lambda e: NOT list_contains(child_ids, e))) > 0 THEN 'evidence_refs' END, CASE WHEN len(terms) > 2 THEN 'term_budget' END, CASE WHEN complexity < 2 OR complexity > 4 THEN 'complexity_band' END, CASE WHEN len(own2) >= 4 AND {_share("own2", "known2")} < 0.65 THEN 'unsupported_terms' END], lambda e: e IS NOT NULL)) AS code FROM raw)
      SELECT *, CASE code WHEN 'term_budget' THEN 'term_budget' WHEN 'evidence_refs' THEN 'evidence_coverage' WHEN 'unsupported_terms' THEN 'entailment' ELSE 'vocabulary_continuity' END AS policy_code FROM c""",
    "quality_samples": f"WITH RECURSIVE {QUALITY} SELECT proof_id, node_id, depth, child_count, round(complexity_spread, 6) AS complexity_spread, prerequisite_order_violations, round(evidence_coverage_ratio, 6) AS evidence_coverage_ratio, round(vocabulary_continuity_ratio, 6) AS vocabulary_continuity_ratio, round(supported_claim_ratio, 6) AS supported_claim_ratio, introduced_term_count, round(introduced_term_rate, 6) AS introduced_term_rate, policy_violation_count FROM sample",
    "quality_metrics": f"WITH RECURSIVE {QUALITY} SELECT {METRICS} FROM sample",
    "quality_levels": f"WITH RECURSIVE {QUALITY} SELECT CASE WHEN grouping(proof_id) = 1 THEN 'all' WHEN grouping(depth) = 1 THEN 'proof' ELSE 'depth' END AS scope, proof_id, depth, {METRICS} FROM sample GROUP BY GROUPING SETS ((), (proof_id), (proof_id, depth))",
    "quality_gate": f"WITH RECURSIVE {QUALITY}, m AS (SELECT {METRICS}, 0.0 AS event_rate, 0 AS max_round FROM sample), r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS code, {v}::double AS actual, {x}::double AS expected, '{o}' AS comparator FROM m" for c, v, x, o in [
      ("unsupported_parent_rate", "unsupported_parent_rate", "0.1", "<="), ("prerequisite_violation_rate", "prerequisite_violation_rate", "0", "<="), ("policy_violation_rate", "policy_violation_rate", "0", "<="), ("term_jump_rate", "mean_term_jump_rate", "0.35", "<="), ("complexity_spread_mean", "mean_complexity_spread", "1", "<="),
      ("evidence_coverage_mean", "mean_evidence_coverage", "1", ">="), ("vocabulary_continuity_mean", "mean_vocabulary_continuity", "0.6", ">="), ("min_repartition_event_rate", "event_rate", "0", ">="), ("repartition_event_rate", "event_rate", "1", "<="), ("repartition_max_round", "max_round", "3", "<=")]) + ") SELECT *, CASE comparator WHEN '<=' THEN actual <= expected ELSE actual >= expected END AS ok FROM r",
    "baseline_compare": f"""WITH RECURSIVE {ENDS}, g AS (SELECT side, proof_id, count(*) FILTER (node_kind = 'leaf') AS leaf_count, count(*) FILTER (node_kind = 'parent') AS parent_count, max(node_depth) AS max_depth FROM n GROUP BY ALL), a AS (SELECT * FROM g WHERE side = 'old'), b AS (SELECT * FROM g WHERE side = 'new'),
      j AS (SELECT coalesce(a.proof_id, b.proof_id) AS preset_name, a.side IS NULL AS na, b.side IS NULL AS nb, a.leaf_count AS al, b.leaf_count AS bl, a.parent_count AS ap, b.parent_count AS bp, a.max_depth AS ad, b.max_depth AS bd FROM a FULL JOIN b ON a.proof_id = b.proof_id)
      SELECT preset_name, 'missing_preset' AS code, '' AS field, NULL::varchar AS expected, NULL::varchar AS actual FROM j WHERE nb UNION ALL SELECT preset_name, 'unexpected_preset', '', NULL, NULL FROM j WHERE na UNION ALL SELECT preset_name, 'field_mismatch', 'leaf_count', al::varchar, bl::varchar FROM j WHERE NOT na AND NOT nb AND al <> bl
      UNION ALL SELECT preset_name, 'field_mismatch', 'parent_count', ap::varchar, bp::varchar FROM j WHERE NOT na AND NOT nb AND ap <> bp UNION ALL SELECT preset_name, 'field_mismatch', 'max_depth', ad::varchar, bd::varchar FROM j WHERE NOT na AND NOT nb AND ad IS DISTINCT FROM bd""",
    "prereq_violations": f"""WITH RECURSIVE {TREE}, {ALLK}, {PAIR}, k AS (SELECT proof_id, node_id, unnest(child_ids) AS child, generate_subscripts(child_ids, 1) AS "at" FROM tree WHERE node_kind = 'parent'), e AS (SELECT DISTINCT node_id AS src, descendant_id AS dst FROM pair WHERE node_id <> descendant_id)
      SELECT a.proof_id, a.node_id, count(*) AS violations FROM k a JOIN e ON e.src = a.child JOIN k b ON b.proof_id = a.proof_id AND b.node_id = a.node_id AND b.child = e.dst AND b."at" > a."at" GROUP BY ALL""",
    # changes
    "change_batches": f"WITH RECURSIVE {_PLAN}, {_LAYERS} SELECT c.id, c.change_type, b.id IS NOT NULL AS is_blocked, ly.batch, ly.cyclic FROM c LEFT JOIN b ON b.id = c.id LEFT JOIN ly ON ly.id = c.id",
    "change_summary": f"""WITH RECURSIVE {_PLAN}, {_LAYERS}, x AS (SELECT c.id, c.change_type AS k, b.id IS NOT NULL AS bl, ly.batch, ly.cyclic FROM c LEFT JOIN b ON b.id = c.id LEFT JOIN ly ON ly.id = c.id), y AS (SELECT count(*) FILTER (k <> 'same') AS changed, count(*) FILTER (k = 'added') AS added, count(*) FILTER (k = 'removed') AS removed, count(*) FILTER (bl AND k <> 'removed') AS blocked, count(*) FILTER (NOT bl) AS unaffected,
      count(DISTINCT batch) AS batches, coalesce(max(cyclic::int), 0) AS cyclic_batches FROM x) SELECT *, added > 0 OR removed > 0 AS reshaped, blocked > 0 OR removed > 0 AS rebuild_required FROM y""",
    "cache_status": f"""WITH h AS (SELECT proof_id, config_hash, {idset("leaf_ids")} AS ids, row_number() OVER (PARTITION BY proof_id, config_hash ORDER BY taken_at, delivery_no, snapshot_id) AS a, row_number() OVER (PARTITION BY proof_id, config_hash ORDER BY taken_at DESC, delivery_no DESC, snapshot_id DESC) AS z FROM tree_snapshots WHERE proof_id IS NOT NULL AND config_hash IS NOT NULL)
      SELECT x.proof_id, x.config_hash, CASE WHEN x.ids = y.ids THEN 'hit' ELSE 'miss' END AS status, CASE WHEN x.ids = y.ids THEN 'cache_hit' ELSE 'cache_miss' END AS code FROM h x JOIN h y ON x.proof_id = y.proof_id AND x.config_hash = y.config_hash AND x.a = 1 AND y.z = 1""",
    "common_ancestors": f"""WITH RECURSIVE {LEAF}, {EDGE}, {TREE}, {ALLK}, {TOP}, {TEDGE}, f AS (SELECT proof_id, child_id, min(parent_id) AS up FROM tedge GROUP BY ALL), s AS (SELECT proof_id, parent_id AS id FROM tedge UNION SELECT proof_id, child_id FROM tedge),
      a AS (SELECT proof_id, id AS node_id, id AS top, [id] AS path FROM s UNION ALL SELECT a.proof_id, a.node_id, f.up, list_prepend(f.up, a.path) FROM a JOIN f ON f.proof_id = a.proof_id AND f.child_id = a.top WHERE NOT list_contains(a.path, f.up)),
      p AS (SELECT a.proof_id, a.node_id, a.path FROM a LEFT JOIN f ON f.proof_id = a.proof_id AND f.child_id = a.top JOIN top ON top.proof_id = a.proof_id AND top.root_id = a.path[1] WHERE f.up IS NULL), o AS (SELECT proof_id, node_id FROM tree WHERE node_kind = 'leaf'),
      q AS (SELECT x.proof_id, x.node_id AS a, y.node_id AS b, px.path AS u, py.path AS v FROM edge e JOIN o x ON x.node_id = e.src JOIN o y ON y.proof_id = x.proof_id AND y.node_id = e.dst JOIN p px ON px.proof_id = x.proof_id AND px.node_id = x.node_id JOIN p py ON py.proof_id = y.proof_id AND py.node_id = y.node_id WHERE e.src <> e.dst)
      SELECT proof_id, a, b, u[list_max(list_filter(range(1, least(len(u), len(v)) + 1), lambda k: u[1:k] = v[1:k]))] AS ancestor FROM q""",
    "tree_heights": f"WITH RECURSIVE {BOTH}, {LEVELS} SELECT proof_id, node_id, max(b[1]) OVER (PARTITION BY proof_id) - b[1] AS depth FROM best",
    "reuse_match": f"""WITH {TREE}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proof_id, snapshot_id ORDER BY delivery_no DESC) AS rn FROM tree_snapshots) WHERE rn = 1),
      sn AS (SELECT * EXCLUDE (rn) FROM (SELECT h.proof_id, h.snapshot_id, {cid("s.node_id")} AS node_id, s.node_kind, s.statement_text, {cids("s.child_ids")} AS child_ids, row_number() OVER (PARTITION BY h.proof_id, h.snapshot_id, {cid("s.node_id")} ORDER BY s.delivered_at DESC NULLS LAST, s.node_kind DESC NULLS LAST, s.statement_text DESC NULLS LAST, s.node_depth DESC NULLS LAST) AS rn
        FROM snapshot_nodes s JOIN h ON h.proof_id = s.proof_id AND h.snapshot_id = s.snapshot_id AND h.delivery_no = s.delivery_no WHERE {cid("s.node_id")} IS NOT NULL) WHERE rn = 1),
      both_ AS (SELECT proof_id AS k, node_id AS id, node_id, node_kind, statement_text, child_ids, true AS is_old FROM tree UNION ALL SELECT proof_id || '|' || snapshot_id, snapshot_id || '|' || node_id, node_id, node_kind, statement_text, child_ids, false FROM sn),
      c AS (SELECT k, id, is_old, unnest(child_ids) AS child, len(child_ids) AS n FROM both_ WHERE node_kind = 'parent'),
      g AS (SELECT c.k, c.id, c.is_old, list_sort(list(c.child || chr(31) || trim(regexp_replace(coalesce(b.statement_text, ''), '{_W}+', ' ', 'g')))) AS g, list_sort(list(trim(regexp_replace(coalesce(b.statement_text, ''), '{_W}+', ' ', 'g')))) AS s FROM c JOIN both_ b ON b.k = c.k AND b.is_old = c.is_old AND b.node_id = c.child GROUP BY c.k, c.id, c.is_old, c.n HAVING count(*) = c.n),
      o AS (SELECT g, s, min(id) AS old_id FROM g WHERE is_old GROUP BY ALL), w AS (SELECT id AS new_id, g, s FROM g WHERE NOT is_old), x AS (SELECT w.new_id, o.old_id, 'grounding' AS how FROM w JOIN o ON o.g = w.g), one AS (SELECT s, min(old_id) AS old_id FROM o GROUP BY s HAVING count(*) = 1)
      SELECT * FROM x UNION ALL SELECT w.new_id, one.old_id, 'signature' FROM w JOIN one ON one.s = w.s WHERE w.new_id NOT IN (SELECT new_id FROM x)""",
    # jobs
    "job_rollup": f"""WITH {JOB} SELECT leaf_id, count(*) AS jobs, count(*) FILTER (job_status = 'queued') AS n_queued, count(*) FILTER (job_status = 'running') AS n_running, count(*) FILTER (job_status = 'success') AS n_success, count(*) FILTER (job_status = 'failure') AS n_failure, count(*) FILTER (job_status = 'timeout') AS n_timeout,
      arg_max(job_id, (queue_sequence, job_id)) AS latest_job, arg_max(job_status, (queue_sequence, job_id)) AS latest_status FROM job WHERE leaf_id IS NOT NULL GROUP BY leaf_id""",
    "job_problems": f"""WITH j AS (SELECT * FROM (SELECT *, {cid("job_id")} AS id, row_number() OVER (PARTITION BY {cid("job_id")} ORDER BY updated_at DESC NULLS LAST, job_status DESC) AS rn FROM verification_jobs) WHERE rn = 1 AND id IS NOT NULL)
      SELECT id AS job_id, unnest(list_filter([CASE WHEN coalesce(job_status NOT IN ('queued', 'running', 'success', 'failure', 'timeout'), true) THEN 'unknown_status' END, CASE WHEN job_status = 'queued' AND (started_at IS NOT NULL OR finished_at IS NOT NULL OR job_result IS NOT NULL) THEN 'queued_with_run' END, CASE WHEN job_status = 'running' AND started_at IS NULL THEN 'running_without_start' END,
      CASE WHEN job_status IN ('success', 'failure', 'timeout') AND (finished_at IS NULL OR job_result IS NULL) THEN 'finished_without_result' END, CASE WHEN coalesce(timeout_ms <= 0, true) THEN 'bad_timeout' END, CASE WHEN {cid("job_target.leaf_id")} IS NULL THEN 'missing_leaf' END, CASE WHEN {cid("reproducibility.command_line")} IS NULL THEN 'missing_command' END,
      CASE WHEN len(list_filter(coalesce(logs, []), lambda e: e IS NOT NULL AND coalesce(e.stream_name NOT IN ('stdout', 'stderr', 'system'), true))) > 0 THEN 'unknown_stream' END, CASE WHEN len(list_filter(coalesce(logs, []), lambda e: e IS NOT NULL AND {cid("e.message")} IS NULL)) > 0 THEN 'blank_message' END], lambda e: e IS NOT NULL)) AS code FROM j""",
    "job_queue": f"""WITH {LEAF}, {JOB}, t AS (SELECT leaf_id, source_span.file_path AS p, row_number() OVER (ORDER BY leaf_id) - 1 AS i FROM leaf WHERE leaf_id NOT IN (SELECT leaf_id FROM job WHERE leaf_id IS NOT NULL)), m AS (SELECT coalesce(max(try_cast(regexp_extract(job_id, '^job-([0-9]+)$', 1) AS bigint)), 0) + 1 AS a, coalesce(max(queue_sequence) + 1, 0) AS q FROM job)
      SELECT 'job-' || CASE WHEN a + i < 1000000 THEN lpad((a + i)::varchar, 6, '0') ELSE (a + i)::varchar END AS job_id, q + i AS queue_sequence, leaf_id, 'queued' AS job_status, 'env lean' || CASE WHEN p IS NULL THEN '' ELSE ' ' || p END AS args FROM t, m""",
    "log_interleave": f"""WITH l AS (SELECT DISTINCT job_id, l.line_index AS i, l.stream_name AS s, l.message AS m FROM (SELECT {cid("job_id")} AS job_id, unnest(logs) AS l FROM verification_jobs) WHERE l IS NOT NULL AND job_id IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i NULLS FIRST, s NULLS FIRST, m NULLS FIRST) - 1 AS "at", count(*) OVER (PARTITION BY job_id) AS n FROM l)
      SELECT job_id, "at", CASE WHEN n > 400 THEN "at" ELSE i END AS line_index, CASE WHEN n > 400 AND "at" = 399 THEN 'system' ELSE s END AS stream_name, CASE WHEN n > 400 AND "at" = 399 THEN 'Truncated ' || (n - 399) || ' log lines.' ELSE m END AS message FROM r WHERE "at" < 400""",
    # views
    "leaf_detail": f"""WITH RECURSIVE {LEAF}, {TREE}, {ALLK}, {TOP}, {CHILD}, {PATHS}, {JOB}, ro AS (SELECT leaf_id, count(*) AS jobs, arg_max(job_id, (queue_sequence, job_id)) AS latest_job, arg_max(job_status, (queue_sequence, job_id)) AS latest_status FROM job WHERE leaf_id IS NOT NULL GROUP BY leaf_id),
      x AS (SELECT leaf_id, module_path || '.' || declaration_name AS dn, source_span.start_line || ':' || source_span.start_column || '-' || source_span.end_line || ':' || source_span.end_column AS sp, 'https://example.org/src/' || array_to_string(list_transform(list_filter(string_split(source_span.file_path, '/'), lambda e: e <> ''), lambda e: url_encode(e)), '/') || '#L' || source_span.start_line || 'C' || source_span.start_column || '-L' || source_span.end_line || 'C' || source_span.end_column AS u FROM leaf WHERE source_span.file_path IS NOT NULL)
      SELECT p.proof_id, x.leaf_id, array_to_string(p.path, '>') AS path, dn || '@' || sp AS compact, '[' || dn || '](' || u || ')' AS markdown, u AS source_url, 'source_span' AS source_url_origin, '{views.ORIGINS["source_span"][0]}' AS origin_label, coalesce(ro.jobs, 0) AS total_jobs, ro.latest_job, ro.latest_status, NULL::varchar AS code FROM x JOIN paths p ON p.node_id = x.leaf_id LEFT JOIN ro ON ro.leaf_id = x.leaf_id""",
    "leaf_detail_codes": f"""WITH RECURSIVE {LEAF}, {TREE}, {ALLK}, {TOP}, {REACH}, q AS (SELECT DISTINCT {cid("proof_id")} AS proof_id, {cid("leaf_id")} AS leaf_id FROM tree_provenance), x AS (SELECT *, CASE WHEN leaf_id NOT IN (SELECT leaf_id FROM leaf) THEN 'leaf_not_found' WHEN (proof_id, leaf_id) NOT IN (SELECT (proof_id, id) FROM reached) THEN 'leaf_not_reachable' END AS code FROM q WHERE proof_id IS NOT NULL AND leaf_id IS NOT NULL) SELECT * FROM x WHERE code IS NOT NULL""",
    "catalogue": f"""WITH {TREE}, {ALLK}, {TOP} SELECT t.proof_id, t.root_id, coalesce(r.statement_text, t.root_id) AS root_statement, 'a75632c3c71bea58a13445a49951b87763ebd9e868fb4f51ac128e6c783e8af7' AS config_hash, (SELECT count(*) FROM tree x WHERE x.proof_id = t.proof_id AND node_kind = 'leaf') AS leaf_count, (SELECT max(depth) FROM tree x WHERE x.proof_id = t.proof_id) AS max_depth
      FROM top t LEFT JOIN tree r ON r.proof_id = t.proof_id AND r.node_id = t.root_id""",
    "fully_loaded": f"WITH RECURSIVE {TREE}, {ALLK}, {TOP}, {REACH}, {CHILD} SELECT proof_id, proof_id NOT IN (SELECT c.proof_id FROM child c JOIN reached r ON r.proof_id = c.proof_id AND r.id = c.parent_id JOIN tree t ON t.proof_id = c.proof_id AND t.node_id = c.parent_id AND t.node_kind = 'parent' WHERE NOT c.there) AS loaded FROM top",
    # training data
    "p2_nodes": f"""WITH RECURSIVE {BOTH}, {LEVELS}, rc AS (SELECT proof_id, src, dst FROM lk UNION SELECT r.proof_id, r.src, k.dst FROM rc r JOIN lk k ON k.proof_id = r.proof_id AND k.src = r.dst), u AS (SELECT proof_id, src, dst FROM lk UNION SELECT proof_id, dst, src FROM lk), cc AS (SELECT proof_id, src, dst FROM u UNION SELECT c.proof_id, c.src, u.dst FROM cc c JOIN u ON u.proof_id = c.proof_id AND u.src = c.dst),
      up AS (SELECT b.proof_id, b.node_id, min(k.src) AS prev FROM best b JOIN lk k ON k.proof_id = b.proof_id AND k.dst = b.node_id JOIN best a ON a.proof_id = k.proof_id AND a.node_id = k.src AND a.b[1] = b.b[1] - 1 AND a.b[2] = b.b[2] GROUP BY ALL),
      w AS (SELECT proof_id, node_id, node_id AS path FROM best WHERE b[1] = 0 UNION ALL SELECT u.proof_id, u.node_id, w.path || ' > ' || u.node_id FROM w JOIN up u ON u.proof_id = w.proof_id AND u.prev = w.node_id)
      SELECT n.proof_id, n.node_id, least(n.node_id, coalesce((SELECT min(dst) FROM cc WHERE cc.proof_id = n.proof_id AND cc.src = n.node_id), n.node_id)) AS component_id, coalesce(b.b[2], '') AS root_id, coalesce(b.b[1], -1)::int AS hops, ((n.proof_id, n.node_id) IN (SELECT (proof_id, src) FROM rc WHERE src = dst))::int AS in_cycle, w.path,
      (SELECT count(*) FROM rc WHERE rc.proof_id = n.proof_id AND rc.src = n.node_id)::int AS n_descendants FROM nd n LEFT JOIN best b ON b.proof_id = n.proof_id AND b.node_id = n.node_id LEFT JOIN w ON w.proof_id = n.proof_id AND w.node_id = n.node_id""",
    "p3_counts": f"SELECT proof_id, record_kind, change_type, count(*) AS n FROM ({ORACLE['p3_found']}) GROUP BY ALL",
    "p5_report": f"""WITH RECURSIVE d AS (SELECT {cid("declaration_id")} AS id, indexed_at, deleted_at FROM lean_declarations),
      r AS (SELECT DISTINCT * FROM (SELECT 'lean_declarations' AS ref_table, coalesce({strip("declaration_id")}, '') AS src_key, unnest({cids("dependency_ids")}) AS ref_key, indexed_at AS t FROM lean_declarations
        UNION ALL SELECT 'missing_dependency_refs', coalesce({strip("declaration_id")}, ''), {cid("dependency_id")}, reported_at FROM missing_dependency_refs UNION ALL SELECT 'tree_provenance', coalesce({strip("node_id")}, ''), {cid("leaf_id")}, recorded_at FROM tree_provenance) WHERE ref_key IS NOT NULL),
      x AS (SELECT ref_table, src_key, ref_key, coalesce(strftime(t, '%Y-%m'), '') AS period, bool_or(ref_key NOT IN (SELECT {cid("symbol_id")} FROM shared_symbols) AND NOT EXISTS (SELECT 1 FROM d WHERE d.id = r.ref_key AND d.indexed_at <= r.t AND (d.deleted_at IS NULL OR r.t < d.deleted_at))) AS direct FROM r GROUP BY ALL),
      e AS (SELECT DISTINCT src_key, ref_key FROM x WHERE NOT direct AND ref_table = 'lean_declarations' AND src_key <> ''), s AS (SELECT DISTINCT src_key AS id, 0 AS n FROM x WHERE direct AND ref_table = 'lean_declarations' AND src_key <> '' UNION SELECT e.src_key, s.n + 1 FROM s JOIN e ON e.ref_key = s.id WHERE s.n < 100), o AS (SELECT id, min(n) AS n FROM s GROUP BY id)
      SELECT x.ref_table, x.period, count(*) FILTER (direct) AS direct, count(*) FILTER (NOT direct AND o.id IS NOT NULL) AS inherited, max(CASE WHEN direct THEN 0 ELSE o.n + 1 END) AS deepest_round FROM x LEFT JOIN o ON o.id = x.ref_key WHERE direct OR o.id IS NOT NULL GROUP BY ALL""",
}
