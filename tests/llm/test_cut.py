import random

import numpy as np

from lemmaflow.llm import cut

DOCS = "doc_id long, text string, lang string, source string, chars int, a long"


def corpus(seed=4, n=1500):
    """Sentences of fixed patterns with names; every tenth text is cut at random inside a sentence."""
    rng = random.Random(seed)
    nouns, verbs = ["lattice", "journal", "segment", "witness", "pointer", "budget"], ["restores", "narrows", "exposes", "balances"]
    name = lambda: f"{rng.choice(nouns)}_{rng.choice(verbs)}_{rng.choice(nouns)}{rng.randrange(100)}"
    pattern = ["The lemma {} shows that every {} needs the {} before {} stops.", "Without {} the {} would let a reader see the {} of {}.", "After the rewrite {} closes the {} and {} follows from {}."]
    rows, truth = [], set()
    for i in range(n):
        text = " ".join(rng.choice(pattern).format(name(), rng.choice(nouns), rng.choice(nouns), name()) for _ in range(rng.randrange(4, 9)))
        if i % 7 == 3:
            text += "\n\nSee also: " + name()
        if i % 10 == 0:
            at = rng.randrange(120, 200)
            while text[at - 1] in ". " or text[at - 2] == ".":
                at += 1
            text = text[:at] + rng.choice(["", "...", "…", " [truncated]"])
            truth.add(i)
        rows.append((i, text, rng.choice(["en", "EN ", "eng", None]), "s%d" % (i % 3), 1, 1))
    return rows, truth


def test_planted_cuts_are_found(spark):
    rows, truth = corpus()
    copies = [(5000 + k, rows[10][1], "en", "S0 ", 1, 1) for k in range(700)]  # a third of all: copies of one cut text
    odd = [(9001, None, "en", "s0", 1, 1), (9002, "", "en", "s0", 1, 1), (9003, " ... ", "en", None, 1, 1), (9004, "x" * 300_000, "en", "s0", 1, 1)]
    docs = spark.createDataFrame(rows + copies + odd, DOCS)
    found = {r.doc_id for r in cut.found(cut.truncated_documents(docs)).collect()}
    own = found - set(range(5000, 9999))
    right = len(own & truth)
    assert right >= 0.9 * len(truth) and right >= 0.9 * len(own), (right, len(truth), len(own))
    assert {c[0] for c in copies} <= found and not found & {9001, 9002, 9003}
    report = {r.source: r for r in cut.truncation_report(docs, cut.truncated_documents(docs)).collect()}
    assert report["s0"].documents > 1000 and 0 < report["s1"].share < 0.3 and report[""].truncated == 0
    assert cut.found(cut.truncated_documents(docs.limit(0))).count() == 0


def test_window_hashes_depend_on_the_window_only():
    a, b = cut.Windows(["xxabcde", "q"]), cut.Windows(["abcd"])
    assert a.hashes(np.array([6]), 4, 1) == b.hashes(np.array([4]), 4, 1)
    assert a.hashes(np.array([6]), 4, 1) != b.hashes(np.array([4]), 4, 2)
    assert a.hashes(np.array([6]), 4, 1) != a.hashes(np.array([7]), 4, 1)
