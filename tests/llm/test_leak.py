import random

import numpy as np

from lemmaflow.llm import leak

DOCS = "doc_id long, text string, item_id long"
ITEMS = "item_id long, passage string, prompt string, doc_id long"
RNG = random.Random(5)
WORDS = [f"word{i}" for i in range(300)]
PASSAGE = [RNG.choice(WORDS) for _ in range(60)]
NOISE = lambda n: " ".join(RNG.choice(["alpha", "beta", "gamma", "delta", *WORDS[:20]]) for _ in range(n))


def test_fm_index_finds_and_locates_every_phrase():
    rng = np.random.default_rng(3)
    sym = rng.integers(1, 5, 400).astype(np.int32)
    sym[[100, 250, 399]] = 0
    sym[110:140] = sym[10:40]  # a long repeat
    index = leak.FMIndex(sym, sample=4)
    text = sym.tolist()
    for size in (1, 2, 4, 9):
        phrases = [text[i : i + size] for i in range(0, 390, 7) if 0 not in text[i : i + size]] + [[4] * size]
        lo, hi = index.search(np.array([p[::-1] for p in phrases], np.int64), np.full(len(phrases), size))
        for p, a, b in zip(phrases, lo, hi):
            expected = [i for i in range(len(text) - size + 1) if text[i : i + size] == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_exact_altered_and_short_copies(spark):
    p = PASSAGE
    altered = [w for k, w in enumerate(p[:45]) for w in ([] if k % 14 == 6 else ["other_word"] if k % 14 == 13 else [w])]
    texts = {
        1: NOISE(30) + " " + " ".join(p[5:17]) + " " + NOISE(30),  # 12 words
        2: NOISE(30) + " " + " ".join(p[5:16]) + " " + NOISE(30),  # 11 words
        3: "> " + "\n> ".join(" ".join(p[k : k + 4]) for k in range(0, 24, 4)).upper(),
        4: " ".join(f"**{w}**," if k % 3 else f"<i>{w}</i>" for k, w in enumerate(p[20:40])),
        5: NOISE(10) + " " + " ".join(altered) + " " + NOISE(10),
        6: " ".join(altered[:15]),  # an altered copy that is too short
        7: NOISE(200), 8: "", 9: None, 10: "instruction shared by many items " * 20,
    }
    docs = spark.createDataFrame([(k, t, 7) for k, t in texts.items()] + [(11, texts[1], 7), (None, texts[1], 7)], DOCS)
    items = spark.createDataFrame([(100, " ".join(p).capitalize() + ".", "instruction shared by many items", 1), (101, "too short", "x", 1), (102, None, "x", 1), (103, "", None, 1), (104, " ".join(p), "x", 1)], ITEMS)
    spans = leak.leaked_spans(docs, items, shard_pieces=100)
    got = sorted((r.doc_id, r.item_id) for r in leak.found(spans).collect())
    assert got == [(d, i) for d in (1, 3, 4, 5, 11) for i in (100, 104)]
    one = spans.where("doc_id = 1 AND item_id = 100").first()
    assert leak.normalize(texts[1])[one.first_char : one.last_char] == " ".join(p[5:17]) and one.run_words == 12
    assert leak.found(leak.leaked_spans(docs.limit(0), items)).count() == 0 and leak.found(leak.leaked_spans(docs, items.limit(0))).count() == 0


def test_against_brute_force_on_random_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6)]  # few words: many chance matches
    items = [(k, " ".join(rng.choice(words) for _ in range(25))) for k in range(5)]
    docs = []
    for d in range(40):
        t = [rng.choice(words) for _ in range(60)]
        if d % 4 == 0:
            k, n, at = rng.randrange(5), rng.randrange(9, 16), rng.randrange(9)
            t[20:20] = items[k][1].split()[at : at + n]
        docs.append((d, " ".join(t)))
    grams = lambda t: {tuple(t[i : i + 12]) for i in range(len(t) - 11)}
    expected = sorted((d, k) for d, t in docs for k, p in items if grams(t.split()) & grams(p.split()))
    spans = leak.leaked_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), altered_words=1000)
    assert sorted((r.doc_id, r.item_id) for r in leak.found(spans).collect()) == expected


def test_two_altered_words_with_one_between_them_do_not_end_a_copy():
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]

    def found(altered, n):
        text = " ".join(f"zz{i}" if i in altered else w for i, w in enumerate(words[:n]))
        return leak.search_shard([(7, f"so {text} end")], leak.Passages([(1, " ".join(words[:n]))], 5), 12, 30, 0.8)

    assert [r[5:] for r in found({9, 11, 20}, 30)] == [(30, 27)]
    assert all(found(set(range(k - 1, 60, k)), 60) for k in (6, 7, 8, 10, 14))
