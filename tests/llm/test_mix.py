import random

import pytest

from lemmaflow.llm import mix

DOCS = "doc_id long, text string, source string, tokens long, copies int"
MIX = "mix_id string, source string, target_share double, max_repeats int, budget_ratio double"


def make(spark, n=400):
    rng = random.Random(1)
    rows = [(i, " ".join(["proof"] * rng.randrange(1, 60)), " Big " if i % 4 else "small", 1, 1) for i in range(n)]
    return spark.createDataFrame([*rows, (9001, "a b c", None, 1, 1), (9002, None, "big", 1, 1), (9003, "", "big", 1, 1)], DOCS)


@pytest.mark.skipif(not __import__("os").path.exists(mix.DEFAULT_TOKENIZER), reason="no tokenizer here")
@pytest.mark.parametrize("part_rows,fanout", [(20_000, 64), (10, 4)])
def test_shares_caps_and_totals(spark, part_rows, fanout):
    docs = make(spark)
    targets = spark.createDataFrame([("m", "BIG", 3.0, 1, 0.5), ("m", "Small", 1.0, None, 0.5), ("m", "absent", 1.0, 2, 0.5), ("m", None, 1.0, 2, 0.5), ("c", "small", 1.0, 2, 5.0), ("c", "big", 0.0, 2, 5.0)], MIX)
    selection, wanted = mix.mixed(docs, targets, part_rows=part_rows, fanout=fanout)
    sizes = {r.doc_id: r.tokens for r in mix.token_counts(docs).collect()}
    total, longest = sum(sizes.values()) + 3, max(sizes.values())
    report = {(r.mix_id, r.source): r for r in mix.shares(selection, wanted).collect()}
    assert set(report) == {("m", "big"), ("m", "small"), ("m", "absent"), ("c", "small")}
    assert abs(report["m", "big"].tokens - 0.5 * total * 0.75) <= longest and abs(report["m", "small"].tokens - 0.5 * total * 0.25) <= longest
    assert report["m", "absent"].tokens == 0 and report["m", "big"].max_used == 1
    small = sum(r.tokens for r in mix.token_counts(docs).where("source = 'small'").collect())
    assert report["c", "small"].tokens == 2 * small and report["c", "small"].max_used == 2  # capped
    rows = [(r.mix_id, r.doc_id) for r in selection.collect()]
    assert len(rows) == len(set(rows))
    again = mix.mixed(docs.repartition(7), targets, part_rows=part_rows, fanout=fanout)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))  # partitioning changes nothing
    assert mix.shares(*mix.mixed(docs.limit(0), targets)).where("tokens > 0").count() == 0
    assert mix.mixed(docs, targets.limit(0))[0].count() == 0


def test_rounding_keeps_mass_and_is_unbiased():
    rng = random.Random(2)
    base = [[i, rng.randrange(1, 50), 0, 0.3] for i in range(60)]
    mass = sum(r[1] * r[3] for r in base)
    hits = [0] * 60
    for seed in range(400):
        rows = mix.round_part([list(r) for r in base], str(seed))
        assert sum(0 < r[3] < 1 for r in rows) <= 1
        assert abs(sum(r[1] * (r[2] + r[3]) for r in rows) - mass) < 1e-6
        for r in rows:
            hits[r[0]] += r[2] + r[3]  # the fraction that is left is rounded by chance, one level up
    assert all(0.15 < h / 400 < 0.45 for h in hits)
