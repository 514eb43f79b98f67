from lemmaflow.operators import logs

JOBS = "job_id string, logs array<struct<line_index:int,stream_name:string,message:string>>, route string"
LINES = [
    (0, "stdout", "checker starting"), (1, "stdout", "2025-12-19T19:12:29.257Z ERROR resolver: retry 1"), (2, "stdout", "  > 2025-12-19T19:12:31.954Z ERROR linter: nested"), (3, "stderr", "== build =="),
    (4, "stdout", None), (5, "stdout", "\x1b[33m1763294719772|D|kernel|open goal\x1b[0m"), (6, "stdout", "h0 : quota x < 53"), (7, "stderr", "Lib/Arith.lean:3:36: error: bad"), (8, "system", "Output was shortened."),
    (9, "stdout", "{"), (10, "stdout", '  "level": "info", "msg": "in braces"'), (11, "stdout", "}"), (12, "stdout", "I0515 06:33:50.189314 77 lake.build.cc:184] folded"), (13, "stdout", "Dec 19 19:12:18 cache[4180]: <warning> slow"),
    (14, "stdout", "ts=2025-08-28T19:36:27+00:00 level=info component=linter msg=\"said so\""), (15, "stdout", "INFO: tactic: checked"), (16, "stdout", "[16:37:10] error (linter) report"), (17, "stdout", "30/01/2025 23:04:38,586 - kernel - deep"),
    (18, "stdout", "caused by: retry 2025"), (19, "stdout", "plan: 1 target"),
]


def test_entries_and_fields(spark, rows):
    df = spark.createDataFrame([("j ", [*LINES[::-1], None], "x"), ("j", LINES, "x"), (None, LINES, "x"), ("k", [], "x"), ("l", None, "x")], JOBS)
    placed = logs.placed_lines(df)
    assert rows(logs.found(placed)) == sorted([("j", *x) for x in [(1, 4), (5, 6), (7, 7), (8, 8), (9, 11), (12, 12), (13, 13), (14, 14), (15, 15), (16, 16), (17, 19)]], key=repr)
    got = {r.first_index: (r.time_text, r.level, r.component, r.message) for r in logs.entries(placed).collect()}
    assert got[1] == ("2025-12-19T19:12:29.257Z", "ERROR", "resolver", "retry 1\n  > 2025-12-19T19:12:31.954Z ERROR linter: nested\n")
    assert got[5] == ("1763294719772", "DEBUG", "kernel", "open goal\nh0 : quota x < 53")
    assert got[8] == (None, None, None, "Output was shortened.")
    assert got[9][1:] == ("INFO", None, "in braces")
    assert got[14][1:] == ("INFO", "linter", "said so")
    assert got[16] == ("16:37:10", "ERROR", "linter", "report")
    assert got[17][2:] == ("kernel", "deep\ncaused by: retry 2025\nplan: 1 target")
    assert got[12] == ("0515 06:33:50.189314", "INFO", "lake.build", "folded") and got[13] == ("Dec 19 19:12:18", "WARNING", "cache", "slow")
    assert rows(logs.found(logs.placed_lines(df.limit(0)))) == []


def test_templates_merge():
    tree = logs.TemplateTree(0.6)
    for t in ("a b c d", "a b c e", "x y z w"):
        tree.add("r", t.split())
    assert sorted(" ".join(t.tokens) for t in tree.leaves["r"]) == ["a b c <*>", "x y z w"]


def raw_templates(lines, least=0.6):
    """Every distinct line as a template of its own: no tree."""
    p = logs.Patterns()

    def own(parts):
        import pandas as pd

        for pdf in parts:
            out = [(h, *p.head(t, p.slots(t))) for h, t in zip(pdf["h"], pdf["text"])]
            yield pd.DataFrame([(h, str(h), "", 1, lay if lay not in ("", "level") else None, c, m) for h, lay, c, m in out], columns=["h", "template_id", "template", "n", "layout", "comp_at", "msg_at"])

    rows = lines.where("text IS NOT NULL").select("h", "text").distinct().mapInPandas(own, "h long, template_id string, template string, n long, layout string, comp_at int, msg_at int")
    return rows.select("h", "template_id"), rows.drop("h")


def test_templates_decide_what_begins_an_entry(spark, rows, monkeypatch):
    good = [(i, "stdout", f"2025-12-19T19:12:{i:02}Z resolver: retry of goal_{i}") for i in range(20)]
    bad = [(20, "stdout", "2025-12-19T19:1 resolver: retry of goal_x"), (21, "stdout", "goes on"), (22, "stdout", "info lemma checked a_b"), (23, "stdout", "warn lemma checked c_d"), (24, "stdout", "error was met twice in all")]
    df = spark.createDataFrame([("j", [*good, *bad])], "job_id string, logs array<struct<line_index:int,stream_name:string,message:string>>")
    expected = [("j", i, i) for i in range(20)] + [("j", 20, 21), ("j", 22, 22), ("j", 23, 24)]
    assert rows(logs.found(logs.placed_lines(df))) == sorted(expected, key=repr)
    monkeypatch.setattr(logs, "templates_of", raw_templates)
    assert rows(logs.found(logs.placed_lines(df))) == sorted([("j", i, i) for i in range(19)] + [("j", 19, 24)], key=repr)


def test_nothing_of_a_long_line_is_lost_and_blocks_agree(spark, rows, monkeypatch):
    bars, words = "1763294719772|I|kernel|" + "|".join(f"f{i}" for i in range(1500)), "INFO: tactic: " + " ".join(f"w{i}" for i in range(100_500))
    twice = "2025-12-19T19:12:29Z ERROR resolver: since 2025-12-18T01:02:03Z late"
    lines = [(0, "stdout", bars), (1, "stdout", words), (2, "stdout", twice), *((i, "stdout", "more") for i in range(3, 40))]
    df = spark.createDataFrame([("j", lines), ("k", [(5, "system", "a"), (9, "stdout", "b")])], "job_id string, logs array<struct<line_index:int,stream_name:string,message:string>>")
    got = {r.first_index: r.message for r in logs.entries(logs.placed_lines(df)).where("job_id = 'j'").collect()}
    assert got[0].endswith("|f1499") and got[0].startswith("f0|") and got[1].endswith(" w100499") and got[1].startswith("w0 ") and got[2].startswith("since 2025-12-18T01:02:03Z late\nmore")
    whole = rows(logs.found(logs.placed_lines(df)))
    assert whole == [("j", 0, 0), ("j", 1, 1), ("j", 2, 39), ("k", 5, 5)]
    monkeypatch.setattr(logs, "BLOCK", 4)
    monkeypatch.setattr(logs, "PIECE", 1)
    assert rows(logs.found(logs.placed_lines(df))) == whole


def test_similar_templates_are_found_by_their_rarest_places():
    import random

    rng, fast, slow = random.Random(1), logs.TemplateTree(0.6), []
    for _ in range(400):
        tokens = [rng.choice("abcdef") if rng.random() < 0.8 else f"v{rng.randrange(99)}" for _ in range(7)]
        score, k = max(((logs.similarity(t, tokens), -i) for i, t in enumerate(slow)), default=(0.0, 0))
        if score >= 0.6:
            slow[-k] = [x if x == y else "<*>" for x, y in zip(slow[-k], tokens)]
        else:
            slow.append(tokens)
        fast.add("r", tokens)
    assert [t.tokens for t in fast.leaves["r"]] == slow
