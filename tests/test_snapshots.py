from datetime import datetime as T

from lemmaflow.operators import snapshots

H = "proof_id string, snapshot_id string, delivery_no int, leaf_ids array<string>, taken_at timestamp, bucket int"
N = "proof_id string, snapshot_id string, delivery_no int, node_id string, node_kind string, statement_text string, node_depth int, child_ids array<string>, evidence_refs array<string>, complexity_score double, record_kind string"


def test_changes_between_neighbours(spark, rows):
    heads = [("p", "s2", 1, ["a", " b ", "b", None], T(2025, 1, 2), 0), ("p", "s1", 1, ["zz"], T(2025, 1, 1), 0), ("p", "s1", 2, ["a"], T(2025, 1, 1), 0), ("q", "t1", 1, None, T(2025, 1, 1), 0), ("p", "s3", 1, ["a", "b"], T(2025, 1, 3), 0)]
    n = lambda s, d, i, text="x", depth=0, kids=None, refs=None, score=1.0: ("p", s, d, i, "leaf", text, depth, kids, refs, score, "k")
    nodes = [
        n("s1", 1, "old"), n("s1", 2, "a", "x  y"), n("s1", 2, "b", refs=["r", "q"]), n("s1", 2, "c", kids=["1", "2"]), n("s1", 2, "gone"),
        n("s2", 1, "a", " x y "), n("s2", 1, "a", " x y "), n("s2", 1, "b", refs=["q", "r ", "r"], score=1.00000000001), n("s2", 1, "c", kids=["2", "1"]), n("s2", 1, "new", kids=[]), n("s3", 1, "a", "x y"),
    ]
    got = rows(snapshots.snapshot_changes(spark.createDataFrame(heads, H), spark.createDataFrame(nodes, N)))
    assert got == sorted([("p", "s1", "s2", "leaf", "b", "added"), ("p", "s1", "s2", "node", "c", "changed"), ("p", "s1", "s2", "node", "gone", "removed"), ("p", "s1", "s2", "node", "new", "added"), ("p", "s2", "s3", "node", "b", "removed"), ("p", "s2", "s3", "node", "c", "removed"), ("p", "s2", "s3", "node", "new", "removed")], key=repr)
    for fanout_bits, bottom in ((1, 1), (2, 2), (3, 1)):  # the tree's shape doesn't matter
        assert rows(snapshots.snapshot_changes(spark.createDataFrame(heads, H), spark.createDataFrame(nodes, N), fanout_bits, bottom)) == got
    assert rows(snapshots.snapshot_changes(spark.createDataFrame([], H), spark.createDataFrame([], N))) == []


def test_few_changes_in_a_large_snapshot_open_few_ranges(spark, rows):
    """100,000 nodes, 10 of them changed: the records below the differing ranges are a small part."""
    from pyspark.sql import functions as F

    n = 100_000
    heads = spark.createDataFrame([("p", "s1", 1, None, T(2025, 1, 1), 0), ("p", "s2", 1, None, T(2025, 1, 2), 0)], H)
    base = spark.range(n).select(F.lit("p").alias("proof_id"), F.lit(1).alias("delivery_no"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.lit("leaf").alias("node_kind"), F.lit(0).alias("node_depth"), F.array().cast("array<string>").alias("child_ids"), F.array().cast("array<string>").alias("evidence_refs"), F.lit(1.0).alias("complexity_score"), F.col("id"))
    nodes = base.select("*", F.lit("s1").alias("snapshot_id"), F.lit("x").alias("statement_text")).unionByName(base.select("*", F.lit("s2").alias("snapshot_id"), F.when(F.col("id") % 10_000 == 7, "y").otherwise("x").alias("statement_text")))
    got = rows(snapshots.snapshot_changes(heads, nodes))
    assert got == sorted([("p", "s1", "s2", "node", f"n{i * 10_000 + 7}", "changed") for i in range(10)], key=repr)
    headers = snapshots.numbered(snapshots.latest_headers(heads))
    records = snapshots.node_records(headers, nodes).withColumn("h", F.xxhash64("record_id"))
    digests = snapshots.bottom_digests(records, 3, 16)
    ranges = snapshots.differing_ranges(digests, headers, 3)
    opened = digests.join(ranges.select("bucket"), "bucket", "left_semi").agg(F.sum("n")).first()[0]
    assert ranges.count() <= 10 and opened < n / 100
