"""What changed between consecutive full snapshots, by Merkle trees over hash ranges of the record keys.

Every record becomes (key, digest of its compared fields), written once. The key hashes of a proof are cut into ranges of about `bottom` records,
so the tree's depth follows from the largest snapshot; a range's digest is (count, xor, sum) of its records' digests, and ranges above combine
`fanout` below. Neighbouring snapshots are compared from the top, a level at a time: only ranges under a differing one are looked at,
and only the records of bottom ranges that differ are read again and compared.

Defined results: of each snapshot only the highest delivery counts; repeated rows count once (of rows that differ the
one with the smallest digest); null or blank record ids make no record; rows of a null proof or snapshot make none; the
first snapshot of a proof gives no case; a snapshot without rows is one whose records are all removed; null and empty
arrays are equal; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.ids import clean_id, clean_ids, squash_space
from lemmaflow.session import cut_lineage

FOUND = ["proof_id", "from_snapshot_id", "to_snapshot_id", "record_kind", "record_id", "change_type"]
_KEY = ["proof_id", "record_kind", "seq"]


def latest_headers(snapshots: DataFrame) -> DataFrame:
    """One row a snapshot: its highest delivery's number, time and leaf ids."""
    ids = snapshots.select(clean_id("proof_id").alias("proof_id"), clean_id("snapshot_id").alias("snapshot_id"), F.coalesce("delivery_no", F.lit(-1)).alias("delivery_no"), "taken_at", "leaf_ids")
    ids = ids.where("proof_id IS NOT NULL AND snapshot_id IS NOT NULL")
    best = F.max_by(F.struct("taken_at", "leaf_ids"), F.struct(F.col("delivery_no"), F.col("taken_at"), F.size("leaf_ids")))
    return ids.groupBy("proof_id", "snapshot_id").agg(F.max("delivery_no").alias("delivery_no"), best.alias("h")).select("proof_id", "snapshot_id", "delivery_no", "h.taken_at", "h.leaf_ids")


def numbered(headers: DataFrame) -> DataFrame:
    """The headers with seq, the snapshot's place within its proof by taken_at, equal times by id, from 0."""
    w = Window.partitionBy("proof_id").orderBy(F.col("taken_at").asc_nulls_first(), "snapshot_id")
    return headers.withColumn("seq", F.row_number().over(w) - 1)


def _pair_digest(*fields: Column) -> Column:
    """Two independent 64-bit hashes of the fields' JSON-free canonical text."""
    text = F.concat_ws("\x1f", *(F.coalesce(f, F.lit("\x00")) for f in fields))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def node_records(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """proof_id, record_kind, seq, record_id, digest of the nodes of each snapshot's last delivery."""
    score = F.col("complexity_score")
    score = F.when(score.isNotNull(), F.format_string("%.6f", score + F.lit(0.0)))
    score = F.when(score == "-0.000000", F.lit("0.000000")).otherwise(score)
    rows = nodes.select(
        clean_id("proof_id").alias("proof_id"),
        clean_id("snapshot_id").alias("snapshot_id"),
        F.coalesce("delivery_no", F.lit(-1)).alias("delivery_no"),
        F.lit("node").alias("record_kind"),
        clean_id("node_id").alias("record_id"),
        _pair_digest(
            F.col("node_kind"),
            squash_space("statement_text"),
            F.col("node_depth").cast("string"),
            F.concat_ws("\x1e", clean_ids("child_ids")),
            F.concat_ws("\x1e", F.array_sort(F.array_distinct(clean_ids("evidence_refs")))),
            score,
        ).alias("digest"),
    ).where("record_id IS NOT NULL")
    rows = rows.join(headers.select("proof_id", "snapshot_id", "delivery_no", "seq"), ["proof_id", "snapshot_id", "delivery_no"])
    return rows.groupBy(*_KEY, "record_id").agg(F.min("digest").alias("digest"))


def leaf_records(headers: DataFrame) -> DataFrame:
    """The same columns for the leaf ids of each snapshot; a leaf has no fields, so it can't change."""
    rows = headers.select("proof_id", F.lit("leaf").alias("record_kind"), "seq", F.explode(F.array_distinct(clean_ids("leaf_ids"))).alias("record_id"))
    return rows.withColumn("digest", _pair_digest(F.col("record_id")))


def _at_level(h: Column, bits: Column) -> Column:
    """The range of a key hash among 2 ** bits ranges."""
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (64 - bits).cast("int")))


def bottom_digests(records: DataFrame, fanout_bits: int, bottom: int) -> DataFrame:
    """proof_id, record_kind, seq, depth, bucket, n, x, s: the digests of the bottom ranges; depth is the number of levels below the whole."""
    most = records.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).groupBy("proof_id", "record_kind").agg(F.max("n").alias("n"))
    levels = F.ceil(F.log2(F.col("n") / bottom) / fanout_bits)
    depth = most.select("proof_id", "record_kind", F.least(F.greatest(levels, F.lit(0)), F.lit(60 // fanout_bits)).cast("int").alias("depth"))
    placed = records.join(depth, ["proof_id", "record_kind"]).withColumn("bucket", _at_level(F.col("h"), F.col("depth") * fanout_bits))
    return placed.groupBy(*_KEY, "depth", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("record_id", "digest.a")).alias("x"), F.sum(F.xxhash64("record_id", "digest.b").cast("decimal(20,0)")).alias("s")
    )


def differing_ranges(digests: DataFrame, headers: DataFrame, fanout_bits: int) -> DataFrame:
    """proof_id, record_kind, pair (the newer snapshot's seq), bucket, depth of the bottom ranges that differ, found from the top down."""
    last = headers.groupBy("proof_id").agg(F.max("seq").alias("last"))
    deepest = digests.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    pair, out, above = ["proof_id", "record_kind", "pair", "bucket", "depth"], None, None
    for level in range(deepest + 1):
        up = F.call_function("shiftrightunsigned", F.col("bucket"), ((F.col("depth") - level) * fanout_bits).cast("int"))
        rows = digests.where(F.col("depth") >= level).select(*_KEY, "depth", up.alias("bucket"), "n", "x", "s")
        if above is not None:  # only what lies under a differing range of one of the two pairs
            wanted = above.select("proof_id", "record_kind", F.col("bucket").alias("up"), F.explode(F.array(F.col("pair") - 1, F.col("pair"))).alias("seq")).distinct()
            rows = rows.withColumn("up", F.call_function("shiftrightunsigned", F.col("bucket"), F.lit(fanout_bits))).join(wanted, ["proof_id", "record_kind", "up", "seq"], "left_semi").drop("up")
        rows = rows.groupBy(*_KEY, "depth", "bucket").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
        # a range stands in the pair with the snapshot before it and in the one with the snapshot after it
        sides = rows.select("proof_id", "record_kind", "depth", "bucket", "n", "x", "s", F.explode(F.array(F.struct(F.col("seq").alias("pair"), F.lit(1).alias("side")), F.struct((F.col("seq") + 1).alias("pair"), F.lit(0).alias("side")))).alias("p"))
        both = sides.groupBy("proof_id", "record_kind", F.col("p.pair").alias("pair"), "bucket", "depth").agg(*(F.max(F.when(F.col("p.side") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in "nxs"))
        same = F.lit(True)
        for c in "nxs":
            same = same & F.col(f"{c}0").eqNullSafe(F.col(f"{c}1"))
        both = both.where((F.col("pair") > 0) & ~same).join(last, "proof_id").where(F.col("pair") <= F.col("last")).select(*pair)
        if above is not None:
            both = both.join(above.select("proof_id", "record_kind", "pair", F.col("bucket").alias("up")), (both.proof_id == above.proof_id) & (both.record_kind == above.record_kind) & (both.pair == above.pair) & (F.call_function("shiftrightunsigned", both.bucket, F.lit(fanout_bits)) == F.col("up")), "left_semi")
        above = cut_lineage(both)
        here = above.where(F.col("depth") == level)
        out = here if out is None else out.unionByName(here)
    return out


def snapshot_changes(snapshots: DataFrame, nodes: DataFrame, fanout_bits: int = 3, bottom: int = 16) -> DataFrame:
    """proof_id, from_snapshot_id, to_snapshot_id, record_kind, record_id, change_type (added, removed, changed)."""
    headers = cut_lineage(numbered(latest_headers(snapshots)))
    records = cut_lineage(node_records(headers, nodes).unionByName(leaf_records(headers)).withColumn("h", F.xxhash64("record_id")))
    digests = cut_lineage(bottom_digests(records, fanout_bits, bottom))
    ranges = differing_ranges(digests, headers, fanout_bits)
    wanted = ranges.select("proof_id", "record_kind", "bucket", "depth", "pair", F.explode(F.array(F.struct((F.col("pair") - 1).alias("seq"), F.lit(0).alias("side")), F.struct(F.col("pair").alias("seq"), F.lit(1).alias("side")))).alias("s"))
    wanted = wanted.select("proof_id", "record_kind", "bucket", "pair", "s.seq", "s.side")
    depth = digests.select("proof_id", "record_kind", "depth").distinct()
    rows = records.join(depth, ["proof_id", "record_kind"]).withColumn("bucket", _at_level(F.col("h"), F.col("depth") * fanout_bits)).join(wanted, [*_KEY, "bucket"])
    both = rows.groupBy("proof_id", "record_kind", "pair", "record_id").agg(*(F.max(F.when(F.col("side") == k, F.col(f"digest.{c}"))).alias(f"{c}{k}") for k in (0, 1) for c in "ab"))
    change = F.when(F.col("a0").isNull(), "added").when(F.col("a1").isNull(), "removed").when((F.col("a0") != F.col("a1")) | (F.col("b0") != F.col("b1")), "changed")
    both = both.withColumn("change_type", change).where("change_type IS NOT NULL")
    name = lambda n, k: headers.select("proof_id", F.col("snapshot_id").alias(n), (F.col("seq") + k).alias("pair"))
    return both.join(name("from_snapshot_id", 1), ["proof_id", "pair"]).join(name("to_snapshot_id", 0), ["proof_id", "pair"]).select(*FOUND)


def change_counts(changes: DataFrame) -> DataFrame:
    """Number of changes a proof, kind of record and type."""
    return changes.groupBy("proof_id", "record_kind", "change_type").agg(F.count(F.lit(1)).alias("n"))
