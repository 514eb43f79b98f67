"""References to records that do not exist at the time of the referring row.

Direct orphans come from one join of the references with the spans of time in which each declaration exists. The
cascade then walks down the foreign keys: whoever refers to a declaration that is orphaned inherits it, round after
round by semi-joins against the last round's declarations, until no new one is met.

Defined results: null and blank references are no reference; a null time of the referring row gives period '' and counts
as a time at which nothing exists; null indexed_at means the declaration was never there; rows of a null key keep ''
as src_key; repeated rows count once; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.ids import clean_id, clean_ids, strip_space
from lemmaflow.session import cut_lineage

FOUND = ["ref_table", "src_key", "ref_key", "period", "reason"]


def references(declarations: DataFrame, missing_refs: DataFrame, provenance: DataFrame) -> DataFrame:
    """ref_table, src_key, ref_key, at: one row a distinct reference."""
    key = lambda c: F.coalesce(strip_space(c), F.lit(""))
    a = declarations.select(F.lit("lean_declarations").alias("ref_table"), key("declaration_id").alias("src_key"), F.explode(clean_ids("dependency_ids")).alias("ref_key"), F.col("indexed_at").alias("at"))
    b = missing_refs.select(F.lit("missing_dependency_refs").alias("ref_table"), key("declaration_id").alias("src_key"), clean_id("dependency_id").alias("ref_key"), F.col("reported_at").alias("at"))
    c = provenance.select(F.lit("tree_provenance").alias("ref_table"), key("node_id").alias("src_key"), clean_id("leaf_id").alias("ref_key"), F.col("recorded_at").alias("at"))
    return a.unionByName(b).unionByName(c).where("ref_key IS NOT NULL").distinct()


def lifespans(declarations: DataFrame) -> DataFrame:
    """ref_key, since, until: disjoint spans in which the declaration exists. A running window merges overlapping ones, so no declaration's rows are gathered."""
    far = F.to_timestamp(F.lit("9999-12-31 00:00:00"))
    rows = declarations.select(clean_id("declaration_id").alias("ref_key"), F.col("indexed_at").alias("since"), F.coalesce("deleted_at", far).alias("until")).where("ref_key IS NOT NULL AND since IS NOT NULL")
    rows = rows.groupBy("ref_key", "since").agg(F.max("until").alias("until"))
    before = Window.partitionBy("ref_key").orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", F.coalesce(F.col("since") > F.max("until").over(before), F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(Window.partitionBy("ref_key").orderBy("since")))
    return rows.groupBy("ref_key", "island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("island")


def labelled(refs: DataFrame, declarations: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_table, src_key, ref_key, period, reason (missing, late, deleted; null where the reference leads somewhere at its time) of the distinct references."""
    spans = lifespans(declarations)
    known = spans.groupBy("ref_key").agg(F.min("since").alias("first"))
    there = declarations.select(clean_id("declaration_id").alias("ref_key")).where("ref_key IS NOT NULL").distinct().join(known, "ref_key", "left").withColumn("known", F.lit(True))
    shared = symbols.select(clean_id("symbol_id").alias("ref_key")).where("ref_key IS NOT NULL").distinct().withColumn("shared", F.lit(True))
    r, s = refs.join(shared, "ref_key", "left").alias("r"), spans.alias("s")
    # at most one span holds the time, so a hot key isn't multiplied; the next join uses the same distribution
    held = r.join(s, (F.col("r.ref_key") == F.col("s.ref_key")) & (F.col("s.since") <= F.col("r.at")) & (F.col("r.at") < F.col("s.until")), "left").select("r.*", F.col("s.since").alias("held"))
    j = held.join(there, "ref_key", "left")
    reason = F.when(F.col("shared") | F.col("held").isNotNull(), None).when(F.col("known").isNull(), "missing").when((F.col("first") > F.col("at")) | F.col("first").isNull(), "late").otherwise("deleted")
    return j.select("ref_table", "src_key", "ref_key", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("period"), reason.alias("reason")).distinct()


def cascade(references: DataFrame) -> DataFrame:
    """ref_table, src_key, ref_key, period, reason, kind ('direct' or 'inherited'), round, over labelled references.

    A declaration with a direct orphan among its references is orphaned in round 0; references to a declaration
    orphaned in round n are inherited in round n + 1, unless they are direct already. Rounds go on until one finds nothing new.
    """
    rows = cut_lineage(references)
    whole = rows.groupBy("ref_table", "src_key", "ref_key", "period").agg(F.max("reason").alias("reason")).where("reason IS NULL")
    inner = cut_lineage(whole.where("ref_table = 'lean_declarations' AND src_key <> ''").select("src_key", "ref_key").distinct())
    front = rows.where("reason IS NOT NULL AND ref_table = 'lean_declarations' AND src_key <> ''").select(F.col("src_key").alias("ref_key")).distinct()
    seen = front = cut_lineage(front.withColumn("round", F.lit(0)))
    n = 0
    while not front.isEmpty():
        n += 1
        up = inner.join(front.select("ref_key"), "ref_key", "left_semi").select(F.col("src_key").alias("ref_key")).distinct()
        front = cut_lineage(up.join(seen, "ref_key", "left_anti").withColumn("round", F.lit(n)))
        seen = seen.unionByName(front)
        if n % 10 == 0:
            seen = cut_lineage(seen)
    direct = rows.where("reason IS NOT NULL").select("ref_table", "src_key", "ref_key", "period", "reason", F.lit("direct").alias("kind"), F.lit(0).alias("round"))
    inherited = whole.drop("reason").join(seen, "ref_key").select("ref_table", "src_key", "ref_key", "period", F.lit(None).cast("string").alias("reason"), F.lit("inherited").alias("kind"), (F.col("round") + 1).alias("round"))
    return direct.unionByName(inherited)


def found(cascaded: DataFrame) -> DataFrame:
    """The direct orphans as cases."""
    return cascaded.where("kind = 'direct'").select(*FOUND)


def report(cascaded: DataFrame) -> DataFrame:
    """Direct and inherited orphan references a table and month; a reference that is orphaned for several reasons in a month is one."""
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return cascaded.drop("reason").distinct().groupBy("ref_table", "period").agg(kind("direct").alias("direct"), kind("inherited").alias("inherited"), F.max("round").alias("deepest_round"))
