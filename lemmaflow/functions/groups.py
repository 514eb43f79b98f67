"""Kernels over groups of rows, many small groups a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.session import cut_lineage


def by_group(df: DataFrame, keys: list[str], order: list[str | Column], kernel: Callable[[tuple, dict[str, list]], Iterator[tuple]], schema: str, rows: int = 20_000) -> DataFrame:
    """kernel(key, the group's columns as lists, in order) gives tuples of the schema. Groups follow each other within a sorted partition, so that
    what a small group costs is its rows; results are given out `rows` at a time. A group is held whole by one task: the caller bounds its size."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = df.columns
    width = len(keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key, held = None, {c: [] for c in columns}
        for pdf in parts:
            cols = [pdf[c].tolist() for c in columns]
            marks = list(zip(*cols[:width]))
            start, n = 0, len(marks)
            while start < n:
                end = start
                while end < n and marks[end] == marks[start]:
                    end += 1
                if key is not None and marks[start] != key:
                    for r in kernel(key, held):
                        out.append(r)
                        if len(out) >= rows:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                    held = {c: [] for c in columns}
                key = marks[start]
                for c, values in zip(columns, cols):
                    held[c] += values[start:end]
                start = end
        if key is not None:
            for r in kernel(key, held):
                out.append(r)
                if len(out) >= rows:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    placed = df.select(*keys, *(c for c in columns if c not in keys))
    columns = placed.columns
    return placed.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with the place of each row in the order of all, from 0: ranges are sorted apart, and each range's places begin after the rows of the ranges before it, so no task sees all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    part = F.shiftright("_at", 33)
    size = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = size.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    out = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def salted(df: DataFrame, keys: list[str], by: str, rows: int) -> DataFrame:
    """df with `salt`: groups of more than `rows` rows are split by the hash of column `by`."""
    size = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("salts")).where("salts > 1")
    return df.join(size, keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
