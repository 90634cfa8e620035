"""Totals in a total order, and joins with hot keys, in which no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from takerank.operators.shared import saved


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with columns that hold, for each row, the sums over the rows before it in order (0 for the first).

    The rows are sorted over many tasks and stored; each part then adds up its own and the totals of the
    parts before it, of which there is a row each.
    """
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    rows = saved(df.withColumns(values).orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)  # a row a part
    totals = rows.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    totals = totals.select("_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_b{v}") for v in values])
    inside = W.Window.partitionBy("_part").orderBy("_id").rowsBetween(W.Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(totals), "_part")
    own = {name: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_b{v}") for name, v in zip(sums, values, strict=True)}
    return out.withColumns(own).drop("_part", "_id", *values, *[f"_b{v}" for v in values])


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its place in a total order, from 1."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("int"))
