"""Ordered scans over groups that may hold a third of all rows: windows run within segments, summaries of the segments carry the state across.

A segment is a column whose order agrees with the order of the rows (a prefix of the key, a range of positions), so that a group's rows
are many tasks' work and only one short row a segment meets in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _inner(group: str, segment: str, order: list[str]):
    return Window.partitionBy(group, segment).orderBy(*order)


def _summary(df: DataFrame, group: str, segment: str, **values: Column) -> DataFrame:
    """One row a segment; nulls of group and segment meet themselves."""
    return df.groupBy(F.col(group).alias("_g"), F.col(segment).alias("_s")).agg(*[v.alias(k) for k, v in values.items()])


def _back(df: DataFrame, summary: DataFrame, group: str, segment: str) -> DataFrame:
    return df.join(summary, df[group].eqNullSafe(summary["_g"]) & df[segment].eqNullSafe(summary["_s"]), "left").drop("_g", "_s")


def _outer():
    return Window.partitionBy("_g").orderBy("_s")


def _before():
    return _outer().rowsBetween(Window.unboundedPreceding, -1)


def running_last(df: DataFrame, group: str, segment: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name: the last value that is not null at or before each row of the group."""
    rows = df.withColumn("_v", value)
    local = F.last("_v", ignorenulls=True).over(_inner(group, segment, order).rowsBetween(Window.unboundedPreceding, 0))
    s = _summary(rows, group, segment, _last=F.max_by(F.when(F.col("_v").isNotNull(), F.col("_v")), F.when(F.col("_v").isNotNull(), F.struct(*order))))
    s = s.withColumn("_carry", F.last("_last", ignorenulls=True).over(_before())).drop("_last")
    return _back(rows.withColumn("_local", local), s, group, segment).withColumn(name, F.coalesce("_local", "_carry")).drop("_v", "_local", "_carry")


def running_sum(df: DataFrame, group: str, segment: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value up to and with each row of the group; null while there is none."""
    rows = df.withColumn("_v", value)
    local = F.sum("_v").over(_inner(group, segment, order).rowsBetween(Window.unboundedPreceding, 0))
    s = _summary(rows, group, segment, _all=F.sum("_v"))
    s = s.withColumn("_carry", F.sum("_all").over(_before())).drop("_all")
    return _back(rows.withColumn("_local", local), s, group, segment).withColumn(name, F.coalesce(F.col("_local") + F.col("_carry"), "_local", "_carry")).drop("_v", "_local", "_carry")


def neighbour(df: DataFrame, group: str, segment: str, order: list[str], values: dict[str, Column], ahead: bool = True) -> DataFrame:
    """df with columns of values taken from the next (or the previous) row of the group; null at its end."""
    inner = _inner(group, segment, order)
    pack = F.struct(*[v.alias(k) for k, v in values.items()])
    rows = df.withColumn("_v", pack)
    local = (F.lead if ahead else F.lag)("_v").over(inner)
    edge = (F.min_by if ahead else F.max_by)("_v", F.struct(*order))
    s = _summary(rows, group, segment, _edge=edge).withColumn("_carry", (F.lead if ahead else F.lag)("_edge").over(_outer())).drop("_edge")
    out = _back(rows.withColumn("_local", local), s, group, segment).withColumn("_v", F.coalesce("_local", "_carry"))
    return out.select(*df.columns, *[F.col(f"_v.{k}").alias(k) for k in values])
