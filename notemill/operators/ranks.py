"""Places in a global order and ranks within groups, without a task that meets a whole group.

Rows are dealt by ranges of the order, sorted within their partitions and written once. What lies before a partition, or
before a group's part in it, comes from tables of counts with at most one row for each partition, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.shared import checkpoint

#: monotonically_increasing_id() puts the partition above this many bits.
_BITS = 33


def ordered(df: DataFrame, order: list[str | Column], part: str, row: str) -> DataFrame:
    """df in global order: partitions follow each other and are sorted; `part` is the partition, `row` the place in it."""
    done = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    return done.select("*", F.shiftright(at, _BITS).cast("int").alias(part), at.bitwiseAND(F.lit((1 << _BITS) - 1)).alias(row))


def before_parts(rows: DataFrame, part: str, total: Column, name: str) -> DataFrame:
    """(part, name): the total over all partitions before; one row a partition."""
    sums = rows.groupBy(part).agg(total.alias("_n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias(name))


def with_place(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with `name`, its place in the order from 0. Rows equal in order share a partition and get their places in any order."""
    rows = ordered(df, order, "_part", "_row")
    placed = rows.join(F.broadcast(before_parts(rows, "_part", F.count(F.lit(1)), "_before")), "_part")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_before") + F.col("_row")).alias(name))


def with_rank(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df with `name`, the rank from 1 within its group; a group may be larger than any partition.

    A null group is a group like others. Rows equal in group and order share a partition and get their ranks in any order.
    """
    rows = ordered(df, [group, order], "_part", "_row")
    met = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # a group starts in one partition only, and goes on as the first one of others: at most a row for each partition
    carried = met.withColumn("_before", earlier).where("_before IS NOT NULL").select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_before", F.col("_n").alias("_here"))
    joined = rows.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & (F.col("_row") < F.col("_here")), "left")
    nth = F.row_number().over(Window.partitionBy("_part", group).orderBy("_row"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (nth + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def at_places(df: DataFrame, order: list[str], value: str, places: Iterable[int]) -> dict[int, float]:
    """The numbers in column `value`, one of order's, at the given places (from 0) of df in that order; exact.

    Rows equal in order are counted first, so that no task meets all copies of one. The driver gets one row a partition and
    one a place.
    """
    wanted = np.unique(np.fromiter(places, np.int64))
    rows = ordered(df.groupBy(*order).agg(F.count(F.lit(1)).alias("_count")), order, "_part", "_row")
    before = {r["_part"]: r["_before"] for r in before_parts(rows, "_part", F.sum("_count"), "_before").collect()}

    def pick(batches):
        start = None
        for batch in batches:
            if not len(batch):
                continue
            start = before[int(batch["_part"].iloc[0])] if start is None else start
            ends = start + batch["_count"].to_numpy().cumsum()
            first, last = np.searchsorted(wanted, np.append(start, ends[:-1])), np.searchsorted(wanted, ends)
            start = int(ends[-1])
            met = np.flatnonzero(first < last)
            at = [wanted[i] for m in met for i in range(first[m], last[m])]
            yield pd.DataFrame({"place": np.array(at, np.int64), "v": np.repeat(batch["v"].to_numpy(float)[met], (last - first)[met])})

    picked = rows.select("_part", "_count", F.col(value).cast("double").alias("v")).mapInPandas(pick, "place long, v double")
    return {r["place"]: r["v"] for r in picked.collect()}
