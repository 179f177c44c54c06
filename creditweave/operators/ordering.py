"""Exact ranks and running sums within groups, without one task per group.

A window that is partitioned by the model split alone would sort a whole split in one task.
Instead the rows are range-partitioned by (group, order), which also separates rows of equal
score because the order ends in a unique key; each partition numbers its rows locally, and a
table with one row per (partition, group) holds the offsets. The range boundaries are sampled
anew by every execution, so the placed rows are written once and read from there on.
There is one plan for every size. A NULL group is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditweave.sources.workspace import Stored, store


def ranked(
    rows: DataFrame | Stored,
    groups: Sequence[str],
    order: Sequence[Column],
    sums: Sequence[str] = (),
) -> DataFrame:
    """Add ``rank`` (from 1), ``group_rows`` and, per name in ``sums``, running_* and group_*.

    The order must be total within a group.
    """
    rows = rows.frame if isinstance(rows, Stored) else rows
    total_order = [*(F.col(g).asc() for g in groups), *order]
    slots = (
        rows.repartitionByRange(*total_order)
        .sortWithinPartitions(*total_order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    placed = store(slots.withColumn("_part", F.shiftright("_slot", 33)), "placed").frame

    # One row per (partition, group): at most partitions + groups rows.
    pieces = placed.groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_slot").alias("_first"),
        *[F.sum(s).alias(f"_sum_{s}") for s in sums],
    )
    whole = W.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)

    def earlier(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    offsets = pieces.select(
        "_part",
        *groups,
        "_first",
        earlier("_n").alias("_before_n"),
        F.sum("_n").over(whole).alias("group_rows"),
        *[earlier(f"_sum_{s}").alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"group_{s}") for s in sums],
    )
    # Written, so that its true size decides whether Spark broadcasts it.
    known = store(offsets, "offsets").frame
    renamed = {g: f"_of_{g}" for g in groups}
    same = [placed["_part"] == F.col("_of_part"), *(placed[g].eqNullSafe(F.col(n)) for g, n in renamed.items())]
    joined = placed.join(known.withColumnsRenamed({"_part": "_of_part", **renamed}), same)
    inside = W.partitionBy("_part", *groups).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    return joined.select(
        *rows.columns,
        (F.col("_before_n") + F.col("_slot") - F.col("_first") + 1).alias("rank"),
        "group_rows",
        *[(F.col(f"_before_{s}") + F.sum(s).over(inside)).alias(f"running_{s}") for s in sums],
        *[f"group_{s}" for s in sums],
    )
