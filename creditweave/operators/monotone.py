"""Isotonic regression by pooling adjacent violators in parallel.

Equal scores are averaged first. Scores are dealt into ranges, and every range pools its own
neighbours whose means fall; any two such neighbours end in one block of the answer, so the order of pooling
doesn't matter. Where means still fall between two ranges, the blocks that are left are dealt
again, into other ranges, until they rise everywhere. A round pools at least all of one range into its
neighbour, most often everything: violations that cross a range's end reach few blocks into it.

A range holds `RANGE_BLOCKS` blocks; the driver sees counts and one row per range. The answer is a
table of blocks (first and last score, value), in steps that rise. Between two blocks values are
interpolated on a line, before the first and behind the last they are constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditweave.sources.workspace import Stored, store

RANGE_BLOCKS = 1 << 20
_BLOCK = pa.schema([("low", pa.float64()), ("high", pa.float64()), ("total", pa.float64()), ("weight", pa.float64())])
_BLOCK_DDL = "low double, high double, total double, weight double"


def pooled(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Where the blocks of rising means begin, for sums and weights in order of their scores."""
    starts: list[int] = []
    sums: list[float] = []
    weights: list[float] = []
    for i, (s, w) in enumerate(zip(total.tolist(), weight.tolist(), strict=True)):
        at = i
        # Means are compared by products, which are exact for counts.
        while sums and sums[-1] * w >= s * weights[-1]:
            s, w, at = s + sums.pop(), w + weights.pop(), starts.pop()
        starts.append(at)
        sums.append(s)
        weights.append(w)
    return np.array(starts, np.int64)


def _pool_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), schema=_BLOCK)
    if not len(table):
        return
    low, high, total, weight = (table[c].to_numpy() for c in _BLOCK.names)
    starts = pooled(total, weight)
    ends = np.append(starts[1:], len(low)) - 1
    found = [low[starts], high[ends], np.add.reduceat(total, starts), np.add.reduceat(weight, starts)]
    yield from pa.table(found, schema=_BLOCK).to_batches(max_chunksize=1 << 16)


def _round(blocks: DataFrame, ranges: int) -> Stored:
    """Pool within ranges of neighbouring scores; `part` is the range."""
    dealt = blocks.select(*_BLOCK.names).repartitionByRange(ranges, "low").sortWithinPartitions("low")
    return store(dealt.mapInArrow(_pool_range, _BLOCK_DDL).withColumn("part", F.spark_partition_id()), "pooled")


def _falls(blocks: DataFrame) -> bool:
    """Whether means still fall from one range to the next: one row per range is compared."""
    mean = F.col("total") / F.col("weight")
    ends = blocks.groupBy("part").agg(
        F.min("low").alias("low"), F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last")
    )
    before = F.lag("last").over(W.partitionBy(F.lit(0)).orderBy("low"))
    return not ends.select((before >= F.col("first")).alias("falls")).where("falls").isEmpty()


@dataclass(frozen=True)
class Steps:
    """A rising step function as a stored table (low, high, value)."""

    table: Stored

    @staticmethod
    def load(spark: SparkSession, path: str) -> Steps:
        frame = spark.read.parquet(path)
        return Steps(Stored(frame, frame.count()))

    def save(self, path: str) -> None:
        self.table.frame.write.mode("overwrite").parquet(path)

    def at(self, scores: DataFrame, score: str, name: str) -> DataFrame:
        """Rows of `scores` with the value at each score. NULL scores have none.

        Ranges of knots are a cut of the score axis, so each distinct score meets one range, whose
        knots and both neighbours it needs. Rows get their value by a join on the score.
        """
        distinct = scores.select(F.col(score).alias("x")).where(F.col("x").isNotNull()).distinct()
        found = interpolated(distinct, self.table).withColumnsRenamed({"x": "_x", "y": name})
        return scores.join(found, F.col(score) == F.col("_x"), "left").drop("_x")


_KNOT_DDL = "x double, y double"


def _fill(key: tuple[pa.Scalar, ...], scores: pa.Table, knots: pa.Table) -> pa.Table:
    x = scores["x"].to_numpy()
    knots = knots.sort_by([("x", "ascending"), ("y", "ascending")])
    at, values = knots["x"].to_numpy(), knots["y"].to_numpy()
    return pa.table([pa.array(x), pa.array(np.interp(x, at, values) if len(at) else np.full(len(x), np.nan))], names=["x", "y"])


def interpolated(distinct: DataFrame, steps: Stored) -> DataFrame:
    """(x, y) of distinct scores, range by range of the steps."""
    count = max(1, -(-steps.rows // RANGE_BLOCKS))
    blocks = steps.frame
    if count > 1:
        share = [i / count for i in range(1, count)]
        # Any cuts give the same values; these are near to equal parts.
        cuts = blocks.agg(F.percentile_approx("low", share).alias("cuts")).first()["cuts"]
    else:
        cuts = []
    places = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")

    def range_of(column: str):
        return F.size(F.filter(places, lambda c: c <= F.col(column))).alias("r")

    dealt = blocks.select("low", "high", "value", range_of("low"))
    # The last block before a range and the first behind it bound the lines at its ends.
    edges = dealt.groupBy("r").agg(
        F.struct(F.min("low").alias("low"), F.min_by("high", "low").alias("high"), F.min_by("value", "low").alias("value")).alias("head"),
        F.struct(F.max("low").alias("low"), F.max_by("high", "low").alias("high"), F.max_by("value", "low").alias("value")).alias("tail"),
    )
    order = W.partitionBy(F.lit(0)).orderBy("r")
    # Cuts between blocks of one range may leave ranges empty; every range takes part all the same.
    every = distinct.sparkSession.range(count).select(F.col("id").cast("int").alias("r")).join(edges, "r", "left")
    before = F.last("tail", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    behind = F.first("head", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    bounds = every.select("r", before.alias("before"), behind.alias("behind"))
    around = bounds.select("r", F.explode(F.array_compact(F.array("before", "behind"))).alias("b")).select("b.*", "r")
    both = dealt.unionByName(around)
    knots = both.select("r", F.explode(F.array(F.struct(F.col("low").alias("x"), F.col("value").alias("y")), F.struct(F.col("high").alias("x"), F.col("value").alias("y")))).alias("k"))
    knots = knots.select("r", "k.x", "k.y")
    rows = distinct.select("x", range_of("x"))
    return rows.groupBy("r").cogroup(knots.groupBy("r")).applyInArrow(_fill, _KNOT_DDL)


def fit_steps(rows: DataFrame, score: str = "probability", target: str = "target") -> Steps:
    """The rising step function nearest to the targets by weighted squares."""
    per_score = store(
        rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(score).cast("double").alias("low"))
        .agg(F.sum(F.col(target).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
        .select("low", F.col("low").alias("high"), "total", "weight"),
        "scores",
    )
    if not per_score.rows:
        raise ValueError("An isotonic fit needs rows with a score and a target")
    blocks, turn = per_score, 0
    while True:
        # Another number of ranges each time, so that their ends move.
        blocks = _round(blocks.frame, -(-blocks.rows // RANGE_BLOCKS) + turn % 2)
        if not _falls(blocks.frame):
            break
        turn += 1
    found = blocks.frame.select("low", "high", (F.col("total") / F.col("weight")).alias("value"))
    return Steps(store(found, "steps"))
