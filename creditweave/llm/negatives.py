"""Hard negatives of embeddings by Fagin's threshold algorithm, exact over whole-number scores.

A row's score for an anchor is the inner product of their components, each taken as
floor(scale * x). An anchor's positives are the best rows of its own label. Around each of them
lies a window of scores, a share of the positive's; the best rows of other labels inside the
window are the hard negatives.

Rows are dealt into blocks, anchors into blocks of their own, and each pair of blocks is one
group. Within it:

* The candidates of every dimension are one list, sorted by their component. An anchor reads a
  list from its top where its own component is positive, from its bottom where it is negative;
  dimensions where it is zero cannot move a score and are not read (an anchor of zeros reads
  every row).
* Every list is read to the same depth. Rows seen for the first time are scored in full.
* The threshold, the anchor's product with the components last read, bounds every row not yet
  seen. An anchor is done once the threshold is strictly below the kth score of each of its
  windows, or below the window itself. Equal scores thus never end a search, so that ties go
  to the smallest id.

The depth doubles from round to round, so reading past the stopping depth costs at most as much
again. Each block gives at most k rows per window, and a ranked window over these few keeps
the best of all blocks. Positives are searched first, in lists of the anchor's label only;
negatives second, when the windows are known.

Memory: a block of rows holds `BLOCK_COMPONENTS` numbers and as many list entries, a block of
anchors a sixteenth of it; the number of blocks grows with the table. Sums are exact: floats where
they stay below 2^53, else integers of any size. A score beyond 64 bits counts as the nearest long.

Rows without a key, label or vector, or with a null or non-finite component, take no part. Shorter
vectors count as filled up with zeros. Rows are told apart by key: rows of equal key, label and
vector count once, an anchor is never its own positive or negative, and rows of one key with
different vectors or labels each take part. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditweave.sources.workspace import store

BLOCK_COMPONENTS = 1 << 22
FIRST_DEPTH = 16
_LONG = np.iinfo(np.int64)
_WHOLE_FLOATS = float(1 << 53)


@dataclass(frozen=True)
class Mining:
    """Negatives score between `least` and `most` hundredths of their positive's score."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95
    scale: int = 256


def _held(scores):
    """Scores as longs hold them. Floats are only used where no score comes near the ends."""
    exact = isinstance(scores, int) or getattr(scores, "dtype", None) == object
    return np.minimum(np.maximum(scores, _LONG.min), _LONG.max) if exact else scores


class Lists:
    """Rows of one block and, for each dimension, their numbers by ascending component."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.keys, self.labels, self.x = keys, labels, x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32).T
        self.seen = np.zeros(len(keys), bool)

    def walk(self, anchor: np.ndarray):
        """Rows not seen before, their scores, and the bound on all rows not yet seen."""
        n = len(self.keys)
        dims = np.flatnonzero(anchor)
        if not len(dims):
            if n:
                yield np.arange(n), np.zeros(n, self.x.dtype), None
            return
        falling = anchor[dims] > 0
        seen = self.seen
        seen[:] = False
        start, depth = 0, FIRST_DEPTH
        while start < n:
            end = min(n, start + depth)
            fresh = np.zeros(n, bool)
            fresh[self.order[dims[~falling], start:end]] = True
            fresh[self.order[dims[falling], n - end : n - start]] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            last = np.where(falling, self.order[dims, n - end], self.order[dims, end - 1])
            bound = None if end == n else _held((anchor[dims] * self.x[last, dims]).sum())
            yield rows, _held(self.x[rows] @ anchor), bound
            start, depth = end, 2 * depth


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller key."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((keys[places], -scores[places]))][:k]


def best_rows(lists: Lists, anchor: np.ndarray, usable, windows: list[tuple[int, int]], k: int):
    """For each window (lowest, highest score) the places and scores of its k best usable rows."""
    rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, lists.x.dtype)]
    lowest = min(low for low, _ in windows)
    for found, values, bound in lists.walk(anchor):
        keep = usable(found) & (values >= lowest)
        rows.append(found[keep])
        scores.append(values[keep])
        if bound is None:
            break
        # A window whose bound is not below its own floor needs k scores above the bound.
        open_windows = [w for w in windows if bound >= w[0]]
        if open_windows:
            rows, scores = [np.concatenate(rows)], [np.concatenate(scores)]
            values = scores[0]
            if all(np.count_nonzero((values > bound) & (values <= high)) >= k for _, high in open_windows):
                break
        else:
            break
    rows, scores = np.concatenate(rows), np.concatenate(scores)
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        top = inside[_best(scores[inside], lists.keys[rows[inside]], k)]
        yield rows[top], scores[top]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers, shorter ones filled up with zeros."""
    column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where no sum can pass 2^53, else as integers of any size."""
    if not rows.size or not anchors.size:
        return rows.astype(float), anchors.astype(float)
    most = [float(np.abs(x.astype(float)).max()) for x in (rows, anchors)]
    kind = float if most[0] * most[1] * rows.shape[1] < _WHOLE_FLOATS else object
    return rows.astype(kind), anchors.astype(kind)


def _once(keys: np.ndarray, labels: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row numbers by key, without further rows of equal key, label and vector."""
    order = np.argsort(keys, kind="stable")
    if len(order) < 2 or (np.diff(keys[order]) != 0).all():
        return order
    held, kept = set(), []
    for i in order:
        row = (int(keys[i]), int(labels[i]), x[i].tobytes())
        if row not in held:
            held.add(row)
            kept.append(i)
    return np.array(kept)


_FOUND = pa.schema(
    [
        ("anchor", pa.int64()),
        ("anchor_id", pa.int64()),
        ("positive_id", pa.int64()),
        ("positive_score", pa.int64()),
        ("found_id", pa.int64()),
        ("found_score", pa.int64()),
    ]
)
_FOUND_DDL = ", ".join(f"{name} bigint" for name in _FOUND.names)


def _columns(rows: pa.Table, anchors: pa.Table):
    """Rows and anchors of a group as arrays."""
    width = max(
        (int(t["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in (rows, anchors) if len(t)),
        default=0,
    )
    keys, labels = rows["key"].to_numpy(), rows["label"].to_numpy()
    x, a = _matrix(rows["vector"], width), _matrix(anchors["vector"], width)
    kept = _once(keys, labels, x)
    x, a = _exact(x[kept], a)
    return keys[kept], labels[kept], x, a


def _table(found: list[tuple]) -> pa.Table:
    columns = list(zip(*found, strict=True)) if found else [()] * len(_FOUND.names)
    return pa.table([pa.array([int(v) for v in c], pa.int64()) for c in columns], schema=_FOUND)


def _positives(k: int):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        keys, labels, x, a = _columns(rows, anchors)
        anchor_labels, out = anchors["label"].to_numpy(), []
        meta = list(zip(anchors["anchor"].to_pylist(), anchors["key"].to_pylist(), strict=True))
        for label in np.unique(anchor_labels):
            same = np.flatnonzero(labels == label)
            lists = Lists(keys[same], labels[same], x[same])
            for i in np.flatnonzero(anchor_labels == label):
                anchor, key = meta[i]
                ((places, scores),) = best_rows(
                    lists, a[i], lambda r, key=key, lists=lists: lists.keys[r] != key, [(-np.inf, np.inf)], k
                )
                out += [(anchor, key, 0, 0, lists.keys[p], s) for p, s in zip(places, scores, strict=True)]
        return _table(out)

    return search


def _bounds(score: int, mining: Mining) -> tuple[int, int]:
    """The lowest and highest whole score inside a positive's window."""
    return -(-mining.least * score // 100), mining.most * score // 100


def _negatives(mining: Mining):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        keys, labels, x, a = _columns(rows, anchors)
        lists, out = Lists(keys, labels, x), []
        for i, row in enumerate(anchors.select(["anchor", "key", "label", "positives"]).to_pylist()):
            wanted = [(p, _bounds(p["positive_score"], mining)) for p in row["positives"]]
            wanted = [(p, w) for p, w in wanted if w[0] <= w[1]]
            if not wanted:
                continue
            found = best_rows(
                lists,
                a[i],
                lambda r, row=row: (lists.labels[r] != row["label"]) & (lists.keys[r] != row["key"]),
                [w for _, w in wanted],
                mining.negatives,
            )
            for (p, _), (places, scores) in zip(wanted, found, strict=True):
                out += [
                    (row["anchor"], row["key"], p["positive_id"], p["positive_score"], lists.keys[q], s)
                    for q, s in zip(places, scores, strict=True)
                ]
        return _table(out)

    return search


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _search(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], search) -> DataFrame:
    """Every block of anchors meets every block of rows in a group of its own."""
    row_blocks, anchor_blocks = blocks
    left = rows.withColumn("r", F.pmod(F.xxhash64("key"), F.lit(row_blocks)).cast("int"))
    left = left.select("*", _every(anchor_blocks).alias("a"))
    right = anchors.withColumn("a", F.pmod("anchor", F.lit(anchor_blocks)).cast("int"))
    right = right.select("*", _every(row_blocks).alias("r"))
    both = left.groupBy("a", "r").cogroup(right.groupBy("a", "r"))
    return both.applyInArrow(search, _FOUND_DDL)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    best = W.partitionBy(*by).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _usable(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    def broken(x):
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return rows.where(
        F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, broken)
    ).select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("bigint").alias("label"), whole.alias("vector"))


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    mining: Mining = Mining(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) as told above.

    `is_anchor` is a condition on the columns `key`, `label` and `vector` (whole numbers) of a row.
    """
    spark = rows.sparkSession
    usable = _usable(rows, key, vector, label, mining.scale)
    anchors = (
        usable.where(is_anchor)
        .dropDuplicates()
        .select(F.xxhash64("key", "label", "vector").alias("anchor"), "key", "label", "vector")
    )
    anchors = store(anchors, "anchors")
    shape = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(1, shape["width"] or 1)
    row_blocks = max(
        2 * spark.sparkContext.defaultParallelism, -(-shape["n"] * width // BLOCK_COMPONENTS)
    )
    anchor_blocks = max(1, -(-anchors.rows * width * 16 // BLOCK_COMPONENTS))
    blocks = (row_blocks, anchor_blocks)

    found = _search(usable, anchors.frame, blocks, _positives(mining.positives))
    positives = _ranked(found, ["anchor"], mining.positives).groupBy("anchor").agg(
        F.collect_list(F.struct(F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score"))).alias("positives")
    )
    # Written: the search for negatives reads it for every block of rows.
    windows = store(anchors.frame.join(positives, "anchor"), "windows").frame
    found = _search(usable, windows, blocks, _negatives(mining))
    return _ranked(found, ["anchor", "positive_id", "positive_score"], mining.negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("found_score").alias("negative_score"),
    )
