"""Sharding by a two-pass external shuffle.

First pass: a seeded hash scatters the rows into buckets of about `bucket_bytes` inside their
shard. Second pass: each bucket fits in memory, gets a Fisher-Yates shuffle with a seed of its
own, and is written below the folder of its shard. A row's slot is its place in the bucket
plus the rows of the shard's earlier buckets.

The shard follows from the key and the number of shards alone: it is the one with the highest
seeded hash of (key, shard). One more shard can only win rows for itself, so a growing corpus
moves no row between the shards it had.

Rows of one key share a shard by that law, however many they are, but not a bucket: buckets are
dealt by the hash of key and text, and a bucket that still is too large, as it holds many equal
rows, is split further by the rows' order in the scan. So no task holds more than a bucket.
What a task reads is sorted before it is shuffled, so a task that runs again writes the same.

Null keys share a shard. Null texts are empty and have size 1. Repeated rows all stay. Empty
tables give empty tables. Columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweave.llm.textkit import unused
from creditweave.sources.workspace import new_path, store

SEED = 20240229
BUCKET_BYTES = 32 << 20


def shard_of(key: str | Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of seed, key and shard; ties go to the later one."""
    key = F.col(key) if isinstance(key, str) else key
    draws = [
        F.struct(F.xxhash64(F.lit(seed), key, F.lit(shard)).alias("draw"), F.lit(shard).alias("shard"))
        for shard in range(shards)
    ]
    return (F.greatest(*draws) if shards > 1 else draws[0])["shard"]


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _fisher_yates(table: pa.Table, order: list[str], seed: int) -> pa.Table:
    """Rows in the order of a seeded Fisher-Yates shuffle, after a canonical sort."""
    table = table.take(pc.sort_indices(table, sort_keys=[(name, "ascending") for name in order]))
    shuffled = np.arange(table.num_rows)
    np.random.default_rng(seed).shuffle(shuffled)
    return table.take(pa.array(shuffled))


def shard(
    documents: DataFrame,
    shards: int = 16,
    text: str = "text",
    key: str = "doc_id",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
    folder: str | None = None,
) -> DataFrame:
    """Write the shards and return their rows: the input's columns, `shard`, `slot`, `grown_shard`.

    `grown_shard` is the shard that the row has once there is one more. The files are below
    `folder`, one sub-folder for each shard.
    """
    spark = documents.sparkSession
    documents = documents.drop("shard", "slot", "grown_shard")
    names = documents.columns
    bucket, part, place, hashed = (unused(names, x) for x in ("bucket", "part", "place", "text_hash"))
    total = documents.agg(F.coalesce(F.sum(size_of(text)), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    draw = F.xxhash64(F.lit(seed + 1), F.col(key), F.xxhash64(text))
    tagged = documents.withColumns(
        {"shard": shard_of(key, shards, seed), bucket: F.pmod(draw, F.lit(buckets)).cast("int")}
    )
    # Buckets that equal rows make too large, and the parts that each needs.
    parts = unused(names, "parts")
    heavy = (
        tagged.groupBy("shard", bucket)
        .agg(F.sum(size_of(text)).alias(parts))
        .withColumn(parts, F.ceil(F.col(parts) / (2 * bucket_bytes)))
        .filter(F.col(parts) > 1)
    )
    heavy = store(heavy, "shard-heavy").frame
    row = F.xxhash64(F.monotonically_increasing_id())
    tagged = (
        tagged.withColumn(hashed, row)
        .join(heavy, ["shard", bucket], "left")
        .withColumn(part, F.pmod(F.col(hashed), F.coalesce(parts, F.lit(1))).cast("int"))
        .withColumn(hashed, F.xxhash64(text))
        .select(*[F.col(f"`{n}`") for n in names], "shard", bucket, part, hashed)
    )
    sortable = [f.name for f in documents.schema if isinstance(f.dataType, T.AtomicType)]
    order = [hashed, *sortable]

    def shuffled(group, table):
        numbers = [x.as_py() for x in group]
        table = _fisher_yates(table, order, seed + hash(tuple(numbers)) % (1 << 32))
        return table.append_column(place, pa.array(np.arange(table.num_rows)))

    schema = T.StructType([*tagged.schema.fields, T.StructField(place, T.LongType())])
    written = tagged.groupBy("shard", bucket, part).applyInArrow(shuffled, schema).drop(hashed)
    folder = folder or new_path(spark, "shards")
    written.write.partitionBy("shard").parquet(folder)
    rows = spark.read.schema(written.schema).parquet(folder)
    return _with_slots(rows, names, bucket, part, place, key, shards, seed)


def _with_slots(rows, names, bucket, part, place, key, shards, seed) -> DataFrame:
    ahead = unused(names, "rows_ahead")
    earlier = Window.partitionBy("shard").orderBy(bucket, part)
    counts = rows.groupBy("shard", bucket, part).agg(F.count("*").alias(ahead))
    before = F.sum(ahead).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    offsets = store(
        counts.withColumn(ahead, F.coalesce(before, F.lit(0))), "shard-offsets"
    ).frame
    return rows.join(offsets, ["shard", bucket, part]).select(
        *[F.col(f"`{n}`") for n in names],
        F.col("shard").cast("int").alias("shard"),
        (F.col(ahead) + F.col(place)).cast("long").alias("slot"),
        shard_of(key, shards + 1, seed).alias("grown_shard"),
    )
