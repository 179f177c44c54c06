"""Mixing sources to target weights, with DataFrame functions only.

Temperature mixing raises the sources' token shares to an exponent between 0 (all alike) and 1
(as they are) and normalises them. The exponent is the flattest that meets the limit: the
entropy of the weights is at most `target_entropy`, or no source is repeated more than
`most_repeats` times. It is found by bisection, several halvings to a pass, over the table of
sources; only sums come to the driver.

The mixture has `budget_tokens`; by default the fewest with which the largest source, and so
every source, is read at least once. A source's quota is its weight times the budget. Epochs of
a source are seeded permutations of its rows; whole ones are followed by the start of another,
up to the row that reaches the quota. The mixture is a sequence of blocks of about `block_tokens`,
each with every source's due share of tokens, in a seeded order of its own.

A source may hold any part of all rows: its permutation is cut into buckets of a hash range,
which are summed first and numbered by their offset. Buckets that equal keys make large are
split further by the scan's order. So no window sees a whole source.

Tokens are runs of characters other than ASCII white space. A null source is a source of its
own. Null and empty texts have no tokens; they take no budget and stay with the epoch that they
fall into. A source without any token is read once. Repeated rows are rows of their own. Columns
named like an output are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditweave.llm.textkit import unused
from creditweave.sources.workspace import store

SEED = 20240229
BUCKET_ROWS = 4096
BLOCK_TOKENS = 1 << 22
POINTS, ROUNDS = 15, 10
OUTPUTS = ("n_tokens", "weight", "epoch", "block", "slot")


def tokens_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_label(source: str) -> Column:
    """The source as text that is never null, so that joins on it are plain."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def find_exponent(
    sources: DataFrame, tokens: int, budget: float | None, most_repeats: float, target_entropy: float | None
) -> float:
    """The smallest exponent in [0, 1] that meets the limit. `sources` has `tokens` over 0."""
    share = F.col("tokens") / F.lit(float(tokens))
    ends = sources.agg(F.min(share).alias("low"), F.max(share).alias("high")).first()
    low, high = 0.0, 1.0

    def measured(exponents: list[float]) -> list[float]:
        sums = [F.sum(F.pow(share, F.lit(a))).alias(f"z{i}") for i, a in enumerate(exponents)]
        logs = [F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{i}") for i, a in enumerate(exponents)]
        row = sources.agg(*sums, *logs).first()
        out = []
        for i, a in enumerate(exponents):
            z = row[f"z{i}"]
            if target_entropy is not None:
                out.append(math.log(z) - a * row[f"l{i}"] / z)
            elif budget is None:
                out.append((ends["high"] / ends["low"]) ** (1 - a))
            else:
                out.append(ends["low"] ** (a - 1) / z * budget / tokens)
        return out

    limit = (most_repeats if target_entropy is None else target_entropy) + 1e-12
    at_low, at_high = measured([low, high])
    if at_low <= limit:
        return low
    if at_high > limit:
        return high
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        good = [value <= limit for value in measured(points)]
        first = good.index(True) if True in good else POINTS
        low, high = ([low, *points][first], [*points, high][first])
    return high


def plan(
    documents: DataFrame,
    text: str = "text",
    source: str = "source",
    budget_tokens: int | None = None,
    most_repeats: float = 2.0,
    target_entropy: float | None = None,
) -> DataFrame:
    """For each source (`label`): `rows`, `tokens`, `weight`, `quota` in tokens, and `repeats`."""
    sources = store(
        documents.groupBy(source_label(source).alias("label")).agg(
            F.sum(tokens_of(text)).alias("tokens"), F.count("*").alias("rows")
        ),
        "mix-sources",
    ).frame
    filled = sources.filter("tokens > 0")
    ends = filled.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    total = ends["all"] or 0
    exponent = find_exponent(filled, total, budget_tokens, most_repeats, target_entropy) if total else 1.0
    powered = F.pow(F.col("tokens") / F.lit(float(max(1, total))), F.lit(exponent))
    mass = filled.agg(F.sum(powered).alias("z")).first()["z"] or 1.0
    share = (ends["most"] or 0) / max(1, total)
    # With this budget the largest source is read exactly once.
    budget = float(budget_tokens) if budget_tokens is not None else (ends["most"] or 0) * mass / max(share**exponent, 1e-300)
    weight = F.when(F.col("tokens") > 0, powered / F.lit(mass)).otherwise(F.lit(0.0))
    planned = sources.withColumn("weight", weight).withColumn("quota", F.col("weight") * F.lit(budget))
    repeats = F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(F.lit(1.0))
    planned = planned.withColumn("repeats", repeats).withColumn("budget", F.lit(budget))
    return store(planned, "mix-plan").frame


def mix(
    documents: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    **targets,
) -> DataFrame:
    """The mixture's rows: the input's columns, `n_tokens`, `weight`, `epoch`, `block`, `slot`.

    `targets` are those of `plan`.
    """
    documents = documents.drop(*OUTPUTS)
    return _mixed(documents, text, source, key, block_tokens, seed, targets)[0]


def mixed_documents(
    documents: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    seed: int = SEED,
    **targets,
) -> DataFrame:
    """The mixture's rows with the input's columns alone."""
    found, _ = _mixed(documents, text, source, key, BLOCK_TOKENS, seed, targets)
    return found.select(*[F.col(f"`{n}`") for n in documents.columns])


def _mixed(documents, text, source, key, block_tokens, seed, targets) -> tuple[DataFrame, list[str]]:
    names = documents.columns
    tokens, weight, epoch, block, slot = outputs = [unused(names, name) for name in OUTPUTS]
    planned = plan(documents, text, source, **targets)
    drawn, bucket, part, offset = (unused(names, x) for x in ("drawn", "bucket", "part", "offset"))
    rename = {c: unused(names, f"plan_{c}") for c in planned.columns}
    p = {c: F.col(f"`{n}`") for c, n in rename.items()}
    planned = planned.withColumnsRenamed(rename)
    epochs = F.sequence(F.lit(0), F.greatest(F.ceil(p["repeats"] - 1e-9), F.lit(1)).cast("int") - 1)
    rows = (
        documents.withColumn(tokens, tokens_of(text))
        .join(planned, source_label(source) == p["label"])
        .withColumn(epoch, F.explode(epochs))
        .withColumn(drawn, F.xxhash64(F.lit(seed), epoch, F.col(key)))
    )
    # The hash as a number in [0, 1): the place in the permutation, and so the bucket.
    uniform = F.shiftrightunsigned(drawn, 11) / F.lit(float(1 << 53))
    rows = rows.withColumn(bucket, F.floor(uniform * F.ceil(p["rows"] / BUCKET_ROWS)).cast("int"))
    group = [rename["label"], epoch, bucket]
    sums = store(
        rows.groupBy(*group).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("members")), "mix-buckets"
    ).frame
    crowded = sums.filter(F.col("members") > 4 * BUCKET_ROWS)
    if crowded.isEmpty():
        rows, sums = rows.withColumn(part, F.lit(0)), sums.withColumn(part, F.lit(0))
    else:
        parts = crowded.select(*group, F.ceil(F.col("members") / BUCKET_ROWS).alias(part))
        scanned = F.xxhash64(F.monotonically_increasing_id())
        joined = rows.withColumn(offset, scanned).join(parts, group, "left")
        choice = F.coalesce(F.pmod(F.col(offset), F.col(part)), F.lit(0)).cast("int")
        # The scan's order must not change between the sums and the windows.
        rows = store(joined.withColumn(part, choice).drop(offset), "mix-parts").frame
        sums = rows.groupBy(*group, part).agg(F.sum(tokens).alias("tokens"))
    in_order = Window.partitionBy(*group[:2]).orderBy(bucket, part)
    ahead = F.sum("tokens").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = store(
        sums.select(*group, part, F.coalesce(ahead, F.lit(0)).alias(offset)), "mix-offsets"
    ).frame
    inside = Window.partitionBy(*group, part).orderBy(drawn, F.col(key))
    before = F.coalesce(F.sum(tokens).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = unused(names, "before")
    rows = rows.withColumn(within, before)
    placed = rows.join(offsets, [*group, part])
    at = F.col(epoch) * p["tokens"] + F.col(offset) + F.col(within)
    whole = F.col(epoch) < F.floor(p["repeats"] + 1e-9)
    placed = placed.filter(whole | (at < p["quota"]))
    blocks = F.greatest(F.ceil(p["budget"] / block_tokens), F.lit(1))
    by_tokens = F.floor(at / F.greatest(p["quota"], F.lit(1.0)) * blocks)
    by_hash = F.pmod(F.col(drawn), blocks)
    number = F.least(F.when(p["tokens"] > 0, by_tokens).otherwise(by_hash), blocks - 1).cast("long")
    placed = placed.withColumns({block: number, weight: p["weight"]})
    order = F.xxhash64(F.lit(seed + 1), block, epoch, F.col(key))
    in_block = F.row_number().over(Window.partitionBy(block).orderBy(order, F.col(key), epoch))
    placed = placed.withColumn(slot, (in_block - 1).cast("long"))
    return placed.select(*[F.col(f"`{n}`") for n in names], *outputs), outputs
