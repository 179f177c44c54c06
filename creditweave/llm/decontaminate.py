"""Benchmark decontamination: short test items found inside long documents.

Words are runs of ASCII letters, digits and longer characters, with A-Z lowered, so case and
punctuation do not hide an item. An item is contained in a document if at least `threshold` of
the item's distinct five-word shingles occur in it. An item of fewer than five words is one
shingle of all its words.

The search is by MinHash over parts of documents that are about as large as the items:

* Items are partitioned by their number of shingles into classes whose bounds grow by half.
* For a class with bound `u`, each document is read in windows of three blocks, each of half
  the bound, that begin at every block. Whatever the length of the document, a passage of up to
  `u` shingles lies within one window, so the Jaccard similarity of item and window is at least
  0.3 where the containment is 0.8. Edits that lengthen a passage by more than a block are
  caught by the neighbouring window at a lower similarity.
* A window and an item are candidates if they agree in any of `HASHES` minima. At a similarity
  of 0.3 that fails with a probability of 2e-6 at most.
* A candidate pair is verified by the exact containment of the item's shingles, as strings.

A task cannot hold an unbounded set of items. It gets two Bloom filters of at most
`MOST_BITS` bits each, of the items' minima and of their shingles. Only what passes them leaves
the task, and the joins with the items' own tables decide. A full filter costs time, not results.

Null and empty texts contain nothing; null and empty items are never found. Repeated rows of
either side behave alike: documents are told apart by key and text, items by id, and an item id
with several texts is found if any of them is. Extra columns are ignored by `leaks` and
kept by `without_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.llm.textkit import NOT_ALNUM, pieces, sums, unused, utf8, words
from creditweave.sources.workspace import store

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 36
LEAST_BOUND = 8
MOST_BITS = 1 << 28
BITS_PER_KEY = 64
# Bytes of texts, and of words, that a task works on at once.
PIECE = 1 << 18
STRETCH = 1 << 16

_ODD = np.uint64(0x100000001B3)
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1)
_PROBES = np.random.default_rng(7).integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64."""
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_FORWARD, _BACK = (_powers(base, STRETCH + 1) for base in (int(_ODD), _inverse(int(_ODD))))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over stretches of whole words."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    for a, b in pieces(bounds, STRETCH):
        part = data[bounds[a] : bounds[b]].astype(np.uint64)
        # Longer than a stretch is only a single word; its powers are not kept.
        forward = _FORWARD if len(part) <= STRETCH else _powers(int(_ODD), len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        part += np.uint64(1)
        part *= forward[: len(part)]
        np.cumsum(part, out=total[1:])
        places = bounds[a : b + 1] - bounds[a]
        out[a:b] = _mix((total[places[1:]] - total[places[:-1]]) * _BACK[places[:-1]])
    return out


def shingle_hashes(found_hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles and where each text's begin."""
    per_text = np.diff(first)
    counts = np.where(per_text > 0, np.maximum(per_text - SHINGLE + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    ends = np.repeat(first[1:], counts)
    padded = np.concatenate([found_hashes, np.zeros(SHINGLE, np.uint64)])
    out = np.zeros(len(starts), np.uint64)
    for step in range(SHINGLE):
        value = np.where(starts + step < ends, padded[starts + step], np.uint64(0))
        out = (out ^ value) * _ODD + np.uint64(step + 1)
        out ^= out >> np.uint64(32)
    return _mix(out), bounds


def class_bound(n: int) -> int:
    """The smallest bound that `n` shingles fit in; bounds grow by half."""
    bound = LEAST_BOUND
    while bound < n:
        bound += bound // 2
    return bound


def _minima(hashes: np.ndarray, starts: np.ndarray, seed: np.uint64) -> np.ndarray:
    return np.minimum.reduceat((hashes ^ seed) * _ODD ^ (hashes * seed >> np.uint64(29)), starts)


def item_keys(hashes: np.ndarray, bound: int) -> np.ndarray:
    """The item's minima as keys that tell apart classes and hash functions."""
    minima = [_minima(hashes, np.array([0]), seed)[0] for seed in _SEEDS]
    return _keyed(np.array(minima, np.uint64), np.arange(HASHES), bound)


def _keyed(minima: np.ndarray, function, bound: int) -> np.ndarray:
    tag = np.atleast_1d(np.asarray(function, np.uint64)) + np.uint64(1000 * bound)
    return _mix(minima + _mix(tag))


def window_keys(hashes: np.ndarray, bounds: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of all texts, and the text of each key."""
    block = max(1, bound // 2)
    counts = np.diff(bounds)
    blocks = -(-counts // block)
    text = np.repeat(np.arange(len(counts)), blocks)
    first = np.concatenate([[0], np.cumsum(blocks)])
    starts = bounds[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * block
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    after = [np.minimum(np.arange(len(starts)) + step, first[1:][text] - 1) for step in (1, 2)]
    keys = []
    for function, seed in enumerate(_SEEDS):
        least = _minima(hashes, starts, seed)
        least = np.minimum(least, np.minimum(least[after[0]], least[after[1]]))
        keys.append(_keyed(least, function, bound))
    return np.concatenate(keys), np.tile(text, HASHES)


class Bloom:
    """Membership with eight probes in a power of two of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    @staticmethod
    def size(keys: int) -> int:
        """Bytes for so many keys, bounded whatever their number."""
        wanted = max(1 << 13, keys * BITS_PER_KEY)
        return min(MOST_BITS, 1 << (wanted - 1).bit_length()) // 8

    @classmethod
    def of(cls, keys: np.ndarray, n_bytes: int) -> Bloom:
        bloom = cls(np.zeros(n_bytes, np.uint8))
        for place in bloom._places(keys):
            np.bitwise_or.at(bloom.bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        return bloom

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [self._place(keys, probe) for probe in range(len(_PROBES))]

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (keys * _PROBES[probe]) >> self.shift

    def has(self, keys: np.ndarray) -> np.ndarray:
        left = np.arange(len(keys))
        for probe in range(len(_PROBES)):
            place = self._place(keys[left], probe)
            left = left[(self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


def _hashed(column) -> Iterator[tuple[int, int, object, np.ndarray, np.ndarray]]:
    """For pieces of a batch: its range, words, and shingle hashes with their bounds."""
    raw, bounds = utf8(column)
    for start, end in pieces(bounds, PIECE):
        part = bounds[start : end + 1] - bounds[start]
        found = words(raw[bounds[start] : bounds[end]], part, NOT_ALNUM, lower=True)
        yield start, end, found, *shingle_hashes(word_hashes(found.data, found.bounds), found.first)


def _shingle_text(found, word: int, end: int) -> bytes:
    data, bounds = found.data, found.bounds
    last = min(word + SHINGLE, end)
    return b" ".join(data[bounds[i] : bounds[i + 1]].tobytes() for i in range(word, last))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's class, minima, shingle hashes and shingles, without repeats."""
    for batch in batches:
        for start, end, found, hashes, bounds in _hashed(batch["item_text"]):
            rows: dict[str, list] = {"item_id": [], "bound": [], "keys": [], "hashes": [], "shingles": []}
            for i, (a, b) in enumerate(pairwise(bounds.tolist())):
                if a == b:
                    continue
                first = int(found.first[i])
                shown = {_shingle_text(found, first + k, int(found.first[i + 1])) for k in range(b - a)}
                bound = class_bound(len(shown))
                rows["item_id"].append(batch["item_id"][start + i].as_py())
                rows["bound"].append(bound)
                rows["keys"].append(item_keys(hashes[a:b], bound).view(np.int64))
                rows["hashes"].append(np.unique(hashes[a:b]).view(np.int64))
                rows["shingles"].append(sorted(shown))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows.values(), _ITEM_TYPES, strict=True)], names=list(rows)
            )


_ITEM_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
_ITEM_SCHEMA = "item_id bigint, bound bigint, keys array<bigint>, hashes array<bigint>, shingles array<binary>"


def _bloom(items: DataFrame, column: str, keys: int) -> np.ndarray:
    """The filter of all values of an array column, made in the tasks and merged there."""
    n_bytes = Bloom.size(keys)

    def partial(batches):
        bits = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            values = batch["key"].to_numpy(zero_copy_only=False).view(np.uint64)
            bits |= Bloom.of(values, n_bytes).bits
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    one = (
        items.select(F.explode(column).alias("key"))
        .coalesce(8)
        .mapInArrow(partial, "bits binary")
        .collect()
    )
    merged = np.zeros(n_bytes, np.uint8)
    for row in one:
        merged |= np.frombuffer(bytes(row.bits), np.uint8)
    return merged


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Contained items: `doc_id`, `text_hash`, `item_id`, `containment`.

    `text_hash` is Spark's xxhash64 of the document's text, so that key and hash name the rows.
    """
    items = store(
        benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("item_text"))
        .dropDuplicates()
        .mapInArrow(_item_rows, _ITEM_SCHEMA)
        # An id with several texts is several items.
        .withColumn("item", F.xxhash64("item_id", F.array_join(F.transform("shingles", F.hex), " "))),
        "leak-items",
    ).frame
    sizes = items.agg(
        F.sum(F.size("keys")).alias("keys"),
        F.sum(F.size("hashes")).alias("hashes"),
        F.array_sort(F.collect_set("bound")).alias("bounds"),
    ).first()
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(
        (_bloom(items, "keys", sizes["keys"] or 0), _bloom(items, "hashes", sizes["hashes"] or 0))
    )
    classes = list(sizes["bounds"])

    def search(batches):
        keys, shingles = (Bloom(bits) for bits in shared.value)
        for batch in batches:
            yield from _candidates(batch, classes, keys, shingles)

    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    found = store(rows.mapInArrow(search, _FOUND_SCHEMA).dropDuplicates(["doc_id", "text_hash"]), "leak-candidates").frame
    row = ["doc_id", "text_hash"]
    minima = items.select("item", F.explode("keys").alias("minimum"))
    pairs = (
        found.select(*row, F.explode("minima").alias("minimum")).join(minima, "minimum").select(*row, "item").distinct()
    )
    needed = items.select("item", F.explode("shingles").alias("shingle"))
    held = found.select(*row, F.explode("shingles").alias("shingle"))
    total = items.select("item", "item_id", F.size("shingles").alias("n"))
    shared_shingles = held.join(needed, "shingle").groupBy(*row, "item").agg(F.count("*").alias("k"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*row, "item")]
    verified = (
        pairs.alias("p")
        .join(shared_shingles.alias("s"), same)
        .select("p.*", "k")
        .join(total, "item")
        .withColumn("containment", F.col("k") / F.col("n"))
        .filter(F.col("containment") >= threshold)
    )
    return verified.groupBy(*row, "item_id").agg(F.max("containment").alias("containment"))


_FOUND_SCHEMA = "doc_id bigint, text_hash bigint, minima array<bigint>, shingles array<binary>"


def _candidates(batch, classes: list[int], keys: Bloom, shingles: Bloom) -> Iterator[pa.RecordBatch]:
    """Rows with a minimum that an item may have, with all shingles that items may have."""
    for start, end, found, hashes, bounds in _hashed(batch["text"]):
        known = shingles.has(hashes)
        # A minimum that an item shares is the hash of a shingle of that item, so texts
        # without any such shingle have no candidate.
        open_texts = np.flatnonzero(sums(known, bounds))
        counts = np.diff(bounds)[open_texts]
        parts = np.concatenate([[0], np.cumsum(counts)])
        inside = np.repeat(bounds[open_texts] - parts[:-1], counts) + np.arange(parts[-1])
        hits: dict[int, set[int]] = {}
        for bound in classes:
            values, texts = window_keys(hashes[inside], parts, bound)
            some = keys.has(values)
            for text, value in zip(open_texts[texts[some]].tolist(), values[some].view(np.int64).tolist(), strict=True):
                hits.setdefault(text, set()).add(value)
        rows: list[tuple] = []
        for i, minima in sorted(hits.items()):
            a, b = bounds[i], bounds[i + 1]
            first, last = int(found.first[i]), int(found.first[i + 1])
            held = {_shingle_text(found, first + k, last) for k in np.flatnonzero(known[a:b]).tolist()}
            rows.append((batch["doc_id"][start + i].as_py(), batch["text_hash"][start + i].as_py(), sorted(minima), sorted(held)))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["doc_id", "text_hash", "minima", "shingles"],
        )


def without_leaks(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options
) -> DataFrame:
    """The documents that contain no item; the columns are those of the input."""
    found = leaks(documents, benchmark, text, key, **options)
    k, h = unused(documents.columns, "leaked_key"), unused(documents.columns, "leaked_hash")
    leaked = store(
        found.select(F.col("doc_id").alias(k), F.col("text_hash").alias(h)).distinct(), "leak-rows"
    ).frame
    same = F.col(key).cast("long").eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h))
    return documents.join(leaked, same, "left_anti")
