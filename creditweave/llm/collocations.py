"""Collocations: phrases of two to `longest` words, counted exactly by an FM-index per shard.

Texts are lower-cased (A-Z), split into pieces at `.,;:!?` and line breaks, and the pieces into
words at blanks and tabs. Everything is per language. A phrase of `least` or more occurrences is a
candidate; its score is the lowest, over all cuts into two parts, of floor(1000 * a * n / (l * r)).
A candidate that any longer one explains, because it occurs as often, is dropped.

* Each task that reads documents makes shards of up to `SHARD_BYTES` of text, one language each. A shard
  numbers its words and is stored as these numbers. Every row is in one shard, and which one doesn't matter.
* A shard's index is the Burrows-Wheeler transform over word numbers, in both directions, sorted to
  the depth of the longest phrase. A phrase is a pair of intervals, one per direction. All intervals of
  a length are extended at once: a step of the last-to-first map gives the words that stand before
  (or, in the reversed text, behind) each, with their counts, and the interval of each extension.
* First all words and all pairs of words are enumerated, and their counts summed by a hash: first those of a task's
  shards, of all languages together, then across tasks.
  A sum is at least the count of each word or pair in it, so where it stays below `least` none is frequent,
  nor any phrase that holds one. The others are bit maps, one bucket for about eight words of the corpus and
  `MOST_BUCKETS` at most; a crowded map prunes less, and never wrongly.
* Then what the remaining pairs chain together is indexed to the full depth, and the longer phrases are sifted in
  the same way. Of single words only those in remaining pairs are needed.
* The counts of all that is left are summed across shards by the phrases themselves, packed in blocks of
  buckets. Nothing is pruned by the counts of one shard.
* A phrase of n words is explained by a longer candidate only if it is by one of n + 1 words, as
  counts fall from part to whole; so candidates are compared with their own first and last parts.

Memory: a shard (a single longer text is a shard of its own size) in numpy arrays, about two hundred bytes
per word, and texts of a few shards that wait; a shard is one row, of about half its texts' size. Sums and joins are by phrase; a phrase has at most a row per shard, so no key is hot. Parts
are found by joins with the table of frequent phrases, of which there are at most 5 / `least` per word.

Null and empty texts hold no words, a null language is `und`, repeated rows count each time,
further columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditweave.llm.decontaminate import word_hashes
from creditweave.llm.textkit import LOWER, Words, pieces, utf8
from creditweave.sources.workspace import store

LONGEST = 5
LEAST = 100
TOP = 2000
SHARD_BYTES = 6 << 20
MOST_BUCKETS = 1 << 28
# Sums that a task holds before it writes them, twenty bytes each.
HELD_SUMS = 1 << 21

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_SEPARATES = _ENDS.copy()
_SEPARATES[list(b" \t")] = True


# --- words ------------------------------------------------------------------------------


def piece_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of all texts, and the piece each is in, by ascending numbers."""
    keep = ~_SEPARATES[raw]
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    starts = bounds[:-1][np.diff(bounds) > 0]
    begin[starts] = keep[starts]
    places = np.flatnonzero(begin)
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    first = np.searchsorted(places, bounds)
    ends = np.cumsum(_ENDS[raw], dtype=np.int64)
    piece = ends[places] + np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    data = LOWER[raw[keep]]
    return Words(data, np.concatenate([kept[places], [len(data)]]), first), piece


def _numbered(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Word numbers from 1, with a 0 after every piece, and the distinct words in that order."""
    raw, bounds = utf8(texts)
    data, lengths, breaks = [], [], []
    for start, end in pieces(bounds):
        found, piece = piece_words(raw[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
        if len(found):
            data.append(found.data)
            lengths.append(np.diff(found.bounds))
            breaks.append(np.concatenate([piece[1:] != piece[:-1], [True]]))
    if not data:
        return np.zeros(0, np.int32), pa.array([], pa.large_string())
    lengths, breaks = np.concatenate(lengths), np.concatenate(breaks)
    every = Words(np.concatenate(data), np.concatenate([[0], np.cumsum(lengths)]), np.array([0, len(lengths)]))
    places = pa.py_buffer(np.ascontiguousarray(every.bounds, np.int64))
    words = pa.Array.from_buffers(pa.large_string(), len(every), [None, places, pa.py_buffer(every.data)])
    words = words.dictionary_encode()
    # Every break shifts what follows by the separator before it.
    ids = np.zeros(len(every) + np.count_nonzero(breaks), np.int32)
    at = np.arange(len(every)) + np.concatenate([[0], np.cumsum(breaks[:-1])])
    ids[at] = words.indices.to_numpy() + 1
    return ids, words.dictionary


_SHARD = pa.schema(
    [
        ("kind", pa.string()),
        ("lang", pa.string()),
        ("part", pa.int32()),
        ("places", pa.binary()),
        ("held", pa.binary()),
        ("n", pa.int64()),
    ]
)
_SHARD_DDL = "kind string, lang string, part int, places binary, held binary, n bigint"
# A row of a shard: its word numbers (`places`), words (`held`) and size (`n`). Rows of a task: sums of words and of pairs by bucket.
_NUMBERS, _WORDS, _PAIRS = "numbers", "words", "pairs"
# In the second round: sums of longer phrases, and the words that are needed.
_LONGER, _NEEDED = "longer", "needed"
_BLOCK = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: bytes) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values, "zstd", asbytes=True)


def _unpacked(values: bytes) -> bytes:
    return pa.decompress(values[8:], int.from_bytes(values[:8], "little"), "zstd", asbytes=True)


def _packed_numbers(values: np.ndarray) -> bytes:
    """Byte by byte: the upper bytes of small numbers are nearly all alike."""
    width = values.dtype.itemsize
    return _packed(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def _unpacked_numbers(values: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_unpacked(values), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _summed(at: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(at):
        return at, np.zeros(0, np.uint8)
    order = np.argsort(at, kind="stable")
    filled, starts = np.unique(at[order], return_index=True)
    return filled, np.minimum(np.add.reduceat(counts[order].astype(np.int64), starts), least).astype(np.uint8)


class _Sums:
    """Sums by bucket of a task's shards, of all languages together.

    The more buckets of a block are filled, the less a row of them costs for each; so shards are added up first.
    """

    def __init__(self, least: int):
        self.least = least
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, kind: str, at: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        """Rows of what is held, where that is too much."""
        self.held.setdefault(kind, []).append((at, counts))
        if sum(len(part) for part, _ in self.held[kind]) > HELD_SUMS:
            yield from self.rows(kind)

    def all(self) -> Iterator[dict]:
        for kind in list(self.held):
            yield from self.rows(kind)

    def rows(self, kind: str) -> Iterator[dict]:
        """Blocks of buckets."""
        parts = self.held.pop(kind)
        filled, values = _summed(*(np.concatenate(column) for column in zip(*parts, strict=True)), self.least)
        block, places = filled // _BLOCK, (filled % _BLOCK).astype(np.uint16)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        for i, j in zip(first, np.append(first, len(filled))[1:], strict=True):
            steps = np.diff(places[i:j], prepend=np.uint16(0))
            held = _packed(values[i:j].tobytes())
            yield {"kind": kind, "part": int(block[i]), "places": _packed_numbers(steps), "held": held}


class _Shard:
    """Word numbers from 1 with a 0 after every piece, the words, and their hashes with the language's."""

    def __init__(self, lang: str, ids: np.ndarray, words: pa.Array):
        self.lang, self.ids, self.words = lang, ids, words
        name = np.frombuffer(lang.encode(), np.uint8)
        seed = word_hashes(name, np.array([0, len(name)]))[0]
        self.hashes = np.zeros(len(words) + 1, np.uint64)
        self.hashes[1:] = (word_hashes(*utf8(words)) ^ seed) * _ODD

    def buckets(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The bucket of each word or pair (a row of numbers); equal in all shards of a language."""
        mixed = np.zeros(len(rows), np.uint64)
        for i in range(rows.shape[1]):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD + self.hashes[rows[:, i]]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD
        return (mixed >> np.uint64(32)).astype(np.int64) & (n - 1)

    def sums(self, rows: np.ndarray, counts: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Filled buckets and their counts. Beyond `least` a count need not be exact."""
        return _summed(self.buckets(rows, n), np.minimum(counts, least), least)

    def row(self, kind: str, part: int, places: bytes, held: bytes, n: int | None = None) -> dict:
        return {"kind": kind, "lang": self.lang, "part": part, "places": places, "held": held, "n": n}

    def stored(self) -> dict:
        # No word holds a blank.
        texts = " ".join(self.words.to_pylist()).encode("utf-8", "surrogatepass")
        return self.row(_NUMBERS, 0, _packed_numbers(self.ids), _packed(texts), int(np.count_nonzero(self.ids)))

    def pair_sums(self, buckets: int, least: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Sums of words and of pairs."""
        counts = np.bincount(self.ids, minlength=len(self.words) + 1)[1:]
        singles = np.arange(1, len(self.words) + 1)[:, None]
        yield _WORDS, *self.sums(singles, counts, buckets, least)
        for pairs, found in Index(self.ids, 2).phrases(2):
            yield _PAIRS, *self.sums(pairs, found, buckets, least)


def _make_shards(buckets: int, least: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[pa.Array]] = {}
        held: dict[str, int] = {}
        sums = _Sums(least)

        def emptied(lang):
            held.pop(lang)
            shard = _Shard(lang, *_numbered(pa.chunked_array(waiting.pop(lang))))
            if not len(shard.words):
                return
            yield pa.RecordBatch.from_pylist([shard.stored()], schema=_SHARD)
            for found in shard.pair_sums(buckets, least):
                for row in sums.add(*found):
                    yield pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for batch in batches:
            table = pa.table(batch)
            for lang in pc.unique(table["lang"]).to_pylist():
                texts = table.filter(pc.equal(table["lang"], lang))["text"].combine_chunks()
                _, bounds = utf8(texts)
                for start, end in pieces(bounds, SHARD_BYTES):
                    if held.get(lang, 0) + bounds[end] - bounds[start] > SHARD_BYTES and lang in held:
                        yield from emptied(lang)
                    # A copy, as a slice would hold its whole batch.
                    waiting.setdefault(lang, []).append(pa.concat_arrays([texts[start:end].take(pa.array(np.arange(end - start)))]))
                    held[lang] = held.get(lang, 0) + int(bounds[end] - bounds[start])
                    while sum(held.values()) > 3 * SHARD_BYTES:
                        yield from emptied(max(held, key=held.get))
        for lang in list(held):
            yield from emptied(lang)
        for row in sums.all():
            yield pa.RecordBatch.from_pylist([row], schema=_SHARD)

    return make


# --- index ------------------------------------------------------------------------------


class Side:
    """One direction: suffixes sorted by their first `depth` words, and the last-to-first map."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n = len(sequence)
        rank, known = sequence.astype(np.int64), 1
        order = np.argsort(rank, kind="stable") if depth < 2 else None
        while known < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - known)] = rank[known:] + 1
            key = rank * (rank.max() + 2) + after if n else rank
            order = np.argsort(key, kind="stable")
            fresh = np.diff(key[order], prepend=-1) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            known *= 2
        self.suffixes = order.astype(np.int32)
        self.first_word = sequence[order]
        before = sequence[order - 1]
        self.last_to_first = np.empty(n, np.int32)
        self.last_to_first[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
        self.has_before = before > 0


class Intervals:
    """Phrases of one length: where each begins in both directions, and its occurrences."""

    def __init__(self, ahead: np.ndarray, back: np.ndarray, size: np.ndarray):
        self.ahead, self.back, self.size = ahead, back, size

    def __len__(self) -> int:
        return len(self.size)


class Index:
    """A two-way index of a sequence of numbers above 0, in which a 0 ends every piece."""

    def __init__(self, sequence: np.ndarray, depth: int):
        self.sequence, self.depth = sequence, depth
        self.ahead = Side(sequence, depth)
        self._back: Side | None = None

    @property
    def back(self) -> Side:
        if self._back is None:
            # A piece ends with a 0 in both directions.
            turned = self.sequence[::-1]
            self._back = Side(np.concatenate([turned[1:], turned[:1]]) if len(turned) else turned, self.depth)
        return self._back

    def words(self) -> Intervals:
        """Single words. Both directions hold the same words, so their intervals are equal."""
        starts = np.flatnonzero(np.diff(self.ahead.first_word, prepend=-1) != 0)
        size = np.diff(np.append(starts, len(self.sequence)))
        real = self.ahead.first_word[starts] > 0
        return Intervals(starts[real], starts[real], size[real])

    @staticmethod
    def _extended(side: Side, begins: np.ndarray, others: np.ndarray, size: np.ndarray):
        """Parents, begins here, begins in the other direction, and sizes of all extensions."""
        parent = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins, size)
        held = side.has_before[at]
        source = np.full(len(side.first_word), -1, np.int64)
        source[side.last_to_first[at[held]]] = parent[held]
        # Extensions of one phrase by one word are neighbours; words ascend with the place.
        change = np.ones(len(source), bool)
        change[1:] = (source[1:] != source[:-1]) | (side.first_word[1:] != side.first_word[:-1])
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(source)))
        real = source[starts] >= 0
        starts, sizes, parents = starts[real], sizes[real], source[starts[real]]
        # In the other direction extensions follow each other by word, after the piece ends.
        order = np.argsort(parents, kind="stable")
        ordered, total = parents[order], np.cumsum(sizes[order])
        ends = size - np.bincount(parents, sizes, len(size)).astype(np.int64)
        new = np.diff(ordered, prepend=-1) != 0
        base = np.repeat((total - sizes[order])[new], np.diff(np.append(np.flatnonzero(new), len(ordered))))
        other = np.empty(len(starts), np.int64)
        other[order] = others[ordered] + ends[ordered] + total - sizes[order] - base
        return starts, other, sizes

    def extend_left(self, phrases: Intervals) -> Intervals:
        return Intervals(*self._extended(self.ahead, phrases.ahead, phrases.back, phrases.size))

    def extend_right(self, phrases: Intervals) -> Intervals:
        back, ahead, size = self._extended(self.back, phrases.back, phrases.ahead, phrases.size)
        return Intervals(ahead, back, size)

    def phrases(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 2 the phrases, a row of numbers each, and their counts."""
        found = self.words()
        for length in range(2, longest + 1):
            found = self.extend_left(found) if length % 2 == 0 else self.extend_right(found)
            if not len(found):
                return
            places = self.ahead.suffixes[found.ahead]
            yield self.sequence[places[:, None] + np.arange(length)], found.size


# --- shards -----------------------------------------------------------------------------


def _runs(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Keep what is linked to a neighbour; a 0 ends every run. `linked[i]`: i and i + 1 belong together."""
    after = np.append(linked, False)
    before = np.insert(linked, 0, False)
    kept = (after | before) & (ids > 0)
    out = np.zeros(np.count_nonzero(kept) + np.count_nonzero(kept & ~after), ids.dtype)
    ends = (kept & ~after)[kept]
    out[np.arange(len(ends)) + np.concatenate([[0], np.cumsum(ends[:-1])])] = ids[kept]
    return out


_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_PHRASES_DDL = "lang string, phrase string, n bigint"


def _crowded(least: int):
    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of a block whose sums reach `least`."""
        sums = np.zeros(_BLOCK, np.int64)
        for batch in group:
            for places, held in zip(batch["places"].to_pylist(), batch["held"].to_pylist(), strict=True):
                at = np.cumsum(_unpacked_numbers(places, np.uint16), dtype=np.int64)
                sums[at] += np.frombuffer(_unpacked(held), np.uint8)
        bits = np.packbits(sums >= least).tobytes()
        yield pa.RecordBatch.from_pylist([{"kind": key[0].as_py(), "part": key[1].as_py(), "bits": bits}], schema=_BITS)

    return add


_BITS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("bits", pa.binary())])
_BITS_DDL = "kind string, part int, bits binary"


def _sifted(longest: int, buckets: int, crowded):
    """A function of a stored shard: the shard, its words in crowded buckets, and its phrases by length.

    All neighbouring pairs of a phrase lie in crowded buckets, as does a longer phrase once its sums are known.
    """

    def sift(lang: str, numbers: bytes, words: bytes):
        ids = _unpacked_numbers(numbers, np.int32)
        texts = _unpacked(words).decode("utf-8", "surrogatepass").split(" ")
        shard, bits = _Shard(lang, ids, pa.array(texts, pa.large_string())), crowded.value

        def kept(kind: str, rows: np.ndarray) -> np.ndarray:
            at = shard.buckets(rows, buckets)
            held = np.frombuffer(bits[kind], np.uint8)[at >> 3]
            return held & (128 >> (at & 7)).astype(np.uint8) > 0

        singles = np.arange(1, len(texts) + 1)[:, None]
        for kind in (_WORDS, _NEEDED):
            if kind in bits:
                singles = singles[kept(kind, singles)]
        linked = (ids[1:] > 0) & (ids[:-1] > 0)
        places = np.flatnonzero(linked)
        linked[places] = kept(_PAIRS, np.column_stack([ids[places], ids[places + 1]]))
        found = [(singles, np.bincount(ids, minlength=len(texts) + 1)[singles[:, 0]])]
        for rows, counts in Index(_runs(ids, linked), longest).phrases(longest):
            if rows.shape[1] > 2 and _LONGER in bits:
                held = kept(_LONGER, rows)
                rows, counts = rows[held], counts[held]
            found.append((rows, counts))
        return shard, found

    return sift


def _each(batches: Iterator[pa.RecordBatch], sift):
    for batch in batches:
        for i in range(len(batch)):
            yield sift(*(batch.column(name)[i].as_py() for name in ("lang", "places", "held")))


def _longer_sums(longest: int, buckets: int, least: int, crowded):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of longer phrases by bucket, and the buckets of words in pairs."""
        sums = _Sums(least)
        for shard, found in _each(batches, _sifted(longest, buckets, crowded)):
            for rows, counts in found[1:]:
                if rows.shape[1] == 2:
                    kind, rows = _NEEDED, np.unique(rows)[:, None]
                    counts = np.full(len(rows), least)
                else:
                    kind = _LONGER
                for row in sums.add(kind, *shard.sums(rows, counts, buckets, least)):
                    yield pa.RecordBatch.from_pylist([row], schema=_SHARD)
        for row in sums.all():
            yield pa.RecordBatch.from_pylist([row], schema=_SHARD)

    return count


def _counted(longest: int, buckets: int, crowded):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All that is left with its counts: a row for each block of buckets."""
        for shard, found in _each(batches, _sifted(longest, buckets, crowded)):
            texts, sizes, blocks = [], [], []
            for rows, counts in found:
                parts = [shard.words.take(pa.array(rows[:, i] - 1)) for i in range(rows.shape[1])]
                texts.append(pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())))
                sizes.append(counts.astype(np.int64))
                blocks.append(shard.buckets(rows, buckets) // _BLOCK)
            blocks, sizes = np.concatenate(blocks), np.concatenate(sizes)
            order = np.argsort(blocks, kind="stable")
            texts, sizes = pa.concat_arrays(texts).take(pa.array(order)), sizes[order]
            held, first = np.unique(blocks[order], return_index=True)
            for block, i, j in zip(held, first, np.append(first, len(order))[1:], strict=True):
                # No phrase holds a line break.
                packed = _packed("\n".join(texts[i:j].to_pylist()).encode("utf-8", "surrogatepass"))
                row = shard.row("counts", int(block), packed, _packed_numbers(sizes[i:j]))
                yield pa.RecordBatch.from_pylist([row], schema=_SHARD)

    return count


def _added(least: int):
    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The frequent phrases of a block; only its distinct phrases are held."""
        held, waiting, rows = pa.table({"phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), [], 0

        def summed():
            table = pa.concat_tables([held, *waiting]).group_by("phrase").aggregate([("n", "sum")])
            return table.select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])

        for batch in group:
            for phrases, counts in zip(batch["places"].to_pylist(), batch["held"].to_pylist(), strict=True):
                texts = _unpacked(phrases).decode("utf-8", "surrogatepass").split("\n")
                waiting.append(pa.table({"phrase": pa.array(texts, pa.string()), "n": _unpacked_numbers(counts, np.int64)}))
                rows += len(texts)
                if rows > max(1 << 18, 2 * len(held)):
                    held, waiting, rows = summed(), [], 0
        held = summed()
        held = held.filter(pc.greater_equal(held["n"], least))
        lang = pa.array([key[0].as_py()] * len(held), pa.string())
        yield from pa.table([lang, held["phrase"], held["n"]], schema=_PHRASES).to_batches(1 << 16)

    return add


def _bit_maps(sums: DataFrame, kinds: tuple[str, ...], buckets: int, least: int) -> dict[str, bytes]:
    """The crowded buckets of each kind, at most MOST_BUCKETS / 8 bytes."""
    found = {kind: np.zeros(buckets // 8, np.uint8) for kind in kinds}
    rows = sums.where(F.col("kind").isin(*kinds)).select("kind", "part", "places", "held")
    for row in rows.groupBy("kind", "part").applyInArrow(_crowded(least), _BITS_DDL).toLocalIterator():
        found[row.kind][row.part * _BLOCK // 8 :][: _BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return {kind: bits.tobytes() for kind, bits in found.items()}


def frequent_phrases(
    documents: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, n) of all frequent phrases, single words included; and (lang, total), its words."""
    held = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    # About a word for six bytes.
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(_BLOCK, 1 << (size // 48).bit_length()))
    enough = min(least, 255)
    shards = store(held.mapInArrow(_make_shards(buckets, enough), _SHARD_DDL), "shards").frame

    numbers = shards.where(F.col("kind") == _NUMBERS)
    totals = numbers.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = store(totals, "totals").frame
    context = documents.sparkSession.sparkContext
    parts = numbers.select("lang", "places", "held")
    bits = _bit_maps(shards, (_WORDS, _PAIRS), buckets, enough)
    if longest > 2:
        longer = parts.mapInArrow(_longer_sums(longest, buckets, enough, context.broadcast(bits)), _SHARD_DDL)
        bits |= _bit_maps(longer, (_LONGER, _NEEDED), buckets, enough)
    found = parts.mapInArrow(_counted(longest, buckets, context.broadcast(bits)), _SHARD_DDL)
    packed = found.select("lang", "part", "places", "held").groupBy("lang", "part")
    counted = packed.applyInArrow(_added(least), _PHRASES_DDL)
    counted = counted.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n_words"), "n")
    return store(counted, "phrases").frame, totals


def collocations(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases as told above."""
    return best_phrases(*frequent_phrases(documents, text, lang, longest, least), top)


def best_phrases(phrases: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The candidates among counted phrases that no longer one explains, by score."""
    candidates = phrases.where(F.col("n_words") > 1).withColumn("words", F.split("phrase", " "))

    def part(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    longer = candidates.where(F.col("n_words") > 2)
    ends = F.array(part(F.lit(1), F.col("n_words") - 1), part(F.lit(2), F.col("n_words") - 1))
    explained = longer.select("lang", F.explode(ends).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    left = candidates.join(explained, ["lang", "phrase"], "left")
    left = left.where(F.coalesce(F.col("most") < F.col("n"), F.lit(True))).drop("most")

    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang",
        "phrase",
        F.col("n").alias("a"),
        "k",
        part(F.lit(1), F.col("k")).alias("head"),
        part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("tail"),
    )
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    parts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    # Decimals of 38 digits hold the products of two counts; the quotient fits a long.
    wide = "decimal(38,0)"
    score = F.expr(f"CAST(CAST(a AS {wide}) * 1000 * total AS {wide}) div CAST(CAST(l AS {wide}) * r AS {wide})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = parts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(lowest)
    scored = scored.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
