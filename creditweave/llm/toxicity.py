"""Toxicity scores from the nearest labelled examples.

Terms are lower-cased words and the six-byte grams inside them, hashed to 64 bits; grams carry
over to forms of a word that no example has. Fitting takes a bounded sample of labelled rows
(`sample_rows`, those with the smallest hash of their id):

* Of examples with equal texts one counts, so that copies are no evidence for their words.
* Every term of every example is indexed.
* Document frequencies are those of all documents: exact for indexed terms, and for terms that
  no example has in `BUCKETS` hash buckets. The latter only lengthen a text's vector.
* The IDF of a term that `least_rows` examples have is raised by its correlation with the label
  (times `emphasis`). No term is left out or lowered by it: else the many terms of a long text
  drown the few that matter.
* Each example becomes a TF-IDF vector of unit length, and the vectors an inverted index: for
  each term the examples that have it, with their counts as numbers of few bits, from which the weights follow.
  Examples are numbered in blocks, and each term that many examples have knows its largest weight in each block.
  Tasks order the postings, each those of a range of hashes; the driver gets them in order, as runs of equal count,
  and works through them `STRETCH` at a time.
* Votes are calibrated: the leave-one-out votes of the examples, taken in tasks, are binned and made monotone.

The index is as large as the texts of the sample, whatever the size of the corpus, so tasks get
it by broadcast. A text is scored whole, in its task: the postings of its rarer terms are added up
for every example. A term's postings lie in runs of equal count, hence of one factor, so only their rows are read;
terms with the same postings, as a word and most of its grams, are read once, with the sum of their weights.
Sums over the common terms are one matrix product for `TOGETHER` texts. For a single text, as in fitting, the
bound for a block is its highest such sum and the sum of the block's
largest weights of the common terms; blocks are opened in descending order of the bound until
none can hold a nearer example. Both ways are exact; ties go to the smaller
example id. The vote is the mean label of the `k` nearest, weighted by cosine, with the share of
toxic examples as a prior of weight `prior`.

A text without any indexed term, such as a null or empty one, has no cosine; it gets the share
of toxic examples among those that have no indexed term either. Labels without an id or value are
not used; of several labels of an id the highest counts. Without any example every score is 0.
Repeated rows are scored alike. All columns of the input are kept; those named like an output
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.llm.decontaminate import word_hashes
from creditweave.llm.textkit import NOT_ALNUM, Words, pieces, unused, utf8, words
from creditweave.sources.workspace import store

GRAM = 6
BLOCK = 64
EVIDENCE = 3
BUCKETS = 1 << 20
COMMON = 256
TOGETHER = 64
SLICED = 64
PARTS = 64
STRETCH = 1 << 18
# Bytes of texts whose terms a task has at once.
PIECE = 1 << 19


@dataclass(frozen=True)
class Fit:
    sample_rows: int = 8192
    least_rows: int = 5
    emphasis: float = 30.0
    k: int = 25
    prior: float = 0.5
    bins: int = 20


def _grams(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte grams inside words as hashes, and the word of each."""
    data = found.data.astype(np.uint64)
    if len(data) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.diff(found.bounds)
    counts = np.maximum(0, lengths - GRAM + 1)
    word = np.repeat(np.arange(len(found)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    starts = np.repeat(found.bounds[:-1] - first, counts) + np.arange(len(word))
    packed = reduce(lambda total, step: (total << np.uint64(8)) | data[starts + step], range(GRAM), np.zeros(len(starts), np.uint64))
    return packed * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5851F42D4C957F2D), word


def _terms(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a batch: its range, term hashes, and the text of each."""
    raw, bounds = utf8(column)
    for start, end in pieces(bounds, PIECE):
        part = bounds[start : end + 1] - bounds[start]
        found = words(raw[bounds[start] : bounds[end]], part, NOT_ALNUM, lower=True)
        text = found.text_of_word()
        grams, word = _grams(found)
        yield (
            start,
            end,
            np.concatenate([word_hashes(found.data, found.bounds), grams]),
            np.concatenate([text, text[word]]),
        )


def _counted(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs in order, with their counts."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    places = np.flatnonzero(new)
    return text[places], term[places], np.diff(np.concatenate([places, [len(text)]]))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example with its distinct terms and their counts."""
    for batch in batches:
        for start, end, terms, texts in _terms(batch["text"]):
            text, term, count = _counted(texts, terms)
            bounds = pa.array(np.searchsorted(text, np.arange(end - start + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["example"][start:end],
                    batch["label"][start:end],
                    pa.ListArray.from_arrays(bounds, pa.array(term.view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int32))),
                ],
                names=["example", "label", "term", "n"],
            )


_DEALT_DDL = "part int, row array<int>, term array<bigint>, n array<int>"
_ORDERED_DDL = "part int, term array<bigint>, runs array<int>, n array<int>, length array<int>, row array<int>"


def _dealt(ids: np.ndarray):
    """Postings by the range their term's hash is in; `row` is the example's place in `ids`."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                row = np.searchsorted(ids, some["example"].to_numpy()).astype(np.int32)
                row = np.repeat(row, pc.list_value_length(some["term"]).to_numpy())
                term, n = (pc.list_flatten(some[c]).to_numpy() for c in ("term", "n"))
                part = (term.view(np.uint64) // np.uint64(2**64 // PARTS)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                bounds = pa.array(np.searchsorted(part[order], np.arange(PARTS + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in (row, term, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(PARTS, dtype=np.int32)), *lists], names=["part", "row", "term", "n"]
                )

    return deal


def _ordered(table: pa.Table) -> pa.Table:
    """The postings of a range by term, count and row: terms with their numbers of runs, runs with their lengths."""
    row, term, n = (pc.list_flatten(table[c]).to_numpy() for c in ("row", "term", "n"))
    # Hashes of a range have the same sign, so their order is that of unsigned ones.
    order = np.lexsort((row, n, term))
    row, term, n = row[order], term[order], n[order]
    new_term, new_run = np.ones(len(term), bool), np.ones(len(term), bool)
    new_term[1:] = term[1:] != term[:-1]
    new_run[1:] = new_term[1:] | (n[1:] != n[:-1])
    starts = np.flatnonzero(new_run)
    firsts = np.flatnonzero(new_term[starts])
    runs = np.diff(np.append(firsts, len(starts))).astype(np.int32)
    length = np.diff(np.append(starts, len(term))).astype(np.int32)
    lists = [pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in (term[new_term], runs, n[starts], length, row)]
    return pa.Table.from_arrays([table["part"][:1], *lists], names=["part", "term", "runs", "n", "length", "row"])


def _postings(vectors: DataFrame, ids: np.ndarray) -> DataFrame:
    """A row for each range of hashes, in any order."""
    ordered = vectors.mapInArrow(_dealt(ids), _DEALT_DDL).groupBy("part").applyInArrow(_ordered, _ORDERED_DDL)
    # Rows go to the driver as narrow as they can be.
    return ordered.withColumn("row", F.col("row").cast("array<smallint>")) if len(ids) < 1 << 15 else ordered


def _numbers(known: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The places of terms among the known ones; others get one of `BUCKETS` numbers above."""
    other = len(known) + (terms >> np.uint64(40)).astype(np.int64) % BUCKETS
    if not len(known):
        return other
    place = np.searchsorted(known, terms)
    place[place == len(known)] = 0
    return np.where(known[place] == terms, place, other)


def _counted_numbers(text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_counted`, for numbers below 2^32; sorts one array."""
    pairs = np.sort(text.astype(np.int64) << 32 | number)
    places = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[places] >> 32, pairs[places] & 0xFFFFFFFF, np.diff(np.concatenate([places, [len(pairs)]]))


def _document_frequencies(documents: DataFrame, text: str, known: np.ndarray) -> np.ndarray:
    """Texts that hold each known term, and then those of each bucket of other terms."""
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + BUCKETS, np.int64)
        for batch in batches:
            for _, _, terms, texts in _terms(batch.column(0)):
                _, number, _ = _counted_numbers(texts, _numbers(shared.value, terms))
                np.add.at(total, number, 1)
        held = np.flatnonzero(total)
        for at in range(0, len(held), 1 << 16):
            some = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["number", "n"])

    parts = documents.select(text).mapInArrow(counts, "number bigint, n bigint")
    found = parts.groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(known) + BUCKETS)
    out[found["number"].to_numpy()] = found["n"].to_numpy()
    return out


@dataclass(frozen=True)
class Index:
    """The model that tasks get.

    Terms are in hash order; `bounds` are those of their postings, which are `rows` of examples, and `first` those
    of their runs of equal counts. A run's postings end where the next `starts`; `tf` has the factor of its code in
    `codes`, `norms` the length of each example (1 beyond the last). `same` is the first term that has the same
    postings. `idf` goes on with the buckets of other terms. Rows of `largest` and of `dense` (block, example,
    term) are the common terms.
    """

    terms: np.ndarray
    idf: np.ndarray
    examples: np.ndarray
    labels: np.ndarray
    norms: np.ndarray
    bounds: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    same: np.ndarray
    tf: np.ndarray
    common: np.ndarray
    largest: np.ndarray
    dense: np.ndarray
    without_terms: float
    fit: Fit

    def weights(self, term: int) -> np.ndarray:
        """Of a term's postings."""
        some = slice(self.bounds[term], self.bounds[term + 1])
        runs = slice(self.first[term], self.first[term + 1])
        lengths = np.diff(self.starts[runs.start : runs.stop + 1])
        return np.repeat(self.tf[self.codes[runs]], lengths) * self.idf[term] / self.norms[self.rows[some]]

    def rare_sums(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """For each example, the sum over these terms; postings are read as they are stored."""
        if not len(places):
            return np.zeros(len(self.norms))
        weights, places = query * self.idf[places], self.same[places]
        order = np.argsort(places, kind="stable")
        change = np.flatnonzero(np.diff(places[order], prepend=-1))
        places, weights = places[order][change], np.add.reduceat(weights[order], change)
        # Long postings are sliced, the many short ones gathered at once.
        length = self.bounds[places + 1] - self.bounds[places]
        long = length >= SLICED
        cut = len(places) - np.count_nonzero(long)
        order = np.concatenate([np.flatnonzero(~long), np.flatnonzero(long)])
        places, weights, length = places[order], weights[order], length[order].astype(np.int64)
        begins = self.bounds[places].astype(np.int64)
        short = np.arange(length[:cut].sum()) + np.repeat((begins + length - np.cumsum(length))[:cut], length[:cut])
        slices = [self.rows[a : a + n] for a, n in zip(begins[cut:].tolist(), length[cut:].tolist(), strict=True)]
        rows = np.concatenate([self.rows[short], *slices])
        first = self.first[places].astype(np.int64)
        count = self.first[places + 1] - first
        runs = np.arange(count.sum()) + np.repeat(first + count - np.cumsum(count), count)
        weights = self.tf[self.codes[runs]] * np.repeat(weights, count)
        weights = np.repeat(weights, self.starts[runs + 1] - self.starts[runs])
        return np.bincount(rows, weights, len(self.norms)) / self.norms

    def vector(self, places: np.ndarray, counts: np.ndarray, others: float = 0.0) -> np.ndarray:
        """Weights of the indexed terms; `others` is the squared weight of the text's other terms."""
        weights = (1.0 + np.log(counts)) * self.idf[places]
        return weights / np.sqrt(weights @ weights + others)

    def wide(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The query over the common terms."""
        at = self.common[places]
        some = at >= 0
        places = places[some]
        return np.bincount(at[some], query[some] * self.idf[places] / self.idf[self.same[places]], len(self.largest))

    def common_sums(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each query and example, the sum over the common terms."""
        wide = np.array([self.wide(*query) for query in queries])
        return wide @ self.dense.reshape(-1, len(self.largest)).T

    def nearest_given(self, places: np.ndarray, query: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `nearest`, with the sums over the common terms."""
        k, n = self.fit.k, len(self.examples)
        rare = self.common[places] < 0
        scores = (self.rare_sums(places[rare], query[rare]) + sums)[:n]
        least = np.partition(scores, n - k)[n - k] - 1e-9 if n > k else 0.0
        rows = np.flatnonzero((scores > 0) & (scores >= least))
        held = scores[rows]
        best = np.lexsort((self.examples[rows], -np.round(held, 9)))[:k]
        return rows[best], held[best]

    def nearest(self, places: np.ndarray, query: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the nearest examples, by blocks in descending order of bound."""
        k, n = self.fit.k, len(self.examples)
        rare = self.common[places] < 0
        wide = self.wide(places, query)
        sums = self.rare_sums(places[rare], query[rare]).reshape(-1, BLOCK)
        bound = sums.max(1) + wide @ self.largest
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        held_rows, held = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order):
            if len(held) >= k and bound[order[at]] < held[k - 1] - 1e-9:
                break
            opened = np.sort(order[at : at + step])
            at, step = at + step, step * 4
            # Of many blocks all are multiplied, which copies none.
            products = (self.dense @ wide)[opened] if 4 * len(opened) > len(sums) else self.dense[opened] @ wide
            scores = (sums[opened] + products).ravel()
            rows = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            some = (scores > 0) & (rows < n) & (rows != leave)
            if len(held) >= k:
                some &= scores >= held[k - 1] - 1e-9
            held_rows = np.concatenate([held_rows, rows[some]])
            held = np.concatenate([held, scores[some]])
            # Cosines that differ by rounding only are ties.
            best = np.lexsort((self.examples[held_rows], -np.round(held, 9)))[:k]
            held_rows, held = held_rows[best], held[best]
        return held_rows, held

    def vote(self, rows: np.ndarray, cosines: np.ndarray, share: float) -> float:
        prior = self.fit.prior
        return float((prior * share + cosines @ self.labels[rows]) / (prior + cosines.sum()))


def _monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), value) for value, _, n in pools])


def _calibrate(votes: np.ndarray, labels: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(votes):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(votes, kind="stable")
    centres, rates, sizes = [], [], []
    for some in np.array_split(order, min(bins, len(order))):
        centres.append(votes[some].mean())
        rates.append((labels[some].sum() + 0.5 * votes[some].mean()) / (len(some) + 0.5))
        sizes.append(len(some))
    return np.array(centres), _monotone(np.array(rates), np.array(sizes, float))


@dataclass(frozen=True)
class Model:
    """A shared index, the share of toxic examples, and the line that calibrates votes."""

    index: Broadcast
    share: float
    edges: np.ndarray
    levels: np.ndarray

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.edges, self.levels))


def fit_model(
    documents: DataFrame, labels: DataFrame, fit: Fit, text: str, key: str, label: str
) -> Model:
    """Fit on the labelled rows given; which rows those are is the caller's choice."""
    index, vectors = fit_index(documents, labels, fit, text, key, label)
    share = float(index.labels.mean()) if len(index.labels) else 0.0
    shared = documents.sparkSession.sparkContext.broadcast(index)
    del index
    votes = _left_out(vectors, shared, share).toArrow().sort_by("example")
    edges, levels = _calibrate(votes["vote"].to_numpy(), votes["label"].to_numpy(), fit.bins)
    return Model(shared, share, edges, levels)


def _left_out(vectors: DataFrame, shared: Broadcast, share: float) -> DataFrame:
    """(example, vote, label) of each indexed example without itself."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        numbers = {int(e): i for i, e in enumerate(index.examples)}
        for batch in batches:
            found = []
            for example, term, n in zip(batch["example"], batch["term"], batch["n"], strict=True):
                row = numbers.get(example.as_py(), -1)
                if row < 0:
                    continue
                # An example's terms ascend, as those of the index do.
                places = np.searchsorted(index.terms, term.values.to_numpy().view(np.uint64))
                query = index.vector(places, n.values.to_numpy())
                vote = index.vote(*index.nearest(places, query, leave=row), share)
                found.append({"example": int(index.examples[row]), "vote": vote, "label": float(index.labels[row])})
            yield pa.RecordBatch.from_pylist(found, schema=_VOTES)

    return vectors.mapInArrow(votes, "example bigint, vote double, label double")


_VOTES = pa.schema([("example", pa.int64()), ("vote", pa.float64()), ("label", pa.float64())])


def fit_index(
    documents: DataFrame, labels: DataFrame, fit: Fit, text: str, key: str, label: str
) -> tuple[Index, DataFrame]:
    """The index, and the table of the examples' terms (example, label, term, n)."""
    spark = documents.sparkSession
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("example"))
        .agg((F.max(label) > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("example"), "example")
        .limit(fit.sample_rows)
    )
    chosen = store(known, "toxicity-sample").frame
    texts = documents.select(F.col(key).alias("example"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "example")
    # Of rows that repeat an id, the smallest text is the example.
    sample = sample.groupBy("example", "label").agg(F.min("text").alias("text"))
    same_text = F.coalesce(F.xxhash64("text"), F.lit(0))
    sample = sample.groupBy(same_text).agg(
        F.min(F.struct("example", "text")).alias("one"), F.max("label").alias("label")
    )
    sample = sample.select("one.example", "label", "one.text")
    vectors = store(
        sample.mapInArrow(_examples, "example bigint, label int, term array<bigint>, n array<int>"),
        "toxicity-terms",
    ).frame
    rows = float(documents.count())
    known = vectors.select("example", "label").toArrow().sort_by("example")
    ids, everyone = known["example"].to_numpy(), known["label"].to_numpy().astype(float)
    found = _postings(vectors, ids).toArrow()
    index = _index(found, ids, everyone, lambda known: _document_frequencies(documents, text, known), rows, fit)
    return index, vectors


def _related(df: np.ndarray, hit: np.ndarray, rows: float, toxic: float) -> np.ndarray:
    """Squared correlation with the label of terms that `df` examples have, `hit` of them toxic."""
    cross = hit * (rows - toxic - (df - hit)) - (df - hit) * (toxic - hit)
    below = df * (rows - df) * toxic * (rows - toxic)
    return np.divide(cross * cross, below, out=np.zeros(len(df)), where=below > 0)


def _same_postings(bounds: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each term the first term with the same rows and codes."""
    n = len(bounds) - 1
    if not n:
        return np.zeros(0, np.int32)
    length = np.diff(bounds)
    stretches = list(pieces(bounds.astype(np.int64), STRETCH))
    mixed = np.empty(n, np.uint64)
    for a, b in stretches:
        some = slice(bounds[a], bounds[b])
        value = (codes[some].astype(np.uint64) << np.uint64(32) | rows[some]) + np.uint64(1)
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        mixed[a:b] = np.add.reduceat(value, bounds[a:b] - bounds[a])
    _, found, of = np.unique(mixed, return_index=True, return_inverse=True)
    del mixed
    same = found[of].astype(np.int32)
    # Hashes may agree by chance.
    alike = length == length[same]
    for a, b in stretches:
        some = slice(bounds[a], bounds[b])
        at = np.arange(some.start, some.stop) + np.repeat(bounds[same[a:b]] - bounds[a:b], length[a:b])
        at = np.minimum(at, len(rows) - 1)
        equal = (rows[some] == rows[at]) & (codes[some] == codes[at])
        alike[a:b] &= np.logical_and.reduceat(equal, bounds[a:b] - bounds[a])
    return np.where(alike, same, np.arange(n, dtype=np.int32))


def _index(found: pa.Table, ids: np.ndarray, everyone: np.ndarray, frequencies, rows: float, fit: Fit) -> Index:
    """`found` are the `_postings` of the examples `ids` with the labels `everyone`, `frequencies` gives document
    frequencies of terms, `rows` is the number of documents."""
    parts = np.argsort(found["part"].to_numpy()).tolist()

    def joined(column: str) -> np.ndarray:
        kind = found.schema.field(column).type.value_type.to_pandas_dtype()
        return np.concatenate([np.zeros(0, kind), *(found[column][i].values.to_numpy() for i in parts)])

    unsigned = joined("term").view(np.uint64)
    first = np.concatenate([[0], np.cumsum(joined("runs"))]).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(joined("length"))]).astype(np.int32)
    known_counts, codes = np.unique(joined("n"), return_inverse=True)
    tf = 1.0 + np.log(known_counts)
    codes = codes.astype(np.min_scalar_type(max(0, len(tf) - 1)))
    holder = joined("row")
    del found
    bounds = starts[first]
    held_by = np.diff(bounds)
    # Arrays over all postings are the driver's largest; only their rows and codes are held whole.
    stretches = list(pieces(bounds.astype(np.int64), STRETCH))
    dfs = frequencies(unsigned)
    idf = np.log((1.0 + rows) / (1.0 + dfs)) + 1.0
    del dfs
    toxic = np.zeros(len(unsigned))
    for a, b in stretches:
        toxic[a:b] = np.add.reduceat(everyone[holder[bounds[a] : bounds[b]]], bounds[a:b] - bounds[a])
    related = _related(held_by.astype(float), toxic, float(len(ids)), everyone.sum())
    related[held_by < fit.least_rows] = 0.0
    idf[: len(unsigned)] *= 1.0 + fit.emphasis * np.sqrt(related)
    del toxic, related

    def weighted(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and weights of the postings of some terms."""
        lengths = np.diff(starts[first[a] : first[b] + 1])
        weight = np.repeat(tf[codes[first[a] : first[b]]], lengths) * np.repeat(idf[a:b], held_by[a:b])
        return holder[bounds[a] : bounds[b]], weight

    squares, most = np.zeros(len(ids)), np.zeros(len(ids))
    for a, b in stretches:
        row, weight = weighted(a, b)
        np.add.at(squares, row, weight**2)
        np.maximum.at(most, row, weight)
    norms = np.sqrt(squares)
    # Examples that share their heaviest term get neighbouring numbers, so that a block holds
    # like examples and its largest weights are tight bounds.
    heaviest = np.full(len(ids), len(unsigned))
    for a, b in stretches:
        row, weight = weighted(a, b)
        top = np.flatnonzero(weight == most[row])
        np.minimum.at(heaviest, row[top], np.searchsorted(bounds, bounds[a] + top, side="right") - 1)
    indexed = np.flatnonzero(norms > 0)
    indexed = indexed[np.lexsort((ids[indexed], heaviest[indexed]))]
    labels, examples = everyone[indexed], ids[indexed]
    renumbered = np.zeros(len(ids), np.min_scalar_type(max(0, len(indexed) - 1)))
    renumbered[indexed] = np.arange(len(indexed))
    rows_by_term = renumbered[holder]
    del holder
    blocks = -(-max(1, len(examples)) // BLOCK)
    lengths = np.ones(blocks * BLOCK)
    lengths[: len(indexed)] = norms[indexed]
    # Terms of a twelfth of the examples or more, at most `COMMON`, are held densely.
    same = _same_postings(bounds, rows_by_term, np.repeat(codes, np.diff(starts)))
    often = np.flatnonzero(same == np.arange(len(same)))
    often = often[np.argsort(-held_by[often], kind="stable")[:COMMON]]
    often = often[held_by[often] * 12 >= max(1, len(examples))]
    common = np.full(len(unsigned), -1, np.int16)
    common[often] = np.arange(len(often))
    common = common[same]
    dense = np.zeros((blocks, BLOCK, len(often)))
    without = everyone[norms == 0]
    share = float(everyone.mean()) if len(everyone) else 0.0
    apart = (float(without.sum()) + share) / (len(without) + 1.0)
    index = Index(
        unsigned, idf, examples, labels, lengths, bounds, rows_by_term, first, starts, codes, same, tf, common, dense.max(1).T, dense, apart, fit
    )
    for at, term in enumerate(often):
        held = rows_by_term[bounds[term] : bounds[term + 1]].astype(np.int64)
        dense[held // BLOCK, held % BLOCK, at] = index.weights(term)
    return replace(index, largest=dense.max(1).T.copy())


_RESULT = "score double, evidence array<struct<example:bigint,cosine:double,toxic:int>>"


def _queries(index: Index, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text with indexed terms: its place, their places, and their weights."""
    for start, end, terms, of in _terms(texts):
        text, number, counts = _counted_numbers(of, _numbers(index.terms, terms))
        hit = number < len(index.terms)
        squares = ((1.0 + np.log(counts[~hit])) * index.idf[number[~hit]]) ** 2
        others = np.bincount(text[~hit], squares, end - start)
        text, places, counts = text[hit], number[hit], counts[hit]
        bounds = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]])) if len(text) else [0]
        for a, b in pairwise(bounds):
            yield start + text[a], places[a:b], index.vector(places[a:b], counts[a:b], others[text[a]])


def _score_batch(model: Model, texts: pa.Array) -> pa.StructArray:
    index, share = model.index.value, model.share
    scores = np.full(len(texts), index.without_terms)
    evidence: list[list[dict]] = [[] for _ in range(len(texts))]
    queries = _queries(index, texts) if len(index.terms) else iter(())
    while some := list(islice(queries, TOGETHER)):
        for (at, *query), sums in zip(some, index.common_sums([tuple(query) for _, *query in some]), strict=True):
            rows, cosines = index.nearest_given(*query, sums)
            scores[at] = model.calibrated(index.vote(rows, cosines, share))
            evidence[at] = [
                {"example": int(index.examples[r]), "cosine": float(c), "toxic": int(index.labels[r])}
                for r, c in zip(rows[:EVIDENCE], cosines[:EVIDENCE], strict=True)
            ]
    kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    return pa.StructArray.from_arrays([pa.array(scores), pa.array(evidence, kind)], ["score", "evidence"])


def _scored(documents: DataFrame, labels: DataFrame, examples, fit, text, key, label) -> tuple[DataFrame, str]:
    model = fit_model(documents if examples is None else examples, labels, fit, text, key, label)

    @F.arrow_udf(_RESULT)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _score_batch(model, texts)

    got = unused(documents.columns, "scored")
    return documents.withColumn(got, scored(F.col(text))), got


def toxicity(
    documents: DataFrame,
    labels: DataFrame,
    examples: DataFrame | None = None,
    fit: Fit = Fit(),
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
) -> DataFrame:
    """Add `score`, `predicted` and `evidence` to each document.

    `labels` are the rows to learn from. `examples` are the documents they refer to, where
    those are not `documents` itself.
    """
    found, got = _scored(documents, labels, examples, fit, text, key, label)
    outputs = {"score": F.col(got)["score"], "evidence": F.col(got)["evidence"]}
    return (
        found.withColumns(outputs)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .drop(got)
    )


def without_toxic(
    documents: DataFrame,
    labels: DataFrame,
    examples: DataFrame | None = None,
    fit: Fit = Fit(),
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    threshold: float = 0.5,
) -> DataFrame:
    """The documents that score below the threshold; the columns are those of the input."""
    found, got = _scored(documents, labels, examples, fit, text, key, label)
    return found.filter(F.col(got)["score"] < threshold).drop(got)
