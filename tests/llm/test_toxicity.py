import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from creditweave.llm import toxicity
from tests.llm.corpus import AWKWARD, LONG, documents, prose

BAD = "idiot moron scum trash loser".split()


def corpus(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        found = prose(i, 60).split()
        for _ in range(rng.randrange(1, 5) if bad else 0):
            found.insert(rng.randrange(len(found)), rng.choice(BAD) + rng.choice(["", "", "ic"]))
        rows.append((i, " ".join(found)))
        labels.append((i, int(bad)))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_documents(spark):
    rows, labels = corpus(spark)
    known = label_frame(spark, [x for x in labels if x[0] % 4])
    truth = dict(labels)
    got = toxicity.toxicity(documents(spark, rows).repartition(3), known).collect()
    held = [r for r in got if r.doc_id % 4 == 0]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == bool(r.predicted) for r in got)
    shown = next(r for r in held if r.predicted)
    assert shown.evidence[0].cosine > 0.3 and truth[shown.evidence[0].example] == shown.evidence[0].toxic


def test_search_is_exact(spark):
    rows, labels = corpus(spark, 500)
    fit = toxicity.Fit(k=7)
    index, _ = toxicity.fit_index(documents(spark, rows), label_frame(spark, labels), fit, "text", "doc_id", "toxic")
    dense = np.zeros((len(index.terms), len(index.examples)))
    for t in range(len(index.terms)):
        some = slice(index.bounds[t], index.bounds[t + 1])
        dense[t, index.rows[some]] = index.weights(t)
    assert np.allclose((dense**2).sum(0), 1)
    rng = np.random.default_rng(0)
    assert index.largest.shape[1] > 2
    for _ in range(200):
        places = np.sort(rng.choice(len(index.terms), rng.integers(1, 6), replace=False))
        query = index.vector(places, rng.integers(1, 4, len(places)))
        got, cosines = index.nearest(places, query)
        every = np.round(query @ dense[places], 9)
        want = [r for r in np.lexsort((index.examples, -every)) if every[r] > 0][:7]
        assert got.tolist() == want and np.allclose(cosines, every[want])


def test_labels_only_from_rows_given_and_no_other_input(spark):
    rows, labels = corpus(spark, 200)
    first = {r.doc_id: r.score for r in toxicity.toxicity(documents(spark, rows), label_frame(spark, labels)).collect()}
    moved = documents(spark, [(i, t, "xx") for i, t in rows], "lang string")
    again = {r.doc_id: r.score for r in toxicity.toxicity(moved, label_frame(spark, labels)).collect()}
    assert first == again


def test_awkward_texts_labels_and_tables(spark):
    rows, labels = corpus(spark, 200)
    rows = rows + [(1000 + i, t) for i, t in enumerate([*AWKWARD, LONG])] + [(None, None), (3, None)]
    labels = labels + [(None, 1), (5, None), (1000, 1), (1001, 0), (7, 0), (7, 1), (99_999, 1)]
    frame = documents(spark, [(*r, "old", "kept") for r in rows], "score string, scored string")
    got = toxicity.toxicity(frame, label_frame(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.scored == "kept" for r in got)
    kept = toxicity.without_toxic(frame, label_frame(spark, labels))
    assert kept.columns == frame.columns and {r.score for r in kept.collect()} == {"old"}
    none = toxicity.toxicity(frame, label_frame(spark, []))
    assert {r.score for r in none.collect()} == {0.0}
    assert toxicity.toxicity(frame.limit(0), label_frame(spark, labels)).count() == 0


def test_sample_is_bounded_and_postings_are_small(spark):
    rows, labels = corpus(spark, 300)
    fit = toxicity.Fit(sample_rows=120)
    index, _ = toxicity.fit_index(documents(spark, rows), label_frame(spark, labels), fit, "text", "doc_id", "toxic")
    assert len(index.examples) <= 120
    assert index.rows.itemsize + index.codes.itemsize <= 4


def terms_of(text):
    """Words and the six-byte grams inside them, told apart."""
    found = Counter()
    for word in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower().encode()):
        found[b"w", word] += 1
        for i in range(len(word) - 5):
            found[b"g", word[i : i + 6]] += 1
    return found


def brute_scores(rows, labels, fit):
    """Every cosine with every example, the votes, and their calibration, without an index."""
    counts = {i: terms_of(t) for i, t in rows}
    n, df = len(rows), Counter(t for c in counts.values() for t in c)
    first = {}
    for i, text in sorted(rows):
        if i in labels:
            first.setdefault(text, i)
    of_text = {}
    for i, text in rows:
        if i in labels:
            of_text[first[text]] = max(of_text.get(first[text], 0), labels[i])
    examples = {i: y for i, y in of_text.items() if counts[i]}
    seen = Counter(t for i in of_text for t in counts[i])
    bad = Counter(t for i, y in of_text.items() if y for t in counts[i])
    m, toxic = len(of_text), sum(of_text.values())

    def idf(term):
        value, held = np.log((1 + n) / (1 + df[term])) + 1, seen[term]
        if held >= fit.least_rows:
            cross = bad[term] * (m - toxic - held + bad[term]) - (held - bad[term]) * (toxic - bad[term])
            below = held * (m - held) * toxic * (m - toxic)
            value *= 1 + fit.emphasis * np.sqrt(cross * cross / below if below else 0.0)
        return value

    weight = {t: idf(t) for t in df}

    def vector(i):
        v = {t: (1 + np.log(c)) * weight[t] for t, c in counts[i].items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(i) for i, _ in rows}
    share = sum(examples.values()) / len(examples)

    def vote(i, leave=None):
        near = []
        for e in examples:
            if e != leave:
                cosine = sum(x * vectors[e].get(t, 0.0) for t, x in vectors[i].items())
                if cosine > 0:
                    near.append((-round(cosine, 9), e, cosine))
        near = sorted(near)[: fit.k]
        total = fit.prior + sum(c for _, _, c in near)
        return (fit.prior * share + sum(c * examples[e] for _, e, c in near)) / total

    order = sorted((vote(e, e), e) for e in examples)
    centres, rates, sizes = [], [], []
    for some in np.array_split(np.arange(len(order)), fit.bins):
        votes = np.array([order[j][0] for j in some])
        hits = sum(examples[order[j][1]] for j in some)
        centres.append(votes.mean())
        rates.append((hits + 0.5 * votes.mean()) / (len(some) + 0.5))
        sizes.append(len(some))
    levels = [
        max(min(np.average(rates[a : c + 1], weights=sizes[a : c + 1]) for c in range(b, len(rates))) for a in range(b + 1))
        for b in range(len(rates))
    ]
    return {i: float(np.interp(vote(i), centres, levels)) for i, _ in rows}


def test_scores_equal_brute_force(spark):
    rows, labels = corpus(spark, 240)
    rows += [(1000 + i, t) for i, t in enumerate([rows[3][1], rows[8][1], "idiot", "idiot scum tree river"])]
    known = {i: y for i, y in labels if i % 3} | {1000: 1, 1003: 1}
    fit = toxicity.Fit(k=9)
    want = brute_scores(rows, known, fit)
    got = toxicity.toxicity(documents(spark, rows).repartition(3), label_frame(spark, list(known.items())), fit=fit).collect()
    assert len(got) == len(rows)
    # Bins are cut in order of the votes, so equal votes of different labels may change places.
    assert max(abs(r.score - want[r.doc_id]) for r in got) < 2e-2
    assert np.mean([abs(r.score - want[r.doc_id]) < 1e-6 for r in got]) > 0.9


def test_whole_text_counts(spark):
    """Every example is indexed over all its terms, and every text with words gets evidence."""
    rows, labels = corpus(spark, 200)
    rows = [*rows, (900, "quorvax plimber"), (901, "quorvax plimber dostrane"), (902, "zzqwert")]
    labels = [*labels, (900, 0)]
    index, _ = toxicity.fit_index(documents(spark, rows), label_frame(spark, labels), toxicity.Fit(), "text", "doc_id", "toxic")
    assert sorted(index.examples) == sorted({i for i, _ in labels})
    got = {r.doc_id: r for r in toxicity.toxicity(documents(spark, rows), label_frame(spark, labels)).collect()}
    assert all(got[i].evidence for i, _ in rows if i != 902) and not got[902].evidence
    nearest = got[901].evidence[0]
    # 901 has all terms of 900, and of its own one word and its three grams. Six-byte grams:
    # quorva uorvax, plimbe limber, dostra ostran strane.
    n = len(rows)
    shared, own = [np.log((1 + n) / 3) + 1] * 6, [np.log((1 + n) / 2) + 1] * 4
    want = np.sqrt(np.square(shared).sum() / np.square(shared + own).sum())
    assert nearest.example == 900 and abs(nearest.cosine - want) < 1e-9
    assert abs(got[900].evidence[0].cosine - 1) < 1e-9


def test_search_keeps_no_spread_postings(spark):
    """Sums over postings as stored equal those of their weights, and a search adds nothing to a worker's index."""
    rows, labels = corpus(spark, 200)
    index, _ = toxicity.fit_index(documents(spark, rows), label_frame(spark, labels), toxicity.Fit(), "text", "doc_id", "toxic")
    places = np.flatnonzero(index.common < 0)[::7]
    query = np.linspace(0.1, 0.9, len(places))
    want = np.zeros(len(index.norms))
    for place, q in zip(places, query, strict=True):
        want[index.rows[index.bounds[place] : index.bounds[place + 1]]] += q * index.weights(place)
    assert np.allclose(index.rare_sums(places, query), want, rtol=1e-12, atol=0)
    assert not index.rare_sums(places[:0], query[:0]).any()
    index.nearest(places, query)
    assert set(vars(index)) == set(index.__dataclass_fields__)


def test_search_of_many_texts_equals_that_of_one(spark):
    """Scoring multiplies the common terms once for many texts, and finds what a search by blocks finds."""
    rows, labels = corpus(spark, 300)
    index, _ = toxicity.fit_index(documents(spark, rows), label_frame(spark, labels), toxicity.Fit(k=9), "text", "doc_id", "toxic")
    # A run holds the postings of a term and count, and none is empty.
    assert index.first[-1] == len(index.codes) and (np.diff(index.starts) > 0).all()
    assert np.array_equal(index.starts[index.first], index.bounds)
    assert (index.common >= 0).any() and (np.diff(index.first) > 1).any()
    # Terms share postings only if rows and counts are the same.
    def postings(t):
        some = slice(index.bounds[t], index.bounds[t + 1])
        return index.rows[some].tobytes(), (index.weights(t) / index.idf[t]).round(12).tobytes()

    assert np.array_equal(index.same[index.same], index.same) and len(set(index.same)) < len(index.same)
    assert all(postings(t) == postings(index.same[t]) for t in range(len(index.terms)))
    rng = np.random.default_rng(1)
    queries = []
    for size in [0, 1, 2, *rng.integers(1, len(index.terms), 40)]:
        places = np.sort(rng.choice(len(index.terms), size, replace=False))
        queries.append((places, index.vector(places, rng.integers(1, 4, size), 0.5)))
    for query, sums in zip(queries, index.common_sums(queries), strict=True):
        (found, held), (want, cosines) = index.nearest_given(*query, sums), index.nearest(*query)
        assert found.tolist() == want.tolist() and np.allclose(held, cosines, rtol=0, atol=1e-12)


def test_driver_holds_few_bytes_per_posting(spark, monkeypatch):
    """The driver gets the postings in order, and keeps no array over them but their rows and codes."""
    rows = [(i, " ".join(f"{i * j % 9973:07d}" for j in range(300))) for i in range(1500)]
    # Leaves out what does not grow with the postings.
    monkeypatch.setattr(toxicity, "BUCKETS", 1024)
    monkeypatch.setattr(toxicity, "COMMON", 8)
    monkeypatch.setattr(toxicity, "_document_frequencies", lambda documents, text, known: np.full(len(known) + 1024, 2.0))
    frame, labels = documents(spark, rows), label_frame(spark, [(i, i % 2) for i, _ in rows])
    tracemalloc.start()
    index, _ = toxicity.fit_index(frame, labels, toxicity.Fit(), "text", "doc_id", "toxic")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.examples) == 1500 and len(index.rows) > 1_000_000
    assert peak < 30 * len(index.rows)


def test_scoring_holds_little_of_a_batch(spark, monkeypatch):
    """A task's arrays are those of a piece of the batch, and queries of neighbouring pieces are multiplied together."""
    rows, labels = corpus(spark, 300)
    index, _ = toxicity.fit_index(documents(spark, rows), label_frame(spark, labels), toxicity.Fit(), "text", "doc_id", "toxic")
    shared = type("Shared", (), {"value": index})
    model = toxicity.Model(shared, 0.25, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    few = pa.array([text for _, text in rows] + [None, "", "..."])
    want = toxicity._score_batch(model, few).to_pylist()
    together = []
    common_sums = toxicity.Index.common_sums
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    monkeypatch.setattr(toxicity.Index, "common_sums", lambda self, queries: together.append(len(queries)) or common_sums(self, queries))
    got = toxicity._score_batch(model, few).to_pylist()
    assert together == [64, 64, 64, 64, 44]
    assert np.allclose([x["score"] for x in got], [x["score"] for x in want], rtol=0, atol=1e-12)
    assert [[e["example"] for e in x["evidence"]] for x in got] == [[e["example"] for e in x["evidence"]] for x in want]
    monkeypatch.undo()
    batch = pa.array([prose(n, 400) for n in range(1500)])
    tracemalloc.start()
    toxicity._score_batch(model, batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 3 << 20
    assert peak < 30 << 20
