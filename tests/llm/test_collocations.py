import random
import re
from collections import Counter

import numpy as np
import pytest

from creditweave.llm import collocations as co
from tests.llm.corpus import texts

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split("[.,;:!?\n-\r]", lowered):
        yield re.findall("[^ \t]+", piece)


def brute(rows, longest, least, top):
    count, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                count.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}

    def explained(lang, p, a):
        return any(
            k == lang and b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (k, q), b in candidates.items()
        )

    out = []
    for lang in totals:
        found = []
        for (k, p), a in candidates.items():
            if k == lang and not explained(lang, p, a):
                cuts = []
                for i in range(1, len(p)):
                    left, right = count[lang, p[:i]], count[lang, p[i:]]
                    cuts.append((1000 * a * totals[lang] // (left * right), i, left, right))
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, longest=5, least=3, top=50):
    frame = spark.createDataFrame([(i, t, k, "x", 1) for i, (t, k) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, n int")
    found = co.collocations(frame.repartition(3), longest=longest, least=least, top=top)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def chatter(seed, n, words=("on", "the", "way", "to", "a", "new", "York", "hotel", "ß")):
    rng = random.Random(seed)
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "  ", "\n"]) for _ in range(n))


@pytest.mark.parametrize("longest, least", [(5, 3), (3, 10), (2, 2)])
def test_equals_brute_force(spark, longest, least):
    rows = [(chatter(i, 5 + 9 * i), ["en", "de", None, "und"][i % 4]) for i in range(24)]
    want = brute(rows, longest, least, 50)
    assert len(want) > 40 and mined(spark, rows, longest, least) == want


def test_awkward_texts(spark):
    rows = [(t, ["en", None, ""][i % 3]) for i, t in enumerate(texts()[:-1])]
    rows += [(chatter(5, 60), "en")] * 30 + [("same same " * 4000, "en"), ("x" * 300_000 + " " + "y" * 9, "fr")] * 3
    assert mined(spark, rows, least=6) == brute(rows, 5, 6, 50)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en"), (" . ", "en"), ("one two", "en")]) == []


def test_counts_add_up_over_small_shards(spark, monkeypatch):
    rows = [(chatter(i, 80), "en") for i in range(40)]
    want = brute(rows, 5, 12, 2000)
    monkeypatch.setattr(co, "SHARD_BYTES", 900)
    assert mined(spark, rows, least=12, top=2000) == want


def test_index_enumerates_every_phrase_once():
    rng = np.random.default_rng(2)
    for n, words in ((0, 3), (1, 1), (40, 2), (300, 3), (300, 40)):
        sequence = rng.integers(0, words + 1, n)
        sequence = np.append(sequence, 0).astype(np.int32) if n else sequence.astype(np.int32)
        want = Counter()
        for size in range(2, 6):
            for i in range(len(sequence) - size + 1):
                if (sequence[i : i + size] > 0).all():
                    want[tuple(sequence[i : i + size].tolist())] += 1
        got = Counter()
        for rows, counts in co.Index(sequence, 5).phrases(5):
            for row, c in zip(rows.tolist(), counts.tolist(), strict=True):
                assert tuple(row) not in got
                got[tuple(row)] = c
        assert got == want


def test_intervals_of_both_directions_agree():
    rng = np.random.default_rng(3)
    sequence = np.append(rng.integers(0, 4, 400), 0).astype(np.int32)
    index = co.Index(sequence, 4)

    def phrases(found):
        rows = sequence[index.ahead.suffixes[found.ahead][:, None] + np.arange(4)]
        return dict(zip(map(tuple, rows.tolist()), found.size.tolist(), strict=True))

    words = index.words()
    left, right = index.extend_left, index.extend_right
    orders = [left(left(left(words))), right(right(right(words))), right(left(right(words))), left(right(left(words)))]
    assert len(phrases(orders[0])) > 30
    assert all(phrases(found) == phrases(orders[0]) for found in orders)


def test_score_is_exact_beyond_64_bits(spark):
    a, n, left, right = 987_654_321_987, 98_765_432_198_765_431, 1_234_567_890_123, 998_877_665_544
    rows = [("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, n_words int, n bigint")
    totals = spark.createDataFrame([("en", n)], "lang string, total bigint")
    got = co.best_phrases(phrases, totals, 10).first()
    assert got.score == 1000 * a * n // (left * right)


def test_sums_of_shards_meet_in_their_task(monkeypatch):
    """Shards of a task, of any language, are added up before their sums are written."""
    import pyarrow as pa

    texts = [(lang, f"w{i} w{i * 7 % 50} w{i * 3 % 20}") for i in range(300) for lang in ("de", "en")]
    batch = pa.RecordBatch.from_pylist([{"lang": k, "text": t} for k, t in texts])

    def sums():
        rows = [r for b in co._make_shards(1 << 17, 200)(iter([batch])) for r in b.to_pylist()]
        total = Counter()
        for r in rows:
            if r["kind"] != co._NUMBERS:
                at = np.cumsum(co._unpacked_numbers(r["places"], np.uint16), dtype=np.int64)
                for place, n in zip(at, co._unpacked(r["held"]), strict=True):
                    total[r["kind"], r["part"], int(place)] += n
        return total, [(r["kind"], r["part"]) for r in rows if r["kind"] != co._NUMBERS]

    together, keys = sums()
    assert len(keys) == len(set(keys)) == 4 and sum(n for (kind, *_), n in together.items() if kind == "words") == 1800
    monkeypatch.setattr(co, "HELD_SUMS", 10)
    monkeypatch.setattr(co, "SHARD_BYTES", 900)
    apart, keys = sums()
    assert apart == together and len(keys) > 20
