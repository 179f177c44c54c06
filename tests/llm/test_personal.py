import hashlib
import random
import re

import numpy as np
import pytest

from creditweave.llm import personal, queries, tagger
from creditweave.llm.personal import CARD, EMAIL, IP, KINDS, PHONE, Fit, base_spans, fit_tagger, personal_data
from tests.llm.corpus import documents, prose, texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HELD = [
    "mail jo.x+1@a-b.example.com, or @x or a@b or a@b. or a@@b.c or a@b.c@d.e.f",
    "1.2.3.4 and 1.2.3.4.5.6.7.8.9 and 256.1.1.1 and 0001.2.3.255 1.2.3 00.0.0.0. 1..2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 41 11 0 4111  1111 1111 1111",
    "+1 (918) 555-3922 +12 +1-2-3-4-5-6-7-8-9, ++49 30 123456 (x) +4930123456789012345678 +1 5",
    "é1.2.3.4é jo@ex.com.+49 30 1234567@x.y 4111111111111111.1.2.3 \x00a@b.c\x00",
    "9" * 4000 + "." + "1." * 2000 + "a" * 5000 + "@" + "b." * 50 + " +" + "1 " * 3000,
]
WAYS = ["write to kamilo (at) sitaka dot net please", "call (918) 555-3922 now", "host 10[.]0[.]12[.]7 up", "card 4111/1111/1111/1111 was"]
SAMPLE = Fit(sample_rows=100_000, windows=1200, steps=260)


def brute(text):
    """By the patterns themselves, each tried at every place."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fits = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), order, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    values = [prose(i, 60) + " " + personal.invented(rng, i % 4) + " " + prose(i + 1000, 40) for i in range(400)]
    return fit_tagger(documents(spark, list(enumerate(values))), fit=SAMPLE)


def test_base_equals_the_patterns():
    rng = random.Random(7)
    values = [*(t or "" for t in texts()[:-1]), *HELD[:-1], *WAYS, HELD[-1][:300]]
    values += ["".join(rng.choice("0123456789.+-@ ()ab") for _ in range(300)) for _ in range(300)]
    for _ in range(300):
        values.append(" ".join(personal.harmless(rng) if rng.random() < 0.5 else personal.invented(rng, rng.randrange(4)) for _ in range(6)))
    found = [base_spans(v) for v in values]
    assert found == [brute(v) for v in values]
    assert {s[1] for spans in found for s in spans} == {EMAIL, IP, CARD, PHONE}


def test_patterns_take_linear_time():
    for piece in ("9", "a", "1.", "+1 ", "a@", "1 ", "-", "a."):
        base_spans(piece * 400_000)


def test_gradients():
    rng = np.random.default_rng(0)
    model = tagger._new(9, rng)
    x, y = rng.integers(0, tagger.CLASSES, (4, 20)), rng.integers(0, 9, (4, 20))
    _, found = tagger.gradients(model, x, y)
    for weight, gradient in zip(model.weights(), found, strict=True):
        way = rng.normal(size=weight.shape).astype(np.float32)
        way *= 0.03 / np.linalg.norm(way)
        weight += way
        above, _ = tagger.gradients(model, x, y)
        weight -= 2 * way
        below, _ = tagger.gradients(model, x, y)
        weight += way
        assert abs((above - below) / 2 - (gradient * way).sum()) < 0.02 * abs((gradient * way).sum()) + 2e-4


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(4)
    model = tagger._new(3, rng)
    model.moves += rng.normal(0, 1, (3, 3)).astype(np.float32)
    scores = rng.normal(0, 1, (6, 3, 5)).astype(np.float32)
    got = model.decode(scores)
    for i in range(5):
        def total(path, i=i):
            moves = sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False))
            return model.first[path[0]] + moves + sum(scores[t, k, i] for t, k in enumerate(path))

        best = max(np.ndindex(*[3] * 6), key=total)
        assert abs(total(best) - total(tuple(got[i]))) < 1e-4
    # Windows that are passed over have no tag but 0.
    scores = rng.normal(0, 1, (6, 3, 4000)).astype(np.float32)
    scores[:, 0] += rng.uniform(-1, 8, 4000)
    live = model.can_leave(scores)
    assert not (model.decode(scores)[~live] > 0).any() and 400 < live.sum() < 3600


def test_emissions_of_training_and_reading_agree(model):
    rng = np.random.default_rng(5)
    batch = rng.integers(0, tagger.CLASSES, (7, 50)).astype(np.uint8)
    _, _, _, states = tagger._forward(model, batch.T.astype(int))
    read = np.concatenate([states[1:, 0], states[1:, 1][::-1]], 2)
    assert np.allclose(read @ model.out + model.bias, model.emissions(batch).transpose(0, 2, 1), atol=1e-3)


def test_reconciled_keeps_the_greatest_total():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(s, rng.randrange(4), s + rng.randint(1, 9), float(rng.randint(1, 9))) for s in (rng.randrange(25) for _ in range(7))]
        best = 0.0
        for mask in range(1 << len(spans)):
            chosen = sorted(s for i, s in enumerate(spans) if mask >> i & 1)
            if all(a[2] <= b[0] for a, b in zip(chosen, chosen[1:], strict=False)):
                best = max(best, sum({s: s[3] for s in chosen}.values()))
        kept = personal.reconciled(spans)
        assert all(a[2] <= b[0] for a, b in zip(kept, kept[1:], strict=False))
        score = {s[:3]: max(t[3] for t in spans if t[:3] == s[:3]) for s in spans}
        assert sum(score[s] for s in kept) == best


def test_learns_other_ways_of_writing(model):
    rng, found, wanted, wrong = random.Random(42), 0, 0, 0
    for i in range(300):
        kind = rng.choice((EMAIL, IP, CARD, PHONE, None))
        piece = personal.harmless(rng) if kind is None else personal.invented(rng, kind)
        text, gold = personal._planted(rng, prose(5000 + i, 50), [], piece, kind)
        (tagged,) = model.spans([text])
        base = base_spans(text)
        added = personal.added_spans(text, base, tagged)
        wanted += len(gold)
        found += len(set(gold) & {*base, *added})
        wrong += len(set(added) - set(gold))
    assert found >= 0.8 * wanted and wrong <= 0.05 * wanted


def test_long_text_equals_its_windows(model):
    """A span is found wherever the windows fall."""
    hits = 0
    for shift in range(0, 200, 7):
        text = prose(1, 200)[: 400 + shift].rsplit(" ", 1)[0] + " call (918) 555-3922 now " + prose(2, 200)
        (tagged,) = model.spans([text])
        hits += any(text[s:e] == "(918) 555-3922" for s, _, e in personal.added_spans(text, [], tagged))
    assert hits >= 26


def test_rows(spark, model):
    values = [*texts(), *HELD, *WAYS, *WAYS]
    frame = spark.createDataFrame([(i, t, "p", "s", 3) for i, t in enumerate(values)], "doc_id int, text string, personal string, spans string, n_email int")
    rows = personal_data(frame.repartition(3), model).collect()
    assert [f for f in rows[0].__fields__] == ["doc_id", "text", "spans", "n_email", "personal"]
    assert sorted(r.doc_id for r in rows) == list(range(len(values)))
    added = 0
    for r in rows:
        spans = [(s.start, KINDS.index(s.kind), s.end) for s in r.personal]
        assert spans == sorted(spans) and r.text == values[r.doc_id]
        assert [s for s, x in zip(spans, r.personal, strict=True) if x.base] == brute(r.text)
        added += sum(not x.base for x in r.personal)
    assert added >= 4
    assert personal_data(frame.limit(0), model).collect() == []


def test_without_labelled_text(spark):
    nothing = documents(spark, [(1, None), (2, "")])
    assert fit_tagger(nothing) is None and fit_tagger(documents(spark, [])) is None
    assert [r.personal for r in personal_data(nothing, None).collect()] == [[], []]


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(personal, "Fit", lambda: SAMPLE)
    sf = "/root/testdata/sf0.001"
    held = {r.doc_id: r.text or "" for r in queries.read(spark, sf, "documents").collect()}
    rows = queries.personal_data(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(held)
    for r in rows:
        want = brute(held[r.doc_id])
        listed = [f"{KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(listed) <= set(filter(None, r.spans.split(",")))
