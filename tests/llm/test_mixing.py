import math
import re
from collections import Counter, defaultdict

import pytest

from creditweave.llm import mixing
from tests.llm.corpus import prose

SCHEMA = "doc_id bigint, source string, text string"


def tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(spark):
    rows = [(i, "hot", prose(i, 20 + i % 30)) for i in range(400)]
    rows += [(1000 + i, "warm", prose(i, 30)) for i in range(120)]
    rows += [(2000 + i, "cold", prose(i, 25)) for i in range(30)]
    rows += [(3000 + i, None, prose(i, 40)) for i in range(20)]
    rows += [(4000, "empty", None), (4001, "empty", ""), (5, "hot", None), (None, "warm", prose(1, 9))]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def check(rows, got, budget=None):
    total = Counter()
    for _, source, text in rows:
        total[source] += tokens(text)
    weight = {r.source: r.weight for r in got}
    assert abs(sum(weight.values()) - 1) < 1e-9
    held, epochs = Counter(), defaultdict(lambda: defaultdict(Counter))
    for r in got:
        held[r.source] += r.n_tokens
        epochs[r.source][r.epoch][(r.doc_id, r.text)] += 1
    all_rows = defaultdict(Counter)
    for key, source, text in rows:
        all_rows[source][(key, text)] += 1
    longest = max(tokens(t) for *_, t in rows)
    for source, found in epochs.items():
        for epoch in range(max(found)):
            assert found[epoch] == all_rows[source]
        assert not found[max(found)] - all_rows[source]
        if budget:
            assert -1e-6 <= held[source] - weight[source] * budget < longest or not total[source]
    for block in {r.block for r in got}:
        assert sorted(r.slot for r in got if r.block == block) == list(range(sum(r.block == block for r in got)))
    return total, weight, held


@pytest.mark.parametrize("bucket_rows", [mixing.BUCKET_ROWS, 16])
def test_repetition_limit(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows, frame = corpus(spark)
    got = mixing.mix(frame, most_repeats=2.5).collect()
    total, weight, held = check(rows, got)
    whole = sum(total.values())
    # The smallest source is repeated as often as allowed, the largest is read once.
    repeats = {s: held[s] / total[s] for s in total if total[s]}
    assert abs(repeats[None] - 2.5) < 0.1 or abs(max(repeats.values()) - 2.5) < 0.1
    assert repeats["hot"] == 1.0
    shares = {s: t / whole for s, t in total.items() if t}
    low, high = min(shares.values()), max(shares.values())
    exponent = 1 - math.log(2.5) / math.log(high / low)
    z = sum(p**exponent for p in shares.values())
    for s, p in shares.items():
        assert abs(weight[s] - p**exponent / z) < 1e-6
    assert weight["empty"] == 0 and sum(r.source == "empty" for r in got) == 2


def test_target_entropy_and_budget(spark):
    rows, frame = corpus(spark)
    got = mixing.mix(frame, target_entropy=1.2, budget_tokens=9000, block_tokens=1000).collect()
    _, weight, held = check(rows, got, budget=9000)
    assert abs(-sum(w * math.log(w) for w in weight.values() if w) - 1.2) < 1e-6
    assert abs(sum(held.values()) - 9000) < 300
    blocks = {r.block for r in got}
    assert blocks == set(range(9))
    for block in blocks:
        for source in ("hot", "warm"):
            n = sum(r.n_tokens for r in got if r.block == block and r.source == source)
            assert abs(n - weight[source] * 1000) < 100


@pytest.mark.parametrize("limit, exponent", [(1e9, 0.0), (1.0, 1.0)])
def test_limits_out_of_reach(spark, limit, exponent):
    sources = spark.createDataFrame([(10,), (1000,)], "tokens bigint")
    assert mixing.find_exponent(sources, 1010, None, limit, None) == exponent


def test_hot_key_is_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(1, "a", "x y")] * 300 + [(i, "b", "z") for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    check(rows, got)


def test_seeds_empty_and_clashing_columns(spark):
    _, frame = corpus(spark)

    def order(seed):
        found = mixing.mix(frame, seed=seed, block_tokens=2000).filter("source = 'hot'").collect()
        return [r.doc_id for r in sorted(found, key=lambda r: (r.block, r.slot))]

    assert order(1) == order(1) != order(2)
    assert mixing.mix(frame.limit(0)).count() == 0
    clash = frame.selectExpr("*", "'x' as weight", "1 as bucket", "2 as plan_label")
    assert mixing.mixed_documents(clash).columns == clash.columns
    assert {r.weight for r in mixing.mixed_documents(clash).collect()} == {"x"}


def test_no_python_in_the_plan(spark):
    _, frame = corpus(spark)
    assert "Python" not in mixing.mix(frame)._jdf.queryExecution().executedPlan().toString()
