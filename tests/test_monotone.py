import numpy as np
import pytest

from creditweave.operators import monotone
from creditweave.operators.monotone import Steps, fit_steps

SCORES = "SK_ID_CURR long, target int, probability double"


def brute(x, y):
    """The largest, over starts, of the smallest mean of a run that ends at or behind a score."""
    at, place = np.unique(x, return_inverse=True)
    total, weight = np.bincount(place, y), np.bincount(place)
    out = []
    for i in range(len(at)):
        out.append(max(min(total[a : b + 1].sum() / weight[a : b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)))
    return at, np.array(out)


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(b), float(a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], SCORES).repartition(3)


def shapes(rng):
    n = 160
    x = rng.permutation(n) / n
    yield "noise", x, rng.integers(0, 2, n)
    yield "rising", x, rng.random(n) < x
    yield "falling", x, rng.random(n) < 1 - x
    yield "one block", x, x < 0.5
    yield "all apart", np.arange(40) / 40, np.arange(40)
    yield "heavy end", np.append(x, np.full(300, 1.0)), np.append(rng.random(n) < x, np.zeros(300))
    yield "ties", np.round(x, 1), rng.random(n) < x
    yield "one score", np.full(9, 0.5), rng.integers(0, 2, 9)


@pytest.mark.parametrize("blocks", [1 << 20, 12])
def test_equals_the_definition(spark, monkeypatch, blocks):
    monkeypatch.setattr(monotone, "RANGE_BLOCKS", blocks)
    for name, x, y in shapes(np.random.default_rng(8)):
        at, want = brute(x, np.asarray(y, float))
        fitted = fit_steps(frame(spark, x, y))
        assert fitted.table.rows <= len(at)
        # At the scores, between them and beyond them.
        probes = np.unique(np.concatenate([at, (at[1:] + at[:-1]) / 2, [-1.0, 2.0]]))
        rows = spark.createDataFrame([(float(p),) for p in probes], "probability double")
        got = {r[0]: r[1] for r in fitted.at(rows, "probability", "y").collect()}
        assert [got[p] for p in probes] == pytest.approx(list(np.interp(probes, at, want))), name


def test_hot_and_missing_scores(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, 0.5 if i % 3 else i / 400) for i in range(400)] + [(900, 1, None), (901, None, 0.3)], SCORES)
    fitted = fit_steps(rows)
    fitted.save(f"{tmp_path}/steps")
    loaded = Steps.load(spark, f"{tmp_path}/steps")
    got = loaded.at(rows, "probability", "y").collect()
    assert len(got) == 402 and [r["SK_ID_CURR"] for r in got if r["y"] is None] == [900]
    assert len({r["y"] for r in got if r["probability"] == 0.5}) == 1


def test_no_rows(spark):
    with pytest.raises(ValueError, match="needs rows"):
        fit_steps(spark.createDataFrame([(1, None, 0.5)], SCORES))


def test_many_distinct_scores(spark, monkeypatch):
    """Ranges of a twentieth of the scores: nothing but counts and range ends reach the driver."""
    monkeypatch.setattr(monotone, "RANGE_BLOCKS", 10_000)
    rows = spark.range(200_000).selectExpr(
        "id AS SK_ID_CURR", "CAST(pmod(hash(id), 1000) < id / 200 AS INT) AS target", "id / 200000 AS probability"
    )
    fitted = fit_steps(rows)
    blocks = fitted.table.frame.orderBy("low").collect()
    values = [b["value"] for b in blocks]
    assert values == sorted(values) and 50 < len(blocks) < 20_000
    assert all(a["high"] < b["low"] for a, b in zip(blocks, blocks[1:], strict=False))
    # Pooled means keep the total.
    joined = fitted.at(rows, "probability", "y").selectExpr("sum(y)", "sum(target)", "count(y)").first()
    assert joined[0] == pytest.approx(joined[1]) and joined[2] == 200_000
