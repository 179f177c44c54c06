from collections import Counter, defaultdict

import pytest

from creditweave.llm import sharding
from tests.llm.corpus import documents, numbered, texts


def check(rows, got, shards):
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.grown_shard in (r.shard, shards)
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    for pick in ("shard", "grown_shard"):
        assert all(len({r[pick] for r in got if r.doc_id == key}) == 1 for key in {r.doc_id for r in got})


@pytest.mark.parametrize("bucket_bytes", [sharding.BUCKET_BYTES, 2000])
def test_every_row_has_one_place(spark, bucket_bytes):
    rows = list(enumerate(texts())) + [(9, "repeated")] * 300 + [(None, "no id"), (None, None)]
    frame = documents(spark, rows).repartition(3)
    got = sharding.shard(frame, bucket_bytes=bucket_bytes).collect()
    check(rows, got, 16)


def test_growth_takes_rows_only_into_the_new_shard(spark):
    ids = spark.range(4000)
    found = ids.select("id", *[sharding.shard_of("id", n).alias(f"s{n}") for n in range(1, 9)]).collect()
    for n in range(1, 8):
        moved = [r for r in found if r[f"s{n}"] != r[f"s{n + 1}"]]
        assert all(r[f"s{n + 1}"] == n for r in moved)
        assert abs(len(moved) - 4000 / (n + 1)) < 200


def test_a_seed_gives_the_same_order_and_another_a_different_one(spark):
    frame = numbered(spark, [f"text {i}" for i in range(300)])

    def order(seed, parts):
        found = sharding.shard(frame.repartition(parts), seed=seed).collect()
        return [(r.shard, r.slot, r.doc_id) for r in sorted(found, key=lambda r: (r.shard, r.slot))]

    assert order(1, 2) == order(1, 7) != order(2, 2)


def test_order_is_shuffled(spark):
    frame = documents(spark, [(1, f"{i:04d}") for i in range(500)])
    found = sorted(sharding.shard(frame, shards=1).collect(), key=lambda r: r.slot)
    placed = [int(r.text) for r in found]
    assert placed != sorted(placed)
    assert 150 < sum(a < b for a, b in zip(placed, placed[1:], strict=False)) < 350


def test_empty_table_and_clashing_columns(spark):
    assert sharding.shard(documents(spark, [])).count() == 0
    frame = documents(spark, [(1, "a", "b", "s", 7)], "bucket string, shard string, place int")
    row = sharding.shard(frame).first()
    assert (row.bucket, row.place, row.slot) == ("b", 7, 0) and isinstance(row.shard, int)
    assert sharding.shard(frame).columns == ["doc_id", "text", "bucket", "place", "shard", "slot", "grown_shard"]
