import re
import tracemalloc

import numpy as np
import pyarrow as pa

from creditweave.llm import decontaminate
from creditweave.llm.decontaminate import leaks, without_leaks
from tests.llm.corpus import LONG, documents, numbered, prose, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute(values, items, threshold=0.8):
    out = {}
    for i, text in enumerate(values):
        held = shingles(text)
        for item, item_text in items:
            wanted = shingles(item_text)
            if wanted and len(wanted & held) >= threshold * len(wanted):
                out[(i, item)] = len(wanted & held) / len(wanted)
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def found(spark, values, items):
    rows = leaks(numbered(spark, values), benchmark(spark, items)).collect()
    assert len({(r.doc_id, r.text_hash, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r.containment for r in rows}


def test_pairs_equal_brute_force(spark):
    passages = [prose(100 + n, 15 + 3 * n) for n in range(20)]
    items = [*enumerate(passages), (90, None), (91, ""), (92, "four words only here"), (93, "one two three")]
    around = [prose(200 + n, 900) + " " + p.upper() + "! " + prose(300 + n, 400) for n, p in enumerate(passages)]
    edited = [re.sub(r"^(\S+ ){2}", "", p) + " " + prose(400 + n, 2000) for n, p in enumerate(passages)]
    halves = [p[: len(p) // 2] for p in passages]
    every = " ".join(passages) + LONG
    values = [*texts(), *around, *edited, *halves, every, around[0], "say FOUR words, only here now"]
    want = brute(values, items)
    assert len(want) > 60
    assert found(spark, values, items) == want


def test_minhash_recall_at_the_threshold():
    """Edited passages at a containment of just 0.8, in windows of a long document."""
    rng = np.random.default_rng(3)
    missed = 0
    for n in rng.integers(8, 60, 300):
        item = rng.integers(0, 1 << 63, n, np.uint64)
        bound = decontaminate.class_bound(int(n))
        kept = item.copy()
        lost = rng.choice(n, int(n) - int(np.ceil(0.8 * n)), replace=False)
        kept[lost] = rng.integers(0, 1 << 63, len(lost), np.uint64)
        text = np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 500), np.uint64), kept, rng.integers(0, 1 << 63, 300, np.uint64)])
        keys, _ = decontaminate.window_keys(text, np.array([0, len(text)]), bound)
        missed += not np.isin(decontaminate.item_keys(item, bound), keys).any()
    assert missed == 0


def test_bloom_has_no_false_negatives_and_is_bounded():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64)
    bloom = decontaminate.Bloom.of(keys, decontaminate.Bloom.size(len(keys)))
    assert bloom.has(keys).all()
    assert bloom.has(keys + np.uint64(1)).mean() < 0.05
    assert decontaminate.Bloom.size(1 << 40) * 8 == decontaminate.MOST_BITS


def test_nulls_repeats_clashes_and_empty_tables(spark):
    passage = prose(7, 40)
    rows = [(None, passage, "a"), (1, passage, "b"), (1, passage, "c"), (1, "clean " + prose(8, 40), "d"), (2, None, "e")]
    docs = documents(spark, rows, "leaked_key string")
    items = benchmark(spark, [(5, passage), (5, passage), (None, passage)])
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.leaked_key for r in kept.collect()) == ["d", "e"]
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    assert got == {(None, 5), (1, 5), (None, None), (1, None)}
    assert without_leaks(docs, items.limit(0)).count() == len(rows)
    assert leaks(docs.limit(0), items).count() == 0


def test_common_passage_in_many_documents(spark):
    passage = prose(9, 50)
    values = [f"{prose(i, 30)} {passage} {prose(i + 1, 30)}" for i in range(400)]
    assert found(spark, values, [(1, passage)]) == {(i, 1): 1.0 for i in range(400)}


def test_word_hashes_take_stretches_and_keep_nothing():
    """A word's hash is that of its bytes alone, wherever the word stands; memory does not grow with the text."""
    power, wanted = 1, []
    found = [b"word", b"", b"\xc3\xa9t\xc3\xa9", b"x" * (3 * decontaminate.STRETCH), b"", b"word"]
    for word in found:
        total, power = 0, 1
        for byte in word:
            total += (byte + 1) * power
            power = power * int(decontaminate._ODD) % 2**64
        wanted.append(total % 2**64)
    found, wanted = found * 3, decontaminate._mix(np.array(wanted * 3, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in found])])
    data = np.frombuffer(b"".join(found), np.uint8)
    assert np.array_equal(decontaminate.word_hashes(data, bounds), wanted)
    assert not len(decontaminate.word_hashes(data[:0], bounds[:1]))
    words = 400_000
    data = np.frombuffer(b"seven77" * words, np.uint8)
    tracemalloc.start()
    held = decontaminate.word_hashes(data, np.arange(words + 1) * 7)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(set(held.tolist())) == 1 and len(held) == words
    assert peak < 24 * words and kept < 9 * words + 100_000


def test_search_holds_little_of_a_batch():
    """A task's arrays are those of a piece of the batch, whatever the batch holds."""
    column = pa.array([prose(n, 400) for n in range(1500)])
    tracemalloc.start()
    for *_, bounds in decontaminate._hashed(column):
        assert len(bounds) > 1
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert column.nbytes > 3 << 20
    assert peak < 12 << 20 and kept < 4 << 20
