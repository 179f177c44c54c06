"""Registered queries over a whole small table against brute force."""

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from creditweave.llm import queries
from tests.llm import test_licenses, test_mixing, test_quality, test_sharding, test_tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in queries.read(spark, SF, "documents").collect()}


def test_every_operator_is_registered_once():
    numbers = [name.split("_")[0] for name in queries.llm_queries()]
    assert numbers == [f"op{n}" for n in range(1, 14)]
    assert set(queries.llm_oracles()) <= set(queries.llm_queries())


def test_token_counts_query(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.token_counts(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for key, row in texts.items():
        n = test_tokens.whole(row.text)
        assert got[key] == (len((row.text or "").encode()), n, n > 2048)


def test_quality_rules_query(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.quality_rules(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for key, row in texts.items():
        want, entropy = test_quality.brute(row.text, model)
        assert {name: got[key][name] for name in want} == want
        assert abs(got[key].entropy - entropy) < 1e-9
        assert not (got[key].kept and got[key].base_failed)


def test_license_scan_query(spark, texts):
    keys = sorted(texts)
    want = dict(zip(keys, test_licenses.brute([texts[k].text for k in keys]), strict=True))
    got = queries.license_scan(spark, SF).collect()
    assert {r.doc_id for r in got} == texts.keys()
    for r in got:
        found = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        assert found == want[r.doc_id][:6] and abs(r.score - want[r.doc_id][6]) < 1e-9
    assert any(r.labels for r in got)


def test_source_mixing_query(spark, texts):
    rows = [(r.doc_id, r.source, r.text) for r in texts.values()]
    mixed = queries.source_mixing(spark, SF)
    held = spark.createDataFrame([(r.doc_id, r.text) for r in texts.values()], "doc_id bigint, text string")
    total, weight, got = test_mixing.check(rows, mixed.join(held, "doc_id").collect())
    repeats = {s: got[s] / total[s] for s in total}
    assert min(repeats.values()) == 1.0 and max(repeats.values()) < 2.2


def test_sharding_query(spark, texts):
    import zlib

    rows = queries.sharded_documents(spark, SF).withColumn("text", F.lit(None))
    got = rows.collect()
    test_sharding.check([(k, None) for k in texts], got, 16)
    for r in got:
        data = (texts[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")


def test_toxicity_learns_from_the_training_folds_only(spark, texts):
    import zlib

    labels = {r.doc_id: r.toxic for r in queries.read(spark, SF, "labels").collect()}
    got = queries.toxicity_scores(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        for found in r.evidence:
            assert zlib.crc32(str(found.example).encode()) % 5 and labels[found.example] == found.toxic
