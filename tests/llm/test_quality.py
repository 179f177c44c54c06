import math
import re
from collections import Counter

import public_tokenizers
import sentencepiece

from creditweave.llm.quality import quality_rules
from tests.llm.corpus import documents, numbered, prose, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, model):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    tokens = [t for word in found for t in model.encode(word)]
    counts = Counter(tokens)
    entropy = -sum(c / len(tokens) * math.log2(c / len(tokens)) for c in counts.values()) if tokens else 0.0
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_tokens": len(tokens),
        "n_byte_tokens": sum(model.is_byte(t) for t in tokens),
        "base_failed": len(found) < 10 or 100 * len(covered) > 20 * len(found),
    }, entropy


def test_counts_equal_brute_force(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    values = [*texts(), "a b c d e " * 9, "x y z w v u " + "a b c d e f " * 2]
    for row in quality_rules(numbered(spark, values), PATH).collect():
        want, entropy = brute(values[row.doc_id], model)
        assert {name: row[name] for name in want} == want, row.doc_id
        assert abs(row.entropy - entropy) < 1e-9


def test_verdicts(spark):
    rows = [
        (1, prose(1, 300)),
        (2, None),
        (3, "from " * 300),
        (4, " ".join(f"{i:x}Zq{i * 7919:x}==" for i in range(300))),
        (5, "கா " * 9 + " ".join(chr(0x1D400 + i % 400) * 4 for i in range(300))),
        (6, " ".join("qxzjk"[i % 5] * (2 + i % 7) for i in range(300))),
        (7, "short but clean text of some ten or more plain words here"),
    ]
    kept = {r.doc_id: r.kept for r in quality_rules(documents(spark, rows), PATH).collect()}
    assert kept[1] and kept[7]
    assert not kept[2] and not kept[3]


def test_bands_decide(spark):
    from dataclasses import replace

    from creditweave.llm.quality import BANDS

    frame = documents(spark, [(1, prose(1, 300))])
    for change in ({"chars_low": 50.0}, {"chars_high": 0.1}, {"byte_share": -1.0}, {"entropy_low": 20.0}):
        bands = BANDS | {"latin": replace(BANDS["latin"], **change)}
        row = quality_rules(frame, PATH, bands=bands).first()
        assert not row.base_failed and not row.kept
    bands = BANDS | {"latin": replace(BANDS["latin"], entropy_low=20.0, least_tokens=10_000)}
    assert quality_rules(frame, PATH, bands=bands).first().kept


def test_empty_table_and_clashing_columns(spark):
    empty = quality_rules(documents(spark, [], "script bigint, n_words string"), PATH)
    assert empty.count() == 0 and empty.schema["script"].dataType.simpleString() == "string"
    one = quality_rules(documents(spark, [(None, prose(2, 50), "x")], "note string"), PATH).first()
    assert one.note == "x" and one.script == "latin" and one.kept


def test_measured_floor_rejects_low_quality_and_judges_short_texts(spark):
    from creditweave.llm.queries import is_held_out, quality_rules as query

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(is_held_out("doc_id")).dropDuplicates(["doc_id"])
    rows = [r for r in query(spark, sf).join(labels, "doc_id").collect() if not r.base_failed]
    bad, good = ([r for r in rows if r.quality == q] for q in (0, 1))
    assert bad and sum(r.kept for r in bad) < 0.5 * len(bad)
    assert sum(not r.kept for r in good) <= 0.05 * len(good)


def test_floor_depends_on_length(spark):
    from dataclasses import replace

    from creditweave.llm.quality import BANDS

    # 12 and 300 words of the same few: both are below the least tokens or judged by the floor.
    frame = documents(spark, [(1, "tree river stone " * 4), (2, prose(1, 300)), (3, prose(1, 12))])
    bands = BANDS | {"latin": replace(BANDS["latin"], least_tokens=10_000, floor=((1, 0.0), (16, 3.0), (256, 7.0)))}
    got = {r.doc_id: (r.base_failed, r.kept, r.entropy) for r in quality_rules(frame, PATH, bands=bands, most_repeated=100).collect()}
    assert got[1][:2] == (False, False) and got[2][:2] == (False, False) and got[3][:2] == (False, True), got
