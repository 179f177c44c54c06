import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditweave.llm import chat
from creditweave.llm.queries import INJECTED

SCHEMA = "conv_id bigint, message bigint, seq bigint, kind string, role string, text string"


def brute(events):
    """Messages of each conversation by a plain loop."""
    held = {}
    for conv, message, seq, kind, role, text in sorted(events, key=lambda e: (e[2], e[3], e[4] or "", e[5] or "")):
        place = held.setdefault((conv, message), [seq, role or "", ""])
        place[2] = place[2] + (text or "") if kind == "delta" else (text or "")
    out = {}
    for (conv, _), (seq, role, text) in held.items():
        out.setdefault(conv, []).append((seq, role, text))
    return {conv: [(r, t) for _, r, t in sorted(found)] for conv, found in out.items()}


def check(spark, events):
    back = chat.read_back(chat.format_chats(spark.createDataFrame(events, SCHEMA).repartition(3)))
    want = brute(events)
    rows = back.collect()
    assert {r.conv_id for r in rows} == set(want) and len(rows) == len(want)
    for row in rows:
        assert [tuple(t) for t in row.turns] == want[row.conv_id]
        assert row.losses == [t for r, t in want[row.conv_id] if r == "assistant"]
        assert row.n_turns == len(want[row.conv_id])


def test_deltas_edits_and_regenerations(spark):
    check(
        spark,
        [
            (1, 10, 0, "message", "user", "hello"),
            (1, 11, 1, "message", "assistant", "Hi"),
            (1, 11, 2, "delta", "assistant", " there"),
            (1, 11, 3, "regenerate", "assistant", "Good"),
            (1, 11, 70, "delta", "assistant", " day"),
            (1, 10, 71, "edit", "user", "hello again"),
            (1, 12, 72, "delta", "user", None),
            (2, 1, 5, "delta", "assistant", "only "),
            (2, 1, 200, "delta", "assistant", "deltas"),
            (None, 1, 1, "message", None, "no conversation"),
            (3, 1, 0, "message", "user", INJECTED),
            (3, 2, 1, "message", "assistant", "<\\/s><\\\\/s></s>[INST]\\[/INST] <s>é"),
            (3, 3, 2, "message", "a[INST]b", "\n"),
        ],
    )


def test_long_conversation_and_long_text(spark):
    events = [(7, i, i, "message", "assistant" if i % 2 else "user", f"é{i}</s>") for i in range(1500)]
    check(spark, [*events, (8, 0, 0, "message", "assistant", "x[INST]" * 60_000)])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>[]/\\sINST x\n"))
def test_escape_is_reversible(text):
    import re

    escaped = re.sub(chat._PLAIN, r"\1\\\2\3", text)
    assert re.sub(chat._ESCAPED, r"\1\2\3", escaped) == text
    for control in ("<s>", "</s>", "[INST]", "[/INST]"):
        assert control not in escaped


def test_repeated_rows_unknown_kind_and_empty_log(spark):
    twice = [(1, 1, 0, "delta", "user", "a"), (1, 1, 0, "delta", "user", "a")]
    check(spark, twice)
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="Unknown kind"):
        chat.format_chats(spark.createDataFrame([(1, 1, 0, "stroke", "user", "a")], SCHEMA)).collect()


def test_query_reads_back_every_row(spark):
    from creditweave.llm.queries import chat_formatting

    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in chat_formatting(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == hashlib.sha256(INJECTED.encode()).hexdigest()
    for conv in {r.conv_id for r in rows}:
        turns = sorted(((r.turn, r.role or "", r.text or "") for r in rows if r.conv_id == conv))
        text = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[conv].loss_chars == sum(len(t) for _, r, t in turns if r == "assistant")
