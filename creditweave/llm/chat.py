"""Chat formatting from an event log, with DataFrame functions only.

A conversation is rebuilt from events ordered by `seq`. Kinds:

* `message` — a finished message, or the first text of one that goes on;
* `delta` — text to append;
* `edit`, `regenerate` — the text so far is replaced: by the edit, or by the new attempt, which
  further deltas continue.

Folding is associative: a stretch of events becomes whether it starts afresh, and the text since
then; two stretches combine to a third. So stretches of `STRETCH` sequence numbers are folded
first, then messages, then stretches of messages, then conversations. The text moves twice: to
its stretch, and to its conversation. A long conversation reaches its last task as a row for
each message and stretch, not for each event.

The template is `<s>[INST] role [/INST]text</s>` for each message. A control string inside a role
or text gets a backslash after its first character, and one that has backslashes there already
gets one more, so that what is read back is exact. The loss mask has, for each assistant
message, the place and length of its escaped text in bytes of the formatted UTF-8.

Null texts and roles are empty. Events of an unknown kind are an error. Events that tie on `seq`
are ordered by kind, role and text. A null conversation is a conversation of its own. Repeated
rows repeat what they do. Extra columns are ignored. An empty log gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 64
KINDS = ("message", "delta", "edit", "regenerate")
# The template's strings. Fixed values.
OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"
_PLAIN = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _joined(parts: Column) -> Column:
    """Texts of ordered parts since the last that starts afresh."""
    last = F.coalesce(F.array_max(F.transform(parts, lambda p, i: F.when(p["fresh"], i))), F.lit(0))
    return F.array_join(F.transform(F.slice(parts, last + 1, F.size(parts)), lambda p: p["text"]), "")


def _any_fresh(parts: Column) -> Column:
    return F.exists(parts, lambda p: p["fresh"])


def fold(events: DataFrame) -> DataFrame:
    """Final messages: `conv_id`, `message`, `seq` of its first event, `role`, `text`.

    `events` has conv_id, message, seq, kind, role, text. A message has the role of its first
    event.
    """
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("Unknown kind of event: "), F.coalesce("kind", F.lit("null"))))
    )
    parts = events.select(
        "conv_id",
        "message",
        F.col("seq"),
        F.floor(F.col("seq") / STRETCH).alias("stretch"),
        kind.alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("fresh", F.col("kind") != "delta")
    # Stretches are dealt out by themselves, so a hot conversation is folded in many tasks.
    parts = parts.repartition("conv_id", "stretch")
    stretches = parts.groupBy("conv_id", "message", "stretch").agg(
        F.min(F.struct("seq", "kind", "role")).alias("first"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text", "fresh"))).alias("parts"),
    )
    stretches = stretches.select(
        "conv_id", "message", "first",
        F.struct("stretch", _any_fresh(F.col("parts")).alias("fresh"), _joined(F.col("parts")).alias("text")).alias("part"),
    )
    # From here on a conversation stays in one task, as its text does in the end: none of the
    # groupings below, by conversation and more, moves the rows again.
    return (
        stretches.repartition("conv_id")
        .groupBy("conv_id", "message")
        .agg(F.min("first").alias("first"), F.array_sort(F.collect_list("part")).alias("parts"))
        .select(
            "conv_id", "message",
            F.col("first.seq").alias("seq"), F.col("first.role").alias("role"), _joined(F.col("parts")).alias("text"),
        )
    )


def _laid_out(pieces: Column, zero: Column) -> Column:
    """Ordered pieces (text, bytes, spans) as one, with the spans moved to their places."""
    step = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), zero.alias("spans")),
        lambda done, piece: F.struct(
            (done["at"] + piece["bytes"]).alias("at"),
            F.concat(
                done["spans"],
                F.transform(
                    piece["spans"],
                    lambda s: F.struct((s["start"] + done["at"]).alias("start"), s["length"].alias("length")),
                ),
            ).alias("spans"),
        ),
    )
    return step["spans"]


_SPANS = "array<struct<start:bigint,length:bigint>>"


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: `conv_id`, `n_turns`, `formatted`, `loss_spans`."""
    head = F.concat(F.lit(OPEN + HEAD), escape(F.col("role")), F.lit(TAIL))
    body = escape(F.col("text"))
    turns = messages.select(
        "conv_id", "seq", "role", "message",
        F.floor(F.col("seq") / STRETCH).alias("stretch"), head.alias("head"), body.alias("body"),
    )
    start = F.octet_length("head").cast("long")
    length = F.octet_length("body").cast("long")
    span = F.struct(start.alias("start"), length.alias("length"))
    none = F.array().cast(_SPANS)
    turns = turns.select(
        "conv_id", "stretch",
        F.struct(
            "seq", "role",
            F.concat("head", "body", F.lit(CLOSE)).alias("text"),
            "message",
            (start + length + len(CLOSE)).alias("bytes"),
            F.when(F.col("role") == trained, F.array(span)).otherwise(none).alias("spans"),
        ).alias("turn"),
    )
    stretches = turns.groupBy("conv_id", "stretch").agg(
        F.array_sort(F.collect_list("turn")).alias("turns")
    )
    stretches = stretches.select(
        "conv_id",
        F.struct(
            "stretch",
            F.size("turns").cast("long").alias("n"),
            F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
            F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["bytes"]).alias("bytes"),
            _laid_out(F.col("turns"), none).alias("spans"),
        ).alias("piece"),
    )
    whole = stretches.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select(
        "conv_id",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        _laid_out(F.col("pieces"), none).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From `formatted` and `loss_spans` alone: `turns` (role, text) and `losses` (texts)."""
    split = F.split("formatted", F.lit(CLOSE.replace("/", r"\/")))
    turns = F.transform(
        F.slice(split, 1, F.size(split) - 1),
        lambda t: F.struct(
            unescape(F.substring(F.substring_index(t, TAIL, 1), F.lit(len(OPEN + HEAD) + 1), F.length(t))).alias("role"),
            unescape(F.substring(t, F.length(F.substring_index(t, TAIL, 1)) + len(TAIL) + 1, F.length(t))).alias("text"),
        ),
    )
    # The bytes are made once for all spans, as the one element of an array.
    losses = F.transform(
        F.array(F.col("formatted").cast("binary")),
        lambda b: F.transform(
            "loss_spans",
            lambda s: unescape(F.decode(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")),
        ),
    )[0]
    return formatted.withColumns({"turns": turns, "losses": losses})


def format_chats(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """Fold an event log and render it: `conv_id`, `n_turns`, `formatted`, `loss_spans`."""
    return render(fold(events), trained)
