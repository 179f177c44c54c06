"""Small tables for the operators' tests: awkward texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

WORDS = "the of and to in that was for with his tree river stone cloud lamp road green seven".split()
LONG = " ".join(f"word{i % 977} next" for i in range(60_000))
AWKWARD = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two three",
    "Éàü ñandú straße ÉÀ ﬁ ǅ İ ſ K",
    "don't it's we'll 12ab34 <|endoftext|> x<|startoftext|>y",
    "áb ́c é̂  x y　z",
    "\x00ctrl \x1c\x1d\x1e\x1f \x85 end",
    "日本語の文章です。 もう一つ 文。",
    "🙂🙃 emoji 👩‍👩‍👧",
    "line one\nline one\nline two\n\nline one\n \n",
    "# * $ % & | < > ##",
]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "ing", "ly"]) for _ in range(n))


def texts() -> list[str | None]:
    return [*AWKWARD, *(prose(i, 20 + 13 * i) for i in range(25)), prose(3, 59), prose(3, 59), LONG]


def documents(spark, rows: list[tuple], extra: str = ""):
    """doc_id, text and whatever `extra` names."""
    return spark.createDataFrame(rows, "doc_id bigint, text string" + (", " + extra if extra else ""))


def numbered(spark, values: list[str | None]):
    return documents(spark, list(enumerate(values))).repartition(3)
