"""Token counts as a public vocabulary's own library gives them.

Texts are cut at ASCII white space. That is a safe boundary for a vocabulary whose
pre-tokeniser drops white space: no token, no special string and no canonical composition
reaches over it. The count of a text is then the sum of its words' counts, so each distinct
word is encoded once, in batches balanced by bytes, and only lengths leave the task. A text
of any length needs memory in proportion to its own bytes and nothing else.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each by itself.
All columns of the input are kept; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.llm.textkit import WHITE, pieces, sums, utf8, words

BATCH_BYTES = 256 << 10
# Distinct words whose lengths a Python worker remembers; beyond it, it starts afresh.
REMEMBERED = 400_000

_LIBRARY: dict[str, object] = {}
_LENGTHS: dict[str, dict[bytes, int]] = {}


def _library(path: str):
    if path not in _LIBRARY:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        _LIBRARY[path] = Tokenizer.from_file(path)
        _LIBRARY[path].no_truncation()
        _LIBRARY[path].no_padding()
    return _LIBRARY[path]


def _encode(path: str, texts: list[bytes]) -> list[int]:
    encode = _library(path).encode_batch_fast
    found: list[int] = []
    batch: list[str] = []
    held = 0
    for text in texts:
        batch.append(text.decode("utf-8", "replace"))
        held += len(text)
        if held >= BATCH_BYTES:
            found += [len(x) for x in encode(batch, add_special_tokens=False)]
            batch, held = [], 0
    return found + [len(x) for x in encode(batch, add_special_tokens=False)]


def word_lengths(path: str, distinct: list[bytes]) -> np.ndarray:
    """Tokens of each distinct word."""
    known = _LENGTHS.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    missing = [word for word in distinct if word not in known]
    known.update(zip(missing, _encode(path, missing), strict=True))
    return np.fromiter((known[word] for word in distinct), np.int64, len(distinct))


def count_tokens(path: str, texts: pa.Array) -> np.ndarray:
    raw, bounds = utf8(texts)
    out = np.zeros(len(texts), np.int64)
    for start, end in pieces(bounds):
        part = bounds[start : end + 1]
        found = words(raw[part[0] : part[-1]], part - part[0], WHITE)
        numbers, distinct = found.encoded()
        if distinct:
            out[start:end] = sums(word_lengths(path, distinct)[numbers], found.first)
    return out


def token_counts(
    documents: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048
) -> DataFrame:
    """Add `n_bytes`, `n_tokens` and `over_limit` (more than `limit` tokens) to each row.

    `vocabulary` is the path of a tokenizer file that every executor can open. Its
    pre-tokeniser must drop white space.
    """

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(count_tokens(vocabulary, texts), pa.int64())

    return documents.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": counted(F.col(text)),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
