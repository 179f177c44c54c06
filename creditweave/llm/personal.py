"""Personal data in texts: fixed patterns, and a character tagger for other ways of writing them.

Kinds are email, ip, card and phone. The patterns' spans (`base`) are found leftmost and without
overlap per kind; a match that fails its kind's check is dropped. The tagger adds spans that the
patterns miss, such as `jo (at) host dot com`, `(918) 555-3922` or `10[.]0[.]0[.]1`:

* `tagger.py` holds a bidirectional LSTM over characters with a CRF on top, written and trained in
  numpy. Labelled spans are the patterns' own in a bounded sample of the corpus (`Fit.sample_rows`
  documents, `Fit.windows` windows), and the same data rewritten in other ways or invented, set
  into windows of the corpus. Numbers and signs that are no personal data are set in unlabelled.
* Every whole text is read in overlapping windows. Each is decoded by the CRF. A span that
  touches an inner edge of its window was not seen whole and is left to the neighbour.
* What the windows of a text found is reconciled over the whole text: among overlapping spans
  those of the greatest total score stay, by dynamic programming. Base spans stand before all.
* An added span must pass its kind's own check (digits, Luhn, parts up to 255, the parts of an
  address), which keeps clean texts clean.

Null and empty texts have no spans. Places are code points, ends exclusive. Rows are judged
each by itself, whatever repeats; all columns are kept, and one named like the output is replaced.
An empty table gives no rows; a corpus without any text is tagged by base alone. Memory is bounded by the
windows of a batch and by the bytes of one text; patterns need time in proportion to the text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.llm import tagger
from creditweave.llm.textkit import unused
from creditweave.sources.workspace import store

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats give the same matches without going back over long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, kind, end


# --- patterns ---------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def card_number(found: str) -> bool:
    digits = "".join(_DIGITS.findall(found))
    return 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[Span]:
    """From sign to sign, so that a long run of letters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, EMAIL, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """By start, then by kind."""
    found = list(_emails(text))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), IP, m.end()))
        found += [(m.start(), CARD, m.end()) for m in _CARD.finditer(text) if card_number(m[0])]
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append((m.start(), PHONE, m.end()))
    return sorted(found)


_AT = re.compile(r"@|\bat\b|\(at\)|\[at\]", re.I)
_DOT = re.compile(r"\.|\bdot\b", re.I)


def plausible(kind: int, found: str) -> bool:
    """The check that a tagged span must pass."""
    digits = "".join(_DIGITS.findall(found))
    if kind == EMAIL:
        sides = _AT.split(found)
        parts = _DOT.split(sides[-1])
        return len(sides) == 2 and len(parts) >= 2 and all(re.search("[A-Za-z0-9]", p) for p in (sides[0], *parts))
    if re.search("[A-Za-z]", found):
        return False
    if kind == IP:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == CARD:
        return card_number(found)
    groups = re.findall("[0-9]+", found)
    return 9 <= len(digits) <= 15 and len(groups) >= 3 and len(groups[-1]) >= 3


# --- labelled windows -------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample that the tagger learns from."""

    sample_rows: int = 20_000
    windows: int = 3_000
    steps: int = 320
    seed: int = 13


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + _number(rng, rng.choice((14, 14, 14, 13)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("an", "er", "lo", "mi", "ta", "on", "ed", "ka", "si", "bru", "x")) for _ in range(rng.randint(1, 4)))


def invented(rng: random.Random, kind: int) -> str:
    """Personal data in one of the ways in which people write it, patterns' own included."""
    if kind == EMAIL:
        at = rng.choice(("@", "@", " at ", " (at) ", "(at)", " [at] ", "[at]", " AT ", " @ "))
        dot = "." if at == "@" and rng.random() < 0.6 else rng.choice((".", " dot ", " (dot) ", "(dot)", " [dot] ", "[dot]", " DOT "))
        local = rng.choice(("", _word(rng) + rng.choice("._-"))) + _word(rng) + rng.choice(("", _number(rng, 2)))
        host = [_word(rng) + rng.choice(("", _number(rng, 1))) for _ in range(rng.choice((1, 1, 2)))]
        return local + at + dot.join([*host, rng.choice(("com", "org", "net", "de", "fr", "info"))])
    if kind == IP:
        sign = rng.choice((".", "[.]", "(.)", " . ", "[.]"))
        return sign.join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == CARD:
        number, sign = _card(rng), rng.choice(("", " ", "-", ".", "/", "  ", "_"))
        return sign.join(number[i : i + 4] for i in range(0, len(number), 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return rng.choice(
        (f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"+1/{a}/{b}/{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}.{c}")
    )


def harmless(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    n = _number
    broken = _card(rng)[:-1] + rng.choice("0123456789")
    return rng.choice(
        (
            f'token = "{rng.getrandbits(160):040x}"',
            f"{n(rng, rng.randint(1, 8))}",
            n(rng, rng.randint(12, 19)) if luhn(broken) else broken,
            f"20{n(rng, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}",
            f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{n(rng, 2)}",
            f"{rng.randint(0, 23)}:{n(rng, 2)}:{n(rng, 2)}",
            f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}",
            f"${rng.randint(1, 999)},{n(rng, 3)}.{n(rng, 2)}",
            f"{rng.randint(100, 999)}-{rng.randint(100, 999)}",
            f"{_word(rng)} at {_word(rng)} {_word(rng)}",
            f"{_word(rng)} at the dot {_word(rng)}",
            f"@{_word(rng)} #{_word(rng)}",
            f"{_word(rng)}.{_word(rng)} ({n(rng, 3)}) {_word(rng)}",
            f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{n(rng, 3)}.{n(rng, 4)}",
            "0x" + n(rng, 8),
            f"{rng.random() * 1000:.4f}",
        )
    )


def _planted(rng: random.Random, text: str, spans: list[Span], piece: str, kind: int | None):
    """The text with a piece set in at a blank outside its spans."""
    places = [i for i, c in enumerate(text) if c == " " and not any(s <= i < e for s, _, e in spans)]
    at = rng.choice(places) if places else len(text)
    piece = " " + piece
    # Punctuation may follow, as in prose.
    after = rng.choice(("", "", "", ",", ".", ";"))
    moved = [(s + len(piece + after), k, e + len(piece + after)) if s >= at else (s, k, e) for s, k, e in spans]
    new = [(at + 1, kind, at + len(piece))] if kind is not None else []
    return text[:at] + piece + after + text[at:], sorted(moved + new)


def examples(windows: list[tuple[str, list[Span]]], fit: Fit) -> list[tuple[str, list[Span]]]:
    """Windows of the corpus as they are, with invented data set in, and with harmless numbers."""
    rng, out = random.Random(fit.seed), []
    for text, spans in windows:
        out.append((text, spans))
        changed = text[: tagger.LEARNED // 2], [s for s in spans if s[2] <= tagger.LEARNED // 2]
        for _ in range(rng.choice((1, 1, 2))):
            kind = rng.choice((EMAIL, IP, CARD, PHONE, None, None))
            piece = harmless(rng) if kind is None else invented(rng, kind)
            changed = _planted(rng, *changed, piece, kind)
        out.append(changed)
    return out


def _tags(example: tuple[str, list[Span]]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of a window, cut or filled to the tagger's length."""
    text, spans = example
    tags = np.zeros(max(len(text), tagger.LEARNED), np.int64)
    for start, kind, end in spans:
        tags[start:end] = 2 * kind + 2
        tags[start : start + 1] = 2 * kind + 1
    codes = tagger.codes(text)[: tagger.LEARNED]
    held = np.full(tagger.LEARNED, tagger.PAD, np.uint8)
    held[: len(codes)] = codes
    return held, tags[: tagger.LEARNED]


_WINDOW_DDL = "hash bigint, text string, spans array<struct<start:int,kind:int,end:int>>"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Around every base span a window, and one from somewhere of each text."""
    size = tagger.LEARNED
    for batch in batches:
        rows = []
        for key, text in zip(batch["hash"].to_pylist(), batch["text"].to_pylist(), strict=True):
            spans, rng = base_spans(text), random.Random(key)
            starts = [s - rng.randint(5, size // 2) for s, _, _ in spans] + [rng.randint(0, max(0, len(text) - size))]
            for start in starts:
                start = max(0, start)
                window = text[start : start + size]
                inside = [(s - start, k, e - start) for s, k, e in spans if s >= start and e <= start + size]
                cut = any(s < start < e or s < start + size < e for s, _, e in spans)
                if window and not cut:
                    rows.append((rng.getrandbits(62), window, [dict(zip(("start", "kind", "end"), x, strict=True)) for x in inside]))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")]))]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["hash", "text", "spans"])


def fit_tagger(documents: DataFrame, text: str = "text", fit: Fit = Fit()) -> tagger.Tagger | None:
    """Learn from a sample that is drawn by a hash of the texts; None without any text."""
    n = documents.count()
    hashed = documents.select(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).where(F.length("text") > 0)
    share = min(1.0, fit.sample_rows / max(n, 1))
    # Copies of a text have one hash; one of their windows is enough.
    drawn = hashed.where(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    found = store(drawn.mapInArrow(_windows, _WINDOW_DDL).dropDuplicates(["text"]), "windows").frame
    # Windows with spans first, half of all at most.
    half = fit.windows // 2
    rows = []
    for condition in (F.size("spans") > 0, F.size("spans") == 0):
        rows += found.where(condition).orderBy("hash", "text").limit(half).collect()
    windows = [(r.text, [(s.start, s.kind, s.end) for s in r.spans]) for r in rows]
    if not windows:
        return None
    labelled = [_tags(x) for x in examples(windows, fit)]
    codes = np.array([c for c, _ in labelled])
    tags = np.array([t for _, t in labelled])
    return tagger.train(codes, tags, 2 * len(KINDS) + 1, fit.steps, fit.seed)


# --- tagging ----------------------------------------------------------------------------


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[Span]:
    """Of (start, kind, end, score) those without overlap whose scores add up to most."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]
    before = np.searchsorted(ends, [s[0] for s in spans], side="right") if spans else []
    for i, (_, _, _, score) in enumerate(spans):
        with_it = best[before[i]][0] + score
        best.append((with_it, i) if with_it > best[i][0] else (best[i][0], -1))
    out, i = [], len(spans)
    while i > 0:
        if best[i][1] >= 0:
            start, kind, end, _ = spans[i - 1]
            out.append((start, kind, end))
            i = int(before[i - 1])
        else:
            i -= 1
    return out[::-1]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in " ,;:.\n\t\"'":
        start += 1
    while end > start and text[end - 1] in " ,;:.\n\t\"'":
        end -= 1
    return start, end


def added_spans(text: str, base: list[Span], found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Tagged spans apart from base ones that pass their check, reconciled over the text."""
    kept = []
    for start, kind, end, score in found:
        start, end = _trimmed(text, start, end)
        apart = all(end <= s or e <= start for s, _, e in base)
        if start < end and apart and plausible(kind, text[start:end]):
            # A number that goes on beyond the span was cut out of something else.
            around = text[max(0, start - 1) : start] + text[end : end + 1]
            if not any(c.isalnum() for c in around):
                kept.append((start, kind, end, score))
    return reconciled(kept)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
_SPANS_DDL = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def personal_data(documents: DataFrame, model: tagger.Tagger | None, text: str = "text", output: str = "personal") -> DataFrame:
    """All columns and the spans of each text by start and kind: (kind, start, end, base)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_SPANS_DDL)
    def find(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        rows = []
        found = shared.value.spans(texts) if shared.value is not None else ([] for _ in texts)
        for t, tagged in zip(texts, found, strict=True):
            base = base_spans(t)
            spans = [(*s, True) for s in base]
            if tagged:
                spans += [(*s, False) for s in added_spans(t, base, tagged)]
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted(spans)])
        return pa.array(rows, _SPANS)

    name = unused(documents.columns, "_found")
    return documents.drop(output).withColumn(name, find(F.col(text))).withColumnRenamed(name, output)
