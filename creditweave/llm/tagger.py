"""A character tagger in numpy: a bidirectional LSTM with a linear-chain CRF on top.

Tag 0 is outside, tag 2k + 1 begins kind k and tag 2k + 2 goes on with it. Texts are read in windows
of `LENGTH` characters that overlap by `OVERLAP`, learned from in windows of `LEARNED`; what is missing
at a text's end is filled with `PAD`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LENGTH = 240
OVERLAP = 48
LEARNED = 96
HIDDEN = 12
# Windows that a task works on at once.
BATCH = 1024

# Classes of characters: letters without case, all digits as one, ASCII signs, white space, the rest.
PAD = 0
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = 5 + len(_LETTERS) + len(_SIGNS)


def _class_table() -> np.ndarray:
    table = np.full(0x110000, 4, np.uint8)
    table[[ord(c) for c in "\n\r\x0b\x0c"]] = 2
    table[[ord(c) for c in " \t\xa0"]] = 1
    table[[ord(c) for c in "0123456789"]] = 3
    for i, c in enumerate(_LETTERS):
        table[[ord(c), ord(c.upper())]] = 5 + i
    for i, c in enumerate(_SIGNS):
        table[ord(c)] = 5 + len(_LETTERS) + i
    return table


_TABLE = _class_table()


def codes(text: str) -> np.ndarray:
    return _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """`inputs` (2, classes, 4H) and `hidden` (2, H, 4H) for both directions, `out` (2H, tags),
    `bias`, and the CRF's `moves` (tags, tags), with row -1 for the beginning in `first`."""

    inputs: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.out, self.bias, self.moves, self.first]

    # -- reading ------------------------------------------------------------------------

    def emissions(self, batch: np.ndarray) -> np.ndarray:
        """(length, tags, windows) scores of a (windows, length) batch of classes."""
        n, length = batch.shape
        h = self.hidden.shape[1]
        # Halved gates: the logistic function is then a single tanh for all four.
        half = np.full(4 * h, 0.5, np.float32)
        half[3 * h :] = 1.0
        scores = np.empty((length, len(self.bias), n), np.float32)
        scores[:] = self.bias[:, None]
        turned = np.ascontiguousarray(batch.T).astype(np.intp)
        for way in range(2):
            # Columns are windows: every gate is then one stretch of memory.
            table = np.ascontiguousarray((self.inputs[way] * half).T)
            through = np.ascontiguousarray((self.hidden[way] * half).T)
            out = np.ascontiguousarray(self.out[way * h : (way + 1) * h].T)
            state, cell, fresh = np.zeros((3, h, n), np.float32)
            gates, added = np.empty((2, 4 * h, n), np.float32)
            given = np.empty((len(self.bias), n), np.float32)
            for t in range(length) if way == 0 else reversed(range(length)):
                np.take(table, turned[t], axis=1, out=gates, mode="clip")
                np.matmul(through, state, out=added)
                gates += added
                np.tanh(gates, out=gates)
                open_ = gates[: 3 * h]
                open_ *= 0.5
                open_ += 0.5
                cell *= gates[h : 2 * h]
                np.multiply(gates[:h], gates[3 * h :], out=fresh)
                cell += fresh
                np.tanh(cell, out=state)
                state *= gates[2 * h : 3 * h]
                np.matmul(out, state, out=given)
                scores[t] += given
        return scores

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """(windows, length) tags of the best path through each window."""
        length, _, n = scores.shape
        best = np.empty_like(scores)
        best[0] = scores[0] + self.first[:, None]
        moves = self.moves[:, :, None]
        for t in range(1, length):
            np.max(best[t - 1][:, None] + moves, axis=0, out=best[t])
            best[t] += scores[t]
        out = np.zeros((length, n), np.int8)
        out[-1] = best[-1].argmax(0)
        for t in range(length - 1, 0, -1):
            out[t - 1] = (best[t - 1] + self.moves[:, out[t]]).argmax(0)
        return np.ascontiguousarray(out.T)

    def can_leave(self, scores: np.ndarray) -> np.ndarray:
        """Which windows may hold more than tag 0 on their best path.

        A stretch of other tags gains at most the difference of scores at each of its places and the best move
        between them, besides the best moves into and out of it. Where no stretch can gain, tag 0 alone
        is best.
        """
        stay = self.moves[0, 0]
        within = (self.moves[1:, 1:] - stay).max()
        into = max((self.moves[0, 1:] - stay).max(), (self.first[1:] - self.first[0]).max())
        leave = max((self.moves[1:, 0] - stay).max(), 0.0)
        gain = scores[:, 1:].max(1) - scores[:, 0] + within
        best = np.full(scores.shape[2], -np.inf, np.float32)
        current = np.zeros(scores.shape[2], np.float32)
        for step in gain:
            np.maximum(current, 0, out=current)
            current += step
            np.maximum(best, current, out=best)
        # A little more, for rounding.
        return best + (into + leave - within) > -1e-3

    def spans(self, texts: list[str]) -> Iterator[list[tuple[int, int, int, float]]]:
        """For each text the (start, kind, end, score) that its windows show whole."""
        waiting: list[tuple[int, int, bool, np.ndarray]] = []
        found: dict[int, list] = {}
        done = 0
        for number, text in enumerate(texts):
            held = codes(text)
            found[number] = []
            for start in range(0, max(1, len(held) - OVERLAP), LENGTH - OVERLAP) if len(held) else ():
                waiting.append((number, start, start + LENGTH >= len(held), held[start : start + LENGTH]))
                if len(waiting) == BATCH:
                    self._read(waiting, found)
                    waiting = []
                    # Texts before the current one are complete.
                    while done < number:
                        yield found.pop(done)
                        done += 1
        self._read(waiting, found)
        for number in range(done, len(texts)):
            yield found.pop(number)

    def _read(self, windows: list, found: dict[int, list]) -> None:
        if not windows:
            return
        batch = np.full((len(windows), LENGTH), PAD, np.uint8)
        for i, (_, _, _, held) in enumerate(windows):
            batch[i, : len(held)] = held
        scores = self.emissions(batch)
        live = np.flatnonzero(self.can_leave(scores))
        if not len(live):
            return
        scores = np.ascontiguousarray(scores[:, :, live])
        tags = self.decode(scores)
        for j in np.flatnonzero((tags > 0).any(1)):
            number, start, last, held = windows[live[j]]
            row = tags[j]
            begin = (row > 0) & ((row % 2 == 1) | (np.insert(row[:-1], 0, 0) != row) & (np.insert(row[:-1], 0, 0) != row - 1))
            for a in np.flatnonzero(begin):
                kind, b = (row[a] - 1) // 2, a + 1
                while b < LENGTH and row[b] == 2 * kind + 2:
                    b += 1
                if (a == 0 and start > 0) or (b >= len(held) and not last):
                    continue
                margin = scores[a:b, 1:, j].max(1) - scores[a:b, 0, j]
                found[number].append((start + int(a), int(kind), start + int(min(b, len(held))), float(max(margin.sum(), 0.1))))


# --- training ---------------------------------------------------------------------------


def _new(tags: int, rng: np.random.Generator) -> Tagger:
    h = HIDDEN

    def normal(*shape, scale=0.2):
        return rng.normal(0, scale, shape).astype(np.float32)

    inputs = normal(2, CLASSES, 4 * h)
    inputs[:, :, h : 2 * h] += 1.0  # remember at first
    return Tagger(
        inputs, normal(2, h, 4 * h), normal(2 * h, tags), np.zeros(tags, np.float32), normal(tags, tags, scale=0.05), np.zeros(tags, np.float32)
    )


def _forward(model: Tagger, x: np.ndarray):
    """States of both directions, each in its own order of reading; x is (length, windows)."""
    length, n = x.shape
    h = HIDDEN
    both = np.stack([x, x[::-1]])
    gates = np.stack([model.inputs[way][both[way]] for way in range(2)], 1)  # (length, 2, n, 4h)
    cells, states = np.zeros((2, length + 1, 2, n, h), np.float32)
    for t in range(length):
        z = gates[t]
        z += states[t] @ model.hidden
        z[..., : 3 * h] = _sigmoid(z[..., : 3 * h])
        z[..., 3 * h :] = np.tanh(z[..., 3 * h :])
        cells[t + 1] = z[..., h : 2 * h] * cells[t] + z[..., :h] * z[..., 3 * h :]
        states[t + 1] = z[..., 2 * h : 3 * h] * np.tanh(cells[t + 1])
    return both, gates, cells, states


def _crf(model: Tagger, scores: np.ndarray, y: np.ndarray):
    """Mean negative log-likelihood and its gradients by scores, moves and first."""
    length, n, tags = scores.shape
    ahead = np.zeros_like(scores)
    ahead[0] = scores[0] + model.first
    for t in range(1, length):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + model.moves, 1) + scores[t]
    total = _log_sum(ahead[-1], 1)
    behind = np.zeros_like(scores)
    moves = np.zeros_like(model.moves)
    for t in range(length - 1, 0, -1):
        rest = scores[t] + behind[t]
        pairs = model.moves + rest[:, None, :]
        behind[t - 1] = _log_sum(pairs, 2)
        moves += np.exp(ahead[t - 1][:, :, None] + pairs - total[:, None, None]).sum(0)
    grad = np.exp(ahead + behind - total[:, None])
    first = grad[0].sum(0)
    rows = np.arange(n)
    gold = model.first[y[0]].sum()
    for t in range(length):
        gold += scores[t, rows, y[t]].sum()
        grad[t, rows, y[t]] -= 1
    np.subtract.at(first, y[0], 1)
    np.subtract.at(moves, (y[:-1].ravel(), y[1:].ravel()), 1)
    gold += model.moves[y[:-1], y[1:]].sum()
    return (total.sum() - gold) / n, grad / n, moves / n, first / n


def gradients(model: Tagger, codes_: np.ndarray, tags_: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The loss of a (windows, length) batch and its gradient by every weight."""
    x, y, h = codes_.T, tags_.T, HIDDEN
    both, gates, cells, states = _forward(model, x)
    length, n = x.shape
    ahead, back = states[1:, 0], states[1:, 1][::-1]
    read = np.concatenate([ahead, back], 2)
    scores = read @ model.out + model.bias
    loss, by_scores, by_moves, by_first = _crf(model, scores, y)
    by_out = np.tensordot(read, by_scores, ([0, 1], [0, 1]))
    by_read = by_scores @ model.out.T
    by_state = np.stack([by_read[:, :, :h], by_read[:, :, h:][::-1]], 1)
    by_gates = np.zeros_like(gates)
    state, cell = np.zeros((2, 2, n, h), np.float32)
    through = model.hidden.transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        state = state + by_state[t]
        i, f, o, g = np.split(gates[t], 4, 2)
        squashed = np.tanh(cells[t + 1])
        cell = cell + state * o * (1 - squashed**2)
        d = by_gates[t]
        d[..., :h] = cell * g * i * (1 - i)
        d[..., h : 2 * h] = cell * cells[t] * f * (1 - f)
        d[..., 2 * h : 3 * h] = state * squashed * o * (1 - o)
        d[..., 3 * h :] = cell * i * (1 - g**2)
        state = d @ through
        cell = cell * f
    by_hidden = np.stack([np.tensordot(states[:-1, w], by_gates[:, w], ([0, 1], [0, 1])) for w in range(2)])
    by_inputs = np.zeros_like(model.inputs)
    for w in range(2):
        flat = by_gates[:, w].reshape(-1, 4 * h)
        order = np.argsort(both[w].ravel(), kind="stable")
        held, starts = np.unique(both[w].ravel()[order], return_index=True)
        by_inputs[w][held] = np.add.reduceat(flat[order], starts)
    return float(loss), [by_inputs, by_hidden, by_out, by_scores.sum((0, 1)), by_moves, by_first]


def train(codes_: np.ndarray, tags_: np.ndarray, tags: int, steps: int, seed: int, batch: int = 96) -> Tagger:
    """Adam with a falling rate on batches drawn by the seed."""
    rng = np.random.default_rng(seed)
    model = _new(tags, rng)
    mean = [np.zeros_like(w) for w in model.weights()]
    square = [np.zeros_like(w) for w in model.weights()]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(codes_), batch)
        _, found = gradients(model, codes_[rows], tags_[rows])
        norm = np.sqrt(sum(float((g**2).sum()) for g in found))
        rate = 0.02 * (1 - (step - 1) / steps) + 0.0005
        for w, g, m, s in zip(model.weights(), found, mean, square, strict=True):
            g = g * min(1.0, 5.0 / norm)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model
