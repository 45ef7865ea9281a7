"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Words that have a softmax row of their own come in classes of so many, by frequency; one more class
#: holds the rest. There are classes enough for the words that occur LEAST_COUNT times, within bounds.
CLASS_WORDS, LEAST_CLASSES, MOST_CLASSES, LEAST_COUNT = 64, 8, 32, 128
HIDDEN = 16
#: Steps between truncations; the state is carried from window to window.
WINDOW = 32
#: Lanes that are trained side by side, and tokens that are dealt to them at once.
LANES, CHUNK_TOKENS = 256, 1 << 20
FLOOR = -30.0


def n_words_for(counts: np.ndarray) -> int:
    """How many words get rows of their own, by their falling counts: more in a larger corpus."""
    classes = -(-int((counts >= LEAST_COUNT).sum()) // CLASS_WORDS)
    return CLASS_WORDS * int(np.clip(classes, LEAST_CLASSES, MOST_CLASSES))


@dataclass
class Gru:
    """Input rows: the words, the rest (n_words) and the start of a text (n_words + 1)."""

    inputs: np.ndarray
    recurrent: np.ndarray
    class_out: np.ndarray
    class_bias: np.ndarray
    word_out: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, rest: float, n_words: int) -> Gru:
        """Small random weights from a fixed seed; biases are the log shares of the words, most
        frequent first, so that the untrained model is the unigram model."""
        draw = np.random.default_rng(11)
        c = np.zeros(n_words)
        c[: len(counts)] = counts
        groups = c.reshape(-1, CLASS_WORDS)
        sums = np.r_[groups.sum(axis=1), max(rest, 0) + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            classes = np.maximum(np.log(sums / sums.sum()), FLOOR)
            words = np.maximum(np.log(groups / groups.sum(axis=1, keepdims=True)), FLOOR)
        return cls(
            (draw.standard_normal((n_words + 2, 3 * HIDDEN)) * 0.1).astype(np.float32),
            (draw.standard_normal((HIDDEN, 3 * HIDDEN)) * 0.25).astype(np.float32),
            np.zeros((HIDDEN, len(sums)), np.float32),
            classes.astype(np.float32),
            np.zeros((n_words, HIDDEN), np.float32),
            np.nan_to_num(words, nan=FLOOR).ravel().astype(np.float32),
        )

    @property
    def n_words(self) -> int:
        return len(self.word_out)

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.class_out, self.class_bias, self.word_out, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def filled(self, flat: np.ndarray) -> Gru:
        out, at = [], 0
        for x in self.arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Gru(*out)

    def states(self, ids: np.ndarray, h: np.ndarray, keep: bool = False):
        """ids: steps x texts of inputs. The states before and after each step, and what backpropagation
        needs. Where a text starts, the state before is zero."""
        steps, n = ids.shape
        x = self.inputs[ids]
        x[:, :, : 2 * HIDDEN] *= 0.5
        gates_in, out = self.recurrent[:, : 2 * HIDDEN] * np.float32(0.5), self.recurrent[:, 2 * HIDDEN :]
        begins = ids == self.n_words + 1
        some = begins.any(axis=1)
        befores, afters = np.empty((steps, n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        gates = np.empty((steps, n, 2 * HIDDEN), np.float32) if keep else None
        fresh = np.empty((steps, n, HIDDEN), np.float32) if keep else None
        for t in range(steps):
            before = befores[t]
            before[...] = afters[t - 1] if t else h
            if some[t]:
                before[begins[t]] = 0
            g = before @ gates_in
            g += x[t, :, : 2 * HIDDEN]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            c = (g[:, HIDDEN:] * before) @ out
            c += x[t, :, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep:
                gates[t], fresh[t] = g, c
            c -= before
            c *= g[:, :HIDDEN]
            np.add(before, c, out=afters[t])
        return befores, afters, gates, fresh

    def logs(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Log probabilities of targets (n_words: the rest, as a class) after states h; with grads,
        also the summed gradients of their negative and that by h, under dh."""
        tail = self.n_words // CLASS_WORDS
        kind = np.minimum(targets // CLASS_WORDS, tail)
        rows = np.arange(len(h))
        score = h @ self.class_out
        score += self.class_bias
        score -= score.max(axis=1, keepdims=True)
        chosen = score[rows, kind]
        np.exp(score, out=score)
        total = score.sum(axis=1)
        out = chosen - np.log(total)
        if grads is not None:
            score /= total[:, None]
            score[rows, kind] -= 1
            grads["class_out"], grads["class_bias"] = h.T @ score, score.sum(axis=0)
            grads["dh"] = score @ self.class_out.T
        # words with a row of their own, ordered by class; the bias is one more weight
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        edges = np.r_[0, np.cumsum(np.bincount(kind, minlength=tail + 1))]
        some = order[: edges[tail]]
        spans = [(slice(edges[k], edges[k + 1]), slice(k * CLASS_WORDS, (k + 1) * CLASS_WORDS)) for k in range(tail) if edges[k] < edges[k + 1]]
        own = np.concatenate([h[some], np.ones((len(some), 1), np.float32)], axis=1)
        rows = np.concatenate([self.word_out, self.word_bias[:, None]], axis=1)
        score = np.empty((len(some), CLASS_WORDS), np.float32)
        for at, span in spans:
            np.matmul(own[at], rows[span].T, out=score[at])
        score -= score.max(axis=1, keepdims=True)
        at, place = np.arange(len(some)), targets[some] % CLASS_WORDS
        chosen = score[at, place]
        np.exp(score, out=score)
        total = score @ np.ones(CLASS_WORDS, np.float32)
        out[some] += chosen - np.log(total)
        if grads is not None:
            score /= total[:, None]
            score[at, place] -= 1
            both, dh = np.zeros_like(rows), np.empty((len(some), HIDDEN), np.float32)
            for at, span in spans:
                np.matmul(score[at].T, own[at], out=both[span])
                np.matmul(score[at], self.word_out[span], out=dh[at])
            grads["word_out"], grads["word_bias"] = both[:, :HIDDEN], both[:, HIDDEN]
            grads["dh"][some] += dh
        return out

    def gradients(self, ids: np.ndarray, targets: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray, float]:
        """Of one window: gradients of the mean negative log probability, the last state, the sum. That
        of the inputs is a pair: the rows that occur, and theirs."""
        before, after, gates, fresh = self.states(ids, h, keep=True)
        steps, n = ids.shape
        g: dict[str, np.ndarray] = {}
        mask = real.ravel()
        flat = after.reshape(-1, HIDDEN)[mask]
        total = float(self.logs(flat, targets.ravel()[mask], g).sum())
        dh = np.zeros((steps * n, HIDDEN), np.float32)
        dh[mask] = g["dh"]
        dh = dh.reshape(steps, n, HIDDEN)
        d_in, d_rec = np.zeros((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(self.recurrent)
        into, out = self.recurrent[:, : 2 * HIDDEN], self.recurrent[:, 2 * HIDDEN :]
        carry = np.zeros((n, HIDDEN), np.float32)
        begins = ids == self.n_words + 1
        some = begins.any(axis=1)
        z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        to_fresh, to_z, to_r, kept = z * (1 - fresh * fresh), (fresh - before) * z * (1 - z), before * r * (1 - r), 1 - z
        for t in range(steps - 1, -1, -1):
            d = dh[t] + carry
            d_gates, dc = d_in[t, :, : 2 * HIDDEN], d_in[t, :, 2 * HIDDEN :]
            np.multiply(d, to_fresh[t], out=dc)
            mixed = dc @ out.T
            np.multiply(d, to_z[t], out=d_gates[:, :HIDDEN])
            np.multiply(mixed, to_r[t], out=d_gates[:, HIDDEN:])
            carry = d * kept[t]
            mixed *= r[t]
            carry += mixed
            carry += d_gates @ into.T
            if some[t]:
                carry[begins[t]] = 0
        rows = d_in.reshape(-1, 3 * HIDDEN)
        d_rec[:, : 2 * HIDDEN] = before.reshape(-1, HIDDEN).T @ rows[:, : 2 * HIDDEN]
        d_rec[:, 2 * HIDDEN :] = (r * before).reshape(-1, HIDDEN).T @ rows[:, 2 * HIDDEN :]
        order = np.argsort(ids.ravel().astype(np.uint16), kind="stable")
        sorted_ids = ids.ravel()[order]
        starts = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        inputs = np.add.reduceat(rows[order], starts, axis=0)
        scale = np.float32(1 / max(1, int(mask.sum())))
        found = [d_rec, g["class_out"], g["class_bias"], g["word_out"], g["word_bias"]]
        return [(sorted_ids[starts], inputs * scale), *(x * scale for x in found)], after[-1], total


def lanes(texts: list[np.ndarray], n: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' targets strung together on n lanes of equal length: inputs, targets and which of them are
    real, steps x n. A lane goes on from text to text; each text's first input is the start row. The
    last lane is filled up with the rest, not real."""
    whole = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    before = np.r_[n_words + 1, whole[:-1]][: len(whole)]
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    before[begin[begin < len(whole)]] = n_words + 1
    steps = -(-len(whole) // n)
    fill = steps * n - len(whole)
    cut = lambda x, value: np.r_[x, np.full(fill, value, x.dtype)].reshape(n, steps).T
    return cut(before, n_words), cut(whole, n_words), cut(np.ones(len(whole), bool), False)


class Trainer:
    """Truncated backpropagation with Adagrad, one pass over every token of the texts that it is fed."""

    def __init__(self, model: Gru, n_lanes: int = LANES, rate: float = 0.16):
        self.model = model.filled(model.flat())
        self.n_lanes, self.rate, self.seen = n_lanes, np.float32(rate), 0
        self.sums = [np.full(x.shape, 1e-6, np.float32) for x in self.model.arrays()]

    def feed(self, texts: list[np.ndarray]) -> None:
        """The lanes start anew; a text that is cut between two goes on in the other with its words before
        it, but from a zero state."""
        n = int(min(self.n_lanes, max(1, sum(map(len, texts)) // (4 * WINDOW))))
        ids, targets, real = lanes(texts, n, self.model.n_words)
        h = np.zeros((n, HIDDEN), np.float32)
        for at in range(0, len(ids), WINDOW):
            part = slice(at, at + WINDOW)
            grads, h, _ = self.model.gradients(ids[part], targets[part], real[part], h)
            self.seen += int(real[part].sum())
            for x, g, s in zip(self.model.arrays(), grads, self.sums):
                if isinstance(g, tuple):
                    rows, g = g
                    np.clip(g, -1, 1, out=g)
                    own = s[rows] + g * g
                    s[rows] = own
                    x[rows] -= self.rate * g / np.sqrt(own)
                else:
                    np.clip(g, -1, 1, out=g)
                    s += g * g
                    g *= self.rate
                    g /= np.sqrt(s)
                    x -= g


def train(model: Gru, texts: Iterable[np.ndarray], **how) -> tuple[Gru, int]:
    """The model trained on all texts, of which no more than CHUNK_TOKENS tokens and a text are held at
    a time; and the number of tokens."""
    trainer, held, size = Trainer(model, **how), [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK_TOKENS:
            trainer.feed(held)
            held, size = [], 0
    if size:
        trainer.feed(held)
    return trainer.model, trainer.seen


def score(model: Gru, texts: list[np.ndarray], width: int = 512, window: int = 64) -> np.ndarray:
    """The natural log probability of each whole text, its state carried from window to window; texts
    of like length run side by side."""
    out = np.zeros(len(texts))
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    for start in range(0, len(order), width):
        some = order[start : start + width]
        some = some[sizes[some] > 0]
        h, left = np.zeros((len(some), HIDDEN), np.float32), sizes[some]
        last = np.full(len(some), model.n_words + 1, np.int64)
        for at in range(0, int(left.max(initial=0)), window):
            n = int((left > at).sum())
            steps = int(min(window, left[0] - at))
            real = np.arange(at, at + steps)[:, None] < left[None, :n]
            targets = np.full((steps, n), model.n_words, np.int64)
            for k in range(n):
                part = texts[some[k]][at : at + steps]
                targets[: len(part), k] = part
            ids = np.vstack([last[None, :n], targets[:-1]])
            _, after, _, _ = model.states(ids, h[:n])
            mask = real.ravel()
            logs = model.logs(after.reshape(-1, HIDDEN)[mask], targets.ravel()[mask])
            owner = np.broadcast_to(np.arange(n), (steps, n)).ravel()[mask]
            out[some[:n]] += np.bincount(owner, logs.astype(np.float64), n)
            h, last = after[-1], targets[-1]
    return out
