"""A bidirectional gated recurrent network with attention pooling, in numpy.

A window is a run of words.  A word's input is its own vector (words of the training
sample; others share one) next to the scaled sum of the vectors of its character runs.  Each
direction's input products depend on the word alone, so they are kept by word.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np

#: Every run of up to WINDOW - STRIDE + 1 words lies whole in some window.
WINDOW, STRIDE = 32, 4
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 8, 8, 8
GRAM, BUCKET_BITS = 4, 16
BUCKETS = 1 << BUCKET_BITS
MAX_WORDS = 20_000
MIN_DOCS = 3
MAX_EPOCHS = 12
#: Words whose input products a worker keeps, and windows that run at a time.
CACHE_WORDS = 150_000
RUN_WINDOWS = 2048

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-cased words; a text without any is one empty word."""
    return _WORD.findall(text.lower()) or [""]


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Overlapping windows over n words; the last one ends with the text."""
    if n <= window:
        return [0]
    return [*range(0, n - window, stride), n - window]


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each run of GRAM bytes of ``^word$$``, number of runs of each word)."""
    coded = [b"^" + w.encode("utf-8", "replace") + b"$$" for w in words]
    counts = np.array([max(1, len(c) - GRAM + 1) for c in coded])
    coded = [c if len(c) >= GRAM else c.ljust(GRAM, b"$") for c in coded]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    sizes = counts + GRAM - 1
    mixed = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        mixed |= data[k : k + len(mixed)] << np.uint32(8 * k)
    mixed = (mixed * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    first = np.repeat(np.cumsum(sizes) - sizes, counts)
    return mixed[first + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)], counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Parameters by name; ``words`` maps known words to rows of E, row 0 is any other word."""

    def __init__(self, words: dict[str, int], parameters: dict[str, np.ndarray]):
        self.words, self.p = words, parameters

    @staticmethod
    def fresh(words: dict[str, int], word_odds: np.ndarray, gram_odds: np.ndarray, seed: int) -> Model:
        """Random parameters; the first dimension of word and run vectors begins as their log-odds."""
        rng = np.random.default_rng(seed)

        def matrix(rows: int, columns: int) -> np.ndarray:
            return (rng.standard_normal((rows, columns)) * math.sqrt(1 / rows)).astype(np.float32)

        d = WORD_DIM + CHAR_DIM
        p = {
            "E": (rng.standard_normal((len(words) + 1, WORD_DIM)) * 0.1).astype(np.float32),
            "C": (rng.standard_normal((BUCKETS, CHAR_DIM)) * 0.05).astype(np.float32),
            "A": matrix(2 * HIDDEN, ATTENTION),
            "a": np.zeros(ATTENTION, np.float32),
            "v": matrix(ATTENTION, 1),
            "o": matrix(2 * HIDDEN, 1),
            "c": np.zeros(1, np.float32),
        }
        p["E"][1:, 0], p["C"][:, 0] = word_odds, gram_odds
        for way in "fb":
            p["W" + way] = matrix(d, 3 * HIDDEN)
            p["U" + way] = matrix(HIDDEN, 3 * HIDDEN)
            p["B" + way] = np.zeros(3 * HIDDEN, np.float32)
        return Model(words, p)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """The input vectors of words, and what their gradient needs."""
        ids = np.array([self.words.get(w, 0) for w in words])
        grams, counts = gram_ids(words)
        scale = 1 / np.sqrt(counts[:, None]).astype(np.float32)
        chars = np.add.reduceat(self.p["C"][grams], np.cumsum(counts) - counts) * scale
        return np.concatenate([self.p["E"][ids], chars], axis=1), (ids, grams, counts, scale)

    def products(self, x: np.ndarray) -> np.ndarray:
        """Input products of both directions, side by side."""
        return np.concatenate([x @ self.p["W" + w] + self.p["B" + w] for w in "fb"], axis=1)

    def forward(self, rows: np.ndarray, mask: np.ndarray, products: np.ndarray, keep: bool = False):
        """Logit of each window.  rows: (windows, steps) rows of ``products``; mask: 1 where there is a word."""
        p, h3 = self.p, 3 * HIDDEN
        n, steps = rows.shape
        states = np.empty((2, steps, n, HIDDEN), np.float32)
        tape = [[], []]
        full = bool(mask.all())
        for d, way in enumerate("fb"):
            u = p["U" + way]
            own = products[:, d * h3 : (d + 1) * h3]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == 0 else reversed(range(steps)):
                x = own[rows[:, t]]
                g = h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                m = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = m + z * (h - m)
                if not full:
                    new = np.where(mask[:, t : t + 1] > 0, new, h)
                if keep:
                    tape[d].append((t, h, zr, m, g[:, 2 * HIDDEN :]))
                states[d, t] = h = new
        both = np.concatenate([states[0], states[1]], axis=2)
        pre = np.tanh(both @ p["A"] + p["a"])
        e = (pre @ p["v"])[:, :, 0]
        if not full:
            e = np.where(mask.T > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        context = np.einsum("tn,tnh->nh", weight, both)
        logit = (context @ p["o"])[:, 0] + p["c"][0]
        return (logit, (both, pre, weight, context, tape)) if keep else logit

    def infer(self, flat: np.ndarray, table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of the windows of ``sizes`` words that begin at ``starts`` of ``flat``, which are rows of ``table``.

        :meth:`forward` for scoring: overlapping windows share the products of a word, both
        directions run side by side, and each step works in place on whole blocks.  Halves
        stand in the products and matrices (``sigmoid(x) = (tanh(x / 2) + 1) / 2``), which is exact.
        """
        p, n, steps = self.p, len(starts), int(sizes.max())
        base = int(starts.min())
        own = table[flat[base : int((starts + sizes).max())]].reshape(-1, 2, 3, HIDDEN).transpose(2, 1, 0, 3)
        half = np.array([0.5, 0.5, 1.0], np.float32)[:, None, None, None]
        own = np.ascontiguousarray(own * half)  # gate, direction, place, unit
        u = np.stack([p["U" + way].reshape(HIDDEN, 3, HIDDEN) for way in "fb"]) * np.float32(0.5)  # direction, unit, gate, unit
        u = np.ascontiguousarray(u.transpose(2, 0, 1, 3))
        last = own.shape[2] - 1
        full = int(sizes.min()) == steps
        z, r, m = (np.empty((2, n, HIDDEN), np.float32) for _ in range(3))
        x = np.empty((3, 2, n, HIDDEN), np.float32)
        states = np.empty((2, steps, n, HIDDEN), np.float32)
        h = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps):
            step = (t, steps - 1 - t)
            for d in (0, 1):
                at = np.minimum(starts - base + step[d], last)
                for gate in range(3):
                    np.take(own[gate, d], at, axis=0, out=x[gate, d], mode="clip")
            np.matmul(h, u[0], out=z)
            z += x[0]
            np.tanh(z, out=z)
            np.matmul(h, u[1], out=r)
            r += x[1]
            np.tanh(r, out=r)
            r += 1
            np.matmul(h, u[2], out=m)
            m *= r
            m += x[2]
            np.tanh(m, out=m)
            # h = m + (z + 1) / 2 * (h - m)
            new = h - m
            z += 1
            z *= 0.5
            new *= z
            new += m
            for d in (0, 1):
                if not full:
                    np.copyto(new[d], h[d], where=(step[d] >= sizes)[:, None])
                states[d, step[d]] = new[d]
            h = new
        pre = states[0] @ p["A"][:HIDDEN]
        pre += states[1] @ p["A"][HIDDEN:]
        pre += p["a"]
        np.tanh(pre, out=pre)
        e = (pre @ p["v"])[:, :, 0]
        if not full:
            e[np.arange(steps)[:, None] >= sizes] = -1e9
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        # the states' part in the logit, then their weighted sum
        worth = (states[0] @ p["o"][:HIDDEN])[:, :, 0]
        worth += (states[1] @ p["o"][HIDDEN:])[:, :, 0]
        worth *= e
        return worth.sum(axis=0) + p["c"][0]

    def gradients(self, rows, mask, x, products, saved, slope) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the input vectors; ``slope`` is the loss by logit."""
        p, h3 = self.p, 3 * HIDDEN
        both, pre, weight, context, tape = saved
        g = {"o": context.T @ slope[:, None], "c": np.array([slope.sum()], np.float32)}
        d_context = slope[:, None] * p["o"][:, 0]
        d_weight = np.einsum("nh,tnh->tn", d_context, both)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_both = weight[:, :, None] * d_context
        d_pre = d_e[:, :, None] * p["v"][:, 0] * (1 - pre * pre)
        g["v"] = np.einsum("tna,tn->a", pre, d_e)[:, None]
        g["A"] = np.einsum("tnh,tna->ha", both, d_pre)
        g["a"] = d_pre.sum(axis=(0, 1))
        d_both = d_both + d_pre @ p["A"].T
        d_products = np.zeros_like(products)
        for d, way in enumerate("fb"):
            u = p["U" + way]
            d_u = np.zeros_like(u)
            d_h = np.zeros((len(rows), HIDDEN), np.float32)
            for t, h, zr, m, un in reversed(tape[d]):
                d_h = d_h + d_both[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                on = (mask[:, t : t + 1] > 0).astype(np.float32)
                d_new = d_h * on
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                d_z = d_new * (h - m) * z * (1 - z)
                d_m = d_new * (1 - z) * (1 - m * m)
                d_r = d_m * un * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_m], axis=1)
                d_g = np.concatenate([d_z, d_r, d_m * r], axis=1)
                d_u += h.T @ d_g
                d_h = d_h * (1 - on) + d_new * z + d_g @ u.T
                np.add.at(d_products[:, d * h3 : (d + 1) * h3], rows[:, t], d_x)
            g["U" + way] = d_u
        d_input = np.zeros_like(x)
        for d, way in enumerate("fb"):
            own = d_products[:, d * h3 : (d + 1) * h3]
            g["W" + way], g["B" + way] = x.T @ own, own.sum(axis=0)
            d_input += own @ p["W" + way].T
        return g, d_input


class _Rows(dict):
    """word -> row of the table of input products; words met for the first time wait in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = row = len(self)
        return row


class Scorer:
    """Window logits of texts, keeping the input products of recent words."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.rows = _Rows()
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def rows_of(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_WORDS:
            self._reset()
        at = len(self.rows)
        out = np.array(list(map(self.rows.__getitem__, words)))
        if self.rows.new:
            while len(self.table) < len(self.rows):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : len(self.rows)] = self.model.products(self.model.inputs(self.rows.new)[0])
            self.rows.new = []
        return out

    def logits(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(logit of each window of each text's words, number of windows of each text)."""
        flat = self.rows_of(list(chain.from_iterable(split)))
        starts, sizes, count, begin = [], [], [], 0
        for words in split:
            at = window_starts(len(words))
            starts += [begin + s for s in at]
            sizes += [min(WINDOW, len(words))] * len(at)
            count.append(len(at))
            begin += len(words)
        starts, sizes = np.array(starts), np.array(sizes)
        logits = np.empty(len(starts), np.float32)
        order = np.argsort(-sizes, kind="stable")  # whole windows run without a mask
        for a in range(0, len(order), RUN_WINDOWS):
            part = order[a : a + RUN_WINDOWS]
            logits[part] = self.model.infer(flat, self.table, starts[part], sizes[part])
        return logits, np.array(count)

    def best_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(largest logit over all windows, number of windows) of each text."""
        logits, count = self.logits([words_of(t) for t in texts])
        return np.maximum.reduceat(logits, np.cumsum(count) - count), count


def _odds(counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of label 1 by (texts of label 0, texts of label 1), halved and bounded; 0 if in few texts."""
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    odds = np.log((counts[:, 1] + 0.5) / (n1 + 1)) - np.log((counts[:, 0] + 0.5) / (n0 + 1))
    return np.where(counts.sum(axis=1) >= MIN_DOCS, np.clip(odds / 2, -2, 2), 0).astype(np.float32)


def statistics(split: list[list[str]], labels: np.ndarray) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Known words (of MIN_DOCS texts, the most frequent MAX_WORDS), their log-odds, and those of character runs."""
    seen: dict[str, list[int]] = {}
    grams = np.zeros((BUCKETS, 2), np.int64)
    for words, y in zip(split, labels.tolist()):
        own = list(dict.fromkeys(words))
        grams[np.unique(gram_ids(own)[0]), y] += 1
        for w in own:
            seen.setdefault(w, [0, 0])[y] += 1
    known = sorted((w for w, c in seen.items() if sum(c) >= MIN_DOCS), key=lambda w: (-sum(seen[w]), w))[:MAX_WORDS]
    counts = np.array([seen[w] for w in known], np.int64).reshape(-1, 2)
    return {w: i + 1 for i, w in enumerate(known)}, _odds(counts, labels), _odds(grams, labels)


def train(texts: list[str], labels: np.ndarray, seed: int, updates: int, batch: int = 64, rate: float = 0.01) -> Model:
    """Fit on whole labelled texts: a text's logit is its largest window's, so the gradient runs through that window.

    Each epoch scores all windows and takes each text's best one; texts of both labels
    weigh the same.  Adam steps; the result depends on the sample and the seed alone.
    """
    split = [words_of(t) for t in texts]
    model = Model.fresh(*statistics(split, labels), seed)
    rng = np.random.default_rng(seed + 1)
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    step = 0
    epochs = min(MAX_EPOCHS, -(-updates // max(1, len(texts) // batch)))  # a small sample is soon learned by heart
    starts = [window_starts(len(w)) for w in split]
    for epoch in range(epochs):
        best = _best_windows(model, split)
        now = rate * (1 - epoch / epochs) + rate * 0.05
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            chosen = [split[i][s : s + WINDOW] for i in part for s in [starts[i][best[i]]]]
            unique = list(dict.fromkeys(w for c in chosen for w in c))
            row = {w: i for i, w in enumerate(unique)}
            longest = max(map(len, chosen))
            mask = np.array([[1.0] * len(c) + [0.0] * (longest - len(c)) for c in chosen], np.float32)
            rows = np.array([[row[w] for w in c] + [0] * (longest - len(c)) for c in chosen])
            x, (ids, grams, counts, scale) = model.inputs(unique)
            products = model.products(x)
            logit, saved = model.forward(rows, mask, products, keep=True)
            slope = ((_sigmoid(logit) - labels[part]) * weight[part] / len(part)).astype(np.float32)
            g, d_input = model.gradients(rows, mask, x, products, saved, slope)
            g["E"] = np.zeros_like(model.p["E"])
            np.add.at(g["E"], ids, d_input[:, :WORD_DIM])
            g["C"] = np.zeros_like(model.p["C"])
            np.add.at(g["C"], grams, np.repeat(d_input[:, WORD_DIM:] * scale, counts, axis=0))
            step += 1
            for k, value in model.p.items():
                grad = g[k].reshape(value.shape) + (1e-4 * value if value.ndim > 1 else 0)
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad * grad
                up = mean[k] / (1 - 0.9**step)
                down = np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6
                model.p[k] = (value - now * up / down).astype(np.float32)
    return model


def _best_windows(model: Model, split: list[list[str]]) -> list[int]:
    """The place of each text's window of the largest logit."""
    scorer, best, at = Scorer(model), [], 0
    while at < len(split):
        end, words = at + 1, len(split[at])
        while end < len(split) and words + len(split[end]) <= RUN_WINDOWS * STRIDE:
            words += len(split[end])
            end += 1
        logits, count = scorer.logits(split[at:end])
        best += [int(np.argmax(part)) for part in np.split(logits, np.cumsum(count)[:-1])]
        at = end
    return best
