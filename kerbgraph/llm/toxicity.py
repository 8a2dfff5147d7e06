"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Tables, U, Words, blocks, mix

#: Words of a window. Scores take a window at every word; training learns from one every TRAIN_STRIDE words and the one that ends the text.
WINDOW, TRAIN_STRIDE = 32, 24
#: Sizes: hashed word and character-trigram tables, their vectors, the hidden state of one direction.
WORDS_TABLE, CHARS_TABLE, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 14, 1 << 12, 8, 8, 8
#: Labelled rows of a class that training reads, at most, each of them whole; rounds over their windows.
SAMPLE_ROWS, EPOCHS = 900, 6
#: Small samples are gone over again until so many steps are done, up to four times the rounds.
LEAST_STEPS = 240
#: Words of fewer texts are learnt by their characters alone.
LEAST_TEXTS = 3
#: By how many standard deviations a word's or trigram's frequency in toxic texts must differ from chance to count when training begins, and by how
#: many more it counts in full.
CHANCE, EVIDENCE = 3.0, 4.0
THRESHOLD = 0.3
F32 = np.float32


@dataclass
class Net:
    word: np.ndarray = field(default_factory=lambda: np.zeros(0))
    char: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, seed: int = 0) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(F32)
        d = WORD_DIM + CHAR_DIM
        dense = {"v": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "b": np.zeros(1, F32)}
        for k in ("f", "r"):
            dense |= {f"x{k}": draw(d, 3 * HIDDEN), f"h{k}": draw(HIDDEN, 3 * HIDDEN), f"c{k}": np.zeros(3 * HIDDEN, F32)}
        return cls(draw(WORDS_TABLE, WORD_DIM, s=0.1), draw(CHARS_TABLE, CHAR_DIM, s=0.1), dense)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) + F32(0.5) * np.tanh(F32(0.5) * x)


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): between -1 and 1 as tanh is, without an exponential. Its derivative is (1 - |result|) ** 2."""
    return x / (F32(1) + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return F32(0.5) + F32(0.5) * _soft(x)


def _slope(s: np.ndarray) -> np.ndarray:
    return np.square(F32(1) - np.abs(s))


class Lexicon:
    """The different words of a block of texts: hash buckets of each word and of its character trigrams."""

    def __init__(self, words: Words):
        _, at, self.of = np.unique(words.hash, return_index=True, return_inverse=True)
        start, length = words.start[at], words.end[at] - words.start[at]
        self.bucket = (words.hash[at] % U(WORDS_TABLE)).astype(np.int64)
        n = length + 2
        owner = np.repeat(np.arange(len(at)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inner = (place > 0) & (place <= length[owner])
        code = np.where(inner, words.bytes[np.where(inner, start[owner] + place - 1, 0)] if len(words.bytes) else 0, 0).astype(np.uint64)
        three = code[:-2] | code[1:-1] << U(8) | code[2:] << U(16) if len(code) > 2 else code[:0]
        keep = owner[:-2] == owner[2:] if len(code) > 2 else np.zeros(0, bool)
        self.grams = (mix(three[keep] + U(1)) % U(CHARS_TABLE)).astype(np.int64)
        self.first = np.cumsum(length) - length
        self.length = length

    def grams_of(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the trigrams of the words `used`: which of those words, and the trigram's place."""
        length = self.length[used]
        owner = np.repeat(np.arange(len(used)), length)
        return owner, np.arange(len(owner)) + (self.first[used] - (np.cumsum(length) - length))[owner]

    def vectors(self, net: Net) -> np.ndarray:
        if not len(self.bucket):
            return np.zeros((0, WORD_DIM + CHAR_DIM), F32)
        return np.concatenate([net.word[self.bucket], _means(net.char[self.grams], self.length)], axis=1)


def windows(words: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the windows of training (-1: none), WINDOW wide, and the row of each."""
    count = words.count
    n = np.where(count > WINDOW, -(-(count - WINDOW) // TRAIN_STRIDE) + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(words.n), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * TRAIN_STRIDE, np.maximum(count[row] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    ok = at < count[row][:, None]
    return np.where(ok, of[np.where(ok, words.first[row][:, None] + at, 0)] if len(of) else -1, -1), row


def forward(net: Net, inputs: np.ndarray, ids: np.ndarray):
    """Logits of windows and what backward needs. inputs: gate inputs (words + 1, 6 * HIDDEN), the last row for no word."""
    h, d, steps = HIDDEN, net.dense, ids.shape[1]
    states = np.zeros((2, steps, len(ids), h), F32)
    gates = np.zeros((2, steps, len(ids), 4 * h), F32)
    real = ids >= 0
    for k, name in enumerate("fr"):
        state, hh = np.zeros((len(ids), h), F32), d[f"h{name}"]
        for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
            x = inputs[ids[:, t], 3 * h * k : 3 * h * (k + 1)]
            rec = state @ hh
            zr = _gate(x[:, : 2 * h] + rec[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = _soft(x[:, 2 * h :] + r * rec[:, 2 * h :])
            gates[k, t] = np.concatenate([z, r, new, rec[:, 2 * h :]], axis=1)
            state = np.where(real[:, t, None], new + z * (state - new), state)
            states[k, t] = state
    weight = np.where(real.T, states[0] @ d["v"][:h] + states[1] @ d["v"][h:], F32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.concatenate([np.einsum("tb,tbh->bh", weight, states[0]), np.einsum("tb,tbh->bh", weight, states[1])], axis=1)
    logit = pooled @ d["o"] + d["b"]
    return logit, pooled, weight, states, gates, real


def logits(net: Net, inputs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What forward returns, for scoring: gates lie apart so that rows are short and whole."""
    h, d, steps = HIDDEN, net.dense, ids.shape[1]
    at = np.ascontiguousarray(np.where(ids < 0, len(inputs) - 1, ids).T)
    real = np.ascontiguousarray((ids >= 0).T)
    full = real.all(1)
    states = np.zeros((2, steps, len(ids), h), F32)
    for k, name in enumerate("fr"):
        parts = [slice(h * g, h * (g + 1)) for g in range(3)]
        xz, xr, xn = (np.ascontiguousarray(inputs[:, 3 * h * k :][:, p]) for p in parts)
        hz, hr, hn = (np.ascontiguousarray(d[f"h{name}"][:, p]) for p in parts)
        state = np.zeros((len(ids), h), F32)
        for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
            z, r, rec = state @ hz, state @ hr, state @ hn
            z += np.take(xz, at[t], axis=0)
            r += np.take(xr, at[t], axis=0)
            z /= F32(1) + np.abs(z)
            r /= F32(1) + np.abs(r)
            r *= F32(0.5)
            r += F32(0.5)
            rec *= r
            rec += np.take(xn, at[t], axis=0)
            move = np.divide(rec, F32(1) + np.abs(rec), out=rec)
            move -= state
            z -= F32(1)
            z *= F32(-0.5)
            move *= z
            if not full[t]:
                move *= real[t][:, None]
            state = np.add(state, move, out=states[k, t])
    weight = states[0] @ d["v"][:h] + states[1] @ d["v"][h:]
    weight[~real] = -1e9
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    # the output is linear in the states, so it is pooled after the output weights
    return (weight * (states[0] @ d["o"][:h] + states[1] @ d["o"][h:])).sum(0) + d["b"]


def backward(net: Net, inputs: np.ndarray, ids: np.ndarray, target: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weighted log loss: of the dense parameters, and of the gate inputs per word."""
    h, d, steps = HIDDEN, net.dense, ids.shape[1]
    logit, pooled, att, states, gates, real = forward(net, inputs, ids)
    dl = ((_sigmoid(logit) - target) * weights / len(ids)).astype(F32)
    grad = {"o": pooled.T @ dl, "b": dl.sum(keepdims=True), "v": np.zeros(2 * h, F32)}
    dpool = dl[:, None] * d["o"]
    datt = np.einsum("bh,tbh->tb", dpool[:, :h], states[0]) + np.einsum("bh,tbh->tb", dpool[:, h:], states[1])
    dscore = att * (datt - (att * datt).sum(0))
    dinputs = np.zeros_like(inputs)
    for k, name in enumerate("fr"):
        hh, ghh, gc = d[f"h{name}"], np.zeros((h, 3 * h), F32), np.zeros(3 * h, F32)
        grad["v"][k * h : (k + 1) * h] = np.einsum("tb,tbh->h", dscore, states[k])
        dstate = np.zeros((len(ids), h), F32)
        for t in range(steps - 1, -1, -1) if k == 0 else range(steps):
            before = t - 1 if k == 0 else t + 1
            prior = states[k, before] if 0 <= before < steps else np.zeros((len(ids), h), F32)
            dstate = dstate + att[t][:, None] * dpool[:, k * h : (k + 1) * h] + dscore[t][:, None] * d["v"][k * h : (k + 1) * h]
            on = real[:, t, None]
            z, r, new, rec = np.split(gates[k, t], 4, axis=1)
            ds = np.where(on, dstate, 0)
            dn = ds * (1 - z) * _slope(new)
            dz = ds * (prior - new) * F32(0.5) * _slope(2 * z - 1)
            dr = dn * rec * F32(0.5) * _slope(2 * r - 1)
            dx = np.concatenate([dz, dr, dn], axis=1)
            drec = np.concatenate([dz, dr, dn * r], axis=1)
            ghh += prior.T @ drec
            gc += dx.sum(0)
            np.add.at(dinputs[:, 3 * h * k : 3 * h * (k + 1)], ids[:, t], dx)
            dstate = np.where(on, ds * z + drec @ hh.T, dstate)
        grad[f"h{name}"], grad[f"c{name}"] = ghh, gc
    dinputs[-1] = 0
    return grad, dinputs


def gate_inputs(net: Net, vectors: np.ndarray) -> np.ndarray:
    d = net.dense
    out = np.concatenate([vectors @ d["xf"] + d["cf"], vectors @ d["xr"] + d["cr"]], axis=1)
    return np.concatenate([out, np.zeros((1, out.shape[1]), F32)])


def _texts_of(lexicon: Lexicon, words: Words) -> np.ndarray:
    """In how many texts each different word stands."""
    row = np.repeat(np.arange(words.n), words.count)
    pairs = np.unique(lexicon.of.astype(np.int64) * max(words.n, 1) + row) // max(words.n, 1)
    return np.bincount(pairs, minlength=len(lexicon.length))


def _evidence(keys: np.ndarray, row: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """For each key, by how many standard deviations more (or fewer) texts of label 1 hold it than chance would have it, beyond CHANCE and
    two texts more assumed; between -1 and 1."""
    n = max(len(labels), 1)
    pairs = np.unique(keys.astype(np.int64) * n + row)
    key, y = pairs // n, labels[pairs % n]
    held, hits, rate = np.bincount(key, minlength=size), np.bincount(key, y, size), labels.mean()
    z = (hits - rate * held) / np.sqrt((held + 2) * rate * (1 - rate))
    return (np.sign(z) * np.clip((np.abs(z) - CHANCE) / EVIDENCE, 0, 1)).astype(F32)


def informed(net: Net, words: Words, lexicon: Lexicon, labels: np.ndarray) -> None:
    """Where training begins: the first number of a word's and a trigram's vector is what the labelled texts say of it."""
    row = np.repeat(np.arange(words.n), words.count)
    net.word[:, 0] = _evidence(lexicon.bucket[lexicon.of], row, labels, WORDS_TABLE)
    owner = np.repeat(np.arange(len(lexicon.length)), lexicon.length)
    pairs = np.unique(lexicon.of.astype(np.int64) * words.n + row)
    of, text = pairs // max(words.n, 1), pairs % max(words.n, 1)
    at_owner, at = lexicon.grams_of(of)
    net.char[:, 0] = _evidence(lexicon.grams[at], text[at_owner], labels, CHARS_TABLE)


def best_of_rows(logits: np.ndarray, row: np.ndarray, n: int, empty: float = -np.inf) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, row, logits)
    return np.where(np.isinf(out), empty, out)


def train(texts: list[str], labels: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 0) -> Net:
    """A net from whole texts and their 0/1 labels; share: how frequent label 1 is among all rows, for the scale of the scores.

    A row of label 1 teaches by the windows that score highest in it, unless none of them stands out from the rows of label 0
    (labels hold errors; at most 0.4 of these rows are passed over, from the fourth round on); a row of label 0 teaches by its highest windows and some others. The highest logit of a text is turned into a probability by a logistic fit under the true share.
    """
    rng, net = np.random.default_rng(seed), Net.fresh(seed)
    words = Words(pa.array(texts, pa.string()), ALNUM)
    lexicon = Lexicon(words)
    ids, row = windows(words, lexicon.of)
    if not len(ids) or len(set(labels.tolist())) < 2:
        net.scale = (0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        return net
    informed(net, words, lexicon, labels)
    common = _texts_of(lexicon, words) >= LEAST_TEXTS
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.dense.items()}
    tables = {"word": np.full(WORDS_TABLE, 1e-3, F32), "char": np.full(CHARS_TABLE, 1e-3, F32)}
    target, step = labels[row].astype(F32), 0
    for epoch in range(4 * epochs):
        if epoch >= epochs and step >= LEAST_STEPS:
            break
        if epoch == 0:
            chosen = np.arange(len(ids))
        else:
            logit = score_windows(net, lexicon, ids)
            top = best_of_rows(logit, row, words.n)
            real = np.isfinite(top)
            usual = min(np.quantile(top[(labels == 0) & real], 0.9), np.quantile(top[(labels == 1) & real], 0.4)) if epoch > 2 and (real & (labels == 0)).any() and (real & (labels == 1)).any() else -np.inf
            order = np.lexsort((-logit, row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            take = np.zeros(len(ids), bool)
            take[order[rank < 2]] = True
            take &= (target == 0) | (logit >= np.maximum(top[row] - 2, usual))
            take |= (target == 0) & (rng.random(len(ids)) < 0.05)
            chosen = np.flatnonzero(take)
        rng.shuffle(chosen)
        batch = min(max(len(chosen) // 40, 16), 256)
        for lo in range(0, len(chosen), batch):
            part = chosen[lo : lo + batch]
            used, local = np.unique(ids[part], return_inverse=True)
            local = local.reshape(ids[part].shape)
            if used[0] < 0:
                used, local = used[1:], local - 1
            if not len(used):
                continue
            owner, at = lexicon.grams_of(used)
            vectors = np.concatenate([net.word[lexicon.bucket[used]], _means(net.char[lexicon.grams[at]], lexicon.length[used])], axis=1)
            inputs = gate_inputs(net, vectors)
            grad, dinputs = backward(net, inputs, local, target[part], np.where(target[part] == 1, 2.0, 1.0).astype(F32))
            dinputs, h = dinputs[:-1], 3 * HIDDEN
            grad["xf"], grad["xr"] = vectors.T @ dinputs[:, :h], vectors.T @ dinputs[:, h:]
            dvec = dinputs[:, :h] @ net.dense["xf"].T + dinputs[:, h:] @ net.dense["xr"].T
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.dense[k] -= (F32(0.01) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(F32)
            often = common[used]
            _adagrad(net.word, tables["word"], lexicon.bucket[used[often]], dvec[often, :WORD_DIM])
            _adagrad(net.char, tables["char"], lexicon.grams[at], (dvec[:, WORD_DIM:] / lexicon.length[used][:, None])[owner])
    top = best_of_texts(net, words, lexicon)
    seen = np.isfinite(top)
    net.scale = _logistic(top[seen], labels[seen], share)
    return net


def _means(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, np.cumsum(length) - length, axis=0) / length[:, None].astype(F32)


def _adagrad(table: np.ndarray, sums: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float = 0.1) -> None:
    spot, inverse = np.unique(at, return_inverse=True)
    total = np.zeros((len(spot), grad.shape[1]), F32)
    np.add.at(total, inverse, grad)
    sums[spot] += (total * total).mean(1)
    table[spot] -= (rate * total / np.sqrt(sums[spot])[:, None]).astype(F32)


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """a, b of sigmoid(a x + b), rows weighted so that label 1 has the given share; by Newton steps with a weak prior."""
    share = min(max(share, 1e-4), 1 - 1e-4)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    centre, spread = x.mean(), x.std() + 1e-6
    u, theta = (x - centre) / spread, np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * u + theta[1], -30, 30)))
        g = np.array([np.sum(weight * (p - y) * u), np.sum(weight * (p - y))]) + 0.01 * theta
        s = weight * p * (1 - p)
        hess = np.array([[np.sum(s * u * u), np.sum(s * u)], [np.sum(s * u), np.sum(s)]]) + 0.01 * np.eye(2)
        theta = np.clip(theta - np.linalg.solve(hess, g), -20, 20)
    return float(theta[0] / spread), float(theta[1] - theta[0] * centre / spread)


def score_windows(net: Net, lexicon: Lexicon, ids: np.ndarray, batch: int = 2048) -> np.ndarray:
    inputs = gate_inputs(net, lexicon.vectors(net))
    return np.concatenate([logits(net, inputs, ids[lo : lo + batch]) for lo in range(0, len(ids), batch)]) if len(ids) else np.zeros(0)


def every_start(net: Net, inputs: np.ndarray, of: np.ndarray, batch: int = 4096) -> np.ndarray:
    """Logits of the full windows that start at word 0, 1, ... of a row of words (numbers of inputs).

    Windows lie in columns, and step t of all of them reads the words from t on, so inputs are sliced, not gathered.
    """
    h, d = HIDDEN, net.dense
    n = max(len(of) - WINDOW + 1, 0)
    out = np.zeros(n, F32)
    # the candidate's recurrent part is halved beforehand: the reset gate is half of 1 + a number between -1 and 1. Below the gates, in the same
    # product, stand the attention score and the output of the state that a step begins with.
    scale = np.repeat(np.array([1, 1, 0.5], F32), h)
    sides = [(np.ascontiguousarray(inputs[:, 3 * h * k : 3 * h * (k + 1)]), np.concatenate([(d[f"h{name}"] * scale).T, d["v"][None, h * k : h * (k + 1)], d["o"][None, h * k : h * (k + 1)]]).astype(F32)) for k, name in enumerate("fr")]
    for lo in range(0, n, batch):
        m = min(batch, n - lo)
        # of every step and window: attention score, output
        said = np.zeros((WINDOW, 2, m), F32)
        rec, gate, size, move = np.zeros((3 * h + 2, m), F32), np.empty((2 * h, m), F32), np.empty((2 * h, m), F32), np.empty((h, m), F32)
        for k, (table, hidden) in enumerate(sides):
            x = np.ascontiguousarray(table[of[lo : lo + m + WINDOW - 1]].T)
            state, before = np.zeros((h, m), F32), None
            rec[:] = 0
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                if before is not None:
                    np.matmul(hidden, state, out=rec)
                    said[before] += rec[3 * h :]
                before = t
                np.add(rec[: 2 * h], x[: 2 * h, t : t + m], out=gate)
                np.abs(gate, out=size)
                size += F32(1)
                gate /= size
                gate[h:] += F32(1)
                np.multiply(gate[h:], rec[2 * h : 3 * h], out=move)
                move += x[2 * h :, t : t + m]
                np.abs(move, out=size[:h])
                size[:h] += F32(1)
                move /= size[:h]
                move -= state
                gate[:h] -= F32(1)
                gate[:h] *= F32(-0.5)
                move *= gate[:h]
                state += move
            said[before] += hidden[3 * h :] @ state
        weight = said[:, 0] - said[:, 0].max(0)
        np.exp(weight, out=weight)
        out[lo : lo + m] = (weight * said[:, 1]).sum(0) / weight.sum(0) + d["b"]
    return out


def best_of_texts(net: Net, words: Words, lexicon: Lexicon) -> np.ndarray:
    """The highest logit of every text's windows, one at every word from which a full window goes; a shorter text is one window.
    -inf without words."""
    inputs = gate_inputs(net, lexicon.vectors(net))
    top = np.full(words.n, -np.inf)
    long = words.count >= WINDOW
    if long.any():
        logit = every_start(net, inputs, lexicon.of)
        # the last windows of a text would run on into the next one
        row = np.repeat(np.arange(words.n), words.count)[: len(logit)]
        inside = np.arange(len(logit)) + WINDOW <= words.first[row + 1]
        np.maximum.at(top, row[inside], logit[inside])
    short = np.flatnonzero((words.count > 0) & ~long)
    if len(short):
        at = words.first[short][:, None] + np.arange(WINDOW)
        ids = np.where(np.arange(WINDOW) < words.count[short][:, None], lexicon.of[np.minimum(at, len(lexicon.of) - 1)], -1)
        top[short] = np.concatenate([logits(net, inputs, ids[lo : lo + 2048]) for lo in range(0, len(ids), 2048)])
    return top


def score_texts(net: Net, texts: pa.Array) -> np.ndarray:
    words = Words(texts, ALNUM)
    top = best_of_texts(net, words, Lexicon(words))
    a, b = net.scale
    return np.where(np.isinf(top), 0.0, 1 / (1 + np.exp(-np.clip(a * np.where(np.isinf(top), 0, top) + b, -700, 700))))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Net:
    """A net from labelled rows: labels (doc_id, toxic) joined with documents (doc_id, text).

    Of each class about sample_rows rows at most are read, those with the least hash of the id, and of a row all words; one task trains, and the driver gets the net. Null labels and texts teach nothing. An id with several labels counts as
    toxic if one of them is 1; of several texts the least is taken.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([], np.zeros(0, np.int64), 0.1)
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / n)))])
    wanted = known.where(place < shares[F.col("toxic")])
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    share = sizes.get(1, 0) / sum(sizes.values())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches([b for b in batches if len(b)]).sort_by("doc_id")
        net = train(sample["text"].to_pylist(), sample["toxic"].to_numpy().astype(np.int64), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    with Tables(documents.sparkSession) as tables:
        sample = tables.write(rows, "sample")
        if sample.isEmpty():
            return train([], np.zeros(0, np.int64), share)
        return pickle.loads(sample.repartition(1).mapInArrow(learn, "net binary").first()["net"])


def score(documents: DataFrame, net: Net, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in `keep` (one named score gives way) with `score` for every row: the probability that its worst window makes the text toxic. Null texts
    and texts without words have score 0. Whole texts are scored, all windows; repeated rows get equal scores."""
    keep = [k for k in keep if k != "score"]
    shared = documents.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join([*(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            column = batch.column("__text")
            for lo, hi in blocks(column):
                scores = score_texts(net, column.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    return documents.select(*[f"`{k}`" for k in keep], F.col(text).alias("__text")).mapInArrow(run, schema)


def held_out() -> F.Column:
    """Rows that nothing is learnt from: crc32 of the id's text mod 4 is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def judge(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents."""
    net = fit(documents, labels.where(~held_out()), sample_rows)
    out = score(documents.select("doc_id", "text", held_out().alias("held_out")), net, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
