"""A character-level bidirectional LSTM with a CRF over its tags, forward and backward, in numpy."""

from __future__ import annotations

import numpy as np

#: Signs with a number of their own, as each letter a-z has, whatever its case; digits, other letters and the rest share one each.
SIGNS = " .@-_+()[]:;,/=\"'#$%&*<>|!?\n\\{}~^`"
N_CHARS = len(SIGNS) + 30


_CLASS = np.full(128, 3, np.int64)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 1, np.arange(26) + 4, np.arange(26) + 4
_CLASS[[ord(c) for c in SIGNS]] = np.arange(len(SIGNS)) + 30


def encode(text: str) -> np.ndarray:
    """Character classes 1 .. N_CHARS - 1 (0 is padding)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(codes), 3, np.int64)
    plain = codes < 128
    out[plain] = _CLASS[codes[plain]]
    for i in np.flatnonzero(~plain):
        if text[i].isalpha():
            out[i] = 2
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tags each character of padded windows (batch x length of character classes)."""

    def __init__(self, tags: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = hidden
        self.tags, self.hidden = tags, h
        self.p = {"U": rng.normal(0, 0.3, (tags,)), "W": rng.normal(0, 0.2, (2 * h, tags)), "T": rng.normal(0, 0.1, (tags, tags)), "S": np.zeros(tags)}
        for d in "fb":
            self.p[f"X{d}"] = rng.normal(0, 0.3, (N_CHARS, 4 * h))
            self.p[f"H{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"X{d}"][:, h : 2 * h] += 0.5  # forget gates start open

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        h, n, length = self.hidden, *x.shape
        gates = self.p[f"X{d}"][x]
        state, cell, out, kept = np.zeros((n, h)), np.zeros((n, h)), np.empty((length, n, h)), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = gates[:, t] + state @ self.p[f"H{d}"]
            ifo = sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            before, past = cell, state
            cell = ifo[:, h : 2 * h] * before + ifo[:, :h] * g
            squashed = np.tanh(cell)
            state = ifo[:, 2 * h :] * squashed
            out[t] = state
            kept.append((t, ifo, g, before, past, squashed))
        return out, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        forward, kf = self._run(x, "f")
        backward, kb = self._run(x, "b")
        both = np.concatenate([forward, backward], axis=2)
        e = both @ self.p["W"] + self.p["U"]
        return (e, both, kf, kb) if keep else e

    def best(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag paths of sequences with the emissions e (length x sequences x tags).

        Sequences end at their lengths: behind them no tag costs anything and only the last one goes on.
        """
        length, n, k = e.shape
        beyond, stay = self._beyond(e, lengths)
        score, back = e[0] + self.p["S"], np.empty((length, n, k), np.int8)
        for t in range(1, length):
            via = score[:, :, None] + np.where(beyond[t][:, None, None], stay, self.p["T"])
            back[t] = via.argmax(axis=1)
            score = via.max(axis=1) + np.where(beyond[t][:, None], 0.0, e[t])
        path = np.empty((n, length), np.int8)
        path[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        return path

    def _beyond(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(e))[:, None] >= lengths[None, :], np.where(np.eye(e.shape[2], dtype=bool), 0.0, -1e9)

    def paths(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag paths, as best() gives them, and each character's probability of its tag."""
        path, length = self.best(e, lengths), len(e)
        beyond, stay = self._beyond(e, lengths)
        e = np.where(beyond[:, :, None], 0.0, e)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.p["S"]
        for t in range(1, length):
            alpha[t] = logsumexp(alpha[t - 1][:, :, None] + np.where(beyond[t][:, None, None], stay, self.p["T"]), 1) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = logsumexp(np.where(beyond[t + 1][:, None, None], stay, self.p["T"]) + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        gamma = np.exp(alpha + beta - logsumexp(alpha[-1], 1)[None, :, None])
        return path, np.take_along_axis(gamma.transpose(1, 0, 2), path[:, :, None].astype(np.int64), axis=2)[:, :, 0]

    def _marginals(self, e: np.ndarray):
        length, n, k = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.p["S"]
        for t in range(1, length):
            alpha[t] = logsumexp(alpha[t - 1][:, :, None] + self.p["T"], 1) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = logsumexp(self.p["T"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        whole = logsumexp(alpha[-1], 1)
        return np.exp(alpha + beta - whole[None, :, None]), alpha, beta, whole

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y and its gradients."""
        e, both, kf, kb = self.emissions(x, keep=True)
        length, n, k = e.shape
        gamma, alpha, beta, whole = self._marginals(e)
        gold = y.T
        rows = np.arange(n)
        got = e[np.arange(length)[:, None], rows, gold].sum(axis=0) + self.p["S"][gold[0]] + self.p["T"][gold[:-1], gold[1:]].sum(axis=0)
        truth = np.eye(k)[gold]
        de = (gamma - truth) / n
        dt = np.zeros((k, k))
        for t in range(1, length):
            joint = np.exp(alpha[t - 1][:, :, None] + self.p["T"] + (e[t] + beta[t] - whole[:, None])[:, None, :])
            dt += joint.sum(axis=0) / n
        np.add.at(dt, (gold[:-1].ravel(), gold[1:].ravel()), -1 / n)
        grad = {"T": dt, "S": de[0].sum(axis=0), "U": de.sum(axis=(0, 1)), "W": np.tensordot(both, de, ((0, 1), (0, 1)))}
        dboth = de @ self.p["W"].T
        h, read = self.hidden, np.eye(N_CHARS)[x.T.ravel()]
        for d, kept, dout in (("f", kf, dboth[:, :, :h]), ("b", kb, dboth[:, :, h:])):
            ds, dc, dzs, pasts = np.zeros((n, h)), np.zeros((n, h)), np.empty((length, n, 4 * h)), np.empty((length, n, h))
            for t, ifo, g, before, past, squashed in reversed(kept):
                ds = ds + dout[t]
                i, f, o = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h :]
                dc = dc + ds * o * (1 - squashed**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dzs[t], pasts[t] = dz, past
                ds, dc = dz @ self.p[f"H{d}"].T, dc * f
            flat = dzs.reshape(-1, 4 * h)
            grad[f"X{d}"], grad[f"H{d}"] = read.T @ flat, pasts.reshape(-1, h).T @ flat
        return float((whole - got).mean()), grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 48, rate: float = 0.012, seed: int = 3) -> float:
        """Adam over shuffled batches with a falling rate; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        first, second, step, mean = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, 0.0
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            seen = []
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                loss, grad = self.gradients(x[own], y[own])
                seen.append(loss)
                step += 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (1 - 0.9 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            mean = float(np.mean(seen))
        return mean

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float32) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as held:
            p = {k: held[k].astype(float) for k in held.files}
        tagger = cls(len(p["S"]), len(p["Hf"]))
        if {k: v.shape for k, v in p.items()} != {k: v.shape for k, v in tagger.p.items()}:
            raise ValueError(f"{path} holds weights of another network")
        tagger.p = p
        return tagger
