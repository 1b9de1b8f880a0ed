"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters that have an embedding of their own; 0: padding, 1: other letters, 2: anything else.
_OWN = "".join(map(chr, range(32, 127))) + "\n\t"
_TABLE = np.full(128, 2, dtype=np.int64)
_TABLE[[ord(c) for c in _OWN]] = np.arange(3, 3 + len(_OWN))
SYMBOLS = 3 + len(_OWN)


def symbols(text: str) -> np.ndarray:
    """A number below ``SYMBOLS`` for every code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], np.where(codes >= 0xC0, 1, 2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """``tags`` scores for every character of equally long windows of symbols.

    Both directions run in one batched product per step.  Weights: embedding ``e``,
    input ``x``, recurrent ``h`` and bias ``b`` of the gates (input, forget, output,
    cell), output ``o`` with bias ``c``, CRF transitions ``t``.
    """

    def __init__(self, tags: int, embedding: int = 12, hidden: int = 20, seed: int = 7, dtype=np.float32):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(dtype)
        self.hidden, self.tags = hidden, tags
        self.w = {
            "e": draw(SYMBOLS, embedding, scale=0.5),
            "x": draw(2, embedding, 4 * hidden, scale=embedding**-0.5),
            "h": draw(2, hidden, 4 * hidden, scale=hidden**-0.5),
            "b": np.zeros((2, 1, 4 * hidden), dtype=dtype),
            "o": draw(2 * hidden, tags, scale=(2 * hidden) ** -0.5),
            "c": np.zeros(tags, dtype=dtype),
            "t": np.zeros((tags, tags), dtype=dtype),
        }
        self.w["b"][:, :, hidden : 2 * hidden] = 1

    def _states(self, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states ``(length, 2, windows, hidden)``, each direction in its own order, and what backward() needs."""
        w, h = self.w, self.hidden
        n, length = ids.shape
        emb = w["e"][ids.T]  # length, n, embedding
        gates_in = np.stack([emb @ w["x"][0], emb[::-1] @ w["x"][1]], axis=1) + w["b"]
        state = np.zeros((2, n, h), dtype=emb.dtype)
        cell = state
        out, kept = np.empty((length, 2, n, h), dtype=emb.dtype), []
        for s in range(length):
            z = gates_in[s] + state @ w["h"]
            g = _sigmoid(z[:, :, : 3 * h])
            u = np.tanh(z[:, :, 3 * h :])
            before, was = cell, state
            cell = g[:, :, h : 2 * h] * cell + g[:, :, :h] * u
            tc = np.tanh(cell)
            state = g[:, :, 2 * h :] * tc
            out[s] = state
            if keep:
                kept.append((g, u, before, tc, was))
        return out, kept

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Emission scores ``(windows, length, tags)``."""
        out, _ = self._states(ids, False)
        return self._emit(out)

    def _both(self, out: np.ndarray) -> np.ndarray:
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2)  # length, n, 2 hidden

    def _emit(self, out: np.ndarray) -> np.ndarray:
        return (self._both(out) @ self.w["o"] + self.w["c"]).transpose(1, 0, 2)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of every window (Viterbi)."""
        e, t = self.scores(ids), self.w["t"]
        n, length, _ = e.shape
        best, back = e[:, 0], np.empty((length, n, self.tags), dtype=np.int64)
        for s in range(1, length):
            ways = best[:, :, None] + t
            back[s] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[:, s]
        out = np.empty((n, length), dtype=np.int64)
        out[:, -1] = best.argmax(axis=1)
        for s in range(length - 1, 0, -1):
            out[:, s - 1] = back[s][np.arange(n), out[:, s]]
        return out

    def loss(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold tags and its gradient."""
        w, h, n_tags = self.w, self.hidden, self.tags
        n, length = ids.shape
        out, kept = self._states(ids, True)
        e, t = self._emit(out), w["t"]
        at = np.arange(n)
        fwd = np.empty_like(e)
        fwd[:, 0] = e[:, 0]
        for s in range(1, length):
            fwd[:, s] = _logsumexp(fwd[:, s - 1][:, :, None] + t, 1) + e[:, s]
        bwd = np.zeros_like(e)
        for s in range(length - 2, -1, -1):
            bwd[:, s] = _logsumexp(t + (e[:, s + 1] + bwd[:, s + 1])[:, None, :], 2)
        log_z = _logsumexp(fwd[:, -1], 1)
        path = e[at[:, None], np.arange(length), gold].sum(axis=1) + t[gold[:, :-1], gold[:, 1:]].sum(axis=1)
        de = np.exp(fwd + bwd - log_z[:, None, None])
        de[at[:, None], np.arange(length), gold] -= 1
        de /= n
        pairs = np.exp(fwd[:, :-1, :, None] + t + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - log_z[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        grad = {"t": (pairs / n).astype(t.dtype)}
        both, flat = self._both(out), de.transpose(1, 0, 2)
        grad["o"] = both.reshape(-1, 2 * h).T @ flat.reshape(-1, n_tags)
        grad["c"] = flat.sum(axis=(0, 1))
        d_both = flat @ w["o"].T
        d_out = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]], axis=1)
        d_gates = np.empty((length, 2, n, 4 * h), dtype=e.dtype)
        grad["h"] = np.zeros_like(w["h"])
        d_state = np.zeros((2, n, h), dtype=e.dtype)
        d_cell = d_state
        back = w["h"].transpose(0, 2, 1)
        for s in range(length - 1, -1, -1):
            g, u, before, tc, was = kept[s]
            d_state = d_state + d_out[s]
            i, f, o = g[:, :, :h], g[:, :, h : 2 * h], g[:, :, 2 * h :]
            d_cell = d_cell + d_state * o * (1 - tc * tc)
            z = d_gates[s]
            z[:, :, :h] = d_cell * u * i * (1 - i)
            z[:, :, h : 2 * h] = d_cell * before * f * (1 - f)
            z[:, :, 2 * h : 3 * h] = d_state * tc * o * (1 - o)
            z[:, :, 3 * h :] = d_cell * i * (1 - u * u)
            grad["h"] += was.transpose(0, 2, 1) @ z
            d_state = z @ back
            d_cell = d_cell * f
        grad["b"] = d_gates.sum(axis=(0, 2))[:, None, :]
        emb = w["e"][ids.T]
        width = emb.shape[2]
        first, second = d_gates[:, 0], d_gates[::-1, 1]
        grad["x"] = np.stack([emb.reshape(-1, width).T @ first.reshape(-1, 4 * h), emb.reshape(-1, width).T @ second.reshape(-1, 4 * h)])
        grad["e"] = np.zeros_like(w["e"])
        np.add.at(grad["e"], ids.T.ravel(), (first @ w["x"][0].T + second @ w["x"][1].T).reshape(-1, width))
        return float((log_z - path).mean()), grad

    def fit(self, ids: np.ndarray, gold: np.ndarray, steps: int = 200, batch: int = 96, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over drawn batches, with a rate that falls to a tenth; the losses."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, grad = self.loss(ids[pick], gold[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * scale
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.w[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(self.w[k].dtype)
        return losses
