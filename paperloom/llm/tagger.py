"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

CLASSES = 98  # 0 is padding, 1 to 95 are printable ASCII, 96 other characters, 97 controls and line ends
_ASCII = np.full(128, 97, np.uint8)
_ASCII[32:127] = np.arange(1, 96)


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], np.uint8(96))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Scores of tags for every character of equally long windows; ``fit`` trains, ``emissions`` and ``decode`` apply."""

    def __init__(self, tags: int, hidden: int = 20, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = draw.normal(0, 0.3, (CLASSES, 4 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = draw.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"c{d}"][hidden : 2 * hidden] = 1  # forget gates start open
        self.p["o"] = draw.normal(0, 0.2, (2 * hidden, tags)).astype(np.float32)
        self.p["co"] = np.zeros(tags, np.float32)
        self.p["t"] = np.zeros((tags, tags), np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """One direction: hidden states (time, window, unit), and what the way back needs."""
        n, steps, m = x.shape[0], x.shape[1], self.hidden
        h, c = np.zeros((n, m), np.float32), np.zeros((n, m), np.float32)
        out, kept = np.zeros((steps, n, m), np.float32), []
        for t in range(steps):
            z = self.p[f"x{d}"][x[:, t]] + h @ self.p[f"h{d}"] + self.p[f"c{d}"]
            gates = _sigmoid(z[:, : 3 * m])
            i, f, o = gates[:, :m], gates[:, m : 2 * m], gates[:, 2 * m :]
            g = np.tanh(z[:, 3 * m :])
            before, c = c, f * c + i * g
            th = np.tanh(c)
            if keep:
                kept.append((h, before, i, f, o, g, th))
            h = o * th
            out[t] = h
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, into: dict[str, np.ndarray]) -> None:
        m = self.hidden
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(x.shape[1] - 1, -1, -1):
            h, before, i, f, o, g, th = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(into[f"x{d}"], x[:, t], dz)
            into[f"h{d}"] += h.T @ dz
            into[f"c{d}"] += dz.sum(0)
            dh = dz @ self.p[f"h{d}"].T
            dc = dc * f

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (window, time, tag)."""
        forward, _ = self._run(x, "f", False)
        backward, _ = self._run(x[:, ::-1], "b", False)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        return (both @ self.p["o"] + self.p["co"]).transpose(1, 0, 2)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags of the windows, and its gradient."""
        n, steps = x.shape
        into = {k: np.zeros_like(v) for k, v in self.p.items()}
        forward, kept_f = self._run(x, "f", True)
        backward, kept_b = self._run(x[:, ::-1], "b", True)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        e = both @ self.p["o"] + self.p["co"]  # (time, window, tag)
        trans = self.p["t"]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        pairs = alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]
        into["t"] += np.exp(pairs).sum((0, 1))
        yt = y.T
        rows = np.arange(n)
        gold = e[np.arange(steps)[:, None], rows, yt].sum(0) + trans[yt[:-1], yt[1:]].sum(0)
        np.add.at(into["t"], (yt[:-1].ravel(), yt[1:].ravel()), -1)
        de[np.arange(steps)[:, None], rows, yt] -= 1
        de /= n
        into["t"] /= n
        into["o"] += both.reshape(-1, both.shape[2]).T @ de.reshape(-1, self.tags)
        into["co"] += de.sum((0, 1))
        dboth = de @ self.p["o"].T
        self._back(x, "f", kept_f, dboth[:, :, : self.hidden], into)
        self._back(x[:, ::-1], "b", kept_b, dboth[::-1, :, self.hidden :], into)
        return float((z - gold).mean()), into

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 32, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Trains with Adam on windows and their tags; the mean loss of every epoch."""
        draw = np.random.default_rng(seed)
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses, step = [], 0
        for _ in range(epochs):
            total = 0.0
            for part in np.array_split(draw.permutation(len(x)), max(1, len(x) // batch)):
                loss, grad = self.gradient(x[part], y[part])
                total += loss * len(part)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / max(1, len(x)))
        return losses

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tags (window, time) for scores of equally long stretches."""
        n, steps, k = scores.shape
        best, back = scores[:, 0], np.zeros((steps, n, k), np.uint8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.p["t"]
            back[t] = ways.argmax(1)
            best = ways.max(1) + scores[:, t]
        tags = np.zeros((n, steps), np.uint8)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        return tags
