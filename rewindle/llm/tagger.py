"""A character tagger in numpy: bidirectional LSTM, linear layer, CRF transitions.

Labels: 0 outside, 1 + 2k the first and 2 + 2k a later character of a span of kind k. Text goes through in
windows of ``width`` characters; shorter ones are padded with character class 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_CLASSES = 100  # 0 padding, 1 to 95 printable ASCII, 96 line feed, 97 other white space, 98 other letters, 99 the rest


def encoded(texts: list[str], width: int) -> np.ndarray:
    """Character classes, one row for each text."""
    out = np.zeros((len(texts), width), np.int64)
    for row, text in zip(out, texts, strict=True):
        codes = np.frombuffer(text[:width].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ascii_, letter = (codes >= 32) & (codes < 127), codes >= 0xAA
        row[: len(codes)] = np.select([ascii_, codes == 10, codes < 32, letter], [codes - 31, 96, 97, 98], 99)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    p: dict[str, np.ndarray]
    kinds: int

    @staticmethod
    def fresh(kinds: int, hidden: int = 12, embedded: int = 10, seed: int = 7) -> Tagger:
        rng, k = np.random.default_rng(seed), 1 + 2 * kinds
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        p = {"E": rng.normal(0, 0.5, (_CLASSES, embedded)), "V": draw(2 * hidden, k), "c": np.zeros(k), "A": np.zeros((k, k)), "s": np.zeros(k)}
        for d in "fb":
            p |= {f"W{d}": draw(embedded, 4 * hidden), f"U{d}": draw(hidden, 4 * hidden), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        return Tagger(p, kinds)

    def barred(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores that forbid a later character without its span's earlier ones."""
        k = 1 + 2 * self.kinds
        step, start = np.zeros((k, k)), np.zeros(k)
        for j in range(2, k, 2):
            step[[i for i in range(k) if i not in (j - 1, j)], j] = start[j] = -1e4
        return step, start

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        w, u, b = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"b{d}"]
        n = u.shape[0]
        pre = x @ w + b
        h = c = np.zeros((x.shape[1], n), pre.dtype)
        out, kept = np.empty((*x.shape[:2], n), pre.dtype), []
        for t in range(len(x)):
            z = pre[t] + h @ u
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, c = (h, c), f * c + i * g
            tc = np.tanh(c)
            h = out[t] = o * tc
            kept.append((i, f, o, g, tc, before))
        return out, kept

    def emissions(self, chars: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["E"][chars.T]
        hf, kf = self._run(x, "f")
        hb, kb = self._run(x[::-1], "b")
        h = np.concatenate([hf, hb[::-1]], axis=2)
        return h @ self.p["V"] + self.p["c"], (x, h, kf, kb)

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best label of each character."""
        e, _ = self.emissions(chars)
        step, start = self.barred()
        step, start = (self.p["A"] + step).astype(e.dtype), (self.p["s"] + start).astype(e.dtype)
        score, back = e[0] + start, np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            all_ = score[:, :, None] + step
            back[t] = all_.argmax(axis=1)
            score = all_.max(axis=1) + e[t]
        out = np.empty(chars.shape, np.int8)
        out[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(chars))
        for t in range(len(e) - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        return out

    def single(self) -> Tagger:
        """The same tagger in single precision, for decoding."""
        return Tagger({k: v.astype(np.float32) for k, v in self.p.items()}, self.kinds)

    def gradients(self, chars: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the labels, and its gradients."""
        p, n = self.p, len(chars)
        e, (x, h, kf, kb) = self.emissions(chars)
        y, rows = labels.T, np.arange(n)
        bar, bar0 = self.barred()
        step, start = np.exp(p["A"] + bar), np.exp(p["s"] + bar0)
        top = e.max(axis=2, keepdims=True)
        w = np.exp(e - top)
        a, norm = np.empty_like(w), np.empty(w.shape[:2])
        for t in range(len(w)):
            row = w[t] * (a[t - 1] @ step if t else start)
            norm[t] = row.sum(axis=1)
            a[t] = row / norm[t][:, None]
        b = np.ones_like(w)
        for t in range(len(w) - 2, -1, -1):
            b[t] = (w[t + 1] * b[t + 1] / norm[t + 1][:, None]) @ step.T
        de = a * b
        gold = e[np.arange(len(e))[:, None], rows, y].sum() + p["A"][y[:-1], y[1:]].sum() + p["s"][y[0]].sum()
        loss = np.log(norm).sum() + top.sum() - gold
        both = np.einsum("tni,tnj->ij", a[:-1], w[1:] * b[1:] / norm[1:][:, :, None]) * step
        g = {"A": both, "s": de[0].sum(axis=0)}
        np.add.at(g["A"], (y[:-1], y[1:]), -1.0)
        np.add.at(g["s"], y[0], -1.0)
        de[np.arange(len(e))[:, None], rows, y] -= 1.0
        g |= {"V": np.einsum("tni,tnj->ij", h, de), "c": de.sum(axis=(0, 1))}
        dh = de @ p["V"].T
        size = h.shape[2] // 2
        dx = np.zeros_like(x)
        for d, part, kept, xs in (("f", dh[:, :, :size], kf, x), ("b", dh[::-1, :, size:], kb, x[::-1])):
            dz = np.empty((*part.shape[:2], 4 * size))
            down = carry = np.zeros((n, size))
            u = p[f"U{d}"]
            du = np.zeros_like(u)
            for t in range(len(part) - 1, -1, -1):
                i, f, o, c, tc, (hp, cp) = kept[t]
                down = down + part[t]
                carry = carry + down * o * (1 - tc * tc)
                dz[t] = np.concatenate([carry * c * i * (1 - i), carry * cp * f * (1 - f), down * tc * o * (1 - o), carry * i * (1 - c * c)], axis=1)
                du += hp.T @ dz[t]
                down, carry = dz[t] @ u.T, carry * f
            g |= {f"U{d}": du, f"W{d}": np.einsum("tni,tnj->ij", xs, dz), f"b{d}": dz.sum(axis=(0, 1))}
            back = dz @ p[f"W{d}"].T
            dx += back if d == "f" else back[::-1]
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], chars.T, dx)
        return loss / n, {k: v / n for k, v in g.items()}


def trained(chars: np.ndarray, labels: np.ndarray, kinds: int, epochs: int, batch: int = 16, rate: float = 0.03, seed: int = 7) -> Tagger:
    """A tagger fitted to labelled windows by Adam."""
    model, rng = Tagger.fresh(kinds, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step, total = 0, epochs * -(-len(chars) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(chars))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _, g = model.gradients(chars[own], labels[own])
            step += 1
            size = np.sqrt(sum((x * x).sum() for x in g.values()))
            lr = rate * (1 - step / (total + 1)) * min(1.0, 5.0 / (size + 1e-9))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                model.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model
