"""Bidirectional gated recurrent network with attention pooling over word windows, in numpy.

A word enters as two inputs: an embedding of the word itself (hashed) and the
mean of embeddings of its character n-grams (hashed, with marks at both ends).
Two gated recurrent layers read the window in both directions; attention
weighs their states into one vector, and a logistic unit gives the score.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORD_ROWS, NGRAM_ROWS = 1 << 13, 1 << 14
WORD_DIM, NGRAM_DIM, HIDDEN, ATTENTION = 6, 12, 8, 8
NGRAMS = (3, 4, 5)
END = 1  # the mark at both ends of a word

#: Bytes that separate words: ASCII other than letters and digits.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(FOLD).split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Spelling:
    """Hashed inputs of a list of distinct words: word rows, and n-gram rows with the word each belongs to (ascending)."""

    def __init__(self, words: list[bytes]):
        self.size = len(words)
        self.rows = np.fromiter((xxhash.xxh32_intdigest(w) % WORD_ROWS for w in words), np.int64, len(words))
        codes = np.frombuffer(b"\x01" + b"\x01".join(words) + b"\x01", np.uint8)
        marks = np.cumsum(codes == END, dtype=np.int32)
        wide = codes.astype(np.uint32)
        owners, grams = [], []
        for n in NGRAMS:
            last = len(codes) - n + 1
            if last <= 0:
                continue
            inside = marks[n - 2 : n - 2 + last] == marks[:last]
            h = np.full(last, n, np.uint32)
            for i in range(n):
                h = (h ^ wide[i : i + last]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            at = np.flatnonzero(inside)
            owners.append(marks[at] - 1)
            grams.append((h[at] % np.uint32(NGRAM_ROWS)).astype(np.int32))
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        order = np.argsort(owner, kind="stable")
        self.grams = (np.concatenate(grams) if grams else np.zeros(0, np.int32))[order]
        self.count = np.maximum(np.bincount(owner, minlength=self.size), 1).astype(np.float32)
        self.starts = np.searchsorted(owner[order], np.arange(self.size + 1))

    def part(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-gram rows of some words, and which of them each belongs to."""
        sizes = self.starts[of + 1] - self.starts[of]
        owner = np.repeat(np.arange(len(of)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[of], sizes)
        return self.grams[at], owner


class Network:
    SHAPES = {
        "words": (WORD_ROWS, WORD_DIM),
        "ngrams": (NGRAM_ROWS, NGRAM_DIM),
        "wx": (2, WORD_DIM + NGRAM_DIM, 3 * HIDDEN),
        "bx": (2, 3 * HIDDEN),
        "wh": (2, HIDDEN, 3 * HIDDEN),
        "wa": (2 * HIDDEN, ATTENTION),
        "ba": (ATTENTION,),
        "va": (ATTENTION,),
        "wo": (2 * HIDDEN,),
        "bo": (1,),
    }

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = {}
        for name, shape in self.SHAPES.items():
            scale = 0.3 if name in ("words", "ngrams") else 0.0 if name.startswith("b") else 1.0 / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])
            self.p[name] = (rng.standard_normal(shape) * scale).astype(np.float32)

    # -- words to inputs

    def inputs(self, spelling: Spelling, of: np.ndarray) -> tuple[np.ndarray, tuple]:
        grams, owner = spelling.part(of)
        sums = np.stack([np.bincount(owner, weights=self.p["ngrams"][grams, d], minlength=len(of)) for d in range(NGRAM_DIM)], 1)
        means = (sums / spelling.count[of, None]).astype(np.float32)
        return np.concatenate([self.p["words"][spelling.rows[of]], means], 1), (grams, owner)

    def gates(self, words: list[bytes], step: int = 20_000) -> np.ndarray:
        """What each word adds to the gates of both directions; row 0 is for padding."""
        out = np.zeros((len(words) + 1, 2, 3 * HIDDEN), np.float32)
        for at in range(0, len(words), step):
            spelling = Spelling(words[at : at + step])
            grams = self.p["ngrams"][spelling.grams]
            there = np.flatnonzero(np.diff(spelling.starts))
            means = np.zeros((spelling.size, NGRAM_DIM), np.float32)
            if len(there):
                means[there] = np.add.reduceat(grams, spelling.starts[there], axis=0) / spelling.count[there, None]
            x = np.concatenate([self.p["words"][spelling.rows], means], 1)
            for d in (0, 1):
                out[at + 1 : at + 1 + spelling.size, d] = x @ self.p["wx"][d] + self.p["bx"][d]
        return out

    # -- windows to scores

    def run(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """g: (T, B, 2, 3H) gate inputs, mask: (T, B). Logits, and what the backward pass needs."""
        t_max, batch = mask.shape
        states = np.zeros((t_max, batch, 2 * HIDDEN), np.float32)
        tape = []
        for d in (0, 1):
            h = np.zeros((batch, HIDDEN), np.float32)
            steps = range(t_max) if d == 0 else range(t_max - 1, -1, -1)
            u = self.p["wh"][d]
            for t in steps:
                a, x = h @ u, g[t, :, d]
                zr = 1.0 / (1.0 + np.exp(-(a[:, : 2 * HIDDEN] + x[:, : 2 * HIDDEN])))
                z, r = zr[:, :HIDDEN] * mask[t, :, None], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                if keep:
                    tape.append((d, t, h, zr, z, c, a[:, 2 * HIDDEN :]))
                h = h + z * (c - h)
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        u = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = u @ self.p["va"]
        e = np.where(mask > 0, e, -np.inf)
        e = np.exp(e - np.maximum(e.max(0), -1e30))
        alpha = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", alpha, states)
        logits = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logits, (states, u, alpha, pooled, tape)) if keep else logits

    def gradients(self, spelling: Spelling, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradients. ids: (T, B) words of ``spelling``."""
        of, where = np.unique(ids, return_inverse=True)
        where = where.reshape(ids.shape)
        x, (grams, owner) = self.inputs(spelling, of)
        gate = np.stack([x @ self.p["wx"][d] + self.p["bx"][d] for d in (0, 1)], 1)
        logits, (states, u, alpha, pooled, tape) = self.run(gate[where], mask, keep=True)
        y = sigmoid(logits)
        loss = float(-np.mean(labels * np.log(y + 1e-7) + (1 - labels) * np.log(1 - y + 1e-7)))
        out = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("words", "ngrams")}
        dl = ((y - labels) / len(labels)).astype(np.float32)
        out["wo"], out["bo"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * self.p["wo"]
        ds = alpha[:, :, None] * dp
        da = np.einsum("tbh,bh->tb", states, dp)
        de = alpha * (da - (alpha * da).sum(0))
        out["va"] = np.einsum("tb,tba->a", de, u)
        du = de[:, :, None] * self.p["va"] * (1 - u**2)
        out["wa"], out["ba"] = np.einsum("tbh,tba->ha", states, du), du.sum((0, 1))
        ds = ds + du @ self.p["wa"].T
        dg = np.zeros((*ids.shape, 2, 3 * HIDDEN), np.float32)
        dh = [np.zeros((ids.shape[1], HIDDEN), np.float32) for _ in (0, 1)]
        for d, t, h, zr, z, c, ac in reversed(tape):
            g = dh[d] + ds[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            dc = g * z * (1 - c**2)
            zz, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            dz = g * (c - h) * mask[t, :, None] * zz * (1 - zz)
            dr = dc * ac * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], 1)
            dout = np.concatenate([dz, dr, dc * r], 1)
            out["wh"][d] += h.T @ dout
            dg[t, :, d] = dx
            dh[d] = g * (1 - z) + dout @ self.p["wh"][d].T
        flat, seen = where.ravel(), dg.reshape(-1, 2, 3 * HIDDEN)
        order = np.argsort(flat, kind="stable")
        sums = np.add.reduceat(seen[order], np.searchsorted(flat[order], np.arange(len(of))), axis=0)
        dx = np.zeros_like(x)
        for d in (0, 1):
            out["wx"][d], out["bx"][d] = x.T @ sums[:, d], sums[:, d].sum(0)
            dx += sums[:, d] @ self.p["wx"][d].T
        rows = spelling.rows[of]
        out["words"] = np.stack([np.bincount(rows, weights=dx[:, j], minlength=WORD_ROWS) for j in range(WORD_DIM)], 1)
        each = dx[:, WORD_DIM:] / spelling.count[of, None]
        out["ngrams"] = np.stack([np.bincount(grams, weights=each[owner, j], minlength=NGRAM_ROWS) for j in range(NGRAM_DIM)], 1)
        return loss, out


class Adam:
    def __init__(self, network: Network, rate: float = 0.01):
        self.p, self.rate, self.t = network.p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)
