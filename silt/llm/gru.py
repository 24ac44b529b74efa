"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, states carried over windows.

Ids 0 .. size - 1 are words by falling frequency, in classes of ``WIDTH``; id ``size`` stands for all other words and is a class of its own, the last.
The probability of a word is that of its class times that of the word in its class.

Arrays have a column for each token or lane, so that every operation runs along memory.  States carry a last row of ones, which takes the biases.  Gates are
1 / (1 + exp(u)) and the candidate state is 2 / (1 + exp(w)) - 1, a hyperbolic tangent whose sign and scale the weights hold.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np

HIDDEN, WIDTH = 16, 64
WINDOW, LANES, WIDEST, SCORE_LANES = 32, 32, 512, 512
BUFFER = 8192  # segments that training holds
RATE = 0.5


@dataclass
class Gru:
    size: int
    x: np.ndarray  # (3 H, size + 1): what each word adds to the gates and to the candidate
    wh: np.ndarray  # (3 H, H)
    wc: np.ndarray  # (C, H + 1)
    wo: np.ndarray  # (C - 1, WIDTH, H + 1)
    squares: list[np.ndarray]  # of the gradients of each of these

    @staticmethod
    def fresh(counts: np.ndarray, other: int, seed: int = 42) -> Gru:
        """A model that gives the words' shares, whatever came before; ``other``: how many tokens are other words."""
        size, rng = len(counts), np.random.default_rng(seed)
        classes = -(-size // WIDTH)
        c = np.zeros(classes * WIDTH)
        c[:size] = counts + 1.0
        c = c.reshape(classes, WIDTH)
        wc, wo = np.zeros((classes + 1, HIDDEN + 1)), np.zeros((classes, WIDTH, HIDDEN + 1))
        with np.errstate(divide="ignore"):
            wc[:, -1] = np.log(np.r_[c.sum(1), other + 1.0] / (c.sum() + other + 1.0))
            wo[:, :, -1] = np.where(c > 0, np.log(np.maximum(c, 1e-9) / c.sum(1, keepdims=True)), -1e9)
        scale = np.repeat([0.3, 0.3, 0.6], HIDDEN)[:, None]
        parts = [p.astype(np.float32) for p in (rng.standard_normal((3 * HIDDEN, size + 1)) * scale, rng.standard_normal((3 * HIDDEN, HIDDEN)) * 0.2, wc, wo)]
        return Gru(size, *parts, [np.full_like(p, 1e-2) for p in parts])

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.wh, self.wc, self.wo]

    def vector(self) -> np.ndarray:
        """Weights and, after these, the sums of squared gradients that training steps by."""
        return np.concatenate([p.ravel() for p in [*self.parts(), *self.squares]])

    def with_vector(self, v: np.ndarray) -> Gru:
        out, at = [], 0
        for p in [*self.parts(), *self.squares]:
            out.append(v[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Gru(self.size, *out[:4], out[4:])

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, a: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
        """Writes to ``out`` the states after words that add ``x`` to states ``h``; ``a``: ``wh`` @ h, then the gates and what the second one scales, ``n``: the candidate."""
        H = HIDDEN
        g = a[: 2 * H]
        g += x[: 2 * H]
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        np.multiply(g[H:], a[2 * H :], out=n)
        n += x[2 * H :]
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
        np.subtract(h, n, out=out)
        out *= g[:H]
        out += n

    def log_probs(self, hs: np.ndarray, ids: np.ndarray, grads: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of the probabilities of ``ids``, in rising order, after states ``hs``; with ``grads``, fills the last two and gives the states' gradient."""
        classes, at = len(self.wo), np.arange(len(ids))
        limits = np.searchsorted(ids, np.r_[np.arange(classes) * WIDTH, self.size, self.size + 1])

        def soft(logits: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            logits -= logits.max(0)
            own = logits[pick, at[: len(pick)]]
            np.exp(logits, out=logits)
            total = logits.sum(0) if logits.shape[1] > 1 else logits.cumsum(0)[-1]  # in the same order for one column
            if grads is not None:
                logits /= total
                logits[pick, at[: len(pick)]] -= 1
            return own - np.log(total), logits

        out, p = soft(self.wc @ hs, np.repeat(np.arange(classes + 1), np.diff(limits)))
        dh = None
        if grads is not None:
            np.matmul(p, hs.T, out=grads[2])
            dh = self.wc.T @ p
        for c in range(classes):
            own = slice(limits[c], limits[c + 1])
            if own.start < own.stop:
                lp, p = soft(self.wo[c] @ hs[:, own], ids[own] % WIDTH)
                out[own] += lp
                if grads is not None:
                    np.matmul(p, hs[:, own].T, out=grads[3][c])
                    dh[:, own] += self.wo[c].T @ p
            elif grads is not None:
                grads[3][c] = 0
        return out, dh

    def train(self, segments: Iterable[np.ndarray], lanes: int = LANES) -> tuple[Gru, int]:
        """A model after one pass over the segments, and the number of tokens; states carry over a segment's windows, gradients don't.

        Segments come in parts of ``BUFFER``, so memory doesn't follow their number; batches start at ``lanes`` and widen to ``WIDEST``.
        """
        m = self.with_vector(self.vector())
        rng = np.random.default_rng(7)
        tokens, segments = 0, iter(segments)
        with np.errstate(over="ignore"):
            while part := sorted(islice(segments, BUFFER), key=len):
                groups = []
                while part:
                    part, group = part[:-lanes], part[-lanes:]
                    groups.append(group)
                    lanes = min(lanes + LANES // 2, WIDEST)
                rng.shuffle(groups)
                for group in groups:
                    ids = np.full((len(group[-1]), len(group)), self.size + 1, np.uint16)
                    for b, s in enumerate(group):
                        ids[: len(s), b] = s
                    h = np.zeros((HIDDEN, len(group)), np.float32)
                    for at in range(0, len(ids), WINDOW):
                        h, n = m._window(ids[at : at + WINDOW], h)
                        tokens += n
        return m, tokens

    def _window(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, int]:
        """One step of training over a window of ids (places by lanes; ``size + 1``: none); gives the states after it."""
        H, (T, B), params = HIDDEN, ids.shape, self.parts()
        flat = ids.ravel()
        order = np.argsort(flat, kind="stable")
        picked = flat[order]
        n = int(np.searchsorted(picked, self.size + 1))
        picked, live = picked[:n].astype(np.int64), order[:n]
        in_rows = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], T * B)
        xs = self.x.take(ids, axis=1, mode="clip")
        s = np.ones((T + 1, H + 1, B), np.float32)
        s[0, :H] = h
        a, c = np.empty((T, 3 * H, B), np.float32), np.empty((T, H, B), np.float32)
        for t in range(T):
            np.matmul(self.wh, s[t, :H], out=a[t])
            self.step(xs[:, t], s[t, :H], a[t], c[t], s[t + 1, :H])
        states = in_rows(s[:T])
        grads = [np.empty_like(p) for p in params]
        _, got = self.log_probs(states.take(live, axis=1), picked, grads)
        ds = np.zeros((H, T * B), np.float32)
        ds[:, live] = got[:H]
        ds = ds.reshape(H, T, B)
        # What a state's gradient becomes, for all places at once.
        z, r, an = a[:, :H], a[:, H : 2 * H], a[:, 2 * H :]
        left = 1 - z
        for_z = c - s[:T, :H]
        for_z *= z
        for_z *= left
        for_n = c * c
        for_n -= 1
        for_n *= left
        for_n *= 0.5
        for_r = r - 1
        for_r *= r
        for_r *= an
        d, dn = np.empty((T, 3 * H, B), np.float32), np.empty((T, H, B), np.float32)
        dh, back = np.zeros((H, B), np.float32), np.ascontiguousarray(self.wh.T)
        for t in range(T - 1, -1, -1):
            np.multiply(dh, for_z[t], out=d[t, :H])
            np.multiply(dh, for_n[t], out=dn[t])
            np.multiply(dn[t], for_r[t], out=d[t, H : 2 * H])
            np.multiply(dn[t], r[t], out=d[t, 2 * H :])
            dh *= z[t]
            dh += ds[:, t]
            dh += back @ d[t]
        d = in_rows(d)
        np.matmul(d, states[:H].T, out=grads[1])
        d[2 * H :] = in_rows(dn)
        firsts = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
        grads[0].fill(0)
        grads[0][:, picked[firsts]] = np.add.reduceat(d.take(live, axis=1), firsts, axis=1)
        scale = np.float32(max(n, 1) ** -0.5)
        for p, g, q in zip(params, grads, self.squares):
            g *= scale
            q += g * g
            g /= np.sqrt(q)
            g *= RATE
            p -= g
        return s[T, :H].copy(), n

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 of each document's probability: lanes of documents, one after the other, with the state carried across windows and cleared between documents.

        Products are in single precision, whose last bit depends on a lane's place: of what else is scored, a score shows less than a thousandth.
        """
        H = HIDDEN
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lanes: list[list[int]] = [[] for _ in range(min(SCORE_LANES, max(len(docs), 1)))]
        loads = np.zeros(len(lanes), np.int64)
        for i in order:
            if len(docs[i]):
                lane = int(loads.argmin())
                lanes[lane].append(i)
                loads[lane] += len(docs[i])
        lanes = [lanes[b] for b in np.argsort(-loads, kind="stable")]
        loads = np.sort(loads)[::-1]
        total = int(loads.sum())
        if not total:
            return out
        seq = [i for lane in lanes for i in lane]
        ids = np.concatenate([docs[i] for i in seq]).astype(np.uint16)
        sizes = [len(docs[i]) for i in seq]
        owner = np.repeat(seq, sizes)
        opens = np.zeros(total, bool)
        opens[np.r_[0, np.cumsum(sizes)[:-1]]] = True
        starts = np.r_[0, np.cumsum(loads)[:-1]]
        h, a, n = (np.zeros((rows, len(lanes)), np.float32) for rows in (H, 3 * H, H))
        with np.errstate(over="ignore"):
            for at in range(0, int(loads[0]), WINDOW):
                stop = min(at + WINDOW, int(loads[0]))
                lives = np.searchsorted(-loads, -np.arange(at, stop), side="left")
                where = np.concatenate([starts[:k] + t for t, k in zip(range(at, stop), lives)])
                now, fresh = ids[where], opens[where]
                xs = self.x.take(now, axis=1)
                s = np.ones((H + 1, len(where)), np.float32)
                p = 0
                for k in lives:
                    h = h[:, :k] * ~fresh[p : p + k]
                    s[:H, p : p + k] = h
                    np.matmul(self.wh, h, out=a[:, :k])
                    self.step(xs[:, p : p + k], h, a[:, :k], n[:, :k], h)
                    p += k
                by = np.argsort(now, kind="stable")
                lp, _ = self.log_probs(s.take(by, axis=1), now[by].astype(np.int64))
                out += np.bincount(owner[where[by]], lp.astype(np.float64), len(docs))
        return out / np.log(10)
