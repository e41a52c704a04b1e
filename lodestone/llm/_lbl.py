"""A log-bilinear word model over a three-level tree of words, in numpy.

The vector of a context is the sum over its positions of C[j] * R[word at j] (a diagonal
matrix for each position). Each node of the tree scores context . V[node] + b[node];
a word's probability is the product of the normalised probabilities of its leaf, of its
group of leaves and of itself among their siblings, so probabilities over the whole
vocabulary sum to one. b is the log of the node's discounted share of its siblings and
stays as it is. Vectors are trained by noise-contrastive estimation: of each node's
siblings, NOISE are drawn by their share, and told from the word that was there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: words of a leaf, leaves of a group, positions of the context, dimensions, noise samples
LEAF, GROUP, PLACES, DIM, NOISE = 64, 32, 3, 16, 4
BATCH, RATE = 1 << 14, 0.15


@dataclass
class Tree:
    """The fixed part: shares of the words, by rank, padded to whole groups."""

    share: np.ndarray  # of each word
    bias: list[np.ndarray]  # log share among the siblings of groups, leaves, words
    below: list[np.ndarray]  # running shares before each group, leaf, word

    @classmethod
    def of(cls, weights: np.ndarray) -> Tree:
        wide = LEAF * GROUP
        n = max(wide, -(-len(weights) // wide) * wide)
        w = np.zeros(n)
        w[: len(weights)] = weights
        w /= max(w.sum(), 1e-300)
        levels = [w.reshape(-1, wide).sum(1), w.reshape(-1, LEAF).sum(1), w]
        up = [np.ones(1), levels[0], levels[1]]
        bias = []
        for own, parent in zip(levels, up, strict=True):
            of = np.repeat(parent, len(own) // len(parent))
            bias.append(np.where(own > 0, np.log(np.maximum(own, 1e-300)) - np.log(np.maximum(of, 1e-300)), -np.inf).astype(np.float32))
        return cls(w, bias, [np.concatenate([[0.0], np.cumsum(x)]) for x in levels])

    @property
    def words(self) -> int:
        return len(self.share)


@dataclass
class Model:
    """R has a row for each word and one more for the start of a text; V one table for each level."""

    C: np.ndarray
    R: np.ndarray
    V: list[np.ndarray]

    @classmethod
    def new(cls, tree: Tree, dim: int = DIM, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        R = rng.normal(0, 0.3, (tree.words + 1, dim)).astype(np.float32)
        return cls(np.full((PLACES, dim), 0.7, np.float32), R, [np.zeros((len(b), dim), np.float32) for b in tree.bias])

    def arrays(self) -> list[np.ndarray]:
        return [self.C, self.R, *self.V]


def contexts(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """Words at the PLACES places before each token of texts that lie end to end; `start` before the first."""
    begin = np.repeat(first[:-1], np.diff(first))
    out = np.full((PLACES, len(ids)), start, np.int32)
    for j in range(1, PLACES + 1):
        inside = np.flatnonzero(np.arange(len(ids)) - j >= begin)
        out[j - 1, inside] = ids[inside - j]
    return out


def vectors(model: Model, ctx: np.ndarray) -> np.ndarray:
    h = model.C[0] * model.R[ctx[0]]
    for j in range(1, PLACES):
        h += model.C[j] * model.R[ctx[j]]
    return h


def _segments(sorted_ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))


class Trainer:
    """Passes over texts with AdaGrad steps; keeps which rows it moved and how often."""

    def __init__(self, tree: Tree, model: Model, seed: int = 7):
        self.tree, self.model = tree, Model(model.C.copy(), model.R.copy(), [v.copy() for v in model.V])
        self.rng = np.random.default_rng(seed)
        self.seen = [np.zeros(len(x), np.float32) for x in self.model.arrays()]
        self.grown = [np.full(len(x), 1e-2, np.float32) for x in self.model.arrays()]

    def _move(self, k: int, rows: np.ndarray, grad: np.ndarray, times: np.ndarray) -> None:
        """One step for distinct rows of array k; the step is scaled by the row's squared gradients so far."""
        g = grad / np.maximum(1.0, np.sqrt(times))[:, None]
        self.grown[k][rows] += (g * g).mean(1)
        self.model.arrays()[k][rows] += RATE * g / np.sqrt(self.grown[k][rows])[:, None]
        self.seen[k][rows] += times

    def _noise(self, level: int, parents: np.ndarray, width: int) -> np.ndarray:
        """NOISE children of each parent, drawn by share."""
        below = self.tree.below[level]
        lo, hi = below[parents * width], below[(parents + 1) * width]
        u = lo[:, None] + self.rng.random((len(parents), NOISE)) * (hi - lo)[:, None]
        at = np.searchsorted(below, u, "right") - 1
        return np.clip(at, (parents * width)[:, None], (parents * width + width - 1)[:, None])

    def step(self, ids: np.ndarray, ctx: np.ndarray) -> None:
        """One batch: word ranks in the order of the texts, and their contexts."""
        order = np.argsort(ids, kind="stable")
        y, m = ids[order], self.model
        parts = [m.R[c[order]] for c in ctx]
        h = m.C[0] * parts[0]
        for j in range(1, PLACES):
            h += m.C[j] * parts[j]
        dh = np.zeros_like(h)
        # a score is V . h + b, and the noise NOISE times exp(b): the log odds of data are V . h - log NOISE
        odds = np.float32(np.log(NOISE))
        for level, width in enumerate((len(self.tree.bias[0]), GROUP, LEAF)):
            node = y // (LEAF * GROUP) if level == 0 else y // LEAF if level == 1 else y
            parent = node // width
            V = m.V[level]
            there = V[node]
            g = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, there) - odds))
            there *= g[:, None]
            dh += there
            heads = _segments(node)
            rows, times = [node[heads]], [np.diff(np.append(heads, len(node))).astype(np.float32)]
            grads = [np.add.reduceat(g[:, None] * h, heads)]
            # what noise puts there instead: one draw for all tokens of a parent
            cut = _segments(parent)
            many = np.diff(np.append(cut, len(parent)))
            noise = self._noise(level, parent[cut], width)
            Vn = V[noise]
            rows.append(noise.ravel())
            times.append(np.repeat(many.astype(np.float32), NOISE))
            if len(cut) * 64 <= len(y):  # long runs: a product for each parent
                gn = np.empty(Vn.shape, np.float32)
                for p, (i, n) in enumerate(zip(cut.tolist(), many.tolist(), strict=True)):
                    x = h[i : i + n]
                    g = -1 / (1 + np.exp(odds - x @ Vn[p].T))
                    dh[i : i + n] += g @ Vn[p]
                    gn[p] = g.T @ x
            else:
                of = np.repeat(np.arange(len(cut)), many)
                g = np.empty((len(y), NOISE), np.float32)
                for k in range(NOISE):
                    vk = Vn[of, k]
                    g[:, k] = -1 / (1 + np.exp(odds - np.einsum("ij,ij->i", h, vk)))
                    vk *= g[:, k : k + 1]
                    dh += vk
                gn = np.stack([np.add.reduceat(g[:, k : k + 1] * h, cut) for k in range(NOISE)], 1)
            grads.append(gn.reshape(-1, h.shape[1]))
            self._sum(2 + level, np.concatenate(rows), np.concatenate(grads), np.concatenate(times))
        self._move(0, np.arange(PLACES), np.stack([(dh * p).sum(0) for p in parts]), np.full(PLACES, len(y), np.float32))
        # a word's own vector gets what the tokens after it say; words of the batch before get nothing
        said = np.empty_like(dh)
        said[order] = dh
        back, times, begun = np.zeros_like(dh), np.zeros(len(y), np.float32), np.zeros(dh.shape[1], np.float32)
        start, starts = self.tree.words, 0
        for j in range(PLACES):
            at = ctx[j] == start
            begun += (said[at] * m.C[j]).sum(0)
            starts += int(at.sum())
            ok = ~at[j + 1 :]
            back[: len(ok)][ok] += said[j + 1 :][ok] * m.C[j]  # a batch may be shorter than the context
            times[: len(ok)] += ok
        heads = _segments(y)
        self._move(1, y[heads], np.add.reduceat(back[order], heads), np.maximum(1, np.add.reduceat(times[order], heads)))
        if starts:
            self._move(1, np.array([start]), begun[None], np.array([starts], np.float32))

    def _sum(self, k: int, rows: np.ndarray, grads: np.ndarray, times: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        r = rows[order]
        heads = _segments(r)
        self._move(k, r[heads], np.add.reduceat(grads[order], heads), np.add.reduceat(times[order], heads))

    def texts(self, ids: np.ndarray, first: np.ndarray) -> None:
        """A pass over texts that lie end to end."""
        ctx = contexts(ids, first, self.tree.words)
        for i in range(0, len(ids), BATCH):
            self.step(ids[i : i + BATCH], ctx[:, i : i + BATCH])


def log_probabilities(tree: Tree, model: Model, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each word rank, given the vectors of its context."""
    order = np.argsort(ids, kind="stable")
    y, h = ids[order], h[order]
    out = np.zeros(len(y), np.float64)
    for level, width in enumerate((len(tree.bias[0]), GROUP, LEAF)):
        node = y // (LEAF * GROUP) if level == 0 else y // LEAF if level == 1 else y
        parent = node // width
        cut = np.append(_segments(parent), len(parent)) if len(parent) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            p = int(parent[a]) * width
            for i in range(a, b, 1 << 16):
                j = min(b, i + (1 << 16))
                s = h[i:j] @ model.V[level][p : p + width].T
                s += tree.bias[level][p : p + width]
                own = s[np.arange(j - i), node[i:j] - p]
                top = 0.0 if float(s.max(initial=0)) < 60 else s.max(1, keepdims=True)
                s -= top
                np.exp(s, out=s)
                out[i:j] += own - np.reshape(top, -1) - np.log(s.sum(1))
    back = np.empty(len(out))
    back[order] = out
    return back
