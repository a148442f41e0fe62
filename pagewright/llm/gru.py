"""A gated recurrent language model in numpy with a class-factored softmax.

Token ids 0 .. C*W-1 fall into C classes of W words each: P(token) = P(class) *
P(token | class).  Documents are laid end to end in parallel lanes; windows of
STEPS tokens are trained by truncated backpropagation, and the state is carried
from window to window (and cleared where a document starts), so a document's
log-likelihood is that of its whole text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

LANES, STEPS = 256, 16
#: Tokens of a text that training keeps in one lane.
SEGMENT = 512


def pack(docs: list[np.ndarray], lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """inputs, targets, doc numbers (all [time, lane]; -1 beyond a lane's end) and lane lengths, longest first.

    Each document (token ids that close with 0) goes to the lane that is shortest so far, long ones first.
    The input of a token is the token before it, 0 at a document's start."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    heap = [(0, i) for i in range(max(1, min(lanes, len(docs))))]
    own: list[list[int]] = [[] for _ in heap]
    for d in order:
        length, i = heapq.heappop(heap)
        own[i].append(int(d))
        heapq.heappush(heap, (length + len(docs[d]), i))
    lengths = np.array([sum(len(docs[d]) for d in x) for x in own])
    rank = np.argsort(-lengths, kind="stable")
    targets = np.full((len(own), int(lengths.max())), -1, np.int32)
    numbers = np.full(targets.shape, -1, np.int32)
    for row, i in enumerate(rank):
        if own[i]:
            targets[row, : lengths[i]] = np.concatenate([docs[d] for d in own[i]])
            numbers[row, : lengths[i]] = np.repeat(own[i], [len(docs[d]) for d in own[i]])
    inputs = np.zeros_like(targets)
    inputs[:, 1:] = np.maximum(targets[:, :-1], 0)  # a document's last token is 0, which is also what the next one starts from
    return tuple(np.ascontiguousarray(x.T) for x in (inputs, targets, numbers)) + (lengths[rank],)


class Model:
    """Parameters are float32 arrays in ``p``; they flatten to one vector."""

    def __init__(self, classes: int, words: int, hidden: int, embed: int, counts: np.ndarray | None = None, seed: int = 5):
        self.c, self.w, self.h, self.d = classes, words, hidden, embed
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {
            "emb": draw(classes * words, embed, scale=0.3), "wx": draw(embed, 3 * hidden, scale=embed**-0.5), "u": draw(hidden, 3 * hidden, scale=hidden**-0.5), "b": np.zeros(3 * hidden, np.float32),
            "wc": draw(hidden, classes, scale=0.05), "bc": np.zeros(classes, np.float32), "ww": draw(classes, hidden, words, scale=0.05), "bw": np.zeros((classes, words), np.float32),
        }
        self.p["b"][:hidden] = -1.0
        if counts is not None:  # before training, the model is the unigram distribution
            share = (counts.reshape(classes, words) + 0.5).astype(np.float64)
            self.p["bc"][:] = np.log(share.sum(1) / share.sum())
            self.p["bw"][:] = np.log(share / share.sum(1, keepdims=True))

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, vector: np.ndarray) -> Model:
        at = 0
        for k, x in self.p.items():
            self.p[k] = vector[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def recur(self, table: np.ndarray, inputs: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states [time, lane, h] of a window and what backpropagation needs; ``h`` is the state before it."""
        n, u = self.h, self.p["u"]
        gates, out, trace = table.take(inputs, axis=0), np.empty((len(inputs), inputs.shape[1], n), np.float32), []
        going = (inputs != 0).astype(np.float32)[:, :, None]
        starts = (inputs == 0).any(1)
        for t in range(len(inputs)):
            if starts[t]:
                h = h * going[t]
            hu = h @ u
            g = gates[t]
            zr = g[:, : 2 * n] + hu[:, : 2 * n]  # the tables hold minus the gates' inputs
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            z, m = zr[:, :n], hu[:, 2 * n :]
            c = zr[:, n:] * m
            c += g[:, 2 * n :]
            np.tanh(c, c)
            new = out[t]
            np.subtract(h, c, new)
            new *= z
            new += c
            if keep:
                trace.append((h, z, zr[:, n:], m, c))
            h = new
        return out, trace

    def table(self) -> np.ndarray:
        """Gate inputs by input token."""
        return self.p["emb"] @ self.p["wx"] + self.p["b"]

    @staticmethod
    def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp of logits (in place), their sums and what was subtracted; it is only where exp overflows that rows are shifted."""
        y = np.exp(x)
        total = y.sum(1)
        shift = np.zeros(len(x), np.float32)
        bad = ~(np.isfinite(total) & (total > 1e-30))
        if bad.any():
            shift[bad] = x[bad].max(1)
            y[bad] = np.exp(x[bad] - shift[bad][:, None])
            total[bad] = y[bad].sum(1)
        return y, total, shift

    def outputs(self, states: np.ndarray, targets: np.ndarray, grad: bool):
        """Natural log-probabilities of ``targets`` (flat, valid) given ``states``; with ``grad``, also the gradients of their mean's negative."""
        p, cls = self.p, (targets // self.w).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        states_o, cls_o = states.take(order, axis=0), cls.take(order)
        word_o = targets.take(order) - cls_o * np.int32(self.w)
        rows = np.arange(len(order))
        x = states_o @ p["wc"]
        x += p["bc"]
        at = x[rows, cls_o]
        x, total, shift = self._exps(x)
        logp = at - shift - np.log(total)
        scale = np.float32(1 / max(len(order), 1))
        if grad:
            x *= (scale / total)[:, None]
            x[rows, cls_o] -= scale
            d = {"wc": states_o.T @ x, "bc": x.sum(0), "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
            back = x @ p["wc"].T
        ends = np.searchsorted(cls_o, np.arange(self.c + 1))
        for c in range(self.c):
            a, b = ends[c], ends[c + 1]
            if a == b:
                continue
            s = states_o[a:b]
            y = s @ p["ww"][c]
            y += p["bw"][c]
            k = rows[: b - a]
            own = y[k, word_o[a:b]]
            y, t, shift = self._exps(y)
            logp[a:b] += own - shift - np.log(t)
            if grad:
                y *= (scale / t)[:, None]
                y[k, word_o[a:b]] -= scale
                d["ww"][c], d["bw"][c] = s.T @ y, y.sum(0)
                back[a:b] += y @ p["ww"][c].T
        out = np.empty_like(logp)
        out[order] = logp
        if not grad:
            return out
        back_in = np.empty_like(back)
        back_in[order] = back
        return out, d, back_in

    def step(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of one window, the state behind it and the window's summed log-probability."""
        p, n = self.p, self.h
        states, trace = self.recur(self.table(), inputs, h, True)
        flat = targets.ravel()
        valid = np.flatnonzero(flat >= 0)
        logp, d, back = self.outputs(states.reshape(-1, n)[valid], flat[valid], True)
        dh_all = np.zeros((flat.size, n), np.float32)
        dh_all[valid] = back
        dh_all = dh_all.reshape(states.shape)
        du, dg = np.zeros_like(p["u"]), np.empty((len(inputs), inputs.shape[1], 3 * n), np.float32)
        dh = np.zeros_like(h)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, m, c = trace[t]
            dh = dh + dh_all[t]
            g = dg[t]
            one = dh * (1 - z)
            g[:, :n] = (c - before) * one * z  # minus, as the gates' inputs are
            dc = one * (1 - c * c)
            g[:, 2 * n :] = dc
            g[:, n : 2 * n] = dc * m * r * (r - 1)
            dhu = g.copy()
            dhu[:, 2 * n :] *= r
            du += before.T @ dhu
            dh = dh * z + dhu @ p["u"].T
            fresh = inputs[t] == 0
            if fresh.any():
                dh = dh * ~fresh[:, None]
        flat_in, flat_g = inputs.ravel(), dg.reshape(-1, 3 * n)
        order = np.argsort(flat_in.astype(np.int16), kind="stable")
        ids, start = np.unique(flat_in[order], return_index=True)
        by_id = np.add.reduceat(flat_g[order], start, axis=0)
        d |= {"u": du, "b": by_id.sum(0), "wx": p["emb"][ids].T @ by_id, "emb": np.zeros_like(p["emb"])}
        d["emb"][ids] = by_id @ p["wx"].T
        return d, states[-1], float(logp.sum())


class Adam:
    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def update(self, d: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in d.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        rate = self.rate * min(1.0, self.t / 25) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, x in self.model.p.items():
            g = d[k] * np.float32(clip)
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            x -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-8))


def windows(packed: tuple, steps: int = STEPS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(active lanes, inputs, targets, doc numbers) of each window."""
    inputs, targets, numbers, lengths = packed
    for at in range(0, len(inputs), steps):
        active = int(np.count_nonzero(lengths > at))
        yield active, inputs[at : at + steps, :active], targets[at : at + steps, :active], numbers[at : at + steps, :active]


def train(model: Model, optimizer: Adam, docs: list[np.ndarray]) -> int:
    """One pass over ``docs``, every window backpropagated; returns the number of tokens.  Few tokens go in fewer lanes, so that they make about 50 windows at least."""
    h, seen = None, 0
    lanes = int(np.clip(sum(map(len, docs)) // (50 * STEPS), 8, LANES))
    # A long text in one lane would make many steps of its own: its segments are spread over the lanes.
    parts = [d[at : at + SEGMENT] for d in docs for at in range(0, len(d), SEGMENT)]
    for active, inputs, targets, _ in windows(pack(parts, lanes)):
        h = np.zeros((active, model.h), np.float32) if h is None else h[:active]
        d, h, _ = model.step(inputs, targets, h)
        optimizer.update(d)
        seen += int(np.count_nonzero(targets >= 0))
    return seen


def score(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document."""
    out, h = np.zeros(len(docs)), None
    table = model.table()
    for active, inputs, targets, numbers in windows(pack(docs), 2 * STEPS):
        h = np.zeros((active, model.h), np.float32) if h is None else h[:active]
        states, _ = model.recur(table, inputs, h, False)
        h = states[-1]
        flat = targets.ravel()
        valid = np.flatnonzero(flat >= 0)
        logp = model.outputs(states.reshape(-1, model.h)[valid], flat[valid], False)
        out += np.bincount(numbers.ravel()[valid], logp, len(docs))
    return out
