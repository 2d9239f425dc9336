"""A gated recurrent language model in numpy.

Tokens are numbers 0 .. K-1 for the known words, most frequent first, and K for
any other. The output softmax is factored: classes are runs of neighbouring
words of about equal frequency mass, the others are a class of their own;
p(token) = p(class | state) p(word | class, state). The model starts as the
unigram model of its counts (biases are log frequencies) and learns by
truncated backpropagation: gradients stop at a window's start, the state does
not, it is carried through the whole document.

Documents are laid side by side in slots, several after one another in a slot;
a document's first input is the mark K + 1, with the state at zero.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
CLASSES = 32
WINDOW = 32
SLOTS = 256
RATE = 0.15
SAFE = 80.0         # exp of less is a float32


class Layout:
    """Where the words of each class lie: class c holds words bounds[c] .. bounds[c + 1]."""

    def __init__(self, counts: np.ndarray, others: float, classes: int = CLASSES):
        self.counts, self.others = np.asarray(counts, dtype=np.float64), float(others)
        mass = np.cumsum(self.counts)
        cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1 if len(mass) else []
        self.bounds = np.unique(np.r_[0, cuts, len(mass)]).astype(np.int64)
        self.words = len(mass)
        self.classes = len(self.bounds) - 1                      # without the class of the others
        self.of = np.repeat(np.arange(self.classes + 1), np.r_[np.diff(self.bounds), 1]).astype(np.int16)

    def start(self, hidden: int = HIDDEN, seed: int = 7) -> np.ndarray:
        """Parameters of a model that is the unigram model of the counts."""
        rng = np.random.default_rng(seed)
        p = views(np.zeros(size(self, hidden), dtype=np.float32), self, hidden)
        p["table"][:] = rng.normal(0, 0.3, p["table"].shape)
        p["u"][:] = rng.normal(0, hidden ** -0.5, p["u"].shape)
        mass = np.r_[np.add.reduceat(self.counts, self.bounds[:-1]) if self.words else [], self.others]
        p["class_b"][:] = np.log((mass + 0.1) / (mass + 0.1).sum())
        p["word_b"][:] = np.log(np.maximum(self.counts, 0.1))
        return p["all"]


def shapes(layout: Layout, hidden: int) -> dict:
    k, c = layout.words, layout.classes + 1
    return {"table": (k + 2, 3 * hidden), "u": (hidden, 3 * hidden), "class_w": (hidden, c), "class_b": (c,),
            "word_w": (hidden, k), "word_b": (k,)}


def size(layout: Layout, hidden: int) -> int:
    return sum(int(np.prod(s)) for s in shapes(layout, hidden).values())


def views(flat: np.ndarray, layout: Layout, hidden: int = HIDDEN) -> dict:
    """The parameters by name, as views of one array."""
    out, a = {"all": flat}, 0
    for name, s in shapes(layout, hidden).items():
        n = int(np.prod(s))
        out[name] = flat[a:a + n].reshape(s)
        a += n
    return out


class Slots:
    """Documents (arrays of tokens) in slots, longest first, so that the slots
    still running at a step are the first ones."""

    def __init__(self, docs: list, words: int, slots: int = SLOTS):
        heap = [(0, k, []) for k in range(min(slots, max(len(docs), 1)))]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, k, held = heapq.heappop(heap)
            held.append(d)
            heapq.heappush(heap, (n + len(docs[d]), k, held))
        heap.sort(key=lambda x: (-x[0], x[1]))
        self.loads = np.array([x[0] for x in heap])
        steps = int(self.loads.max(initial=0))
        self.target = np.zeros((steps, len(heap)), dtype=np.int32)
        self.input = np.zeros((steps, len(heap)), dtype=np.int32)
        self.doc = np.full((steps, len(heap)), -1, dtype=np.int32)
        for s, (_, _, held) in enumerate(heap):
            a = 0
            for d in held:
                n = len(docs[d])
                if n:
                    self.target[a:a + n, s], self.doc[a:a + n, s] = docs[d], d
                    self.input[a, s] = words + 1
                    self.input[a + 1:a + n, s] = docs[d][:-1]
                a += n
        self.words = words

    def windows(self, length: int = WINDOW):
        """(input, target, doc) of each window, of the slots that still run;
        doc is -1 behind a slot's end."""
        for t in range(0, len(self.target), length):
            w = int((self.loads > t).sum())
            yield self.input[t:t + length, :w], self.target[t:t + length, :w], self.doc[t:t + length, :w]


class Model:
    """Forward and backward steps. Within a step arrays are (features, slots),
    so that every gate is one contiguous block."""

    def __init__(self, layout: Layout, flat: np.ndarray, hidden: int = HIDDEN):
        self.layout, self.hidden, self.p = layout, hidden, views(flat, layout, hidden)

    def states(self, inputs: np.ndarray, h: np.ndarray) -> dict:
        """All states of a window, from the state ``h`` (features, slots) before it."""
        n, p = self.hidden, self.p
        steps, width = inputs.shape
        gates = np.ascontiguousarray(p["table"][inputs].transpose(0, 2, 1))
        fresh = inputs == self.layout.words + 1
        some = fresh.any(axis=1)
        before, after, pulled, new = (np.empty((steps, n, width), dtype=gates.dtype) for _ in range(4))
        zr = np.empty((steps, 2 * n, width), dtype=gates.dtype)
        pull = np.ascontiguousarray(p["u"].T)
        for t in range(steps):
            before[t] = h
            if some[t]:
                before[t][:, fresh[t]] = 0
            u = pull @ before[t]
            a, c, h = zr[t], new[t], after[t]
            np.add(gates[t, :2 * n], u[:2 * n], out=a)
            a *= 0.5
            np.tanh(a, out=a)
            a += 1
            a *= 0.5
            pulled[t] = u[2 * n:]
            np.multiply(a[n:], pulled[t], out=c)
            c += gates[t, 2 * n:]
            np.tanh(c, out=c)
            np.subtract(before[t], c, out=h)
            h *= a[:n]
            h += c
        return {"fresh": fresh, "some": some, "before": before, "after": after, "pulled": pulled, "zr": zr, "new": new}

    def logs(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None):
        """Natural log probability of each target given its state (rows of
        ``h``); with ``grad`` also the gradient of their sum by the state, while
        the output parameters' gradients are added to ``grad``."""
        p, lay = self.p, self.layout
        order = np.argsort(lay.of[target], kind="stable")
        h, target = h[order], target[order]
        cls = lay.of[target]
        ends = np.searchsorted(cls, np.arange(lay.classes + 1))

        def picked(w, b, h, own):
            """Log softmax of h @ w + b at own; and its gradient by the logits.
            The biases enter as factors, which saves passes over the logits."""
            x = w.T @ h.T
            if np.abs(w).sum(axis=0).max() > SAFE:              # states lie within -1 and 1
                x -= x.max(axis=0)
            j, top = np.arange(x.shape[1]), b.max()
            log = x[own, j] + b[own]
            np.exp(x, out=x)
            scale = np.exp(b - top)
            s = scale @ x
            log -= np.log(s) + top
            if grad is not None:
                x *= scale[:, None]
                x *= -1 / s
                x[own, j] += 1
            return log, x

        log, x = picked(p["class_w"], p["class_b"], h, cls)
        if grad is not None:
            grad["class_w"] += (x @ h).T
            grad["class_b"] += x.sum(axis=1)
            dh = x.T @ p["class_w"].T
        for c in range(lay.classes):
            lo, hi, a, b = lay.bounds[c], lay.bounds[c + 1], ends[c], ends[c + 1]
            if hi - lo < 2 or a == b:
                continue
            w = p["word_w"][:, lo:hi]
            own, x = picked(w, p["word_b"][lo:hi], h[a:b], target[a:b] - lo)
            log[a:b] += own
            if grad is not None:
                grad["word_w"][:, lo:hi] += (x @ h[a:b]).T
                grad["word_b"][lo:hi] += x.sum(axis=1)
                dh[a:b] += x.T @ w.T
        out = np.empty_like(log)
        out[order] = log
        if grad is None:
            return out, None
        dout = np.empty_like(dh)
        dout[order] = dh
        return out, dout

    def rows(self, states: np.ndarray) -> np.ndarray:
        """(steps, features, slots) as a row per step and slot."""
        return np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, states.shape[1])

    def gradient(self, inputs, target, live, h) -> tuple:
        """Sum of log probabilities of a window, its gradients (``table`` as
        rows and their gradients) and the state after it. Backpropagation stops
        at the window's start."""
        n, p = self.hidden, self.p
        s = self.states(inputs, h)
        grad = {k: np.zeros_like(p[k]) for k in ("u", "class_w", "class_b", "word_w", "word_b")}
        flat, on = self.rows(s["after"]), live.ravel()
        if on.all():
            log, dout = self.logs(flat, target.ravel(), grad)
        else:
            dout = np.zeros_like(flat)
            log, dout[on] = self.logs(flat[on], target.ravel()[on], grad)
        dout = np.ascontiguousarray(dout.reshape(*inputs.shape, n).transpose(0, 2, 1))
        dgates = np.empty((len(inputs), 3 * n, inputs.shape[1]), dtype=flat.dtype)
        dh = np.zeros_like(dout[0])
        z, r = s["zr"][:, :n], s["zr"][:, n:]
        into_z, into_r = (s["before"] - s["new"]) * (z * (1 - z)), s["pulled"] * (r * (1 - r))
        into_new = (1 - z) * (1 - s["new"] * s["new"])
        d = np.empty_like(dgates[0])
        for t in range(len(inputs) - 1, -1, -1):
            dh += dout[t]
            g = dgates[t]
            np.multiply(dh, into_z[t], out=g[:n])
            np.multiply(dh, into_new[t], out=g[2 * n:])
            np.multiply(g[2 * n:], into_r[t], out=g[n:2 * n])
            d[:2 * n] = g[:2 * n]
            np.multiply(g[2 * n:], r[t], out=d[2 * n:])
            grad["u"] += s["before"][t] @ d.T
            dh *= z[t]
            dh += p["u"] @ d
            if s["some"][t]:
                dh[:, s["fresh"][t]] = 0
        tokens = inputs.ravel().astype(np.uint16)          # short numbers sort fast
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        rows = tokens[starts].astype(np.int64)
        grad["table"] = (rows, np.add.reduceat(self.rows(dgates)[order], starts, axis=0))
        return log.sum(), grad, s["after"][-1]


def train(layout: Layout, flat: np.ndarray, seen: np.ndarray, docs: list, hidden: int = HIDDEN,
          rate: float = RATE, slots: int = SLOTS, window: int = WINDOW) -> int:
    """One pass of adaptive gradient steps over whole documents, in place.
    ``seen`` holds the sums of squared gradients. Returns the tokens used."""
    model, sums = Model(layout, flat, hidden), views(seen, layout, hidden)
    laid = Slots(docs, layout.words, slots)
    h, n = np.zeros((hidden, len(laid.loads)), dtype=np.float32), 0
    for inputs, target, doc in laid.windows(window):
        live = doc >= 0
        _, grad, h = model.gradient(inputs, target, live, h[:, :inputs.shape[1]])
        n += int(live.sum())
        for name, g in grad.items():
            p, s = model.p[name], sums[name]
            if name == "table":
                rows, g = g
                s[rows] += g * g
                p[rows] += rate * g / np.sqrt(s[rows] + 1e-6)
            else:
                s += g * g
                p += rate * g / np.sqrt(s + 1e-6)
    return n


def log_likelihoods(layout: Layout, flat: np.ndarray, docs: list, hidden: int = HIDDEN, slots: int = SLOTS,
                    window: int = 2 * WINDOW) -> np.ndarray:
    """Natural log probability of each whole document, the state carried from
    window to window."""
    model, laid = Model(layout, flat, hidden), Slots(docs, layout.words, slots)
    out = np.zeros(len(docs))
    h = np.zeros((hidden, len(laid.loads)), dtype=np.float32)
    for inputs, target, doc in laid.windows(window):
        s = model.states(inputs, h[:, :inputs.shape[1]])
        h, on = s["after"][-1], doc.ravel() >= 0
        log, _ = model.logs(model.rows(s["after"])[on], target.ravel()[on])
        out += np.bincount(doc.ravel()[on], weights=log, minlength=len(docs))
    return out
