"""A gated recurrent language model in numpy with a class-factored softmax.

The vocabulary is dealt into ``classes`` classes of ``members`` entries;
P(token) = P(class | state) * P(member | class, state). Documents run through
parallel lanes; a lane's state is carried from window to window and set to
zero where a document begins. Training cuts the gradient at the window
(truncated backpropagation through time); scoring needs no cut, so a
document's log-likelihood is complete whatever its length.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
CLASSES = 32
MEMBERS = 32
#: Id of the token that ends a document; also the input before its first token.
END = 0
WINDOW = 32
LANES = 512


def _steep(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether a logit could reach where exp overflows; states lie in [-1, 1]."""
    return bool((np.abs(w).sum(-2) + np.abs(b)).max() > 60)


class Model:
    """Parameters by name, as float32 arrays."""

    NAMES = ("embed", "inp", "rec", "bias", "cls", "cls_b", "mem", "mem_b")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Model:
        """Small random weights; the output biases are the unigram model of
        ``counts`` (one for each of classes * members ids)."""
        rng = np.random.default_rng(seed)
        h, c, m = hidden, CLASSES, MEMBERS
        share = (counts + 0.5).reshape(c, m)
        draw = lambda *s, w=0.1: rng.normal(0, w, s).astype(np.float32)
        return cls({
            "embed": draw(c * m, h, w=0.5), "inp": draw(h, 3 * h, w=0.3),
            "rec": draw(h, 3 * h, w=0.3), "bias": np.zeros(3 * h, np.float32),
            "cls": draw(h, c), "cls_b": np.log(share.sum(1) / share.sum()).astype(np.float32),
            "mem": draw(c, h, m),
            "mem_b": np.log(share / share.sum(1, keepdims=True)).astype(np.float32)})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES]).astype(np.float64)

    def like(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for n in self.NAMES:
            size = self.p[n].size
            out[n] = flat[at:at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size
        return Model(out)

    # ------------------------------------------------------------ recurrence
    def states(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """(states after each input, last state, what the backward pass needs
        if ``keep``), steps x lanes. ``fresh`` marks inputs that begin a document."""
        p, size = self.p, self.p["rec"].shape[0]
        # sigmoid(a) = (tanh(a / 2) + 1) / 2: the halves go into the weights
        half = np.ones(3 * size, p["rec"].dtype)
        half[:2 * size] = 0.5
        given = (p["embed"] @ p["inp"] + p["bias"]) * half
        # by gate: numpy is slow on slices of a few columns
        of_gates = np.ascontiguousarray(given[:, :2 * size].reshape(-1, 2, size).swapaxes(0, 1))
        of_n = np.ascontiguousarray(given[:, 2 * size:])
        rec = p["rec"] * half
        steps, lanes = ids.shape
        out = np.empty((steps, lanes, size), rec.dtype)
        held = np.empty((5, steps if keep else 1, lanes, size), rec.dtype)
        any_fresh = fresh.any(axis=1).tolist()
        h = np.array(h, rec.dtype)
        for t in range(steps):
            if any_fresh[t]:
                h = h.copy()
                h[fresh[t]] = 0
            prev, r, z, un, n = own = held[:, t if keep else 0]
            if keep:
                prev[:] = h
            u, g = h @ rec, own[1:3]
            np.add(u[:, :2 * size].reshape(lanes, 2, size).swapaxes(0, 1),
                   of_gates.take(ids[t], axis=1), out=g)
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            un[:] = u[:, 2 * size:]
            np.multiply(r, un, out=n)
            n += of_n.take(ids[t], axis=0)
            np.tanh(n, out=n)
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out, h.copy(), held

    # ------------------------------------------------------------ output
    def token_logs(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target given its state; with
        ``grads``, also d(-sum of logs)/dh, and adds to the gradients. Rows
        are put in the order of their class, so that a class is one slice."""
        p = self.p
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")
        h, target = h.take(order, axis=0), target.take(order)
        c, w = np.divmod(target, MEMBERS)
        rows = np.arange(len(target))

        def part(hs, at, weight, bias, steep):
            """Log softmax at ``at`` and, for the gradient, its error."""
            logit = hs @ weight
            logit += bias
            if steep:
                logit -= logit.max(1, keepdims=True)
            own = rows[:len(hs)]
            picked = logit[own, at]
            e = np.exp(logit, out=logit)
            total = e @ np.ones(e.shape[1], e.dtype)
            if grads is not None:
                e *= (1 / total)[:, None]
                e[own, at] -= 1
            return picked - np.log(total), e

        logs, e = part(h, c, p["cls"], p["cls_b"], _steep(p["cls"], p["cls_b"]))
        dh = None
        if grads is not None:
            grads["cls"] += h.T @ e
            grads["cls_b"] += e.sum(0)
            dh = e @ p["cls"].T
        steep = _steep(p["mem"], p["mem_b"])
        lo = 0
        for k, hi in enumerate(np.cumsum(np.bincount(c, minlength=CLASSES)).tolist()):
            if hi > lo:
                more, e = part(h[lo:hi], w[lo:hi], p["mem"][k], p["mem_b"][k], steep)
                logs[lo:hi] += more
                if grads is not None:
                    grads["mem"][k] += h[lo:hi].T @ e
                    grads["mem_b"][k] += e.sum(0)
                    dh[lo:hi] += e @ p["mem"][k].T
            lo = hi
        back = np.empty_like(order)
        back[order] = rows
        return logs.take(back), None if dh is None else dh.take(back, axis=0)

    # ------------------------------------------------------------ training
    def gradient(self, ids, fresh, target, live, h):
        """Gradient of the mean negative log probability of one window, its
        sum of logs, and the states that the next window starts from."""
        p, size = self.p, self.p["rec"].shape[0]
        grads = {n: np.zeros_like(v) for n, v in p.items()}
        out, last, (prev, r, z, un, n) = self.states(ids, fresh, h, True)
        flat_out, flat_target = out.reshape(-1, size), target.ravel()
        if live.all():
            logs, dout = self.token_logs(flat_out, flat_target, grads)
        else:
            where = np.flatnonzero(live.ravel())
            logs, dflat = self.token_logs(flat_out[where], flat_target[where], grads)
            dout = np.zeros((ids.size, size), out.dtype)
            dout[where] = dflat
        dout = dout.reshape(out.shape)
        # slopes of the whole window; the steps backward only multiply
        rest = 1 - z
        slope_n = rest * (1 - n * n)
        slope_z = (prev - n) * z * rest
        slope_r = un * r * (1 - r)
        du = np.empty((*ids.shape, 3 * size), out.dtype)
        dn = np.empty_like(out)
        carry = np.zeros_like(h)
        any_fresh = fresh.any(axis=1)
        rec_t = np.ascontiguousarray(p["rec"].T)
        for t in range(len(ids) - 1, -1, -1):
            d = dout[t]
            d += carry
            dt = np.multiply(d, slope_n[t], out=dn[t])
            ut = np.concatenate((dt * slope_r[t], d * slope_z[t], dt * r[t]), axis=1, out=du[t])
            carry = ut @ rec_t
            carry += d * z[t]
            if any_fresh[t]:
                carry[fresh[t]] = 0
        flat_u = du.reshape(-1, 3 * size)
        grads["rec"] = prev.reshape(-1, size).T @ flat_u
        # the input enters the gates as the state does, and n without the gate r
        flat_u[:, 2 * size:] = dn.reshape(-1, size)
        by_id = np.zeros((len(p["embed"]), 3 * size), out.dtype)
        flat = ids.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        by_id[flat[order[first]]] = np.add.reduceat(flat_u.take(order, axis=0), first, axis=0)
        grads["inp"] = p["embed"].T @ by_id
        grads["bias"] = by_id.sum(0)
        grads["embed"] = by_id @ p["inp"].T
        scale = out.dtype.type(1 / max(1, len(logs)))
        for g in grads.values():
            g *= scale
        return grads, float(logs.sum()), last


class Adam:
    """Adam steps on a model's parameters."""

    def __init__(self, model: Model, rate: float = 0.01):
        self.model, self.rate, self.n = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def state(self) -> np.ndarray:
        """Parameters and both moments, three rows."""
        return np.stack([Model(x).flat() for x in (self.model.p, self.m, self.v)])

    def resume(self, state: np.ndarray, n: int) -> None:
        """Go on from a ``state`` after ``n`` steps."""
        self.n = n
        self.model.p, self.m, self.v = (self.model.like(x).p for x in state)

    def step(self, grads: dict) -> None:
        self.n += 1
        a, b = 1 - 0.9 ** self.n, 1 - 0.99 ** self.n
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.model.p[k] -= np.float32(self.rate / a) * self.m[k] / (
                np.sqrt(self.v[k] / np.float32(b)) + np.float32(1e-6))


def fit(model: Model, optimiser: Adam, docs: list[np.ndarray], lanes: int = LANES,
        window: int = WINDOW) -> int:
    """Train on every token of ``docs`` (ids); returns how many. The documents
    follow each other in equal lanes; each starts from a state of zero, and one
    that a lane's end cuts goes on in the next lane with a state of zero."""
    line = np.concatenate(docs)
    n = len(line)
    lanes = max(1, min(lanes, n // window))
    steps = -(-n // lanes)
    target = np.zeros(lanes * steps, np.int16)
    target[:n] = line
    live = (np.arange(lanes * steps) < n).reshape(lanes, steps).T
    before = np.concatenate(([END], target[:-1]))
    before[np.cumsum([0] + [len(d) for d in docs[:-1]])] = END
    before = before.reshape(lanes, steps).T
    target = target.reshape(lanes, steps).T
    h = np.zeros((lanes, model.p["rec"].shape[0]), np.float32)
    for lo in range(0, steps, window):
        s = slice(lo, lo + window)
        ids = np.ascontiguousarray(before[s])
        grads, _, h = model.gradient(ids, ids == END, target[s], live[s], h)
        optimiser.step(grads)
    return n


def score(model: Model, docs: list[np.ndarray], lanes: int = LANES,
          window: int = 2 * WINDOW) -> np.ndarray:
    """Log10 probability of each document (ids, each ending with END), whole:
    every document lies in one lane and its state runs through all windows."""
    if not docs:
        return np.zeros(0)
    sizes = np.array([len(d) for d in docs])
    lanes = int(max(1, min(lanes, len(docs), -(-sizes.sum() // sizes.max()))))
    heap = [(0, lane) for lane in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        dealt[lane].append(d)
        heapq.heappush(heap, (load + int(sizes[d]), lane))
    steps = max(load for load, _ in heap)
    target = np.zeros((steps, lanes), np.int16)
    before = np.zeros((steps, lanes), np.int16)
    owner = np.full((steps, lanes), -1, np.int32)
    for lane, own in enumerate(dealt):
        line = np.concatenate([docs[d] for d in own])
        target[:len(line), lane] = line
        before[1:len(line), lane] = line[:-1]
        owner[:len(line), lane] = np.repeat(own, sizes[own])
    total = np.zeros(len(docs))
    size = model.p["rec"].shape[0]
    h = np.zeros((lanes, size), np.float32)
    for lo in range(0, steps, window):
        s = slice(lo, lo + window)
        out, h, _ = model.states(before[s], before[s] == END, h)
        of, flat, own = owner[s].ravel(), out.reshape(-1, size), target[s].ravel()
        if of.min() < 0:
            where = np.flatnonzero(of >= 0)
            of, flat, own = of[where], flat.take(where, axis=0), own[where]
        logs, _ = model.token_logs(flat, own)
        total += np.bincount(of, weights=logs, minlength=len(docs))
    return total / np.log(10)
