"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Symbols are sorted by frequency and cut into classes of equal size; the chance of a symbol is the
chance of its class times its chance within the class. Texts run in parallel lanes; the state is
carried from window to window and cleared where a text begins.
"""

import heapq
import math

import numpy as np

HIDDEN, EMBED, CLASSES, PER_CLASS = 24, 24, 64, 64
SYMBOLS = CLASSES * PER_CLASS
WINDOW = 32
TRAIN_LANES, SCORE_LANES = 64, 512
RATE, CLIP = 0.01, 1.0
SAFE = 60.0  # logits up to this neither overflow nor vanish in single precision
BLOCK, STEP = 4096, 1 << 15  # rows scored, parameters moved at a time
SHAPES = {
    "E": (SYMBOLS, EMBED), "Wx": (EMBED, 3 * HIDDEN), "b": (3 * HIDDEN,), "U": (HIDDEN, 2 * HIDDEN),
    "Un": (HIDDEN, HIDDEN), "Wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
    "Wo": (CLASSES, PER_CLASS, HIDDEN), "bo": (CLASSES, PER_CLASS),
}
Params = dict[str, np.ndarray]


def initial(counts: np.ndarray) -> Params:
    """Parameters that give every symbol its frequency whatever came before."""
    rng = np.random.default_rng(7)
    p = {k: np.zeros(s, dtype=np.float32) for k, s in SHAPES.items()}
    for k in ("E", "Wx", "U", "Un"):
        p[k] = rng.normal(0, 0.5 if k == "E" else 1 / np.sqrt(SHAPES[k][0]), SHAPES[k]).astype(np.float32)
    grid = (counts.astype(np.float64) + 0.01).reshape(CLASSES, PER_CLASS)
    p["bc"] = np.log(grid.sum(axis=1) / grid.sum()).astype(np.float32)
    p["bo"] = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(v: np.ndarray) -> Params:
    return views(np.array(v, dtype=np.float32))


def views(v: np.ndarray) -> Params:
    """The parameters as parts of the vector, not copied."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at:at + n].reshape(s)
        at += n
    return out


def lanes(docs: list[np.ndarray], most: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane; longest lane first."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    heap = [(0, k) for k in range(min(most, len(docs)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in order:
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + len(docs[i]), k))
    return sorted(out, key=lambda own: -sum(len(docs[i]) for i in own))


def grid(docs: list[np.ndarray], end: int, most: int):
    """(inputs, targets, document of each cell, keep, lane lengths); time runs along axis 0.

    Every document ends with the symbol ``end``, which also stands before its first symbol; ``keep``
    is 0 where a document begins.
    """
    dealt = lanes(docs, most)
    sizes = np.array([sum(len(docs[i]) for i in own) for own in dealt])
    shape = (sizes.max(), len(dealt))
    x, y = np.full(shape, end, dtype=np.int32), np.full(shape, end, dtype=np.int32)
    which, keep = np.zeros(shape, dtype=np.int32), np.ones(shape, dtype=np.float32)
    for lane, own in enumerate(dealt):
        at = 0
        for i in own:
            stop = at + len(docs[i])
            y[at:stop, lane] = docs[i]
            x[at + 1:stop, lane] = docs[i][:-1]
            which[at:stop, lane] = i
            keep[at, lane] = 0
            at = stop
    return x, y, which, keep, sizes


class Space(dict):
    """Arrays by name that are used again: fresh ones of these sizes cost more than the work on them."""

    def __call__(self, name: str, shape: tuple[int, ...], dtype=np.float32) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or self[name].size < size or self[name].dtype != dtype:
            self[name] = np.empty(size, dtype=dtype)
        return self[name][:size].reshape(shape)


def run(p: Params, x: np.ndarray, keep: np.ndarray, h: np.ndarray, tape: list | None = None,
        space: Space | None = None):
    """Hidden states of a window, (time, lane, unit), and the last; ``tape`` collects what the backward pass
    needs. They stand in ``space`` until its next use.

    Inside, lanes are the last axis. One product gives what symbol, state and bias add to the candidate from
    outside, to the two gates, and to the candidate from the state.
    """
    space, kind = Space() if space is None else space, p["E"].dtype
    steps, live, cand = len(x), x.shape[1], 3 * HIDDEN
    product = np.zeros((4 * HIDDEN, HIDDEN + EMBED + 1), dtype=kind)
    product[HIDDEN:cand, :HIDDEN], product[cand:, :HIDDEN] = p["U"].T, p["Un"].T
    product[:cand, HIDDEN:-1], product[:cand, -1] = np.roll(p["Wx"].T, HIDDEN, axis=0), np.roll(p["b"], HIDDEN)
    product[HIDDEN:cand] *= 0.5  # a gate is half of one plus the hyperbolic tangent of half its drive
    kept = steps if tape is not None else 1
    given = space("given", (kept, product.shape[1], live), kind)
    drive, n = space("drive", (kept, len(product), live), kind), space("n", (kept, HIDDEN, live), kind)
    states = space("states", (steps, HIDDEN, live), kind)
    given[:, -1] = 1
    if kept > 1:
        given[:, HIDDEN:-1] = np.take(p["E"], x, axis=0).transpose(0, 2, 1)
    h, keep = h.T, keep[:, None, :]
    for t in range(steps):
        k = t if kept > 1 else 0
        own, d, m, out = given[k], drive[k], n[k], states[t]
        before, gates = own[:HIDDEN], d[HIDDEN:cand]
        np.multiply(h, keep[t], out=before)
        if kept == 1:
            own[HIDDEN:-1] = np.take(p["E"], x[t], axis=0).T
        np.matmul(product, own, out=d)
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        np.multiply(gates[HIDDEN:], d[cand:], out=m)
        m += d[:HIDDEN]
        np.tanh(m, out=m)
        np.subtract(before, m, out=out)
        out *= gates[:HIDDEN]
        out += m
        h = out
    if tape is not None:
        tape += (given, drive, n)
    return states.transpose(0, 2, 1), h.T.copy()


def _real(cells: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The cells of a window that hold symbols, one after the other."""
    return cells.reshape(-1, *cells.shape[2:]) if real.all() else cells[real]


def _sorted(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of rows by class, and (class, start, stop) of each that occurs."""
    order = np.argsort(kind.astype(np.int8), kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def _logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, space: Space) -> np.ndarray:
    out = np.matmul(h, weights, out=space("logits", (len(h), weights.shape[1]), weights.dtype))
    out += bias
    return out


def _within(p: Params, h: np.ndarray, kind: np.ndarray, parts: list[tuple[int, int, int]], space: Space) -> np.ndarray:
    """Logits of the symbols of each row's class; rows stand by class."""
    out = space("within", (len(h), PER_CLASS), p["Wo"].dtype)
    turned = space("turned", (CLASSES, HIDDEN, PER_CLASS), out.dtype)
    turned[:] = p["Wo"].transpose(0, 2, 1)
    for c, a, b in parts:
        np.dot(h[a:b], turned[c], out=out[a:b])
    out += np.take(p["bo"], kind, axis=0, out=space("bias", out.shape, out.dtype), mode="clip")
    return out


def _exp(logits: np.ndarray) -> np.ndarray:
    """Exponentials in place, and what was taken off the logits before: 0 unless they could overflow."""
    top = np.zeros((len(logits), 1), dtype=logits.dtype)
    if len(logits) and (logits.max() > SAFE or logits.min() < -SAFE):
        top = logits.max(axis=1, keepdims=True)
        logits -= top
    np.exp(logits, out=logits)
    return top[:, 0]


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Chances, in place."""
    _exp(logits)
    logits *= 1 / (logits @ np.ones((logits.shape[1], 1), dtype=logits.dtype))
    return logits


def log_chances(p: Params, h: np.ndarray, y: np.ndarray, space: Space | None = None) -> np.ndarray:
    """Natural logarithms of the chances of symbols ``y`` after states ``h``."""
    space = Space() if space is None else space
    out = np.empty(len(y), dtype=p["Wo"].dtype)
    order = np.argsort((y // PER_CLASS).astype(np.int8), kind="stable")
    for at in range(0, len(y), BLOCK):
        own = order[at:at + BLOCK]
        part, kind = np.take(h, own, axis=0), y[own] // PER_CLASS
        _, parts = _sorted(kind)
        out[own] = (_log_at(_logits(part, p["Wc"], p["bc"], space), kind)
                    + _log_at(_within(p, part, kind, parts, space), y[own] % PER_CLASS))
    return out


def _log_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = logits[np.arange(len(at)), at]
    top = _exp(logits)
    return own - top - np.log(logits @ np.ones(logits.shape[1], dtype=logits.dtype))


def score(p: Params, docs: list[np.ndarray], end: int) -> np.ndarray:
    """log10 chance of each document; ``docs`` end with ``end``. Finished lanes drop out."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    x, y, which, keep, sizes = grid(docs, end, SCORE_LANES)
    h, space = np.zeros((len(sizes), HIDDEN), dtype=np.float32), Space()
    for at in range(0, len(x), WINDOW):
        live = int((sizes > at).sum())
        part = (slice(at, at + WINDOW), slice(0, live))
        states, h = run(p, x[part], keep[part], h[:live], space=space)
        real = (np.arange(at, at + len(states))[:, None] < sizes[None, :live])
        logs = log_chances(p, _real(states, real), _real(y[part], real), space)
        total += np.bincount(_real(which[part], real), weights=logs, minlength=len(docs))
    return total / np.log(10)


class Trainer:
    """Adam over windows of one replica. Parameters, slopes and moments each stand in one vector."""

    def __init__(self, p: Params):
        self.at = flat(p).astype(np.float32)
        self.p = views(self.at)
        self.slope = np.zeros_like(self.at)
        self.g = views(self.slope)
        # Sums with fading weights; the moments are 0.1 and 0.001 times these.
        self.m, self.v = np.zeros_like(self.at), np.zeros_like(self.at)
        self.steps, self.space = 0, Space()

    def learn(self, docs: list[np.ndarray], end: int) -> int:
        """One pass over the documents; the number of symbols seen."""
        if not docs:
            return 0
        x, y, _, keep, sizes = grid(docs, end, TRAIN_LANES)
        h = np.zeros((len(sizes), HIDDEN), dtype=np.float32)
        for at in range(0, len(x), WINDOW):
            live = int((sizes > at).sum())
            part = (slice(at, at + WINDOW), slice(0, live))
            real = (np.arange(at, min(at + WINDOW, len(x)))[:, None] < sizes[None, :live])
            h = self._window(x[part], y[part], keep[part], real, h[:live])
        return int(sizes.sum())

    def _window(self, x, y, keep, real, h):
        p, g, tape, space, steps, live = self.p, self.g, [], self.space, *x.shape
        states, last = run(p, x, keep, h, tape, space)
        self.slope[:] = 0
        rows = space("rows", (steps, live, HIDDEN))
        if real.all():
            rows[:] = self._output(_real(states, real), _real(y, real), g).reshape(rows.shape)
        else:
            rows[:] = 0
            rows[real] = self._output(states[real], y[real], g)
        ds = space("ds", (steps, HIDDEN, live))
        ds[:] = rows.transpose(0, 2, 1)
        given, drive, n = tape
        # Slopes of the four parts of the drive, per slope of the next state; then slopes.
        slopes, one = space("slopes", (steps, 4, HIDDEN, live)), np.float32(1)
        back = np.concatenate([p["U"], p["Un"]], axis=1)
        keep, (dh, rest, way) = keep[:, None, :], space("dh", (3, HIDDEN, live))
        dh[:] = 0
        for t in range(steps - 1, -1, -1):
            d, own, (_, z, r, inner), m = ds[t], slopes[t], drive[t].reshape(4, HIDDEN, live), n[t]
            of_n, of_z, of_r, of_inner = own
            d += dh
            np.subtract(one, z, out=rest)
            np.multiply(m, m, out=of_n)
            np.subtract(one, of_n, out=of_n)
            of_n *= rest
            of_n *= d
            np.multiply(of_n, r, out=of_inner)
            np.subtract(one, r, out=of_r)
            of_r *= of_inner
            of_r *= inner
            d *= z
            np.subtract(given[t, :HIDDEN], m, out=of_z)
            of_z *= d
            of_z *= rest
            np.matmul(back, own[1:].reshape(3 * HIDDEN, live), out=dh)
            dh += d
            dh *= keep[t]
        slopes = slopes.reshape(steps, 4 * HIDDEN, live)
        held = np.matmul(given[:, :HIDDEN], slopes[:, HIDDEN:].transpose(0, 2, 1),
                         out=space("held", (steps, HIDDEN, 3 * HIDDEN))).sum(axis=0)
        g["U"][:], g["Un"][:] = held[:, :2 * HIDDEN], held[:, 2 * HIDDEN:]
        outside = given[:, HIDDEN:]
        held = np.matmul(outside, slopes[:, :3 * HIDDEN].transpose(0, 2, 1),
                         out=space("held", (steps, outside.shape[1], 3 * HIDDEN))).sum(axis=0)
        held = np.roll(held, -HIDDEN, axis=1)
        g["Wx"][:], g["b"][:] = held[:-1], held[-1]
        # Rows of one symbol are added up first.
        np.matmul(np.roll(p["Wx"], HIDDEN, axis=1), slopes[:, :3 * HIDDEN], out=ds)
        rows[:] = ds.transpose(0, 2, 1)
        flat_x = x.ravel().astype(np.int16)
        order = np.argsort(flat_x, kind="stable")
        flat_x = flat_x[order]
        starts = np.flatnonzero(np.append(True, flat_x[1:] != flat_x[:-1]))
        g["E"][flat_x[starts]] = np.add.reduceat(np.take(rows.reshape(-1, EMBED), order, axis=0), starts, axis=0)
        self._step(g, max(1, int(real.sum())))
        return last

    def _output(self, h, y, g):
        """Slopes of the states; those of the output's parameters are put into ``g``."""
        p, space = self.p, self.space
        order, parts = _sorted(y // PER_CLASS)
        h, y = np.take(h, order, axis=0), y[order]
        rows, kind = np.arange(len(y)), y // PER_CLASS
        ones = np.ones(len(y), dtype=np.float32)
        d = _softmax(_logits(h, p["Wc"], p["bc"], space))
        d[rows, kind] -= 1
        np.matmul(h.T, d, out=g["Wc"])
        np.matmul(ones, d, out=g["bc"])
        dh = d @ p["Wc"].T
        d = _softmax(_within(p, h, kind, parts, space))
        d[rows, y % PER_CLASS] -= 1
        inner, weights, bias, given = np.empty_like(dh), g["Wo"], g["bo"], p["Wo"]
        for c, a, b in parts:
            own = d[a:b]
            np.dot(own.T, h[a:b], out=weights[c])
            np.dot(ones[a:b], own, out=bias[c])
            np.dot(own, given[c], out=inner[a:b])
        dh += inner
        out = np.empty_like(dh)
        out[order] = dh
        return out

    def _step(self, g, n):
        self.steps += 1
        size = np.sqrt(float(self.slope @ self.slope)) / n
        scale = np.float32(min(1.0, CLIP / max(size, 1e-9)) / n)
        rate = RATE * np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        rate, least = np.float32(rate * 0.1 / np.sqrt(0.001)), np.float32(1e-8 / np.sqrt(0.001))
        for at in range(0, len(self.at), STEP):  # parts that stay in the processor's cache
            own, m, v = (w[at:at + STEP] for w in (self.slope, self.m, self.v))
            own *= scale
            m *= np.float32(0.9)
            m += own
            own *= own
            v *= np.float32(0.999)
            v += own
            np.sqrt(v, out=own)
            own += least
            np.divide(m, own, out=own)
            own *= rate
            self.at[at:at + STEP] -= own
