"""A small causal self-attention model over subword ids, trained and run in numpy.

Sequences are read in windows of two blocks: the ids of the second are scored, each once,
and those of the first, which the window before scored, are context only. A window's
successors attend to all earlier ids of it, weighed by content and distance. The next id
is predicted as class, then id within its class; classes are learnt from the company that
ids keep, and the second factor is a smoothed count, both over the whole corpus. Classes
hold either ids that start a word or ids that go on with one, so that the probability
that a word ends is the sum of the former.
"""

from __future__ import annotations

import numpy as np

from .embedding_dedup import fit_centres

LOG10 = np.float32(0.4342944819)


class Windows:
    """The windows of some sequences, in order; sequence i holds places offsets[i] to offsets[i + 1] - 1."""

    def __init__(self, offsets: np.ndarray, size: int):
        self.size = size
        length = np.diff(offsets)
        n = np.maximum(0, -(-(length - 1) // size))
        self.owner = np.repeat(np.arange(len(length)), n)
        self.which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.low, self.high = offsets[:-1][self.owner], offsets[1:][self.owner]

    def __len__(self) -> int:
        return len(self.owner)

    def places(self, at: np.ndarray | slice) -> np.ndarray:
        """The 2 * size + 1 places of each window, -1 where its sequence has none; the last is a successor only."""
        low = self.low[at]
        place = (low + self.which[at] * self.size)[:, None] + np.arange(-self.size, self.size + 1)
        return np.where((place >= low[:, None]) & (place < self.high[at][:, None]), place, -1)


def classes(counts: np.ndarray, starts: np.ndarray, company: np.ndarray | None, own: int, clusters: int) -> np.ndarray:
    """Class of each id: the most frequent have their own, others share by company, apart for ``starts`` and the rest.

    ``company`` has one row an id, of how often each frequent id is near it. Ids that never
    occur are in one class for each kind.
    """
    order = np.argsort(-counts, kind="stable")
    of = np.where(starts, own + 2 * clusters, own + 2 * clusters + 1).astype(np.int32)
    of[order[:own]] = np.arange(min(own, len(order)))
    for kind in (0, 1):
        rest = order[own:]
        rest = rest[(counts[rest] > 0) & (starts[rest] == (kind == 0))]
        if len(rest) and company is not None:
            x = np.sqrt(company[rest] + 1e-3)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            k = min(clusters, len(rest))
            centres = fit_centres(x, k)
            of[rest] = own + kind * clusters + np.concatenate([(x[at : at + 4096] @ centres.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        elif len(rest):
            of[rest] = own + kind * clusters + np.arange(len(rest)) % clusters
    return of


class AttentionLM:
    """One attention layer and one feed-forward layer, with residual connections."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, company: np.ndarray | None = None, size: int = 16, dim: int = 16, rows: int = 8192, own: int = 32, clusters: int = 32, seed: int = 1):
        self.ids, self.size, self.dim, self.starts = len(counts), size, dim, starts
        self.of = classes(counts, starts, company, own, clusters)
        self.classes = own + 2 * clusters + 2
        # frequent ids have an embedding of their own; the others share the last quarter of the rows by class
        order = np.argsort(-counts, kind="stable")
        free = rows - rows // 4
        self.row = (free + (self.of.astype(np.int64) * 2654435761 + np.arange(self.ids)) % (rows // 4)).astype(np.int32)
        self.row[order[:free]] = np.arange(len(order[:free]))
        mass = np.bincount(self.of, counts + 0.5, self.classes)
        self.within = (np.log10(counts + 0.5) - np.log10(mass[self.of])).astype(np.float32)
        self.start_class = np.zeros(self.classes, bool)
        self.start_class[self.of[starts]] = True
        rng = np.random.Generator(np.random.PCG64(seed))
        d, c = dim, self.classes
        init = lambda *shape, scale=1.0: (rng.standard_normal(shape) * (scale / np.sqrt(shape[0]))).astype(np.float32)
        live = np.bincount(self.of, minlength=c) > 0
        self.p = {
            "E": init(rows, d, scale=np.sqrt(rows) * 0.3), "B": np.zeros(2 * size, np.float32), "W": init(d, 3 * d), "O": init(d, d, scale=0.3), "W1": init(d, 2 * d), "b1": np.zeros(2 * d, np.float32),
            "W2": init(2 * d, d, scale=0.3), "C": init(d, c, scale=0.3), "bc": np.where(live, np.log((mass + 1) / (mass.sum() + c)), -60).astype(np.float32),
        }

    def copy(self) -> AttentionLM:
        """A model that shares all but the parameters."""
        out = object.__new__(AttentionLM)
        out.__dict__.update(self.__dict__)
        out.p = {k: v.copy() for k, v in self.p.items()}
        return out

    def flat(self) -> np.ndarray:
        """All parameters as one vector of doubles."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(float)

    def load(self, flat: np.ndarray) -> AttentionLM:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self

    def fit(self, windows: np.ndarray, order: np.ndarray, rate: float, warm: int = 0, batch: int = 64) -> AttentionLM:
        """Adam over ``windows`` (ids in rows, -1 for none), in batches of ``order``; the rate falls to a tenth."""
        f = _Fit(self, windows)
        m1, m2, t = np.zeros_like(f.flat), np.zeros_like(f.flat), np.empty_like(f.flat)
        steps = -(-len(order) // batch)
        for step in range(1, steps + 1):
            g = f.gradient(order[(step - 1) * batch : step * batch])
            lr = rate * min(1.0, step / max(1, warm)) * (1 - 0.9 * step / steps)
            # the moments are kept as 10 and 100 times their values
            m1 *= np.float32(0.9)
            m1 += g
            m2 *= np.float32(0.99)
            m2 += np.multiply(g, g, out=t)
            level = np.sqrt(1 - 0.99**step)
            np.sqrt(m2, out=t)
            t += np.float32(1e-7 * level)
            np.divide(m1, t, out=t)
            t *= np.float32(lr * level / (1 - 0.9**step))
            f.flat -= t
        for k, v in f.parts(f.p).items():
            self.p[k] = v
        return self

    def _mask(self) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each input from each scored one, and whether it is not after it."""
        apart = self.size + np.arange(self.size)[:, None] - np.arange(2 * self.size)
        return np.clip(apart, 0, 2 * self.size - 1), apart >= 0

    def _gradient(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        f = _Fit(self, windows)
        f.gradient(np.arange(len(windows)))
        return f.parts(f.g, np.zeros_like(self.p["E"]))

    def log10(self, tokens: np.ndarray, offsets: np.ndarray, chunk: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(each, ends) of every place: log10 probability of its id, and that a word starts there.

        The id of a place that starts a word is given that one does. Both are 0 at the first
        place of a sequence. Every product has the same shape, whatever is scored beside.
        """
        p, d, size, c = self.p, self.dim, self.size, self.classes
        apart, before = self._mask()
        bias = np.ascontiguousarray(np.where(before, np.exp(np.minimum(p["B"][apart], 30)), 0).T.astype(np.float32))
        # what an input asks for, its embedding, key and value depend on its id only; the last row, for places
        # without an id, is worth nothing; the column of ones sums the weights
        none = len(p["E"])
        table = np.zeros((none + 1, 4 * d + 2), np.float32)
        asks, own, keys, values = table[:, :d], table[:, d : 2 * d + 1], table[:, 2 * d + 1 : 3 * d + 1], table[:, 3 * d + 1 :]
        asks[:-1], own[:-1, :d], keys[:-1] = p["E"] @ p["W"][:, :d] * np.float32(1 / np.sqrt(d)), p["E"], p["E"] @ p["W"][:, d : 2 * d]
        values[:-1, :d], values[:-1, d] = p["E"] @ (p["W"][:, 2 * d :] @ p["O"]), 1
        # divided by itself, that column is the one that the biases go with
        w1, w2, out = np.vstack((p["W1"], p["b1"])), np.pad(p["W2"], ((0, 0), (0, 1))), np.vstack((p["C"], p["bc"]))
        ones, begins = np.ones(c, np.float32), self.start_class.astype(np.float32)
        # a sequence is a block of no ids and the blocks of its ids; a block is read with the one before it
        length = np.diff(offsets)
        blocks = np.maximum(0, -(-(length - 1) // size))
        last = np.cumsum(blocks + 1)
        slot = np.arange(len(tokens)) + np.repeat((last - blocks) * size - offsets[:-1], length)
        total = -(-int(last[-1] if len(last) else 0) // chunk) * chunk
        first = np.zeros(len(tokens), bool)
        first[offsets[:-1][length > 0]] = True
        goal = np.flatnonzero(~first)
        row = np.full((total + 1) * size, none, np.int64)
        row[slot[goal] + size - 1] = self.row[tokens[goal - 1]]
        asked, nxt = slot[goal] - 1, tokens[goal]
        cell = asked % (chunk * size)
        right_one = cell * c + self.of[nxt]
        hit, mass, starting = (np.empty(len(goal), np.float32) for _ in range(3))
        qt, s, h, logits = (np.empty(x, np.float32) for x in ((chunk, d, size), (chunk, 2 * size, size), (chunk, size, d + 1), (chunk * size, c)))
        x, z = np.empty(((chunk + 1) * size, table.shape[1]), np.float32), np.empty((chunk, size, 2 * d), np.float32)
        mine = x[size:].reshape(chunk, size, -1)
        pairs = np.lib.stride_tricks.as_strided(x, (chunk, 2 * size, x.shape[1]), (size * x.strides[0], *x.strides), writeable=False)
        bounds = np.searchsorted(asked, np.arange(0, (total + 1) * size, chunk * size))
        for lo, left, right in zip(range(0, total, chunk), bounds[:-1], bounds[1:], strict=True):
            if left == right:
                continue
            table.take(row[lo * size : (lo + chunk + 1) * size], axis=0, out=x, mode="clip")
            # one product a window, or of as many rows as always: rounding doesn't depend on its neighbours
            np.copyto(qt, mine[:, :, :d].transpose(0, 2, 1))
            np.matmul(pairs[:, :, 2 * d + 1 : 3 * d + 1], qt, out=s)
            if s.max() > 50:
                np.minimum(s, 50, out=s)
            np.exp(s, out=s)
            s *= bias
            np.matmul(s.transpose(0, 2, 1), pairs[:, :, 3 * d + 1 :], out=h)
            h /= h[:, :, d:] + np.float32(1e-30)
            h += mine[:, :, d : 2 * d + 1]
            np.matmul(h, w1, out=z)
            np.maximum(z, 0, out=z)
            h += np.matmul(z, w2)
            np.matmul(h, out, out=logits.reshape(chunk, size, c))
            if logits.max() > 60:
                np.minimum(logits, 60, out=logits)
            logits.take(right_one[left:right], out=hit[left:right], mode="clip")
            np.exp(logits, out=logits)
            at = cell[left:right]
            (logits @ ones).take(at, out=mass[left:right], mode="clip")
            (logits @ begins).take(at, out=starting[left:right], mode="clip")
        np.log(mass, out=mass)
        np.log(starting, out=starting)
        each, ends = np.zeros(len(tokens), np.float32), np.zeros(len(tokens), np.float32)
        each[goal] = (hit - np.where(self.starts[nxt], starting, mass)) * LOG10 + self.within[nxt]
        ends[goal] = (starting - mass) * LOG10
        return each, ends


def _product(x: np.ndarray, y: np.ndarray, n: int, out: np.ndarray) -> None:
    """x.T @ y as a sum of ``n`` products, which take less time than one of so many rows."""
    np.matmul(x.reshape(n, -1, x.shape[1]).transpose(0, 2, 1), y.reshape(n, -1, y.shape[1])).sum(axis=0, out=out)


class _Fit:
    """A model's parameters in one vector, and their gradient, over given windows.

    Only the embeddings that occur in the windows are held, and one of zeros for places
    without an id: the others have no gradient, so Adam leaves them as they are. Each
    embedding ends in a constant one (zero: no id). It carries the biases, as last rows of
    W1 and C, and sums the weights of attention, through a last column of W.
    """

    def __init__(self, model: AttentionLM, windows: np.ndarray):
        self.model, d, c, size = model, model.dim, model.classes, model.size
        inputs, target = windows[:, :-1], windows[:, size + 1 :]
        row = model.row[np.maximum(inputs, 0)]
        held = np.bincount(row[inputs >= 0], minlength=len(model.p["E"])) > 0
        self.used = np.flatnonzero(held)
        slot = np.cumsum(held) - 1
        self.rows = np.where(inputs >= 0, slot[row], len(self.used))
        self.live = ((target >= 0) & (inputs[:, size:] >= 0)).astype(np.float32)
        self.of = model.of[np.maximum(target, 0)].astype(np.int64)
        # transposed: inputs by scored places
        apart, before = model._mask()
        self.apart, self.before = np.ascontiguousarray(apart.T), np.ascontiguousarray(before.T.astype(np.float32))
        shapes = {"E": (len(self.used) + 1, d + 1), "B": (2 * size,), "W": (d + 1, 3 * d + 1), "O": (d + 1, d + 1), "W1": (d + 1, 2 * d), "W2": (2 * d, d + 1), "C": (d + 1, c)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        self.flat, self.grad = np.zeros(ends[-1], np.float32), np.zeros(ends[-1], np.float32)
        self.p, self.g = ({k: part.reshape(s) for (k, s), part in zip(shapes.items(), np.split(x, ends[:-1]), strict=True)} for x in (self.flat, self.grad))
        own, p = model.p, self.p
        p["E"][:-1, :d], p["E"][:-1, d] = own["E"][self.used], 1
        p["B"][:], p["O"][:d, :d], p["W2"][:, :d] = own["B"], own["O"], own["W2"]
        p["W"][:d, : 3 * d], p["W"][d, 3 * d] = own["W"], 1
        p["W1"][:d], p["W1"][d], p["C"][:d], p["C"][d] = own["W1"], own["b1"], own["C"], own["bc"]
        self.cells = np.arange(p["E"].size).reshape(p["E"].shape)
        self.ones = np.ones(c, np.float32)
        self._room(0)

    def parts(self, x: dict[str, np.ndarray], rest: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """The model's parameters, or their gradient, of ``x``; ``rest`` holds the embeddings that don't occur."""
        d = self.model.dim
        e = self.model.p["E"] if rest is None else rest
        e[self.used] = x["E"][:-1, :d]
        own = {"C": x["C"][:d], "bc": x["C"][d], "W2": x["W2"][:, :d], "W1": x["W1"][:d], "b1": x["W1"][d], "O": x["O"][:d, :d], "B": x["B"], "W": x["W"][:d, : 3 * d], "E": e}
        return {k: v.copy() for k, v in own.items()}

    def _room(self, n: int) -> None:
        """Arrays for ``n`` windows; ``dy`` is 0 where nothing is written."""
        d, c, size = self.model.dim, self.model.classes, self.model.size
        self.n, self.start = n, np.arange(n * size) * c
        self.y, self.dy = (np.zeros((n, 2 * size, 3 * d + 1), np.float32) for _ in range(2))
        self.s, self.ds = (np.empty((n, 2 * size, size), np.float32) for _ in range(2))
        self.qt, self.dut, self.u, self.du = (np.empty((n, *x), np.float32) for x in ((d, size), (d + 1, size), (size, d + 1), (size, d + 1)))
        self.dl, self.dx = np.empty((n, size, c), np.float32), np.empty((n, 2 * size, d + 1), np.float32)

    def gradient(self, at: np.ndarray) -> np.ndarray:
        """The gradient of the mean loss of the windows ``at``; it is overwritten by the next."""
        p, g, d, size, n = self.p, self.g, self.model.dim, self.model.size, len(at)
        if n != self.n:
            self._room(n)
        few = np.gcd(n, 16)
        rows, live, scale = self.rows.take(at, axis=0).ravel(), self.live.take(at, axis=0).ravel(), np.float32(1 / np.sqrt(d))
        w = p["W"].copy()
        w[:, :d] *= scale
        x = p["E"].take(rows, axis=0)
        y, s, u, dl, du, ds, dy, dx = self.y, self.s, self.u, self.dl, self.du, self.ds, self.dy, self.dx
        np.matmul(x.reshape(few, -1, d + 1), w, out=y.reshape(few, -1, 3 * d + 1))
        q, k, v = y[:, size:, :d], y[:, :, d : 2 * d], y[:, :, 2 * d :]
        np.copyto(self.qt, q.transpose(0, 2, 1))
        np.matmul(k, self.qt, out=s)
        if s.max() > 50:
            s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        bias = np.exp(np.minimum(p["B"], 30)).take(self.apart)
        bias *= self.before
        s *= bias
        np.matmul(s.transpose(0, 2, 1), v, out=u)
        over = 1 / (u[:, :, d:] + np.float32(1e-30))
        u *= over
        h = np.matmul(u, p["O"])
        h += x.reshape(n, 2 * size, d + 1)[:, size:]
        z = np.matmul(h, p["W1"])
        np.maximum(z, 0, out=z)
        h2 = np.matmul(z, p["W2"])
        h2 += h
        u, h, z, h2 = (a.reshape(n * size, -1) for a in (u, h, z, h2))
        # dl: the classes' masses, less all of them at the right one; what they are divided by goes with narrower factors
        np.matmul(h2.reshape(few, -1, d + 1), p["C"], out=dl.reshape(few, n // few * size, -1))
        if dl.max() > 60:
            dl -= dl.max(axis=2, keepdims=True)
        np.exp(dl, out=dl)
        dl = dl.reshape(n * size, -1)
        mass = dl @ self.ones
        mass += np.float32(1e-30)
        self.dl.reshape(-1)[self.start + self.of.take(at, axis=0).ravel()] -= mass
        part = (live / (mass * max(1.0, live.sum())))[:, None]
        h2 *= part
        _product(h2, dl, few, g["C"])
        dh = np.matmul(dl.reshape(few, n // few * size, -1), np.ascontiguousarray(p["C"].T)).reshape(n * size, d + 1)
        dh *= part
        _product(z, dh, few, g["W2"])
        dz = dh @ np.ascontiguousarray(p["W2"].T)
        dz *= z > 0
        _product(h, dz, few, g["W1"])
        dh += dz @ np.ascontiguousarray(p["W1"].T)
        _product(u, dh, few, g["O"])
        # by softmax, a weight's share less what all share: the last column takes that off where there is an id
        flat = du.reshape(n * size, d + 1)
        np.matmul(dh, np.ascontiguousarray(p["O"].T), out=flat)
        u *= flat
        np.negative(u @ self.ones[: d + 1], out=flat[:, d])
        du *= over
        np.copyto(self.dut, du.transpose(0, 2, 1))
        np.matmul(v, self.dut, out=ds)
        ds *= s
        g["B"][:] = np.bincount(self.apart.ravel(), ds.sum(axis=0).ravel(), 2 * size)
        np.matmul(ds.transpose(0, 2, 1), k, out=dy[:, size:, :d])
        np.matmul(ds, q, out=dy[:, :, d : 2 * d])
        np.matmul(s, du[:, :, :d], out=dy[:, :, 2 * d : 3 * d])
        _product(x, dy.reshape(n * 2 * size, -1), few, g["W"])
        g["W"][:, :d] *= scale
        np.matmul(dy.reshape(few, n // few * 2 * size, -1), np.ascontiguousarray(w.T), out=dx.reshape(few, -1, d + 1))
        dx[:, size:] += dh.reshape(n, size, d + 1)
        g["E"][:] = 0
        np.add.at(g["E"].reshape(-1), self.cells.take(rows, axis=0).ravel(), dx.ravel())
        # what is constant stays
        g["E"][-1], g["E"][:, d], g["W"][d], g["W"][:, 3 * d], g["O"][d], g["O"][:, d], g["W2"][:, d] = 0, 0, 0, 0, 0, 0, 0
        return self.grad
