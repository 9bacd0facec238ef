"""A small causal self-attention model over subword ids, in numpy.

One layer with several heads and a feed-forward part. The next id is predicted in two steps: its class from the context, then the id within its class
from the same context. Frequent ids are in classes of ``SIZE``; the others share a few classes, within
which counts over the whole training corpus decide. All steps are proper distributions, so the score of a text is its
probability under the model.

A softmax weighs by powers of two, linear between whole exponents: adding to the bits of a float does that, for a tenth of the time
of an exponential. Gradients are those of this function, and what is learned and what is scored is the same model.

Training is split into rounds. In a round each task begins with the same weights, makes Adam
steps over its own windows, and the changes are averaged by numbers of windows.
"""

from __future__ import annotations

import ctypes
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

WINDOW = 32
STRIDE = 26
WIDTH, HEADS, HIDDEN = 24, 2, 32
#: Classes of frequent ids, ids in each, and classes for the rest.
CLASSES, SIZE, TAIL = 64, 64, 16
SYMBOLS = CLASSES * SIZE + TAIL
BATCH, RATE = 128, 0.04
_SEEN = np.tril(np.ones((WINDOW, WINDOW), bool))
_LOG2E = 1.4426950408889634
#: Exponents of two that logits are kept to.
_LEAST, _MOST = -100, 60
#: Windows whose contexts are computed together in scoring and in training, whose probabilities are, and rows of a softmax at a time.
_CHUNK, _LEARNED, _TOGETHER, _ROWS = 32, 64, 512, 1024
#: Weights that a step of training changes at a time.
_SPAN = 8192


@lru_cache(maxsize=1)
def _keep_memory() -> None:
    """The C library keeps up to 64 MB that are free: arrays of a step are of the same sizes as those of the one before, and getting fresh pages for them takes a third of the time."""
    with suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD


@dataclass
class Vocabulary:
    """Class of each id, its place in the class (negative in those of the rest), its input symbol, and its log probability within a class of the rest."""

    classes: np.ndarray
    members: np.ndarray
    symbols: np.ndarray
    within: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        n = len(counts)
        members, symbols, within = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n)
        ids = np.lexsort([np.arange(n), -counts])
        own, rest = ids[: CLASSES * SIZE], ids[CLASSES * SIZE :]
        symbols[own], members[own] = np.arange(len(own)), np.arange(len(own)) % SIZE
        classes = symbols // SIZE
        if len(rest):
            # Classes of the rest have about the same mass.
            smooth = counts[rest] + 1.0
            mass = np.cumsum(smooth)
            bins = np.minimum((mass - smooth) / mass[-1] * TAIL, TAIL - 1).astype(np.int64)
            classes[rest], symbols[rest] = CLASSES + bins, CLASSES * SIZE + bins
            within[rest] = np.log10(smooth / np.bincount(bins, weights=smooth, minlength=TAIL)[bins])
        return Vocabulary(classes.astype(np.int32), members, symbols, within)


def _by_class(classes: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows whose target is a frequent id, class by class, and for each class that occurs where its rows begin and end."""
    order = np.argsort(np.where(members < 0, CLASSES, classes).astype(np.int16), kind="stable")[: np.count_nonzero(members >= 0)]
    edges = np.searchsorted(classes[order], np.arange(CLASSES + 1))
    return order, [(c, edges[c], edges[c + 1]) for c in np.flatnonzero(np.diff(edges)).tolist()]


def _bits(dtype: np.dtype) -> tuple[type, float, float]:
    """The integers of a float's size, what a whole exponent is in its bits, and the bits of one."""
    return (np.int32, float(1 << 23), float(127 << 23)) if dtype == np.float32 else (np.int64, float(1 << 52), float(1023 << 52))


def _powers(x: np.ndarray, least: float | None = None) -> np.ndarray:
    """In place, the powers of two whose bits ``x`` says."""
    whole, unit, one = _bits(x.dtype)
    np.clip(x, x.dtype.type(one + _LEAST * unit if least is None else least), x.dtype.type(one + _MOST * unit), out=x)
    np.copyto(x.view(whole), x, casting="unsafe")
    return x


def _slopes(powers: np.ndarray) -> np.ndarray:
    """What each power gains for a whole exponent: the power of two without its fraction."""
    whole, unit, _ = _bits(powers.dtype)
    return np.bitwise_and(powers.view(whole), whole(-int(unit))).view(powers.dtype)


def _pieces(groups: list[tuple[int, int, int]], size: int = _ROWS) -> list[list[tuple[int, int, int]]]:
    """Groups of rows dealt into pieces of so many rows at most; a large group goes on in the next piece."""
    out: list[list[tuple[int, int, int]]] = []
    for c, a, b in groups:
        while a < b:
            if not out or a - out[-1][0][1] >= size:
                out.append([])
            stop = min(b, (out[-1][0][1] if out[-1] else a) + size)
            out[-1].append((c, a, stop))
            a = stop
    return out


def _errors(powers: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradients of rows of logits, in base two, for the row's target and weight."""
    at = np.arange(0, powers.size, powers.shape[1]) + targets
    slopes = _slopes(powers)
    own = weight * slopes.take(at) / powers.take(at)
    slopes *= (weight / (powers @ np.ones(powers.shape[1], powers.dtype)))[:, None]
    slopes.reshape(-1)[at] -= own
    return slopes


@dataclass
class Model:
    """Weights, of fixed size."""

    vocabulary: Vocabulary
    weights: dict[str, np.ndarray]
    end: int

    @staticmethod
    def new(vocabulary: Vocabulary, counts: np.ndarray, end: int, seed: int = 11) -> Model:
        """As it starts: classes are as frequent as they are counted."""
        rng = np.random.default_rng(seed)
        classes, w = CLASSES + TAIL, WIDTH
        shape = {"embed": (SYMBOLS, w), "place": (WINDOW, w), "qkv": (w, 3 * w), "o": (w, w), "up": (w, HIDDEN), "up_bias": (HIDDEN,), "down": (HIDDEN, w), "out": (w, classes), "bias": (classes,), "inner": (CLASSES, w, SIZE), "inner_bias": (CLASSES, SIZE)}
        scale = {"embed": 0.3, "place": 0.1, "bias": 0, "up_bias": 0, "inner_bias": 0, "down": 0.1}
        weights = {n: rng.normal(0, scale.get(n, 0.2), s).astype(np.float32) for n, s in shape.items()}
        seen = np.bincount(vocabulary.classes, weights=counts, minlength=classes) + 0.5
        weights["bias"][:] = np.log(seen / seen.sum())
        own = vocabulary.members >= 0
        weights["inner_bias"][vocabulary.classes[own], vocabulary.members[own]] = np.log(counts[own] + 0.5)
        weights["inner_bias"] -= weights["inner_bias"].max(axis=1, keepdims=True)
        return Model(vocabulary, weights, end)

    def _scaled(self) -> dict[str, np.ndarray]:
        """Weights whose products are bits of powers of two: of queries, and of both predictions with their biases in the last row."""
        w = self.weights
        _, unit, one = _bits(w["out"].dtype)
        by = w["out"].dtype.type(_LOG2E * unit)
        qkv = w["qkv"].copy()
        qkv[:, :WIDTH] *= by * w["qkv"].dtype.type((WIDTH // HEADS) ** -0.5)
        out = np.empty((WIDTH + 1, CLASSES + TAIL), by.dtype)
        np.multiply(w["out"], by, out=out[:WIDTH])
        np.multiply(w["bias"], by, out=out[WIDTH])
        inner = np.empty((CLASSES, WIDTH + 1, SIZE), by.dtype)
        np.multiply(w["inner"], by, out=inner[:, :WIDTH])
        np.multiply(w["inner_bias"], by, out=inner[:, WIDTH])
        out[WIDTH] += by.dtype.type(one)
        inner[:, WIDTH] += by.dtype.type(one)
        return {"qkv": qkv, "out": out, "inner": inner, "mask": np.where(_SEEN, one, -1e30).astype(by.dtype)}

    def _tables(self, scaled: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """With them, what each symbol and each place adds to queries, keys and values."""
        return scaled | {"by_symbol": self.weights["embed"] @ scaled["qkv"], "by_place": self.weights["place"] @ scaled["qkv"]}

    def _forward(self, symbols: np.ndarray, scaled: dict[str, np.ndarray] | None = None, fresh: int = 0) -> tuple[np.ndarray, tuple]:
        """Contexts of all places from ``fresh`` on, and what gradients need."""
        w, s = self.weights, scaled or self._scaled()
        b, n = symbols.shape
        x = w["embed"].take(symbols[:, fresh:], axis=0)
        x += w["place"][fresh:]
        flat = x.reshape(-1, WIDTH)
        if "by_symbol" in s:
            qkv = s["by_symbol"].take(symbols, axis=0)
            qkv += s["by_place"]
        else:
            qkv = flat @ s["qkv"]
        q, k, v = qkv.reshape(b, n, 3, HEADS, WIDTH // HEADS).transpose(2, 0, 3, 1, 4)
        a = q[:, :, fresh:] @ k.transpose(0, 1, 3, 2)
        a += s["mask"][fresh:]
        _powers(a, 0)
        # A context that sees nothing is all but impossible, and zero.
        share = 1 / np.maximum(a.reshape(-1, n) @ np.ones(n, a.dtype), np.finfo(a.dtype).tiny).reshape(b, HEADS, n - fresh, 1)
        z = np.empty((b, n - fresh, HEADS, WIDTH // HEADS), a.dtype)
        heads = z.transpose(0, 2, 1, 3)
        np.matmul(a, v, out=heads)
        heads *= share
        z = z.reshape(-1, WIDTH)
        h = z @ w["o"]
        h += flat
        f = h @ w["up"]
        f += w["up_bias"]
        np.maximum(f, 0, out=f)
        top = f @ w["down"]
        top += h
        return top, (flat, q, k, v, a, share, z, h, f)

    def _log_probability(self, h: np.ndarray, targets: np.ndarray, scaled: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Base-10 logarithms for rows of context and the ids that follow."""
        s = scaled or self._scaled()
        h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
        classes, members = self.vocabulary.classes.take(targets), self.vocabulary.members.take(targets)
        own, total = np.ones((2, 2, len(h)))
        for i in range(0, len(h), _ROWS):
            x = _powers(h[i : i + _ROWS] @ s["out"])
            own[0, i : i + _ROWS] = x[np.arange(len(x)), classes[i : i + _ROWS]]
            total[0, i : i + _ROWS] = x @ np.ones(x.shape[1], x.dtype)
        rows, groups = _by_class(classes, members)
        inside, member = h.take(rows, axis=0), members.take(rows)
        picked, whole = np.empty((2, len(rows)))
        for piece in _pieces(groups):
            i, j = piece[0][1], piece[-1][2]
            x = _powers(self._inside(inside, piece, s))
            picked[i:j] = x[np.arange(j - i), member[i:j]]
            whole[i:j] = x @ np.ones(SIZE, x.dtype)
        own[1, rows], total[1, rows] = picked, whole
        # Powers of two are linear between whole exponents, so these are exact shares.
        own /= total
        return np.log10(own[0]) + np.log10(own[1]) + self.vocabulary.within.take(targets)

    def _inside(self, h: np.ndarray, piece: list[tuple[int, int, int]], scaled: dict[str, np.ndarray]) -> np.ndarray:
        """Bits of powers within classes, for a piece of rows that stand class by class."""
        begin = piece[0][1]
        out = np.empty((piece[-1][2] - begin, SIZE), h.dtype)
        for c, a, b in piece:
            np.matmul(h[a:b], scaled["inner"][c], out=out[a - begin : b - begin])
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each sequence of ids with the end behind it. Windows overlap; every id is scored in one of them."""
        _keep_memory()
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        if not len(sizes):
            return np.zeros(0)
        end = np.array([self.end], np.int64)
        stream = np.concatenate([x for t in texts for x in (end, t)] + [end]).astype(np.int64)  # inputs; targets are one further
        begins = np.cumsum(sizes) - sizes
        symbols = self.vocabulary.symbols.take(stream)
        windows = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
        owner = np.repeat(np.arange(len(texts)), windows)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = begins[owner] + turn * STRIDE
        stop = (begins + sizes)[owner]
        out = np.zeros(len(texts))
        s = self._tables(self._scaled())
        # What a window shares with the one before is seen, but not worked out again.
        for fresh, some in ((0, np.flatnonzero(turn == 0)), (WINDOW - STRIDE, np.flatnonzero(turn))):
            long = WINDOW - fresh
            for at in range(0, len(some), _TOGETHER):
                own = some[at : at + _TOGETHER]
                index = start[own, None] + np.arange(WINDOW)
                scored = np.flatnonzero(index[:, fresh:] < stop[own, None])
                inputs = symbols.take(np.minimum(index, len(stream) - 1))
                h = np.concatenate([self._forward(inputs[i : i + _CHUNK], s, fresh)[0] for i in range(0, len(inputs), _CHUNK)])
                got = self._log_probability(h.take(scored, axis=0), stream.take(index[:, fresh:].reshape(-1).take(scored) + 1), s)
                mine = owner[own]
                out[mine[0] : mine[-1] + 1] += np.bincount(mine.take(scored // long) - mine[0], weights=got, minlength=mine[-1] - mine[0] + 1)
        return out

    def gradients(self, symbols: np.ndarray, targets: np.ndarray, into: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of ids, added to ``into``; a negative target counts for nothing."""
        w, s = self.weights, self._scaled()
        g = into or {n: np.zeros_like(x) for n, x in w.items()}
        kind = w["out"].dtype.type
        b, n = targets.shape
        flat = targets.reshape(-1)
        classes, members = self.vocabulary.classes.take(flat, mode="clip"), np.where(flat >= 0, self.vocabulary.members.take(flat, mode="clip"), -1)
        weight = (flat >= 0) * kind(_LOG2E / max(1, np.count_nonzero(flat >= 0)))
        top, dtop, dx = np.ones((len(flat), WIDTH + 1), kind), np.zeros((len(flat), WIDTH), kind), np.empty((len(flat), WIDTH), kind)
        kept = []
        for i in range(0, b, _LEARNED):
            h, found = self._forward(symbols[i : i + _LEARNED], s)
            top[i * n : i * n + len(h), :WIDTH] = h
            kept.append(found)
        rows, groups = _by_class(classes, members)
        own, member, most = top.take(rows, axis=0), members.take(rows), weight.take(rows)
        back = np.empty((len(rows), WIDTH), kind)
        for piece in _pieces(groups):
            i, j = piece[0][1], piece[-1][2]
            errors = _errors(_powers(self._inside(own, piece, s)), member[i:j], most[i:j])
            for c, first, last in piece:
                e = errors[first - i : last - i]
                both = own[first:last].T @ e
                g["inner"][c] += both[:WIDTH]
                g["inner_bias"][c] += both[WIDTH]
                np.matmul(e, w["inner"][c].T, out=back[first:last])
        dtop[rows] = back
        halves = np.repeat(np.eye(HEADS, dtype=kind), WIDTH // HEADS, axis=0)
        _, unit, _ = _bits(top.dtype)
        for i, (x, q, k, v, a, share, z, h, f) in zip(range(0, b * n, _LEARNED * n), kept):
            j = i + len(x)
            errors = _errors(_powers(top[i:j] @ s["out"]), classes[i:j], weight[i:j])
            both = top[i:j].T @ errors
            g["out"] += both[:WIDTH]
            g["bias"] += both[WIDTH]
            d = dtop[i:j]
            d += errors @ w["out"].T
            df = d @ w["down"].T
            df *= f > 0
            dh = df @ w["up"].T
            dh += d
            g["down"] += f.T @ d
            g["up"] += h.T @ df
            g["up_bias"] += df.sum(axis=0)
            g["o"] += z.T @ dh
            dz = dh @ w["o"].T
            bias = ((dz * z) @ halves).reshape(-1, n, HEADS).transpose(0, 2, 1)[..., None] * share
            dz = dz.reshape(-1, n, HEADS, WIDTH // HEADS).transpose(0, 2, 1, 3) * share
            ds = dz @ v.transpose(0, 1, 3, 2)
            ds -= bias
            ds *= _slopes(a)
            dqkv = np.empty((len(x) // n, n, 3, HEADS, WIDTH // HEADS), kind)
            dq, dk, dv = dqkv.transpose(2, 0, 3, 1, 4)
            np.matmul(ds, k, out=dq)
            np.matmul(ds.transpose(0, 1, 3, 2), q, out=dk)
            np.matmul(a.transpose(0, 1, 3, 2), dz, out=dv)
            dq *= kind(_LOG2E * (WIDTH // HEADS) ** -0.5)
            dk *= kind(1 / unit)
            dqkv = dqkv.reshape(-1, 3 * WIDTH)
            g["qkv"] += x.T @ dqkv
            np.matmul(dqkv, w["qkv"].T, out=dx[i:j])
            dx[i:j] += dh
        g["place"] += dx.reshape(b, n, WIDTH).sum(axis=0)
        at = symbols.reshape(-1).astype(np.int16)
        order = np.argsort(at, kind="stable")
        at = at.take(order)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        g["embed"][at.take(first)] += np.add.reduceat(dx.take(order, axis=0), first, axis=0)
        return g

    def trained(self, windows: np.ndarray, rate: float, seed: int) -> Model:
        """A model after Adam steps over all windows once, in a drawn order.

        ``windows`` holds rows of an input and ``WINDOW`` targets, negative where there are none.
        """
        _keep_memory()
        w = self.packed()
        model = self._of(w)
        if not len(windows):
            return model
        rng = np.random.default_rng(seed)
        m, s, g, t1 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), np.empty(_SPAN, w.dtype)
        grads = self._of(g).weights
        order = rng.permutation(len(windows))
        for t in range(1, 1 + -(-len(windows) // BATCH)):
            part = windows[order[(t - 1) * BATCH : t * BATCH]]
            inputs, targets = np.where(part[:, :-1] < 0, self.end, part[:, :-1]), part[:, 1:]
            g[:] = 0
            model.gradients(self.vocabulary.symbols.take(inputs), targets, grads)
            # Sums m and s are those of Adam without their factors 0.1 and 0.02, which the step brings back.
            least = w.dtype.type(1e-8 * ((1 - 0.98**t) / 0.02) ** 0.5)
            step = w.dtype.type(rate * 0.1 / (1 - 0.9**t) * ((1 - 0.98**t) / 0.02) ** 0.5)
            for i in range(0, len(w), _SPAN):
                mi, si, gi, wi = (x[i : i + _SPAN] for x in (m, s, g, w))
                ti = t1[: len(mi)]
                mi *= w.dtype.type(0.9)
                mi += gi
                gi *= gi
                si *= w.dtype.type(0.98)
                si += gi
                np.sqrt(si, out=ti)
                ti += least
                np.divide(mi, ti, out=ti)
                ti *= step
                wi -= ti
        return model

    def _of(self, packed: np.ndarray) -> Model:
        """A model whose weights are parts of the vector."""
        ends = np.cumsum([x.size for x in self.weights.values()])
        return Model(self.vocabulary, {n: x.reshape(y.shape) for (n, y), x in zip(self.weights.items(), np.split(packed, ends[:-1]))}, self.end)

    def packed(self) -> np.ndarray:
        """All weights in one vector."""
        return np.concatenate([x.ravel() for x in self.weights.values()])

    def moved(self, change: np.ndarray) -> Model:
        """The model with the vector added to its weights."""
        return self._of(self.packed() + change.astype(np.float32))
