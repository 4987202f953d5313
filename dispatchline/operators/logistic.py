"""Multinomial logistic regression over TF-IDF of words and character grams, solved inside one task from the texts.

The product of the matrix of character grams with a vector is taken through the distinct words: grams lie within words, so
rows x grams is rows x words times words x grams, which has about a tenth of its entries and is never written out. The
objective is sum of weight * loss + |w|^2 / 2 with free intercepts (C = 1), minimised by Newton steps, each found by conjugate
gradients. The penalty bounds the curvature from below by 1, so |gradient|^2 / 2 bounds how far the objective is from its
minimum. Two classes go through a product at once, as the parts of complex numbers.

All rows count, however many. Texts become numbers as they come and are dropped; of a row its words, its terms and both
transposed stay, about 1.2 KB for 50 words. All but the words themselves lie in a mapped file where they take more than
``HELD`` bytes.

Edge cases: grams of fewer than two rows are left out; rows without grams have the intercepts only; a class without rows
has a probability of (nearly) nothing; without rows there are no grams and all classes are alike.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

MIN_DF = 2
#: Entries that are made or moved at once, and those a product looks up at once.
ENTRIES, AT_ONCE = 1_000_000, 65_536
#: Bytes of an array from which it lies in a file.
HELD = 256_000_000
#: Share of the objective by which it may exceed its minimum, and products of a Newton step.
NEAR, PRODUCTS = 1e-6, 200
#: Intercept of a class without rows, below the least of the others.
NEVER = 50.0


def _ragged(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _room(n: int) -> np.ndarray:
    """Space for n whole numbers."""
    if 4 * n < HELD:
        return np.empty(n, np.int32)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, np.int32, "w+", shape=(n,))


def _parts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many entries, or of one row."""
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


class _Side:
    """Sums over the entries of each row, where a row has any; an entry that counts twice is there twice."""

    def __init__(self, size: np.ndarray, other: np.ndarray) -> None:
        self.n, self.other, self.at = len(size), other, np.flatnonzero(size)
        ends = np.cumsum(size[self.at])
        self.parts = []
        for low, high in _parts(ends, AT_ONCE):
            start = int(ends[low - 1]) if low else 0
            self.parts.append((low, high, start, int(ends[high - 1]), np.append(0, ends[low : high - 1] - start)))

    def sums(self, v: np.ndarray) -> np.ndarray:
        own = np.empty(len(self.at), v.dtype)
        for low, high, start, end, first in self.parts:
            np.add.reduceat(v.take(self.other[start:end], mode="clip"), first, out=own[low:high])
        out = np.zeros(self.n, v.dtype)
        out[self.at] = own
        return out


class _Sparse:
    """A matrix of counts by the columns of each row's entries; products with vectors, complex ones too, from both sides."""

    def __init__(self, size: np.ndarray, col: np.ndarray, columns: int) -> None:
        ends, count = np.cumsum(size), np.zeros(columns, np.int64)
        for low, high in _parts(ends, ENTRIES):
            count += np.bincount(col[ends[low] - size[low] : ends[high - 1]], minlength=columns)
        row, to = _room(len(col)), np.cumsum(count) - count
        for low, high in _parts(ends, ENTRIES):
            part = col[ends[low] - size[low] : ends[high - 1]]
            order = np.argsort(part, kind="stable")
            keys, n = _runs(part[order])
            row[_ragged(to[keys], n)] = np.repeat(np.arange(low, high, dtype=np.int32), size[low:high])[order]
            to[keys] += n
        self.rows, self.columns = _Side(size, col), _Side(count, row)

    def times(self, v: np.ndarray) -> np.ndarray:
        return self.rows.sums(v)

    def back(self, v: np.ndarray) -> np.ndarray:
        return self.columns.sums(v)


class Lists:
    """Lists of strings by number, as they come."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.size = array("i"), array("q")

    def add(self, lists: Iterable[list[str]]) -> Lists:
        known = self.known
        for x in lists:
            self.ids.extend([known.setdefault(w, len(known)) for w in x])
            self.size.append(len(x))
        return self

    def add_texts(self, texts: Iterable[str]) -> Lists:
        return self.add([w for w in t.split(" ") if w] for t in texts)

    def numbered(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct strings, the number of each string of all lists, and the lengths of the lists."""
        return list(self.known), np.frombuffer(self.ids, np.int32) if self.ids else np.empty(0, np.int32), np.array(self.size, np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / (df + 1)) + 1


def _inverse(length: np.ndarray) -> np.ndarray:
    return np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)


class _Words:
    """Words and pairs of neighbours: rows x terms of length 1."""

    def __init__(self, texts: Lists) -> None:
        words, ids, size = texts.numbered()
        n, ends = len(size), np.cumsum(size)

        def cells() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            """Some rows: distinct keys of words and pairs, and the row, place among the keys and count of each cell."""
            for low, high in _parts(ends, ENTRIES):
                own = ids[ends[low] - size[low] : ends[high - 1]].astype(np.int64)
                row = np.repeat(np.arange(high - low), size[low:high])
                pair = row[1:] == row[:-1]
                keys, at = np.unique(np.concatenate([own, (own[:-1][pair] + 1 << 32) + own[1:][pair]]), return_inverse=True)
                both, tf = _runs(np.concatenate([row, row[1:][pair]]) * max(1, len(keys)) + at)
                yield low, high, keys, *np.divmod(both, max(1, len(keys))), tf

        keys, df, count = np.empty(0, np.int64), np.empty(0), np.empty(0)
        for _, _, more, _, at, tf in cells():
            keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
            df = np.bincount(place, np.concatenate([df, np.bincount(at, minlength=len(more))]), len(keys))
            count = np.bincount(place, np.concatenate([count, np.bincount(at, tf, len(more))]), len(keys))
        ok = df >= MIN_DF
        keys, df, self.count = keys[ok], df[ok], count[ok]
        self.idf, square, self.scale = _idf(n, df), np.zeros(len(keys)), np.zeros(n)
        col, sizes, end = _room(int(self.count.sum())), np.zeros(n, np.int64), 0
        for low, high, more, row, at, tf in cells():
            number = np.searchsorted(keys, more)
            number[np.append(keys, -1)[number] != more] = -1
            ok = number[at] >= 0
            row, term, tf = row[ok], number[at[ok]], tf[ok]
            v = tf * self.idf[term]
            length = np.bincount(row, v * v, high - low)
            square += np.bincount(term, v * v / np.maximum(length[row], 1e-300), len(keys))
            self.scale[low:high], sizes[low:high] = _inverse(np.sqrt(length)), np.bincount(row, tf, high - low)
            col[end : end + tf.sum()] = np.repeat(term, tf)
            end += tf.sum()
        self.names = [words[k] if k < 1 << 32 else f"{words[(k >> 32) - 1]} {words[k & 0xFFFFFFFF]}" for k in keys.tolist()]
        self.square = square / max(1, n)
        self.x = _Sparse(sizes, col, len(keys))

    def times(self, v: np.ndarray) -> np.ndarray:
        return self.x.times(v * self.idf.astype(v.real.dtype)) * self.scale

    def back(self, r: np.ndarray) -> np.ndarray:
        return self.x.back(r * self.scale.astype(r.real.dtype)) * self.idf


class _Chars:
    """Grams of 3 to 5 characters inside words padded with a blank: rows x words times words x grams, scaled to length 1."""

    def __init__(self, texts: Lists) -> None:
        words, ids, size = texts.numbered()
        grams, gram, parts = Lists().add([p[i : i + k] for k in (3, 4, 5) for i in range(len(p) - k + 1)] for p in (f" {w} " for w in words)).numbered()
        n, g = len(size), max(1, len(grams))
        start, ends = np.cumsum(parts) - parts, np.cumsum(size)
        entries = np.zeros(n, np.int64)
        for low, high in _parts(ends, ENTRIES):
            own = np.append(0, np.cumsum(parts[ids[ends[low] - size[low] : ends[high - 1]]]))
            entries[low:high] = np.diff(own[np.append(0, ends[low:high] - ends[low] + size[low])])
        entries = np.cumsum(entries)

        def cells() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Row, gram and count of the rows x grams, some rows at a time."""
            for low, high in _parts(entries, ENTRIES):
                w = ids[ends[low] - size[low] : ends[high - 1]]
                row = np.repeat(np.arange(low, high), size[low:high])
                found, tf = _runs(np.repeat(row, parts[w]) * g + gram[_ragged(start[w], parts[w])])
                yield found // g, found % g, tf

        df, count = np.zeros(len(grams), np.int64), np.zeros(len(grams))
        for _, at, tf in cells():
            df += np.bincount(at, minlength=len(grams))
            count += np.bincount(at, tf, len(grams))
        kept = np.flatnonzero(df >= MIN_DF)
        idf = np.where(df >= MIN_DF, _idf(n, df), 0.0)
        square, self.scale = np.zeros(len(grams)), np.zeros(n)
        for r, at, tf in cells():
            if len(r):
                v, low = tf * idf[at], r[0]
                length = np.bincount(r - low, v * v)
                self.scale[low : low + len(length)] += length
                square += np.bincount(at, v * v / np.maximum(length[r - low], 1e-300), len(grams))  # rows come whole
        self.scale = _inverse(np.sqrt(self.scale))
        self.square = square[kept] / max(1, n)
        number = np.full(len(grams), -1, np.int32)
        number[kept] = np.arange(len(kept))
        ok = number[gram] >= 0
        self.idf, self.count, self.names = idf[kept], count[kept], [grams[i] for i in kept]
        self.c = _Sparse(size, ids, len(words))
        left = np.bincount(np.repeat(np.arange(len(words)), parts)[ok], minlength=len(words))
        self.b = _Sparse(left, number[gram[ok]], len(kept))

    def times(self, v: np.ndarray) -> np.ndarray:
        return self.c.times(self.b.times(v * self.idf.astype(v.real.dtype))) * self.scale

    def back(self, r: np.ndarray) -> np.ndarray:
        return self.b.back(self.c.back(r * self.scale.astype(r.real.dtype))) * self.idf


def solve(words: Lists, chars: Lists, y: np.ndarray, classes: int, max_iter: int) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Blocks (with names, idf and count), coefficients (classes x terms of all blocks), intercepts, steps taken.

    ``words`` are the words of each row, ``chars`` those of which the grams are made, ``y`` classes by number. Steps
    reach ``max_iter`` if the minimum wasn't found before.
    """
    blocks = [_Words(words), _Chars(chars)]
    ends = np.cumsum([len(b.names) for b in blocks])
    m = int(ends[-1])
    hist = np.bincount(y, minlength=classes)
    present = np.flatnonzero(hist)
    k, n = len(present), len(y)
    coef, intercept = np.zeros((classes, m)), np.full(classes, 0.0 if not k else -NEVER)
    if k < 2:
        intercept[present] = 0.0
        return blocks, coef, intercept, 0
    own = np.searchsorted(present, y)
    weight = (n / (k * hist[y])).astype(float)
    every = np.arange(n)

    # the weights of all classes add up to 0 at each step, so the last one needs no products of its own; two go at once
    pairs = [(c, min(c + 1, k - 2)) for c in range(0, k - 1, 2)]

    def margins(w: np.ndarray, kind: type = np.complex128) -> np.ndarray:
        z = np.empty((k, n))
        for a, b in pairs:
            v = (w[a] + 1j * w[b]).astype(kind)
            x = blocks[0].times(v[: ends[0]]) + blocks[1].times(v[ends[0] : m]) + v[m]
            z[a], z[b] = x.real, x.imag
        z[k - 1] = -z[: k - 1].sum(axis=0)
        return z

    def back(p: np.ndarray, w: np.ndarray, kind: type = np.complex128) -> np.ndarray:
        g = np.empty((k, m + 1))
        for a, b in pairs:
            r = (p[a] + 1j * p[b]).astype(kind)
            x = np.concatenate([blocks[0].back(r), blocks[1].back(r)])
            g[a, :m], g[b, :m], g[a, m], g[b, m] = x.real, x.imag, p[a].sum(), p[b].sum()
        g[k - 1] = -g[: k - 1].sum(axis=0)
        g[:, :m] += w[:, :m]
        return g

    def at(w: np.ndarray, z: np.ndarray) -> tuple[float, np.ndarray]:
        """The objective, and the probabilities of the classes."""
        top = z.max(axis=0)
        p = np.exp(z - top)
        total = p.sum(axis=0)
        loss = float(weight @ (top + np.log(total) - z[own, every])) + 0.5 * float(np.vdot(w[:, :m], w[:, :m]))
        return loss, p / total

    def gradient(w: np.ndarray, p: np.ndarray) -> np.ndarray:
        r = p * weight
        r[own, every] -= weight
        return back(r, w)

    def newton(g: np.ndarray, p: np.ndarray, rest: float) -> tuple[np.ndarray, np.ndarray, int]:
        """A direction, its margins and the products taken: conjugate gradients until the residual is as small as ``rest``."""
        spread = np.array([float(weight @ (p[c] * (1 - p[c]))) for c in range(k)]).mean()
        scale = np.append(square * spread + 1.0, spread)
        d, dz, r = np.zeros_like(g), np.zeros_like(p), -g
        s = r / scale
        q, rho = s, float(np.vdot(r, s))
        for i in range(1, min(PRODUCTS, max_iter - steps) + 1):
            qz = margins(q, np.complex64)
            h = back(weight * p * (qz - (p * qz).sum(axis=0)), q, np.complex64)
            a = rho / float(np.vdot(q, h))
            d, dz, r = d + a * q, dz + a * qz, r - a * h
            if np.linalg.norm(r) <= rest:
                break
            s = r / scale
            old, rho = rho, float(np.vdot(r, s))
            q = s + rho / old * q
        return d, dz, i

    square = np.concatenate([b.square for b in blocks])
    w, z, steps = np.zeros((k, m + 1)), np.zeros((k, n)), 0
    loss, p = at(w, z)
    g = gradient(w, p)
    while (length := np.linalg.norm(g)) > (near := np.sqrt(2 * NEAR * loss)) and steps < max_iter:
        d, dz, taken = newton(g, p, max(0.5 * near, min(0.1, length / n) * length))
        slope, step = float(np.vdot(g, d)), 1.0
        for _ in range(40):
            after, p = at(w + step * d, z + step * dz)
            if after <= loss + 1e-4 * step * slope + 1e-12 * abs(loss):
                break
            step /= 2
        else:
            raise ValueError("no step lowers the loss")
        w, loss, steps = w + step * d, after, steps + taken
        z = margins(w)
        loss, p = at(w, z)
        g = gradient(w, p)
    if np.linalg.norm(g) > np.sqrt(2 * NEAR * loss):
        steps = max_iter
    coef[present], intercept[present] = w[:, :m], w[:, m]
    intercept[hist == 0] = w[:, m].min() - NEVER
    return blocks, coef, intercept, steps


class Scorer:
    """Probabilities of texts from blocks of (names, idf, coefficients by class) and intercepts."""

    def __init__(self, blocks: list[tuple[list[str], np.ndarray, np.ndarray]], intercept: np.ndarray) -> None:
        self.blocks, self.intercept = [({w: i for i, w in enumerate(names)}, idf, coef) for names, idf, coef in blocks], intercept

    def _margins(self, block: int, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        known, idf, coef = self.blocks[block]
        ok = term >= 0
        cells, tf = _runs(row[ok] * max(1, len(known)) + term[ok])
        row, term = np.divmod(cells, max(1, len(known)))
        v = tf * idf[term]
        v *= _inverse(np.sqrt(np.bincount(row, v * v, n)))[row]
        return np.array([np.bincount(row, v * c[term], n) for c in coef])

    def probabilities(self, words: list[str], chars: list[str]) -> np.ndarray:
        """Classes x texts; ``words`` and ``chars`` have a blank between words."""
        n, get = len(words), self.blocks[0][0].get
        lists = [[w for w in t.split(" ") if w] for t in words]
        lists = [x + [f"{a} {b}" for a, b in zip(x, x[1:])] for x in lists]
        z = self._margins(0, np.repeat(np.arange(n), [len(x) for x in lists]), np.fromiter((get(t, -1) for x in lists for t in x), np.int64), n)
        get = self.blocks[1][0].get
        names, ids, size = Lists().add_texts(chars).numbered()
        lists = [[get(p[i : i + k], -1) for k in (3, 4, 5) for i in range(len(p) - k + 1)] for p in (f" {w} " for w in names)]
        parts, gram = np.array([len(x) for x in lists], np.int64), np.fromiter((g for x in lists for g in x), np.int64)
        start, row, low = np.cumsum(parts) - parts, np.repeat(np.arange(n), size), 0
        ends = np.cumsum(size)
        for first in range(0, n, 1000):
            last = min(n, first + 1000)
            w, r = ids[low : ends[last - 1]], row[low : ends[last - 1]] - first
            z[:, first:last] += self._margins(1, np.repeat(r, parts[w]), gram[_ragged(start[w], parts[w])], last - first)
            low = ends[last - 1]
        z += self.intercept[:, None]
        p = np.exp(z - z.max(axis=0))
        return p / p.sum(axis=0)
