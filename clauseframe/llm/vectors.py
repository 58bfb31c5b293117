"""Whole-number vectors: how they are read, and products that are exact at any width and size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMB = 21  # bits; two limbs' products over 2,048 components fit the 53 bits of a double
WIDTH = 2048
LONGEST = 2**63 - 1


def whole_numbers(vectors: DataFrame, scale: float, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``v``, floor(scale * component) as longs, instead of ``column``. Vectors that are null, or hold null or a number
    that is not finite, take no part. A component beyond a long stops at its end."""
    x = F.transform(column, lambda c: c.cast("double"))
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.where(F.col(column).isNotNull() & finite)
    return usable.select(*(c for c in vectors.columns if c not in (column, "v")), F.transform(column, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def largest(x: np.ndarray) -> np.ndarray:
    """The largest absolute value of each row, as doubles, rounded up a little."""
    return np.abs(x.astype(np.float64)).max(axis=1, initial=0) * (1 + 1e-12)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=-1))


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles of at most ``LIMB`` bits and a sign, lowest first, that make up ``x``."""
    out = []
    for _ in range(63 // LIMB - 1):
        out.append((x & (2**LIMB - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner product of each row of ``a`` with each of ``b``, both longs; results beyond a long stop at its ends.

    Rows whose products surely fit 53 bits are multiplied as doubles, those that fit 63 as longs, and only the others limb by limb.
    """
    d = a.shape[1]
    ma, mb = largest(a), largest(b)
    most = ma.max(initial=0) * mb.max(initial=0) * d
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    for x, mx, other, turned in ((b, mb, ma, False), (a, ma, mb, True)):
        fits = mx * other.max(initial=0) * d < 2**62
        if fits.any() and not fits.all():
            out = np.empty((len(a), len(b)), np.int64)
            for part in (fits, ~fits):
                if turned:
                    out[part] = products(x[part], b)
                else:
                    out[:, part] = products(a, x[part])
            return out
    total = np.zeros((len(a), len(b)), object)
    for at in range(0, d, WIDTH):
        la, lb = limbs(a[:, at : at + WIDTH]), limbs(b[:, at : at + WIDTH])
        for s in range(len(la) + len(lb) - 1):
            part = sum((la[i] @ lb[s - i].T).astype(np.int64) for i in range(len(la)) if 0 <= s - i < len(lb))
            total += part.astype(object) << (LIMB * s)
    return np.minimum(np.maximum(total, -LONGEST - 1), LONGEST).astype(np.int64)


class Rows:
    """Rows that many queries meet: what ``products`` would find out about them is found once."""

    def __init__(self, x: np.ndarray):
        self.x, self.most, self.doubles = x, largest(x), x.astype(np.float64)

    def products(self, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of the given rows and each of ``q``, as ``products`` gives them."""
        fits = self.most[rows] * largest(q).max(initial=0) * self.x.shape[1] < 2**53
        found = (self.doubles[rows] @ q.astype(np.float64).T).astype(np.int64) if fits.any() else np.empty((len(fits), len(q)), np.int64)
        if not fits.all():
            found[~fits] = products(self.x[rows][~fits], q)
        return found


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row of ``x`` to the vector ``c``; those beyond a long stop at its end."""
    fits = (largest(x) + np.abs(c.astype(np.float64)).max(initial=0)) ** 2 * x.shape[1] < 2**62
    out = np.empty(len(x), np.int64)
    out[fits] = ((x[fits] - c) ** 2).sum(axis=1)
    if not fits.all():
        far = ((x[~fits].astype(object) - c.astype(object)) ** 2).sum(axis=1)
        out[~fits] = np.minimum(far, LONGEST)
    return out
