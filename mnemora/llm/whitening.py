"""Embedding whitening: covariance from generated column aggregates, principal components, projected rows.

Entries become whole numbers, floor(256 c). The fit list holds each distinct vector once. Over it one aggregation sums,
in one generated SQL expression a pair of dimensions of the upper triangle, the products of the centred entries; the
driver assembles the covariance of these numbers, whose size goes by the dimensions and not by the rows, and LAPACK
decomposes it. Rows are projected where they lie, by generated expressions.

Centring is exact but for one rounding: the whole part of a mean is taken off in whole numbers, its fraction in double.

Defined cases: rows whose vector is null or holds a null or a number that is not finite go, whatever their other
columns; entries beyond 2^62 are held there; vectors of one length are one table, each length is fitted by itself;
vectors without entries go, as they have no component; repeated rows are rows of their own but one vector of the fit
list; a component whose eigenvalue is zero to double precision has null `whitened`, and no part in `identity_error`,
which is null without any; `explained` is null if nothing varies; `deviation` is null where it does not fit a long; of
equal eigenvalues LAPACK's order holds; a component's largest entry, the first of several, is positive; columns with
clashing names are left alone, as results get underscores before their names until these are free; an empty table gives
an empty table. Vectors of more than `MOST_DIMENSIONS` entries raise `ValueError`, as their pairs are no plan.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

#: Entries are counted in parts of one over this.
SCALE = 256
COMPONENTS = 4
#: 256 dimensions have 32,896 pairs.
MOST_DIMENSIONS = 256
#: An eigenvalue of less than this share of the largest is zero to double precision.
ZERO = 1e-13
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


class Whitening(NamedTuple):
    """A fit: `n` vectors, by dimension the whole part of the mean and the rest in parts of n, eigenvalues falling, a component a row."""

    n: int
    whole: list[int]
    rest: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def used(self, k: int) -> bool:
        return bool(self.values[k] > ZERO * max(self.values[0], 0.0)) and self.values[k] > 0


def quantised(vector: Column) -> Column:
    """Entries as whole numbers; null for a vector that is null or holds a null or a number that is not finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * float(SCALE)), F.lit(1 << 62)), F.lit(-(1 << 62))))
    return F.when(finite & (F.size(vector) > 0), x)


def _centred(fit: Whitening, k: int) -> str:
    """The centred entry `k` of the array `x`."""
    return f"(CAST(coalesce(x[{k}], 0L) - ({fit.whole[k]}L) AS DOUBLE) - {fit.rest[k] / fit.n!r}D)"


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def fit(vectors: DataFrame, d: int) -> Whitening:
    """The whitening of a table with a column `x` of distinct arrays of `d` whole numbers; it is read twice."""
    sums = ", ".join(f"sum(CAST(x[{k}] AS DECIMAL(20, 0)))" for k in range(d))
    n, sums = vectors.agg(F.count("*"), F.expr(f"array({sums})")).first()
    whole, rest = zip(*(divmod(int(s), n) for s in sums))
    out = Whitening(n, list(whole), list(rest), np.zeros(0), np.zeros((0, 0)), 0.0)
    centred = vectors.selectExpr(*(f"{_centred(out, k)} AS y{k}" for k in range(d)))
    products = centred.agg(F.expr(f"array({', '.join(f'sum(y{i} * y{j})' for i, j in _pairs(d))})")).first()[0]
    covariance = np.zeros((d, d))
    for (i, j), s in zip(_pairs(d), products):
        covariance[i, j] = covariance[j, i] = s / n
    values, columns = np.linalg.eigh(covariance)
    components = columns.T[::-1]
    signs = np.sign(components[np.arange(d), np.abs(components).argmax(axis=1)])
    return out._replace(values=values[::-1], components=components * signs[:, None], trace=float(np.trace(covariance)))


def _projected(model: Whitening, k: int) -> str:
    """The centred vector on component `k`, over the root of its eigenvalue."""
    if not model.used(k):
        return "CAST(NULL AS DOUBLE)"
    terms = " + ".join(f"{_centred(model, i)} * {float(w)!r}D" for i, w in enumerate(model.components[k]))
    return f"({terms}) / {float(np.sqrt(model.values[k]))!r}D"


def _deviation(model: Whitening) -> str:
    """Sum of (n x - S)^2 in whole numbers; null where it does not fit."""
    out = "0L"
    for k in range(len(model.whole)):
        y = f"try_subtract(try_multiply({model.n}L, x[{k}] - ({model.whole[k]}L)), {model.rest[k]}L)"
        out = f"try_add({out}, aggregate(array({y}), 0L, (s, y) -> try_multiply(y, y)))"
    return out


def identity_error(vectors: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest entry, without its sign, of the covariance of the whitened fit list minus the identity."""
    used = [k for k in range(components) if model.used(k)]
    if not used:
        return None
    whitened = vectors.selectExpr(*(f"{_projected(model, k)} AS w{k}" for k in used))
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = whitened.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return float(max(abs(c - (i == j)) for (i, j), c in zip(pairs, found)))


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the vector), then `component`, `n`, `deviation`, `whitened`, `explained`
    and `identity_error`, for each row with a usable vector and each component up to `components`.

    The distinct vectors are written once to the shared folder, as they are read three times.
    """
    keep = [c for c in df.columns if c != vector] if keep is None else keep
    own = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)), quantised(F.col(f"`{vector}`")).alias("x")).filter("x IS NOT NULL")
    distinct = materialise(rows.select("x").distinct())
    lengths = sorted(r[0] for r in distinct.select(F.size("x")).distinct().limit(MOST_DIMENSIONS + 1).collect())
    if lengths and (lengths[-1] > MOST_DIMENSIONS or len(lengths) > MOST_DIMENSIONS):
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} entries")
    out = None
    for d in lengths:
        of_length = distinct.filter(F.size("x") == d)
        model, most = fit(of_length, d), min(components, d)
        error = identity_error(of_length, model, most)
        found = rows.filter(F.size("x") == d).selectExpr(*own, f"{_deviation(model)} AS deviation", f"array({', '.join(_projected(model, k) for k in range(most))}) AS w")
        found = found.select(*own, "deviation", F.posexplode("w").alias("k", "whitened"))
        share = F.array(*(F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values[:most]))
        found = found.select(*own, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select(*own, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *(F.lit(0.0).alias(c) for c in RESULTS[3:])).limit(0)
    named = df.select(*(F.col(f"`{c}`") for c in keep))
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, keep)), *(F.col(r).alias(free_name(named, r)) for r in RESULTS))


def whitening_digest(df: DataFrame) -> DataFrame:
    """Per row and component: the counts, the exact deviation, the whitened coordinate, and how good the fit is."""
    return whiten(df, keep=["vec_id"])
