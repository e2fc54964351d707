"""Whitening against exact fractions and a plain decomposition, and the defined edge cases."""

from fractions import Fraction

import numpy as np
import pytest

from mnemora.llm import queries as q
from mnemora.llm import whitening as w
from tests.test_queries import FOLDER


def brute(rows, components=4):
    """By (id, vector): covariance in exact fractions over distinct vectors, eigenvectors by a plain routine."""
    usable = [(i, [int(np.floor(256.0 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[k] for x in distinct) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in distinct), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for i, x in usable:
        centred = np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(d)])
        for k in range(min(components, d)):
            e = values[d - 1 - k]
            out.setdefault(i, []).append((k + 1, n, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), abs(centred @ vectors[:, d - 1 - k]) / np.sqrt(e), e / values.sum()))
    return out


def compare(got, want, key="vec_id"):
    by_id = {}
    for r in got:
        by_id.setdefault(r[key], []).append((r.component, r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error < 1e-8
    assert by_id.keys() == want.keys()
    for i, rows in by_id.items():
        for a, b in zip(sorted(rows), sorted(want[i]), strict=True):
            assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-7, atol=1e-9)


def test_whole_table_like_brute_force(spark):
    got = q.QUERIES["op13_whitening"](spark, FOLDER)
    assert got.columns == ["vec_id", *w.RESULTS]
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(got.collect(), brute(rows))


def test_faraway_means_and_edge_rows(spark):
    """Means far from zero, a hot vector, bad vectors, clashing and extra columns."""
    rnd = np.random.default_rng(3)
    data = [(i, [1e9 + float(a), -3e7 + float(b), float(a + b) / 3]) for i, (a, b) in enumerate(rnd.normal(size=(80, 2)))]
    rows = data + [(100 + k, data[0][1]) for k in range(60)] + [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0]), (204, [])]
    df = spark.createDataFrame([(*r, None, f"x{r[0]}") for r in rows], "vec_id long, embedding array<double>, n int, `a.b` string").repartition(4)
    out = w.whiten(df)
    assert out.columns[:5] == ["vec_id", "n", "a.b", "component", "_n"]
    got = out.withColumnRenamed("n", "old").withColumnRenamed("_n", "n").collect()
    assert all(r["a.b"] == f"x{r.vec_id}" for r in got)
    compare(got, brute(rows))


def test_nothing_varies_and_several_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5]), (4, [0.75]), (None, [0.5])], "vec_id long, embedding array<float>")
    rows = {(r.vec_id, r.component): r for r in w.whitening_digest(df).collect()}
    assert sorted(rows, key=str) == sorted([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (None, 1)], key=str)
    assert rows[1, 1].whitened is None and rows[1, 1].explained is None and rows[1, 1].identity_error is None and rows[1, 1].deviation == 0
    assert rows[3, 1].whitened == -1.0 and rows[4, 1].whitened == 1.0 and rows[3, 1].n == 2 and rows[3, 1].deviation == 64**2
    empty = w.whitening_digest(df.limit(0))
    assert empty.count() == 0 and empty.dtypes == w.whitening_digest(df).dtypes


def test_huge_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1.0])], "vec_id long, embedding array<double>")
    got = w.whitening_digest(df).collect()
    assert len(got) == 6 and all((r.deviation is None) == (r.vec_id != 3) for r in got)
    with pytest.raises(ValueError):
        w.whiten(spark.createDataFrame([(1, [0.0] * (w.MOST_DIMENSIONS + 1))], "vec_id long, embedding array<double>"))
