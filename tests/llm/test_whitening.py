"""Whitening against numpy's own eigenvectors, and odd vectors."""

import numpy as np
import pytest

from panelwright.llm import whitening
from panelwright.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, e int, l int"


def frame(spark, vectors):
    prepare(spark)
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2) for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("d", [1, 2, 7, 40, 150])
@pytest.mark.parametrize("kind", ["spread", "equal", "halves", "steep", "pairs"])
def test_components_equal_numpys(d, kind):
    rng = np.random.default_rng(d)
    values = {"spread": rng.random(d) * 1e4 + 1, "equal": np.ones(d), "halves": np.arange(d) % 2.0, "steep": 10.0 ** -np.minimum(np.arange(d), 12), "pairs": np.repeat(np.arange(1.0, d + 1), 2)[:d]}[kind]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = q @ np.diag(values) @ q.T
    found, axes = whitening.leading_components((v + v.T) / 2, 8)
    expected = [x for x in sorted(values, reverse=True)[:8] if x > 1e-11]
    scale = max(values.max(), 1e-300)
    assert len(found) >= len(expected) and np.allclose(found[: len(expected)], expected, rtol=0, atol=1e-13 * scale * d)
    assert np.abs(axes.T @ axes - np.eye(len(found))).max(initial=0) < 1e-13 * d and np.abs(v @ axes - axes * found).max(initial=0) < 1e-13 * scale * d


def test_polar_factor():
    a = np.random.default_rng(3).standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar_factor(a)
    w, q = np.linalg.eigh(a)
    assert np.allclose(u, q @ np.diag(np.sign(w)) @ q.T, atol=1e-13)


def test_whitened_equals_numpy(spark):
    rng = np.random.default_rng(0)
    raw = (rng.standard_normal((300, 12)) * np.arange(1, 13) / 10).astype(np.float32)
    vectors = list(raw) + [None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [], [1.0, 2.0], [1e30] * 12, raw[0], raw[0]]
    out = whitening.whitened(frame(spark, vectors)).toPandas()
    use = np.vstack([raw, raw[:1], raw[:1]])
    x = np.floor(1024 * use.astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    w, q = np.linalg.eigh(y.T @ y / n)
    expected = (y @ q[:, ::-1][:, :8]) / np.sqrt(w[::-1][:8])
    wide = out.pivot(index="vec_id", columns="component", values="whitened")
    assert len(wide) == 302 and set(wide.index) == set(range(300)) | {307, 308}
    assert np.allclose(np.abs(wide.to_numpy()), np.abs(expected), atol=1e-9)
    assert np.allclose(out.groupby("component").explained.first(), w[::-1][:8] / w.sum(), rtol=1e-10)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-10 and (out.n == 302).all()
    assert (out[out.component == 1].sort_values("vec_id").deviation.to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()


def test_no_vectors_one_and_equal_ones(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0 and whitening.whitened(frame(spark, [None, []])).count() == 0
    assert whitening.whitened(frame(spark, [[1.0, 2.0]])).count() == 0 and whitening.whitened(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    line = whitening.whitened(frame(spark, [[k, 2.0 * k] for k in range(10)]))
    assert line.count() == 10 and line.agg({"component": "max"}).first()[0] == 1


def test_deviations_beyond_a_long_are_null():
    x = np.array([[0, 0], [2_000_000_000, 0]], dtype=np.int64)
    assert whitening._exact_deviations(x, 4, np.array([4, 8])).to_pylist() == [16 + 64, None]
