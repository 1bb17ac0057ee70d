"""Whitening against fractions and a plain decomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from parlance.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def numbers(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def plain(vectors, components=32):
    """(n, deviation of each, whitened up to sign, share of each component), by fractions up to the decomposition."""
    xs = [numbers(v) for v in vectors]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[j] for x in xs) for j in range(d)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in xs]
    cov = np.array([[float(sum(Fraction(n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs) / n**3) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in xs])
    return n, deviations, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def test_against_fractions(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))).astype(np.float32).tolist()
    rows = [(i, v, i % 3, "a", 1, "b") for i, v in enumerate(vectors)]
    odd = [(100, None, None, None, None, None), (101, [1.0, None, 0.0, 0.0, 0.0], 1, "", 0, ""), (102, [1.0, math.nan, 0.0, 0.0, 0.0], 1, "", 0, ""), (103, [math.inf] * 5, 1, "", 0, ""), (104, [-math.inf] * 5, 1, "", 0, ""), (105, [1.0], 1, "", 0, ""), (106, [], 1, "", 0, "")]
    again = [(3, vectors[3], 0, "a", 1, "b"), (None, vectors[4], 1, "a", 1, "b")]
    got = whitening.digest(spark.createDataFrame(rows + odd + again, SCHEMA)).collect()
    n, deviations, white, explained = plain([*vectors, vectors[3], vectors[4]])
    assert len(got) == 5 * n and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3, 4, 5}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-4
    sign = {}
    for r in got:
        at = 4 if r["vec_id"] is None else r["vec_id"]
        assert r["deviation"] == deviations[at]
        want = white[at, r["component"] - 1]
        sign.setdefault(r["component"], np.sign(want * r["whitened"]))
        assert abs(r["whitened"] * sign[r["component"]] - want) < 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9


def test_whole_table(spark, sf_dir):
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in embeddings.collect()}
    got = whitening.digest(embeddings).collect()
    ids = sorted(vectors)
    n, deviations, white, explained = plain([vectors[i] for i in ids])
    place = {i: k for k, i in enumerate(ids)}
    assert len(got) == n * min(32, white.shape[1])
    table = np.zeros(white.shape)
    for r in got:
        table[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[place[r["vec_id"]]]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-4
    table *= np.sign((table * white).sum(axis=0))
    assert np.abs(table - white).max() < 1e-6
    assert np.abs(table.T @ table / n - np.eye(table.shape[1])).max() < 1e-6


@pytest.mark.parametrize("top", [1, 40, 70_000, 1 << 33, (1 << 62) + 12345])
def test_products_are_exact(top, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(2)
    x = rng.integers(-top, top + 1, (50, 4))
    sums = whitening.Sums(4)
    for part in np.array_split(x, 3):
        sums.add(part)
    want = [[str(sum(int(r[i]) * int(r[j]) for r in x)) for j in range(4)] + [str(sum(int(r[i]) for r in x))] for i in range(4)]
    assert sums.rows() == want
    back = sum(d.astype(np.int64).astype(object) * (1 << (whitening.LIMB * k)) for k, d in enumerate(whitening.limbs(x)))
    assert (back == x.astype(object)).all()


def test_merging_over_many_tasks(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(10**12, 10**12 + 1000, (300, 3))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(130)
    got = whitening.moments(rows, 3)
    assert got.n == 300 and got.sums == [sum(map(int, x[:, j])) for j in range(3)]
    assert got.products == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(3)] for i in range(3)]


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0], 1, "", 1, "")], [(1, [1.0, 2.0], 1, "", 1, ""), (2, [1.0, 2.0], 1, "", 1, "")], [(1, None, 1, "", 1, "")]):
        assert whitening.digest(spark.createDataFrame(rows, SCHEMA)).count() == 0
    # A direction without differences is left out; vectors of great size keep an exact deviation.
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 5e15], 1, "", 1, ""), (2, [1.0, -5e15], 1, "", 1, ""), (3, [1.0, 0.0], 1, "", 1, "")], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["identity_error"] < 1e-4
    n, deviations, *_ = plain([[1.0, 5e15], [1.0, -5e15], [1.0, 0.0]], 1)
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(zip((1, 2, 3), deviations, strict=True))
    assert {r["deviation"] for r in whitening.digest(spark.createDataFrame([(1, [1.0, 5e15], 1, "", 1, ""), (2, [1.0, -5e15], 1, "", 1, "")], SCHEMA)).collect()} == {None}
