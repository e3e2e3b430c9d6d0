"""Whitening against plain numpy over whole tables."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from gristmill.llm import whitening


def brute(vectors, components=4, copies_count=False):
    """(sums, n, eigenvalues, directions, whole vectors) of lists of floats."""
    whole = [tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors]
    many = Counter(whole)
    fit = np.array(list(many), object)
    weights = [many[tuple(x)] if copies_count else 1 for x in fit.tolist()]
    n = sum(weights)
    sums = [sum(w * x for w, x in zip(weights, column, strict=True)) for column in fit.T.tolist()]
    c = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(row, sums, strict=True)] for row in fit.tolist()])
    matrix = (c * np.array(weights)[:, None]).T @ c / n
    values, directions = np.linalg.eigh(matrix)
    return sums, n, values[::-1][:components], directions[:, ::-1][:, :components], whole, np.trace(matrix)


@pytest.mark.parametrize("copies_count", [False, True])
def test_against_numpy(spark, copies_count):
    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"]) for r in table] + [(10_000 + k, table[k % 7]["embedding"]) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(dict)
    for r in whitening.whiten(frame, copies_count=copies_count).collect():
        got[r.vec_id][r.component] = r
    sums, n, values, directions, whole, trace = brute([v for _, v in rows], copies_count=copies_count)
    assert set(got) == {k for k, _ in rows} and all(sorted(x) == [1, 2, 3, 4] for x in got.values())
    z = (np.array(whole, float) - np.array(sums) / n) @ directions / np.sqrt(values)
    for component in range(4):
        mine = np.array([got[k][component + 1].whitened for k, _ in rows])
        sign = np.sign(mine @ z[:, component])
        assert np.abs(mine - sign * z[:, component]).max() < 1e-8
    for (k, _), x in zip(rows, whole, strict=True):
        r = got[k][1]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) and r.identity_error < 1e-9
    assert all(abs(got[rows[0][0]][c + 1].explained - values[c] / trace) < 1e-12 for c in range(4))


def test_query_has_the_contract_s_columns(spark):
    found = whitening.op12_embedding_whitening(spark, SMALL)
    assert [(n, t) for n, t in found.dtypes] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert found.count() == 4 * pq.read_table(f"{SMALL}/embeddings.parquet").num_rows


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, None), (3, [nan, 0.0]), (4, [None, 1.0]), (5, []), (6, [inf, 1.0]), (7, [1.0]), (None, [0.5, -0.3]), (9, [0.5, -0.3]), (9, [0.9, 0.4])]
    frame = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id long, embedding array<double>, n int, x double")
    got = whitening.whiten(frame).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (9, 1), (9, 1), (9, 2), (9, 2)]
    assert {r.n for r in got} == {3} and max(r.identity_error for r in got) < 1e-12
    assert whitening.whiten(frame.where("vec_id = 2")).collect() == whitening.whiten(frame.limit(0)).collect() == []


def test_without_variance_and_beyond_64_bits(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert len(one) == 9 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 5.0]) for k in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {r.explained for r in flat if r.component == 1} == {1.0}
    large = whitening.whiten(spark.createDataFrame([(1, [1e8, 0.0]), (2, [-1e8, 1.0]), (3, [0.0, 0.5]), (4, [1e300, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in large if r.vec_id == 4) and len(large) == 8


def test_exact_sums():
    x = np.array([[1 << 61, -3], [1 << 61, 5], [1 << 61, -1], [1 << 61, 7]])
    assert whitening.weighted_sums(x, np.array([1, 2, 3, 4])) == [10 << 61, -3 + 10 - 3 + 28]
    assert whitening.deviations(x[:, 1:], 4, [8]) == [400, 144, 144, 400] and whitening.deviations(x, 4, [1 << 63, 8])[0] == 400
