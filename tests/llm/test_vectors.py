"""Vector codes and whitening against plain versions; also numbers of any size."""

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tablefit.llm import vector_codes, whitening
from tablefit.llm.queries import SQL, codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, digest string, weight int"


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(11)
    rows = [(i, rnd.normal(size=48).round(2).tolist(), i % 3 or None) for i in range(150)]
    rows += [(200 + i, rows[7][1], 1) for i in range(80)]  # a hot vector
    rows += [(7, rows[9][1], 2), (7, rows[7][1], 2), (None, rows[5][1], 0), (300, [0.5] * 20, 4), (301, [], None)]
    return rows


def table(spark, rows):
    others = [(400, None, 1), (401, [None] + [1.0] * 47, 1), (402, [math.nan] * 48, 1), (403, [math.inf] * 48, 1)]
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows + others], SCHEMA).repartition(4)


def slow_codes(rows, entries=64, parts=16):
    width = max(-(-max(len(v) for _, v, _ in rows) // parts), 1) * parts
    size = width // parts
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(Fraction(x) * 256) for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for v in whole]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))

    for _ in range(2):
        for p in range(parts):
            own = defaultdict(list)
            for row in cut:
                own[nearest(row[p], books[p])[1]].append(row[p])
            for e, found in own.items():
                books[p][e] = [sum(x) // len(found) for x in zip(*found)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    best = [[nearest(row[p], books[p]) for p in range(parts)] for row in cut]
    errors = [sum(d for d, _ in b) for b in best]
    labels = defaultdict(int)
    for (_, _, label), error in zip(rows, errors):
        labels[label] += error
    return [(i, label, "".join(f"{e:02x}" for _, e in b), error, labels[label], digest)
            for (i, _, label), b, error in zip(rows, best, errors)]


def long(value):
    return value if value < 1 << 63 else None


def test_codes(spark, vectors):
    for rows in (vectors, vectors[:5], [(1, [3.0], 1)], [(1, [], 1)]):
        got = vector_codes.compress(table(spark, rows)).collect()
        assert Counter(map(tuple, got)) == Counter(slow_codes(rows))
    assert vector_codes.compress(table(spark, vectors).filter("false")).count() == 0


def test_codes_of_huge_numbers(spark, vectors):
    rows = [(i, [x * 10.0 ** (i % 40 * 7) for x in v], label) for i, v, label in vectors[:90]] + [(900, [1.7e308] * 48, 9)]
    want = slow_codes(rows)
    lost = {w[1] for w in want if w[3] >= 1 << 63}
    got = vector_codes.compress(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(
        (i, label, code, long(error), None if label in lost else long(total), digest)
        for i, label, code, error, total, digest in want)


def test_assign_equals_all_distances():
    rnd = np.random.default_rng(2)
    for size in (1, 2, 3, 4, 8, 13):
        rows, entries = rnd.integers(-4, 4, (300, size)), rnd.integers(-4, 4, (20, size))
        entry, distance = vector_codes.assign(vector_codes.transform(rows), vector_codes.transform(entries))
        all_pairs = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (entry == all_pairs.argmin(axis=1)).all() and (distance == all_pairs.min(axis=1)).all()


def test_codes_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = codes(spark, folder)
    want = duck.execute(SQL["op11_vector_codes"]).fetchall()
    assert [d[0] for d in duck.description] == found.columns
    assert Counter(map(tuple, found.collect())) == Counter(want)


def slow_whitening(rows, weigh=False):
    """n, exact deviations, whitened values up to sign and shares of the spread, by exact sums."""
    width = max(len(v) for _, v, _ in rows)
    whole = [tuple(math.floor(Fraction(c) * 64) + 1000000 for c in v) + (1000000,) * (width - len(v)) for _, v, _ in rows]
    fit = whole if weigh else sorted(set(whole))
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    off = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    cov = np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n ** 3)) for j in range(width)] for i in range(width)])
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1][:16], parts[:, ::-1][:, :16]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in whole])
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in whole]
    return n, deviations, centred @ parts / np.sqrt(values), values / np.trace(cov)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening(spark, vectors, weights):
    got = whitening.whiten(table(spark, vectors), weights=weights).collect()
    n, deviations, whitened, explained = slow_whitening(vectors, weights == "counts")
    assert len(got) == 16 * len(vectors) and {r.n for r in got} == {n}
    assert all(r.identity_error <= 1e-9 for r in got)
    assert np.allclose([r.explained for r in got], [explained[r.component - 1] for r in got], rtol=1e-9)
    want = defaultdict(list)
    for (i, _, _), deviation, values in zip(vectors, deviations, whitened):
        want[i].append((deviation, values))
    signs = {}
    for i, _, _ in vectors:
        rows = [r for r in got if r.vec_id == i]
        assert Counter(int(r.deviation) for r in rows) == Counter(d for d, _ in want[i] for _ in range(16))
        if len(want[i]) == 1:
            for r in rows:
                value = want[i][0][1][r.component - 1]
                if abs(value) > 1e-6:
                    assert signs.setdefault(r.component, np.sign(r.whitened * value)) == np.sign(r.whitened * value)
                assert abs(abs(r.whitened) - abs(value)) < 1e-8


def test_whitening_edges(spark, vectors):
    assert whitening.whiten(table(spark, [(1, [], 1)])).count() == 0
    assert whitening.whiten(table(spark, vectors).filter("false")).count() == 0
    one = whitening.whiten(table(spark, [(1, [3.0, 1.0], 1), (2, [3.0, 1.0], 1)])).collect()
    assert len(one) == 4 and {(r.n, r.whitened, r.explained, r.identity_error) for r in one} == {(1, None, None, None)}
    # Two distinct vectors spread along one line only.
    two = whitening.whiten(table(spark, [(1, [3.0, 1.0], 1), (2, [5.0, 1.0], 1), (3, [5.0, 1.0], 1)])).collect()
    assert {(r.vec_id, r.component, r.whitened and round(abs(r.whitened), 9)) for r in two} == {
        (i, c, 1.0 if c == 1 else None) for i in (1, 2, 3) for c in (1, 2)}
    # x beyond n-fold longs stays exact; components of 2**56 and more are dropped.
    big = [(1, [2.0 ** 55, 1.0], 1), (2, [-2.0 ** 55, 1.5], 1), (3, [0.0, 2.0], 1), (4, [2.0 ** 57, 1.0], 1)]
    got = whitening.whiten(table(spark, big)).collect()
    _, deviations, _, _ = slow_whitening(big[:3])
    assert {(r.vec_id, int(r.deviation) if r.deviation is not None else None) for r in got} == {
        (i + 1, d if d < 10 ** 38 else None) for i, d in enumerate(deviations)}
