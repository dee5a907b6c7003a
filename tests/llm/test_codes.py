"""Whitening, product codes and SimHash against brute force, on odd rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stepfree.llm import catalog, codes, simhash, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n=400, d=8, seed=3):
    rng = np.random.default_rng(seed)
    shape = rng.normal(size=(d, d)) * np.geomspace(1, 1e-2, d)
    rows = [(i, [float(np.float32(x)) for x in shape @ rng.normal(size=d)], int(rng.integers(3))) for i in range(n)]
    rows += [(n + i, rows[7][1], None) for i in range(60)]  # equal vectors
    rows += [rows[3]] * 2  # repeated rows
    rows += [(n + 70, None, 1), (n + 71, [1.0, None] + [0.0] * (d - 2), 1), (n + 72, [math.nan] + [0.0] * (d - 1), 0), (n + 73, [math.inf] + [0.0] * (d - 1), 0)]
    return rows + [(None, rows[9][1], 2)]


@pytest.fixture(scope="module")
def vectors(spark):
    clash = "x code error part entry n s0 sums i j v component label_error __salt __r_label".split()
    return spark.createDataFrame(vector_rows(), VECTORS).repartition(3).select("*", *[F.lit("y").alias(c) for c in clash])


def usable(rows):
    return [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


# whitening


def test_jacobi():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 16, 33):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        true = np.geomspace(1e6, 1e-6, d)
        values, vectors = whitening.jacobi((q * true) @ q.T)
        assert np.allclose(values, true, rtol=1e-3, atol=0) or d == 1
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        scaled = np.diag(np.geomspace(1, 1e-8, d)) @ (np.eye(d) + 0.1) @ np.diag(np.geomspace(1, 1e-8, d))  # graded: small eigenvalues to full precision
        values, vectors = whitening.jacobi(scaled)
        assert np.abs(scaled @ vectors - vectors * values).max() < 1e-14
        if d == 2:
            assert math.isclose(values.prod(), scaled[0, 0] * scaled[1, 1] - scaled[0, 1] ** 2, rel_tol=1e-13)
    values, _ = whitening.jacobi(np.zeros((3, 3)))
    assert values.tolist() == [0, 0, 0]


def test_whitening(vectors):
    rows = usable(vector_rows())
    out = whitening.whiten(vectors, components=5).collect()
    x = np.floor(64 * np.array([v for _, v, _ in rows], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    values, frame = np.linalg.eigh(y.T @ y / n)
    values, frame = values[::-1], frame[:, ::-1]
    white = (x - s / n) @ frame[:, :5] / np.sqrt(values[:5])
    deviation = ((n * x - s) ** 2).sum(1)
    assert len(out) == 5 * len(rows) and {r["n"] for r in out} == {n} and len({r["identity_error"] for r in out}) == 1
    assert out[0]["identity_error"] < 1e-9
    for c in range(1, 6):
        got = sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["whitened"], r["deviation"], r["explained"]) for r in out if r["component"] == c)
        expected = sorted(zip([-1 if i is None else i for i, _, _ in rows], white[:, c - 1], deviation.tolist(), strict=True))
        sign = 1 if got[0][1] * expected[0][1] > 0 else -1
        assert [(g[0], g[2]) for g in got] == [(e[0], e[2]) for e in expected]
        assert np.allclose([sign * g[1] for g in got], [e[1] for e in expected], atol=1e-9)
        assert all(math.isclose(g[3], values[c - 1] / values.sum(), rel_tol=1e-9) for g in got)
    again = whitening.whiten(vectors.repartition(5), components=5)
    key = lambda r: str(r["vec_id"]) + f"{r['component']}"
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again.collect()), key=str) or {key(r) for r in out} == {key(r) for r in again.collect()}
    assert {(r["n"], r["deviation"]) for r in out} == {(r["n"], r["deviation"]) for r in again.collect()}


def test_whitening_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None, 0)])).count() == 0
    assert whitening.whiten(make([(1, [], 0)])).count() == 0
    one = whitening.whiten(make([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(c, 1, 0, 0.0, 0.0, 0.0) for _ in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(make([(1, [1.0, 2.0], 0), (2, [2.0, 2.0], 0), (3, [3.0], 0)])).collect()  # the third is filled with 0
    assert len(flat) == 6 and max(r["identity_error"] for r in flat) < 1e-9
    huge = whitening.whiten(make([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 5.0], 0)])).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge} <= {None, 0} | {r["deviation"] for r in huge if r["deviation"]}
    assert all(math.isfinite(r["whitened"]) for r in huge) and huge[0]["deviation"] is None


# product codes


def plain_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    rows = usable(rows)
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    step = width // parts
    x = [[math.floor(scale * c) for c in v] + [0] * (width - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    cut = [[v[p * step : (p + 1) * step] for v in x] for p in range(parts)]
    books = [[cut[p][k] for k in order] for p in range(parts)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p])) for v in cut[p]]

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = assign(p)
            book = []
            for k, e in enumerate(books[p]):
                held = [v for v, (_, at) in zip(cut[p], own, strict=True) if at == k]
                book.append([sum(c) // len(held) for c in zip(*held, strict=True)] if held else e)
            new.append(book)
        books = new
    last = [assign(p) for p in range(parts)]
    error = [sum(last[p][k][0] for p in range(parts)) for k in range(len(rows))]
    by_label = {lab: sum(e for e, r in zip(error, rows, strict=True) if r[2] == lab) for lab in {r[2] for r in rows}}
    text = ",".join(str(c) for b in books for e in b for c in e)
    code = ["".join(f"{last[p][k][1]:02x}" for p in range(parts)) for k in range(len(rows))]
    fit = lambda v: v if v < 2**63 else None
    return [(r[0], code[k], fit(error[k]), fit(by_label[r[2]]), hashlib.sha256(text.encode()).hexdigest()) for k, r in enumerate(rows)]


@pytest.mark.parametrize("entries", [5, 40])
def test_codes(vectors, entries):
    got = codes.coded(vectors, entries=entries)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_codes(vector_rows(), entries=entries), key=str)


def test_codes_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert codes.coded(make([])).count() == 0 and codes.coded(make([(1, None, 0)])).count() == 0
    assert codes.coded(make([(1, [], None)])).select("code", "error", "label_error").first() == ("00000000", 0, 0)
    rows = [(k, [float(np.float32(k * 1.37e5 * (-1) ** k)), 0.5, -2.0, 1e6, 3.0][: 3 + k % 3], k % 2) for k in range(30)]  # ragged, coordinates beyond PLAIN
    assert sorted(map(tuple, codes.coded(make(rows), entries=7).collect()), key=str) == sorted(plain_codes(rows, entries=7), key=str)
    lost = codes.coded(make([(1, [3e38, 0.0, 0.0, 0.0], 0), (2, [-3e38, 0.0, 0.0, 0.0], 0), (3, [0.0] * 4, 1)]), entries=1).collect()
    assert {r["vec_id"]: (r["error"] is None, r["label_error"] is None) for r in lost}[1] == (True, True)


def test_bounds_hold():
    rng = random.Random(4)
    for size in (300, 2**27, 2**58):
        entries = np.array([[rng.randrange(-size, size) for _ in range(6)] for _ in range(50)], np.int64)
        queries = np.array([[int(c) + rng.randrange(-9, 9) for c in entries[rng.randrange(50)]] for _ in range(40)], np.int64)
        file = codes.Approximation(entries)
        low, high = file.bounds(queries)
        index, distance = file.nearest(queries)
        for q, query in enumerate(queries.tolist()):
            true = [sum((a - b) ** 2 for a, b in zip(query, e, strict=True)) for e in entries.tolist()]
            assert all(low[q, e] <= true[e] <= high[q, e] for e in range(50))
            assert (int(distance[q]), int(index[q])) == min((t, e) for e, t in enumerate(true))
        assert (low <= high.min(1)[:, None]).mean() < 0.5  # the approximation does filter


# SimHash


def plain_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    return sorted(((doc, f"{fps[i]:016x}", names.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_simhash(odd, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    for part in (odd, odd.repartition(7)):
        assert sorted(map(tuple, simhash.near_duplicates(part).collect()), key=str) == plain_components(rows, 4)


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def near_values(rng, n, flips):
    base = rng.integers(0, 2**63, size=max(1, n // 20), dtype=np.uint64)
    return np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, flips), replace=False)) for b in rng.choice(base, n)], np.uint64))


def test_bit_slices():
    rng = np.random.default_rng(1)
    for n in (2, 63, 64, 65, 300, 1500):
        values = near_values(rng, n, 9)
        for radius in (0, 1, 3, 4, 5):
            lanes = simhash.Lanes(values)
            got = set()
            for a in range(0, len(values), simhash.QUERIES):
                q, lane = lanes.within(a, min(len(values), a + simhash.QUERIES), radius)
                got |= set(zip(q.tolist(), lane.tolist(), strict=True))
            i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None]) <= radius, 1))
            assert got == set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("largest", [16_384, 40])
def test_simhash_links(spark, monkeypatch, largest):
    """A ball of near copies, whole and in pairs of blocks, joins what brute force joins."""
    monkeypatch.setattr(simhash, "LARGEST", largest)
    rng = np.random.default_rng(2)
    values = np.unique(np.r_[near_values(rng, 300, 7), np.array([int(12345) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for _ in range(300)], np.uint64)])
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    found = simhash.links(fps, 4).collect()
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    assert all(near[place[r["a"]], place[r["b"]]] for r in found)
    joined = np.eye(len(values), dtype=bool)
    for r in found:
        joined[place[r["a"]], place[r["b"]]] = joined[place[r["b"]], place[r["a"]]] = True

    def label(m):
        at = np.arange(len(m))
        while True:
            new = np.where(m, at[None], len(m)).min(1)
            if (new == at).all():
                return at
            at = new

    assert (label(joined) == label(near)).all()


def test_queries_are_listed():
    assert {"op11_whiten", "op12_code_vectors", "op13_simhash"} <= set(catalog.queries())
