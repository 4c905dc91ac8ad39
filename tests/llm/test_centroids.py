"""Bounded clustering against plain k-means in Python integers."""

import hashlib

import duckdb
import numpy as np
import pytest

from sparkwell.llm import centroids
from sparkwell.llm.centroids import cluster


def brute(rows, k=8, rounds=10, width=64):
    kept = []
    for name, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) and abs(x * 1024) <= 1 << 27 for x in v):
            kept.append((name, [int(np.floor(1024 * float(x))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    places = [r[1] for r in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), i) for i, c in enumerate(places))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        places = [
            [sum(col) // len(members) for col in zip(*members, strict=True)] if (members := [v for (_, v), o in zip(kept, own, strict=True) if o == i]) else c
            for i, c in enumerate(places)
        ]
    last = [nearest(v) for _, v in kept]
    return sorted(
        ((n, c, d, sum(x for x, y in last if y == c), sum(x for x, _ in last), hashlib.sha256(",".join(map(str, places[c])).encode()).hexdigest()) for (n, _), (d, c) in zip(kept, last, strict=True)),
        key=str,
    )


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_given_vectors_by_both_engines(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    df = spark.read.parquet(path)
    got = as_rows(cluster(df))
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{path}'")
    assert got == sorted(con.sql(centroids.ORACLE).fetchall(), key=str)


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    small = [[float(x) for x in rng.integers(-1, 2, 64) / 1024] for _ in range(60)]  # many equal distances
    rows = [(i, v) for i, v in enumerate(small)] + [(i, small[0]) for i in (3, 3, 3)] + [(None, small[1]), (None, small[2])]
    rows += [(90, None), (91, small[0][:63]), (92, [*small[0][:63], None]), (93, [*small[0][:63], float("nan")]), (94, [*small[0][:63], float("inf")]), (95, [*small[0][:63], 1e30]), (96, [])]
    rows += [(97, [100_000.0] * 64), (98, [-100_000.0] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id int, embedding array<double>, x string, cluster int").repartition(5)
    assert as_rows(cluster(df)) == brute(rows)
    assert as_rows(cluster(df.limit(0))) == []
    few = spark.createDataFrame([(1, small[0]), (2, small[1]), (3, small[1])], "vec_id int, embedding array<double>")
    assert as_rows(cluster(few)) == brute([(1, small[0]), (2, small[1]), (3, small[1])])


@pytest.mark.parametrize(("k", "tracked"), [(1, 3), (8, 0), (8, 1), (8, 3), (40, 5)])
def test_bounds_certify(k, tracked):
    """Every round's assignment and order are those of full scans, and most distances are not computed."""
    rng = np.random.default_rng(k)
    x = np.floor(1024 * (rng.normal(size=(4000, 16)) + 4 * rng.integers(0, 2, (4000, 1)))).astype(np.int64)
    c = x[:k].copy()
    tracked = min(tracked, k - 1)
    own, d, near, lower = centroids.scan(x, c, tracked)
    upper, work = np.sqrt(d), []
    for _ in range(12):
        new = np.array([x[own == i].sum(0) // max((own == i).sum(), 1) if (own == i).any() else c[i] for i in range(k)])
        moved, c = np.sqrt(((new - c) ** 2).sum(1).astype(float)), new
        own, upper, near, lower, scanned = centroids.reassign(x, own.copy(), upper, near.copy(), lower, c, moved)
        every = centroids.squared(x, c)
        assert (own == every.argmin(axis=1)).all()
        assert (upper >= np.sqrt(every[np.arange(len(x)), own]) * (1 - 1e-12)).all()
        assert (lower[:, :tracked] <= np.sqrt(np.take_along_axis(every, near, 1)) + 1e-6).all()
        others = every.astype(float)
        np.put_along_axis(others, own[:, None], np.inf, 1)
        np.put_along_axis(others, near, np.inf, 1)
        assert (lower[:, tracked] <= np.sqrt(others.min(axis=1)) + 1e-6).all()
        work.append((scanned == 3).mean())
    assert work[-1] < 0.5
