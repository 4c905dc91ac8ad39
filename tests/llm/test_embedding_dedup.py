import numpy as np

from sparkwell.llm import embedding_dedup as ed


def vectors():
    r = np.random.default_rng(2)
    base = r.standard_normal((60, 16))
    near = base[:30] + 0.25 * r.standard_normal((30, 16)) * np.abs(base[:30]).mean()
    out = [x.tolist() for x in np.concatenate([base, near, base[:9], base[:5] * 3])]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, [1.0] * 3]
    return out + odd


def brute(rows, threshold):
    def ok(v):
        return v and None not in v and np.isfinite(v).all() and np.any(v)

    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok(rows[i]) and ok(rows[j]) and len(rows[i]) == len(rows[j]):
                x, y = np.array(rows[i]), np.array(rows[j])
                near[i, j] = near[j, i] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
    return near.sum(1).tolist(), label


def test_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, class string")
    got = {r.vec_id: r for r in ed.near_vectors(df, threshold=0.9, tile=16).collect()}
    links, label = brute(rows[:-2] + [None, None], 0.9)
    assert [got[i].n_links for i in range(len(rows))] == [*links[:-2], 1, 1]
    assert [got[i].component_id for i in range(len(rows))] == [*label[:-2], len(rows) - 2, len(rows) - 2]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    real = x @ x.T
    off = np.zeros_like(real)
    for seed in range(30):
        turn = ed.rotation(64, seed)
        bits, factor = ed.code(x, turn)
        guess, error = ed.estimate(bits, factor, x @ turn)
        assert (np.abs(guess - real) <= ed.SURE * error[:, None] + 1e-5).all()
        off += (guess - real) / 30
    assert abs(off.mean()) < 0.01


def test_widths_and_sizes_against_brute_force(spark):
    """Two widths of which one is rare, components near 1e200 and 1e-200, and a dense cluster of unequal vectors over several tiles."""
    r = np.random.default_rng(7)
    centre = r.standard_normal(16)
    rows = [(centre + 0.05 * r.standard_normal(16)).tolist() for _ in range(60)]
    rows += [(centre * 10.0**e + 10.0**e * 0.05 * r.standard_normal(16)).tolist() for e in (200, -200, 300, -300)]
    rows += [x.tolist() for x in r.standard_normal((20, 8))] + [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [-1.0, -2.0, -3.0], [5.0], [1e-320], [-3.0], [1e300, 1e300], [1e-300, 1e-300]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    links, label = brute([list(np.array(v) / np.abs(v).max()) for v in rows], 0.95)
    for tile in (16, None):
        got = {x.vec_id: x for x in ed.near_vectors(df, tile=tile).collect()}
        assert [got[i].n_links for i in range(len(rows))] == links and [got[i].component_id for i in range(len(rows))] == label
    assert links[0] == 63 and links[-8:] == [1, 1, 0, 1, 1, 0, 1, 1]


def test_query_on_a_fixture(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    links, label = brute(rows, 0.95)
    got = {x.vec_id: x for x in ed.op6_rotated_code_links(spark, str(tmp_path)).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == list(zip(links, label, strict=True))


def test_none(spark):
    for rows in ([], [(1, None)]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        assert [tuple(r) for r in ed.near_vectors(df).collect()] == [(1, 0, 1, True) for _ in rows]
