import numpy as np

from sparkwell.operators import search


def test_scores_in_slices_are_those_of_the_whole(monkeypatch):
    """Many queries past one block of vectors: no array holds more than CELLS scores."""
    draw = np.random.default_rng(5)
    a, b, ids = draw.integers(0, 3, (50, 4)).astype(float), draw.integers(0, 3, (40, 4)).astype(float), draw.permutation(40)
    mine, theirs = draw.integers(0, 3, 50), draw.integers(0, 3, 40)
    whole = search._scores(a, b, 6)
    whole[mine[:, None] != theirs[None, :]] = -np.inf
    sizes, score = [], search._scores
    monkeypatch.setattr(search, "_scores", lambda *x: (sizes.append(len(x[0]) * len(x[1])), score(*x))[1])
    monkeypatch.setattr(search, "CELLS", 300)
    got, want = search._nearest(a, b, ids, 3, 6, mine, theirs), search._best(whole, ids, 3)
    assert all((x == y).all() for x, y in zip(got, want, strict=True)) and max(sizes) <= 300
