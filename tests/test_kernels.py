"""Greedy kernels on small literals and against naive versions."""

import numpy as np
import pytest

from terravane.operators import kernels as K

NAN = np.nan


def levels(*v):
    return np.array([NAN if x is None else x for x in v], float)


def test_leader_canopy_takes_free_neighbours_of_the_seed_only():
    xyz = np.array([[0, 0, 0], [1.5, 0, 0], [3, 0, 0], [10, 0, 0]], float)
    out = K.leader_canopy(xyz, np.array([0.9, 0.8, 0.7, 0.6]), levels(None, None, None, None), 2.0)
    assert out.tolist() == [0, 0, 1, 2]


def test_leader_canopy_levels_and_gate():
    xyz = np.zeros((4, 3))
    assert K.leader_canopy(xyz, np.array([4.0, 3, 2, 1]), levels(1, 2, None, 2), 1.0).tolist() == [0, 1, 0, 1]
    v = np.array([[1, 0], [0, 1], [1, 0.1], [0, 2]], float)
    assert K.leader_canopy(xyz, np.array([4.0, 3, 2, 1]), levels(*[None] * 4), 1.0, v, 0.8).tolist() == [0, 1, 0, 1]


def test_incremental_joins_the_best_cluster():
    xyz = np.array([[0, 0, 0], [1, 0, 0], [9, 0, 0], [8.5, 0, 0]], float)
    v = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1]], float)
    assert K.incremental(xyz, np.array([4.0, 3, 2, 1]), levels(*[None] * 4), v, 2.0, threshold=1.2).tolist() == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        K.incremental(xyz, np.ones(4), levels(*[None] * 4), np.zeros((4, 2)), 2.0)


def test_cdog_needs_overlapping_neighbourhoods():
    at = np.array([[0, 0, 5], [0.01, 0, 5], [0, 0.01, 5]], float)
    origins = np.array([[0, 0, 0], [3, 0, 0], [-3, 0, 0]], float)
    ray = K.unit_rows(at - origins)
    all_three = K.cdog(at, origins, ray, np.array([1, 2, 3]), levels(None, None, None), 0.25, 5.0, (0.3, 30.0), 0.5)
    assert len(set(all_three.tolist())) == 1
    two = K.cdog(at[:2], origins[:2], ray[:2], np.array([1, 2]), levels(None, None), 0.25, 5.0, (0.3, 30.0), 0.5)
    assert len(set(two.tolist())) == 2  # open neighbourhoods of a pair share nothing
    assert len(set(K.cdog(at[:2], origins[:2], ray[:2], np.array([1, 2]), levels(None, None), 0.25, 5.0, (0.3, 30.0), 0.0).tolist())) == 1


def naive_contraction(w, bar):
    groups = [{i} for i in range(len(w))]
    while True:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                x, y = sorted(groups[a]), sorted(groups[b])
                if not any(bar[i, j] for i in x for j in y):
                    c = sum(w[i, j] for i in x for j in y)
                    if c > 0 and (best is None or (-c, x[0], y[0]) < best[0]):
                        best = ((-c, x[0], y[0]), a, b)
        if best is None:
            label = np.zeros(len(w), int)
            for k, g in enumerate(sorted(groups, key=min)):
                label[list(g)] = k
            return label
        groups[best[1]] |= groups.pop(best[2])
        groups.sort(key=min)


def test_contraction_against_naive():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = rng.integers(1, 9)
        w = np.triu(np.round(rng.normal(0, 4, (n, n))), 1)
        bar = np.triu(rng.random((n, n)) < 0.1, 1)
        w, bar = w + w.T, bar | bar.T
        assert (K.contract(w, bar) == naive_contraction(w, bar)).all()


def test_multicut_keeps_levels_apart():
    xyz = np.zeros((3, 3))
    out = K.multicut(xyz, xyz, xyz, levels(0, None, 1), 6.0, 1.0, 1.0, 0.0, 0.8, "depth", (0.3, 30.0))
    assert out.tolist() in ([0, 0, 1], [0, 1, 1])


def test_near_pairs_by_cells_are_all_pairs():
    rng = np.random.default_rng(1)
    xyz = rng.normal(0, 6, (1700, 3))
    i, j = K.near_pairs(xyz, 1.2)
    a, b = np.nonzero(np.triu(K.distances(xyz, xyz) <= 1.2, 1))
    assert (i == a).all() and (j == b).all()


def test_ray_approach_crossing_skew_and_parallel():
    o = np.zeros((3, 3))
    d = np.array([[0, 0, 1.0]] * 3)
    oj = np.array([[1, 0, 5], [1, 2, 5], [3, 4, 0]], float)
    dj = np.array([[-1, 0, 0], [-1, 0, 0], [0, 0, 1]], float)
    gap, ti, tj = K.ray_approach(o, d, oj, dj)
    assert np.allclose(gap, [0, 2, 5]) and np.allclose(ti[:2], [5, 5]) and np.allclose(tj[:2], [1, 1])


def test_ray_centroid_and_fallback():
    o = np.array([[0, 0, 0], [2, 0, 0], [0, 2, 0]], float)
    d = K.unit_rows(np.array([1, 1, 4.0]) - o)
    assert np.allclose(K.ray_centroid(o, d), [1, 1, 4])
    assert K.ray_centroid(o[:1], d[:1]) is None and K.ray_centroid(o, np.zeros((3, 3))) is None


def test_support_relabels():
    out = K.with_support(np.array([0, 0, 1, 1, 2]), np.array([1, 2, 3, 3, 4]), 2)
    assert out.tolist() == [0, 0, -1, -1, -1]


def test_suppression_thinning_matching_medoid():
    keep = K.suppressed(np.arange(3), lambda k, o: np.abs(o - k) == 1, lambda v: ~v)
    assert keep.tolist() == [True, False, True]
    xyz = np.array([[0, 0, 0], [1, 0, 0], [1.5, 0, 0]], float)
    assert K.thinned(xyz, np.array([1, 2, 3]), 1.0).tolist() == [True, False, True]
    assert K.one_to_one([1, 1, 2], [7, 8, 7], [0.5, 0.6, 0.4], [0, 0, 0]).tolist() == [False, True, True]
    k, score = K.medoid(np.array([[1, 0], [1, 0.1], [0, 1]], float))
    assert k == 1 and score[1] == pytest.approx(1)


def test_geometric_median_is_not_drawn_by_an_outlier():
    xyz = np.array([[0, 0, 0]] * 5 + [[100, 0, 0]], float)
    assert np.linalg.norm(K.geometric_median(xyz)) < 0.1


def test_rotation_to_quaternion():
    a = 0.3
    q = K.rotation_to_quaternion(1.001 * np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]))
    assert np.allclose(q, [np.cos(a / 2), 0, 0, np.sin(a / 2)])


def test_similar_components_in_blocks():
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (50, 4))
    assert (K.similar_components(v, 0.8, block=7) == K.similar_components(v, 0.8)).all()
