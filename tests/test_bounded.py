"""Clusters of one dense map: the memory stays far under a table of all pairs, and the clusters are those of the plain form."""

import tracemalloc

import numpy as np
import pytest

from terravane.operators import kernels as K

RANGE = (0.3, 30.0)


def dense_map(n, seed=7):
    """Places, origins, directions, keyframes, levels and vectors of rows that are nearly all within reach of each other; a third are copies."""
    rng = np.random.default_rng(seed)
    xyz, keyframe = rng.normal(0, 1, (n, 3)) * [2.5, 0.5, 2.5], rng.integers(0, 10, n)
    xyz[: n // 3] = xyz[n // 3 : 2 * (n // 3)]
    origins = np.c_[keyframe * 1.5, np.full(n, 1.6), keyframe * -0.5]
    return xyz, origins, K.unit_rows(xyz - origins), keyframe, rng.choice([np.nan, -1.0, 0.0, 1.0], n), rng.normal(0, 1, (n, 16))


def peak(run):
    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


@pytest.mark.parametrize("bits", [1 << 31, 1200 * 1200 // 3])
def test_cdog_of_a_dense_map_keeps_bits_only(monkeypatch, bits):
    xyz, origins, rays, keyframe, level, _ = dense_map(1200)
    monkeypatch.setattr(K, "BITS", bits)
    out, most = peak(lambda: K.cdog(xyz, origins, rays, keyframe, level, 0.5, 6.0, RANGE, 0.8))
    i, j = K.near_pairs(xyz, 6.0)
    ok = (keyframe[i] != keyframe[j]) & (np.isnan(level[i]) | np.isnan(level[j]) | (level[i] == level[j]))
    i, j = i[ok], j[ok]
    gap, ti, tj = K.ray_approach(origins[i], rays[i], origins[j], rays[j])
    ok = (gap <= 0.5) & (np.minimum(ti, tj) >= 0.3) & (np.maximum(ti, tj) <= 30)
    i, j = i[ok], j[ok]
    table = np.zeros((1200, 1200))
    table[i, j] = table[j, i] = 1
    size, both = table.sum(axis=1), table @ table
    keep = both[i, j] >= 0.8 * np.minimum(size[i], size[j])
    assert out.tolist() == K.compact(K.components(1200, i[keep], j[keep])).tolist() and len(set(out.tolist())) > 1
    assert most < 8 << 20


@pytest.mark.parametrize(
    "settings",
    [
        pytest.param((6.0, 1.0, 2.5, 0.0, 0.8, "depth"), id="multicut"),
        pytest.param((6.0, 1.0, 2.5, 0.5, 0.1, "ray"), id="semantic_multicut"),
        pytest.param((6.0, 1.0, 2.0, 0.0, 0.8, "depth"), id="parameter_sweep"),
    ],
)
def test_multicut_of_a_dense_map_without_a_table_of_pairs(settings):
    n = 700
    xyz, origins, rays, _, level, vectors = dense_map(n)
    radius, geo, pivot, sem, sem_pivot, source = settings
    out, most = peak(lambda: K.multicut(xyz, origins, rays, level, *settings, RANGE, vectors))
    barred = (level[:, None] != level) & ~np.isnan(level[:, None]) & ~np.isnan(level)
    i, j = np.nonzero(np.triu((K.distances(xyz, xyz) <= radius) & ~barred, 1))
    d = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(axis=1))
    if source == "ray":
        d, ti, tj = K.ray_approach(origins[i], rays[i], origins[j], rays[j])
        d[(np.minimum(ti, tj) < 0.3) | (np.maximum(ti, tj) > 30)] = np.nan
    unit = K.unit_rows(vectors)
    w = np.zeros((n, n))
    w[i, j] = np.nan_to_num(geo * (1 - d / pivot) + (sem * (np.einsum("ij,ij->i", unit[i], unit[j]) - sem_pivot) if sem else 0.0))
    assert out.tolist() == K.contract(w + w.T, barred).tolist() and 1 < len(set(out.tolist())) < n
    assert most < 8 * n * n


def test_multicut_over_many_cells_and_rows_without_a_place():
    rng = np.random.default_rng(8)
    n = 500
    xyz, level = rng.normal(0, 1, (n, 3)) * [14, 3, 9], rng.choice([np.nan, 0.0, 1.0], n)
    xyz[7] = np.nan
    barred = (level[:, None] != level) & ~np.isnan(level[:, None]) & ~np.isnan(level)
    d = K.distances(xyz, xyz)
    w = np.where((d <= 3.0) & ~barred & ~np.eye(n, dtype=bool), 1 - d / 2.0, 0.0)
    out = K.multicut(xyz, xyz, xyz, level, 3.0, 1.0, 2.0, 0.0, 0.8, "depth", RANGE)
    assert out.tolist() == K.contract(w, barred).tolist() and (out == out[7]).sum() == 1


@pytest.mark.parametrize(("sem", "pivot", "source"), [(0.5, 0.1, "ray"), (2.0, 0.3, "depth"), (0.1, -0.5, "ray"), (-0.3, 0.1, "ray")])
def test_semantic_multicut_with_parallel_rays_and_copies(sem, pivot, source):
    for seed in range(3):
        n = 150 + 100 * seed
        xyz, origins, rays, _, level, vectors = dense_map(n, seed)
        vectors[: n // 3] = vectors[n // 3 : 2 * (n // 3)]
        rays[::5], rays[1::7] = rays[0], -rays[0]
        barred = (level[:, None] != level) & ~np.isnan(level[:, None]) & ~np.isnan(level)
        i, j = np.nonzero(np.triu((K.distances(xyz, xyz) <= 6.0) & ~barred, 1))
        d = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(axis=1))
        if source == "ray":
            d, ti, tj = K.ray_approach(origins[i], rays[i], origins[j], rays[j])
            d[(np.minimum(ti, tj) < 0.3) | (np.maximum(ti, tj) > 30)] = np.nan
        unit = K.unit_rows(vectors)
        w = np.zeros((n, n))
        w[i, j] = np.nan_to_num(1 - d / 2.5 + sem * (np.einsum("ij,ij->i", unit[i], unit[j]) - pivot))
        out = K.multicut(xyz, origins, rays, level, 6.0, 1.0, 2.5, sem, pivot, source, RANGE, vectors)
        assert out.tolist() == K.contract(w + w.T, barred).tolist()


def test_semantic_multicut_looks_at_few_distances_before_it_begins(monkeypatch):
    n = 1500
    xyz, origins, rays, _, level, vectors = dense_map(n)
    seen, begun, plain = [0], [], K.ray_approach
    monkeypatch.setattr(K, "ray_approach", lambda oi, di, oj, dj: seen.__setitem__(0, seen[0] + max(np.size(oi), np.size(oj)) // 3) or plain(oi, di, oj, dj))
    monkeypatch.setattr(K, "heapq", type("Heap", (), {"heappush": K.heapq.heappush, "heappop": staticmethod(lambda h, pop=K.heapq.heappop: begun.append(seen[0]) or pop(h))}))
    K.multicut(xyz, origins, rays, level, 6.0, 1.0, 2.5, 0.5, 0.1, "ray", RANGE, vectors)
    assert begun[0] < n * (n - 1) // 2 // 10
