"""Hulls of points that all are corners, and of flat and repeated ones, within time."""

import time

import numpy as np
import pytest

from orbifold.operators import metrics


def volume(x):
    pts, tri = metrics.hull_facets(x)
    a, b, c = (pts[tri[:, k]] - pts.mean(axis=0) for k in range(3))
    n = np.cross(b - a, c - a)
    off = (pts - pts.mean(axis=0)) @ n.T - (n * a).sum(axis=1)
    assert (off <= 1e-9 * np.abs(pts).max() ** 3).all()  # no point lies outside a triangle
    edges = {(int(t[k]), int(t[(k + 1) % 3])) for t in tri for k in range(3)}
    assert len(edges) == 3 * len(tri) and all((v, u) in edges for u, v in edges)  # closed
    return float((a * np.cross(b, c)).sum() / 6)


def test_work_of_a_hull_grows_with_its_corners():
    rng, took = np.random.default_rng(0), []
    for n in (2_000, 16_000):
        s = rng.normal(size=(n, 3))
        s /= np.linalg.norm(s, axis=1, keepdims=True)
        begun = time.perf_counter()
        pts, tri = metrics.hull_facets(s)
        took.append(time.perf_counter() - begun)
        assert len(tri) == 2 * n - 4 and len(np.unique(tri)) == n
    assert took[1] < 25 * took[0]  # eight times the points; more than fifty times the time before


@pytest.mark.parametrize("kind", ["grid", "cube", "prism", "doubled", "ball", "narrow"])
def test_hulls_of_awkward_points(kind):
    rng = np.random.default_rng(2)
    cube = np.array(np.meshgrid(*[[0.0, 1.0]] * 3)).reshape(3, -1).T
    around = np.arange(48) * 2 * np.pi / 48
    x, want = {
        "grid": (np.array(np.meshgrid(*[np.arange(6.0)] * 3)).reshape(3, -1).T, 125.0),
        "cube": (np.concatenate([cube, np.eye(3)[rng.integers(0, 3, 300)] * 0 + np.where(np.eye(3, dtype=bool)[rng.integers(0, 3, 300)], rng.integers(0, 2, (300, 1)), rng.random((300, 3)))]), 1.0),
        "prism": (np.concatenate([np.column_stack([np.cos(around), np.sin(around), np.full(48, h)]) for h in (0.0, 0.5, 1.0)]), 24 * np.sin(2 * np.pi / 48)),
        "doubled": (np.repeat(cube, 4, axis=0), 1.0),
        "ball": (np.concatenate([cube * 4 - 2, rng.normal(size=(500, 3)) * 0.2]), 64.0),
        "narrow": (cube * [1, 1, 1e-4], 1e-4),
    }[kind]
    assert np.isclose(volume(x), want, rtol=1e-9)
