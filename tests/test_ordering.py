"""Density orders by a tree of places against all points at each step."""

import numpy as np
import pytest

from tamarack.operators import ordering


def brute(ids, x, eps, mps):
    reach, core, done, out, runs = np.full(len(ids), np.inf), np.full(len(ids), np.inf), np.zeros(len(ids), bool), [], []
    for _ in ids:
        left = np.flatnonzero(~done)
        at = left[int(np.argmin(reach[left]))]
        done[at] = True
        out.append(at)
        runs.append(ids[at] if np.isinf(reach[at]) else runs[-1])
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        near = d <= eps
        if near.sum() >= mps:
            core[at] = np.partition(d, mps - 1)[mps - 1]
            reach = np.where(near & ~done, np.minimum(reach, np.maximum(d, core[at])), reach)
    return out, runs, reach, core


def shapes(rng, slots):
    x = rng.normal(0, 1, (250, slots))
    yield x
    yield np.round(x, 1)  # ties
    yield np.repeat(x[:40], 6, axis=0)[rng.permutation(240)]  # copies
    yield np.where(rng.random(x.shape) < 0.03, np.nan, np.where(rng.random(x.shape) < 0.02, np.inf, x))
    yield x[:1]


@pytest.mark.parametrize(("slots", "last", "leaf"), [(1, 1, 4), (2, 30, 1), (2, 1024, 32), (3, 5, 8)])
@pytest.mark.filterwarnings("ignore:invalid value")
def test_order_against_all_points(monkeypatch, slots, last, leaf):
    monkeypatch.setattr(ordering, "LAST", last)
    monkeypatch.setattr(ordering, "LEAF", leaf)
    rng = np.random.default_rng(slots)
    for x in shapes(rng, slots):
        ids = np.sort(rng.choice(3000, len(x), replace=False)) - 50
        for eps, mps in ((0.0, 2), (0.15, 4), (0.6, 1), (9.0, 6)):
            want, got = brute(ids, x, eps, mps), ordering.density_order(ids, x, eps, mps)
            assert list(want[0]) == list(got[0]) and list(want[1]) == list(got[1])
            assert np.array_equal(want[2], got[2]) and np.array_equal(want[3], got[3])


def test_steps_look_at_few_places(monkeypatch):
    """3,000 places, all within the radius of each other: what is measured grows with their number, not its square."""
    monkeypatch.setattr(ordering, "LAST", 50)
    measured, inner = [], np.sqrt
    monkeypatch.setattr(ordering.np, "sqrt", lambda v: measured.append(np.size(v)) or inner(v))
    order, *_ = ordering.density_order(np.arange(3000), np.random.default_rng(0).normal(0, 0.1, (3000, 2)), 10.0, 5)
    assert sorted(order) == list(range(3000)) and sum(measured) < 3000 * 500
