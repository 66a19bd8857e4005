"""Density clusters against their definition on small data."""

import numpy as np
import pytest

from remarq.operators import clusters, density
from remarq.plans import pipeline


def by_definition(x, k):
    """Lower the distance through all values: parts of connected rows are clusters while they have k rows, and hold rows * (1 / distance)."""
    n = len(x)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(far, axis=1)[:, k]
    reach = np.maximum(np.maximum(far, core[:, None]), core[None])

    def parts(rows, below):
        left, out = set(rows), []
        while left:
            todo, part = [left.pop()], []
            while todo:
                v = todo.pop()
                part.append(v)
                near = [u for u in left if reach[v, u] < below]
                left -= set(near)
                todo += near
            out.append(sorted(part))
        return out

    def best(rows, born):
        """What the cluster holds, and the parts that do best."""
        start, held = list(rows), 0.0
        for d in sorted({reach[i, j] for i in rows for j in rows if i < j}, reverse=True):
            found = parts(rows, d)
            large = [p for p in found if len(p) >= k]
            if len(large) != 1 or len(large[0]) != len(rows):
                lost = len(rows) if len(large) != 1 else len(rows) - len(large[0])
                held += (1 / d - born) * lost
            if not large:
                return held, [start]
            if len(large) > 1:
                inner = [best(p, 1 / d) for p in large]
                total = sum(h for h, _ in inner)
                return (total, [q for _, qs in inner for q in qs]) if total > held or born == 0 else (held, [start])
            rows = large[0]
        return held, [start]

    if n < 2 * k:
        return set()
    _, chosen = best(list(range(n)), 0.0)
    return {tuple(p) for p in chosen if len(p) < n}


def grouped(labels):
    return {tuple(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist()) - {density.NOISE}}


@pytest.mark.parametrize("seed", range(8))
def test_clusters_are_those_of_the_definition(seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, 3)) * 4
    x = np.concatenate([centers[rng.integers(4, size=45)] + rng.normal(size=(45, 3)) * rng.uniform(0.2, 1.2), rng.uniform(-8, 8, size=(10, 3))])
    k = int(rng.integers(4, 7))
    assert grouped(density.labels(x, k)) == by_definition(x, k)


def test_dense_groups_are_found_and_the_rest_is_noise(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.05 * rng.normal(size=(30, 4)) for c in np.eye(4)[:3]] + [rng.uniform(-3, 3, size=(12, 4))])
    rows = [(f"t{t}", 1000 * t + i, v.tolist()) for t in (1, 2) for i, v in enumerate(x)] + [("t3", 1, [1.0]), ("t3", 2, None), ("t4", 1, [])]
    df = spark.createDataFrame(rows, "task_id string, seq long, embedding array<double>").repartition(5)
    got = {(r["task"], r["key"]): r["cluster_label"] for r in density.density_clusters(df).collect()}
    assert len(got) == len(rows)
    for t in (1, 2):
        of = [got[f"t{t}", 1000 * t + i] for i in range(len(x))]
        assert [len(set(of[g * 30 : g * 30 + 30])) for g in range(3)] == [1, 1, 1] and len(set(of[:90])) == 3
        assert of.count(density.NOISE) >= 8
    assert got["t3", 1] == got["t3", 2] == got["t4", 1] == density.NOISE


def test_the_ladder():
    assert [clusters.method_for(n) for n in (5, 12, 40)] == ["rules", "kmeans", "kmeans"]
    assert [clusters.method_for(n, density=True) for n in (5, 12, 29, 30, 5000, 5001)] == ["rules", "kmeans", "kmeans", "density", "density", "kmeans"]
    assert clusters.method_for(40, vectors=False, density=True) == "rules"


def test_a_run_numbers_them_by_size(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.05 * rng.normal(size=(n, 3)) for c, n in zip(np.eye(3), (20, 35, 15))] + [rng.uniform(5, 9, size=(3, 3))])
    rows = [(i, "t", v.tolist(), i == 1, False, "rule") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "seq long, task_id string, embedding array<double>, is_duplicate boolean, is_noise_row boolean, cluster_key string")
    got = {r.seq: r.cluster_id for r in pipeline.by_density(df).collect()}
    assert got[1] is None and {got[i] for i in range(20, 55)} == {0} and {got[i] for i in (0, *range(2, 20))} == {1} and {got[i] for i in range(55, 70)} == {2} and got[72] == -1
