"""Density clusters: the hierarchy of mutual reachability, cut where clusters last longest.

A row's core distance is that to its k-th nearest row; two rows reach each other at the largest of their distance and their core distances. The shortest tree under that
distance, edge by edge from the longest, splits the rows; parts of fewer than k rows are rows that fall out, and of larger parts the ones are taken that hold more (rows times the range of
1 / distance through which they stay) than the parts they split into. What is in none is noise. A task is a run, bounded by its comment limit; tasks are spread over the cluster,
and each takes memory for a few rows of distances, not for all pairs.

Defined cases: rows without a vector, or tasks of fewer rows than two clusters need, are noise; rows that part at one distance part together; more rows in a task than ``MOST_ROWS`` are an error, and
:func:`clusters.method_for` does not choose this method for them; shorter vectors end in zeros.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import MOST_ROWS

#: Distances below this count as this.
LEAST = 1e-9
ROWS_AT_ONCE = 256
NOISE = -1


def least_size(n: int) -> int:
    return max(4, math.isqrt(n))


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """The distance of every row to its k-th nearest other row."""
    squares = (x**2).sum(axis=1)
    out = np.empty(len(x))
    for i in range(0, len(x), ROWS_AT_ONCE):
        far = squares[i : i + ROWS_AT_ONCE, None] + squares[None] - 2 * x[i : i + ROWS_AT_ONCE] @ x.T
        far[np.arange(len(far)), np.arange(i, i + len(far))] = -1.0
        out[i : i + ROWS_AT_ONCE] = np.sqrt(np.maximum(0.0, np.partition(far, k, axis=1)[:, k]))
    return out


def reach_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest tree by mutual reachability: its edges' ends and lengths, from short to long."""
    n = len(x)
    parent, length, open_ = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    v, ends = 0, []
    for _ in range(n - 1):
        open_[v] = False
        far = np.maximum(np.maximum(np.sqrt(((x - x[v]) ** 2).sum(axis=1)), core), core[v])
        nearer = open_ & (far < length)
        length[nearer], parent[nearer] = far[nearer], v
        v = int(np.where(open_, length, np.inf).argmin())
        ends.append((parent[v], v, length[v]))
    a, b, d = (np.array(c) for c in zip(*ends, strict=True))
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), d))
    return a[order], b[order], np.maximum(d[order], LEAST)


def _merges(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """For the node that each edge makes (counted from n) the two that it joins, and every node's rows."""
    top, size, joined = list(range(2 * n - 1)), np.ones(2 * n - 1, np.int64), []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for step, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        left, right = root(p), root(q)
        top[left] = top[right] = n + step
        size[n + step] = size[left] + size[right]
        joined.append((left, right))
    return joined, size


def labels(x: np.ndarray, k: int) -> np.ndarray:
    """A number per row: of its cluster, or NOISE."""
    n = len(x)
    out = np.full(n, NOISE, np.int64)
    if n < 2 * k:
        return out
    a, b, d = reach_tree(x, core_distances(x, k))
    joined, size = _merges(n, a, b, d)

    def rows_below(node: int) -> list[int]:
        found, todo = [], [node]
        while todo:
            i = todo.pop()
            if i < n:
                found.append(i)
            else:
                todo += joined[i - n]
        return found

    def parts(node: int) -> list[int]:
        """What a node falls into below its distance: edges of equal length go together."""
        found, todo = [], list(joined[node - n])
        while todo:
            c = todo.pop()
            if c >= n and d[c - n] == d[node - n]:
                todo += joined[c - n]
            else:
                found.append(c)
        return found

    all_ = 2 * n - 2
    born, held, parent, members = [0.0], [0.0], [-1], [rows_below(all_)]
    todo = [(all_, 0)]
    while todo:  # a node, and the cluster that it belongs to
        node, of = todo.pop()
        end = 1 / d[node - n]
        large = [c for c in parts(node) if size[c] >= k]
        held[of] += (end - born[of]) * (size[node] - size[large[0]] if len(large) == 1 else size[node])
        for c in large:
            if len(large) > 1:
                born.append(end), held.append(0.0), parent.append(of), members.append(rows_below(c))
            todo.append((c, len(born) - 1 if len(large) > 1 else of))
    children: list[list[int]] = [[] for _ in born]
    for c, p in enumerate(parent):
        if p >= 0:
            children[p].append(c)
    best, chosen = list(held), [True] * len(born)
    for c in range(len(born) - 1, 0, -1):  # children come after parents
        inner = sum(best[i] for i in children[c])
        if children[c] and inner > held[c]:
            best[c], chosen[c] = inner, False
    todo, number = list(reversed(children[0])), 0
    while todo:  # the first chosen on each way down
        c = todo.pop()
        if chosen[c]:
            out[members[c]] = number
            number += 1
        else:
            todo += reversed(children[c])
    return out


def density_clusters(df: DataFrame, task: str = "task_id", key: str = "seq", vector: str = "embedding") -> DataFrame:
    """task, key and ``cluster_label`` of every row, by the least size that a task's rows ask for."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > MOST_ROWS:
            raise ValueError(f"task {group['task'].iloc[0]} has {len(group)} rows; density clusters take {MOST_ROWS} at most")
        rows = group.sort_values("key", kind="stable")
        own = np.array([v is not None and len(v) > 0 for v in rows["v"]])
        found = np.full(len(rows), NOISE, np.int64)
        if own.any():
            width = max(len(v) for v in rows["v"][own])
            x = np.array([np.pad(np.asarray(v, float), (0, width - len(v))) for v in rows["v"][own]])
            found[own] = labels(x, least_size(len(x)))
        return pd.DataFrame({"task": rows["task"].to_numpy(), "key": rows["key"].to_numpy(), "cluster_label": found})

    keyed = df.select(F.col(task).cast("string").alias("task"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    return keyed.groupBy("task").applyInPandas(run, "task string, key long, cluster_label long")
