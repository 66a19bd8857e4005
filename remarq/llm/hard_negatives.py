"""Operator 12: hard negatives by bounds along spanning trees of anchors.

An anchor is a row that is mined for. Its positives are the rows of its label with the highest inner products; a hard negative of a positive is a row of
another label whose score lies in a window below the positive's.

Anchors are cut into chunks of rows of near labels and like signs, and every task that gets a chunk spans it by the shortest tree. A candidate's score at an anchor differs from that
at the anchor's parent by at most the edge's length times the candidate's norm; so scores go down the tree as intervals, and only candidates whose interval
meets what the anchor still wants (a place among the positives, or among the best of a window) are scored again. The root scores all. How much
this saves depends on the vectors: of random directions nearly nothing (the intervals hold every window), of dense groups most.

A chunk meets candidates in lanes: each task reads a chunk, then streams its share of the candidates in batches and keeps the best found so far, so its memory is a chunk, a
batch and the tree's open intervals. Candidates go to a chunk once for positives (those of its labels) and once for negatives: the work is that of all anchors with all rows, in blocks.

Scores are sums of whole numbers in double precision, exact below 2**53. Defined cases: rows whose id, label or vector is null, or with a component that is null or not finite, take
no part; of rows that repeat an id the one with the least label, then vector, does; shorter vectors end in zeros; ties go to the smaller id; an anchor without rows of its label has no
positives and no result, one with fewer has as many as there are; windows below a negative score are empty; empty tables give no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .columns import column

#: Anchors of a chunk, about; their distances take 8 bytes a pair in a task.
CHUNK = 512
#: Components whose signs order the anchors of a label.
SIGNS = 16
#: Share of a batch from which all of it is scored, which is then quicker.
MOST = 0.6


@dataclass(frozen=True)
class Wanted:
    """How many positives and negatives, and the window: hundredths of the positive's score, both ends in it."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95


def rows_of(df: DataFrame, key: str, label: Column, vector: Column) -> DataFrame:
    """id, label, q (doubles) of the rows that take part, one an id."""
    plain = df.select(column(key).cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("q")).where("id is not null and label is not null and q is not null")
    good = plain.where(~F.exists("q", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return good.groupBy("id").agg(F.min(F.struct("label", "q")).alias("own")).select("id", "own.label", "own.q")


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows, filled up with zeros to the longest."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def spanning_tree(points: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The shortest tree from the first point (by Prim): its points with parents before children, each one's parent (-1) and distance to it."""
    n = len(points)
    squares = (points**2).sum(axis=1)
    far = np.sqrt(np.maximum(0.0, squares[:, None] + squares[None, :] - 2 * points @ points.T))
    parent, length, open_ = np.full(n, -1), far[0].copy(), np.ones(n, bool)
    open_[0] = False
    parent[1:] = 0
    children: list[list[int]] = [[] for _ in range(n)]
    for _ in range(n - 1):
        v = int(np.where(open_, length, np.inf).argmin())
        open_[v] = False
        children[parent[v]].append(v)
        nearer = open_ & (far[v] < length)
        length[nearer], parent[nearer] = far[v][nearer], v
    order, todo = [], [0] if n else []
    while todo:
        order.append(v := todo.pop())
        todo += children[v]
    length = np.array([0.0 if p < 0 else np.linalg.norm(points[v] - points[p]) for v, p in enumerate(parent)])
    return order, parent, length


class Chunk:
    """The anchors of a task with their tree, and how many scores candidates have cost."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order, self.parent, self.length = spanning_tree(points)
        last = {int(self.parent[v]): v for v in self.order}  # a parent's intervals go with its last child
        self.over = {v: p for p, v in last.items() if p >= 0}
        self.parents = set(map(int, self.parent))
        self.scored = self.bounded = 0

    def scan(self, rows: np.ndarray, want: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every anchor the candidates that it wants by their bounds, and their scores. ``want`` gets the anchor and the lowest and highest possible scores."""
        norms = np.sqrt((rows**2).sum(axis=1))
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        everything = np.arange(len(rows))
        for v in self.order:
            p = int(self.parent[v])
            if p < 0:
                at, low = everything, np.full(len(rows), -np.inf)
                high = -low
            else:
                reach = norms * (self.length[v] * (1 + 1e-9)) + 1e-3
                low, high = kept[p][0] - reach, kept[p][1] + reach
                at = np.flatnonzero(want(v, low, high))
                if v in self.over:
                    del kept[self.over[v]]
            if len(at) >= MOST * len(rows):
                at, s = everything, rows @ self.points[v]
                low = high = s
            else:
                s = rows[at] @ self.points[v]
                low[at] = high[at] = s
            self.scored, self.bounded = self.scored + len(at), self.bounded + len(rows) - len(at)
            if v in self.parents:
                kept[v] = low, high
            yield v, at, s


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class _Best:
    """The best rows found so far for one goal."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            self.ids, self.scores = np.append(self.ids, ids), np.append(self.scores, scores)
            top = first_of(self.ids, self.scores, self.k)
            self.ids, self.scores = self.ids[top], self.scores[top]

    def floor(self) -> float:
        """A score below which nothing can enter."""
        return float(self.scores.min()) if len(self.ids) == self.k else -np.inf


class _Positives:
    """Per anchor the best other rows of its label."""

    def __init__(self, anchors: pa.Table, wanted: Wanted):
        self.ids, self.labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        self.k, self.best = wanted.positives, [_Best(wanted.positives) for _ in self.ids]

    def take(self, chunk: Chunk, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        for label in np.unique(labels[np.isin(labels, self.labels)]):
            # only a label's rows concern its anchors; the tree runs through all of the chunk's
            own = np.flatnonzero(labels == label)

            def want(v: int, low: np.ndarray, high: np.ndarray, of=ids[own], label=label) -> np.ndarray:
                if self.labels[v] != label:
                    return np.zeros(len(low), bool)
                other = of != self.ids[v]
                return other & (high >= max(self.best[v].floor(), kth_largest(low[other], self.k)))

            for v, at, s in chunk.scan(rows[own], want):
                if self.labels[v] == label:
                    other = ids[own][at] != self.ids[v]
                    self.best[v].add(ids[own][at][other], s[other])

    def found(self) -> list[tuple]:
        return [(int(a), int(i), float(s)) for a, b in zip(self.ids, self.best, strict=True) for i, s in zip(b.ids, b.scores, strict=True)]


class _Negatives:
    """Per anchor and positive the best rows of other labels in the window."""

    def __init__(self, anchors: pa.Table, wanted: Wanted):
        self.ids, self.labels, self.wanted = anchors["id"].to_numpy(), anchors["label"].to_numpy(), wanted
        self.goals = [[(p["score"], p["id"], _Best(wanted.negatives)) for p in of if p["score"] >= 0] for of in anchors["positives"].to_pylist()]

    def take(self, chunk: Chunk, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        w = self.wanted

        def want(v: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            found, other = np.zeros(len(low), bool), labels != self.labels[v]
            for score, _, best in self.goals[v]:
                inside = other & (100 * low >= w.least * score) & (100 * high <= w.most * score)
                floor = max(best.floor(), kth_largest(low[inside], w.negatives))
                found |= other & (100 * high >= w.least * score) & (100 * low <= w.most * score) & (high >= floor)
            return found

        for v, at, s in chunk.scan(rows, want):
            other = labels[at] != self.labels[v]
            own, s = ids[at][other], s[other]
            for score, _, best in self.goals[v]:
                inside = (100 * s >= w.least * score) & (100 * s <= w.most * score)
                best.add(own[inside], s[inside])

    def found(self) -> list[tuple]:
        return [(int(a), int(p), float(score), int(i), float(s)) for a, goals in zip(self.ids, self.goals, strict=True) for score, p, b in goals for i, s in zip(b.ids, b.scores, strict=True)]


def _meet(anchors: DataFrame, rows: DataFrame, goal: type[_Positives] | type[_Negatives], wanted: Wanted, names: list[str], kinds: str) -> DataFrame:
    """What a goal finds for chunk and lane: anchors (c, lane, id, label, q, and positives) come before the rows (c, lane, id, label, q) that they meet."""
    asks = "positives" in anchors.columns
    nothing = "cast(null as array<struct<score: double, id: bigint>>) as positives"
    first = anchors.selectExpr("c", "lane", "0 as role", "id", "label", "q", "positives" if asks else nothing)
    both = first.union(rows.selectExpr("c", "lane", "1 as role", "id", "label", "q", nothing))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, chunk, own = None, [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            if own is not None and (found := own.found()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)

        for part in parts:
            places = np.column_stack([part.column(i).to_numpy() for i in range(3)]) if part.num_rows else np.zeros((0, 3))
            cuts = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
                if a == b:
                    continue
                c, lane, role = map(int, places[a])
                some = part.slice(a, b - a)
                if (c, lane) != at:
                    yield from done()
                    at, held, chunk, own = (c, lane), [], None, None
                if role == 0:
                    held.append(some)
                    continue
                if chunk is None and held:
                    table = pa.Table.from_batches(held)
                    chunk, own, held = Chunk(matrix(table["q"])), goal(table, wanted), []
                if chunk is not None:
                    width = chunk.points.shape[1]  # what the anchors lack counts as zero
                    own.take(chunk, matrix(some.column(5), width)[:, :width], some.column(3).to_numpy(), some.column(4).to_numpy())
        yield from done()

    return both.repartition("c", "lane").sortWithinPartitions("c", "lane", "role", "id").mapInArrow(run, kinds)


def mine(rows: DataFrame, is_anchor: Column, wanted: Wanted | None = None, chunk: int = CHUNK) -> DataFrame:
    """From ``id, label, q``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    w = wanted or Wanted()
    rows = stored(rows, "vectors")
    spark = rows.sparkSession
    anchors = rows.where(is_anchor)
    n = anchors.count()
    n_chunks = max(1, -(-n // chunk))
    lanes = max(1, -(-2 * spark.sparkContext.defaultParallelism // n_chunks))
    signs = F.array_join(F.transform(F.slice("q", 1, SIGNS), lambda x: F.when(x < 0, "0").otherwise("1")), "")
    ordered = anchors.withColumn("signs", signs).repartitionByRange(n_chunks, "label", "signs", "id").withColumn("c", F.spark_partition_id())
    chunks = stored(ordered.select("c", "id", "label", "q"), "anchor-chunks")
    every_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int").alias("lane")
    of_labels = chunks.select("label", "c").distinct()
    near = rows.join(of_labels, "label").select("c", lane, "id", "label", "q")
    positives = _meet(chunks.select("c", every_lane, "id", "label", "q"), near, _Positives, w, ["anchor_id", "id", "score"], "anchor_id long, id long, score double")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    top = positives.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= w.positives).groupBy("anchor_id").agg(F.collect_list(F.struct("score", "id")).alias("positives"))
    asking = stored(chunks.join(top, chunks["id"] == top["anchor_id"]).select("c", "id", "label", "q", "positives"), "anchors-with-positives", instead_of=chunks)
    others = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("c"), lane, "id", "label", "q")
    kinds = "anchor_id long, positive_id long, positive_score double, negative_id long, negative_score double"
    found = _meet(asking.select("c", every_lane, "id", "label", "q", "positives"), others, _Negatives, w, [k.split()[0] for k in kinds.split(", ")], kinds)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= w.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))


def report(embeddings: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", wanted: Wanted | None = None) -> DataFrame:
    """:func:`mine` over whole numbers (256ths, rounded down), where every 50th id is an anchor and every 7th row has the next label of ten."""
    own = F.when(column(key) % 7 == 0, (column(label).cast("long") + 1) % 10).otherwise(column(label).cast("long"))
    # null and other components that are no numbers stay what they are, and take their row out
    whole = F.transform(column(vector).cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(_floor(x * 256)))
    return mine(rows_of(embeddings, key, own, whole), F.col("id") % 50 == 0, wanted)


def _floor(x: Column) -> Column:
    """Rounded down, as a double; beyond 2**52 every double is whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def report_sql(wanted: Wanted | None = None) -> str:
    """The same rows in DuckDB SQL."""
    w = wanted or Wanted()
    return f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {w.positives})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {w.least} * positive_score <= 100 * s.score AND 100 * s.score <= {w.most} * positive_score
QUALIFY rank <= {w.negatives}"""
