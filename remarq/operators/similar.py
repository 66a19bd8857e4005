"""Exact similarity search by cosine: cells around pivots, cut into tiles that one task compares by matrix products.

Vectors have length one, so a cosine of theta is a distance of sqrt(2 - 2 theta) at most, and distances obey the triangle inequality. Every vector's home is the cell
of its nearest pivot. If x and y are that close and y's home is another pivot p, then x lies no farther from p than from its own pivot plus twice the distance, nor than the
cell's radius plus the distance; so x also goes to all such cells, as an outer row, and nothing is lost. (It goes to cells of smaller numbers only, which is where each pair then meets once.) A cell's rows are
dealt to blocks by hash and written to the shared folder, once; each pair of blocks is a tile, whose task reads both from there, and in a tile only rows whose distances to the pivot differ by no more than the bound are multiplied.

How much this spares depends on the vectors: texts that fall into groups meet few others, random directions meet all. Cells that spare nothing would only copy every row into all of them, so the number of
pivots is the one at which a sample's rows make the least work, down to a single cell, and never one at which rows have more than one outer copy in the mean: disk grows as the rows, while what is read and multiplied may grow as their square. Memory of a task is two blocks; a cell with a third
of all rows is many tiles, not a large task. Pivots come from a bounded sample and steer the work alone: results do not hang on them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, forget, fresh_folder, open_fs, stored

#: Rows of a block; rows a pivot is chosen for; pivots at most (8 bytes a component each, in every task); rows of which they are chosen.
BLOCK, CELL_ROWS, MOST_PIVOTS, SAMPLE = 4096, 48, 1024, 8192
#: Rows whose distances to all pivots are held at once; placed rows of an output batch; pairs that take as long as a row that is copied to a tile.
SLICE, PLACED, ROW_PAIRS = 1024, 8192, 200
#: What a cosine may lack, for rounding.
SLACK = 1e-12
HOME, OUTER = 0, 1


def radius(theta: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * (theta - SLACK)))) + 1e-9


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Lists as rows of length one (zeros stay zeros); shorter ones end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    norms = np.linalg.norm(out, axis=1)
    return out / np.where(norms == 0, 1.0, norms)[:, None]


def units(rows: DataFrame, width: int) -> DataFrame:
    """``v`` (array<double>) as the bytes of ``width`` doubles of length one; other columns stay."""
    names = rows.columns
    at = names.index("v")
    kinds = ", ".join(f"{n} {'binary' if n == 'v' else k}" for n, k in rows.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = unit_rows(part.column(at))
            found = np.pad(found, ((0, 0), (0, width - found.shape[1])))
            own = [pa.array([r.tobytes() for r in found], pa.binary()) if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(own, names=names)

    return rows.mapInArrow(run, kinds)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Values of ``width`` doubles each as rows, without a copy."""
    if not len(vectors):
        return np.zeros((0, width))
    _, offsets, data = vectors.buffers()
    ends = np.frombuffer(offsets, np.int32)[[vectors.offset, vectors.offset + len(vectors)]]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[1]].view(float).reshape(len(vectors), width)


@dataclass(frozen=True)
class Cells:
    """Pivots, and for each the largest distance of a row whose home it is."""

    points: np.ndarray
    radii: np.ndarray

    @property
    def width(self) -> int:
        return self.points.shape[1]

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (vectors**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None] - 2 * vectors @ self.points.T))


def _cheapest(points: np.ndarray, pivots: np.ndarray, n: int, theta: float) -> int:
    """Of these pivots, how many of the first ones to take: cells of ``n`` rows like the sample's points hold pairs, and copy rows to tiles."""
    reach, share = radius(theta), n / len(points)
    every = Cells(pivots, np.zeros(len(pivots))).distances(points)
    best, least = 1, np.inf
    for p in sorted({len(pivots) >> i for i in range(len(pivots).bit_length())} | {1}):
        far = every[:, :p]
        home = far.argmin(axis=1)
        own = far[np.arange(len(far)), home]
        radii = np.full(p, -np.inf)
        np.maximum.at(radii, home, own)
        near = (far <= own[:, None] + 2 * reach + 1e-6) & (far <= radii[None] + reach + 1e-6) & (np.arange(p)[None] < home[:, None])
        inside, outer = np.bincount(home, minlength=p) * share, near.sum(axis=0) * share
        if outer.sum() > n:  # what lies in the shared folder stays within two copies of the rows
            continue
        tiles = np.ceil(inside / BLOCK) + np.ceil(outer / BLOCK)
        cost = (inside * (inside / 2 + outer)).sum() + ROW_PAIRS * (inside * tiles + outer * np.ceil(inside / BLOCK)).sum()
        if cost < least:
            best, least = p, cost
    return best


def _pivots(rows: DataFrame, width: int, n: int, theta: float | None) -> np.ndarray:
    """About a row of CELL_ROWS, from a sample; taken one after the other as those that lie farthest from all before, as long as they spare work at ``theta``."""
    wanted = int(min(MOST_PIVOTS, max(1, n // CELL_ROWS)))
    chosen = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, n)))
    found = rows.where(chosen).select("v").limit(2 * SAMPLE).toArrow()
    points = matrix(found.column(0).combine_chunks(), width) if len(found) else np.zeros((1, width))
    at, far = [0], np.full(len(points), np.inf)
    while len(at) < min(wanted, len(points)):
        far = np.minimum(far, np.linalg.norm(points - points[at[-1]], axis=1))
        if far.max() < 1e-9:
            break
        at.append(int(far.argmax()))
    return points[at] if theta is None else points[at[: _cheapest(points, points[at], n, theta)]]


def _sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for start in range(0, part.num_rows, SLICE):
            yield part.slice(start, SLICE)


def cells(rows: DataFrame, width: int, theta: float | None = None) -> Cells:
    """Cells for the rows' vectors ``v``, and any rows among them: as many as spare work in a search by ``theta``."""
    found = Cells(points := _pivots(rows, width, rows.count(), theta), np.zeros(len(points)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest = np.full(len(points), -1.0)
        for part in _sliced(parts):
            if part.num_rows:
                far = found.distances(matrix(part.column(0), width))
                np.maximum.at(widest, far.argmin(axis=1), far.min(axis=1))
        told = np.flatnonzero(widest >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), pa.array(widest[told])], names=["cell", "r"])

    radii = np.full(len(points), -1.0)
    for r in rows.select("v").mapInArrow(run, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r")).collect():  # a row a pivot
        radii[r["cell"]] = r["r"]
    return Cells(points, radii)


def placed(rows: DataFrame, into: Cells, theta: float) -> DataFrame:
    """``k, g, serves, asks, v`` with cell, role and ``away`` (the distance to the cell's pivot): a row at home, and one in every cell where it could meet another cell's."""
    reach = radius(theta)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(parts):
            far = into.distances(matrix(part.column(4), into.width))
            home = far.argmin(axis=1)
            near = (far <= far[np.arange(len(far)), home][:, None] + 2 * reach + 1e-6) & (far <= into.radii[None] + reach + 1e-6)
            near &= np.arange(len(into.points))[None] < home[:, None]
            near[np.arange(len(far)), home] = True
            rows_, cells_ = np.nonzero(near)
            for start in range(0, len(rows_), PLACED):
                i, cell = rows_[start : start + PLACED], cells_[start : start + PLACED]
                taken = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array((cell != home[i]).astype(np.int8), pa.int8()), pa.array(far[i, cell])], names=["k", "g", "serves", "asks", "v", "cell", "role", "away"])

    return rows.select("k", "g", "serves", "asks", "v").mapInArrow(run, "k long, g string, serves boolean, asks boolean, v binary, cell int, role tinyint, away double")


def _sizes(rows: DataFrame) -> DataFrame:
    """Per group and cell its numbers of rows at home and of outer ones."""
    return rows.groupBy("g", "cell").agg(F.count_if(F.col("role") == HOME).alias("home"), F.count_if(F.col("role") == OUTER).alias("outer"))


def work(rows: DataFrame) -> tuple[int, int]:
    """Of placed rows: the pairs that tiles hold, and those that all rows of a group make."""
    sizes = _sizes(rows)
    pairs = sizes.agg(F.sum(F.expr("home * (home - 1) div 2 + home * outer"))).first()[0] or 0
    every = sizes.groupBy("g").agg(F.sum("home").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    return pairs, every


class _Block:
    """Rows of a block, by their distance to the cell's pivot."""

    def __init__(self, rows: pa.Table, width: int):
        rows = rows.combine_chunks()
        self.k, self.away = rows["k"].to_numpy(), rows["away"].to_numpy()
        self.serves, self.asks = (rows[c].to_numpy().astype(bool) for c in ("serves", "asks"))
        self.v = matrix(rows["v"].combine_chunks(), width)


def _runs(parts: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that follow each other with the same values in the first columns, and these."""
    held: list[pa.RecordBatch] = []
    at = None
    for part in parts:
        keys = list(zip(*(part.column(i).to_pylist() for i in range(columns)), strict=True))
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a == b:
                continue
            if keys[a] != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = keys[a]
            held.append(part.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def _blocks(rows: DataFrame, block: int, folder: str) -> DataFrame:
    """Placed rows, each written once: a row for every block with where it lies in the folder's files, and whether any of its rows serves or asks."""
    n = _sizes(rows).select("g", "cell", F.ceil(F.col("home") / block).cast("int").alias("hb"), F.ceil(F.col("outer") / block).cast("int").alias("ob"))
    own = F.pmod(F.xxhash64("k"), F.when(F.col("role") == HOME, F.col("hb")).otherwise(F.col("ob"))).cast("int")
    key = ["g", "cell", "role", "no"]
    dealt = rows.join(n.where("hb > 0"), ["g", "cell"]).withColumn("no", own).select(*key, "k", "serves", "asks", "v", "away")
    kinds = "g string, cell int, role tinyint, no int, file string, start long, size long, serves boolean, asks boolean"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_fs(folder)
        name = uuid.uuid4().hex  # a task that runs twice writes another file, and its blocks are told once
        told, out = [], None
        try:
            for at, table in _runs(parts, len(key)):
                if out is None:
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}")
                start = out.tell()
                own = table.select(["k", "serves", "asks", "v", "away"])
                with pa.ipc.new_stream(out, own.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                    w.write_table(own)
                told.append((*at, name, start, out.tell() - start, *(pc.any(own[c]).as_py() for c in ("serves", "asks"))))
        finally:
            if out is not None:
                out.close()
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told, strict=True), _TOLD, strict=True)], names=names)

    return dealt.repartition(*key).sortWithinPartitions(*key, "away").mapInArrow(run, kinds)


_TOLD = [pa.string(), pa.int32(), pa.int8(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]


def _tiles(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of a cell, at home both or one of outer rows, in which some row asks one that serves."""

    def side(role: int, name: str) -> DataFrame:
        return blocks.where(F.col("role") == role).select("g", "cell", *(F.col(c).alias(f"{name}_{c}") for c in ("no", "file", "start", "size", "serves", "asks")))

    inside = side(HOME, "x").join(side(HOME, "y"), ["g", "cell"]).where("x_no <= y_no").withColumn("of", F.lit(HOME))
    across = side(HOME, "x").join(side(OUTER, "y"), ["g", "cell"]).withColumn("of", F.lit(OUTER))
    return inside.unionByName(across).where("x_asks and y_serves or x_serves and y_asks")


def _near(x: _Block, y: _Block, same: bool, theta: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of rows of x and y whose cosine is large enough, and it: every pair once, or those that one of them asks for alone if these are fewer products."""
    every = [(np.ones(len(x.k), bool), np.ones(len(y.k), bool))]
    asked = [(x.asks, y.serves)] if same else [(x.asks, y.serves), (x.serves, y.asks)]
    products = [sum(int(a.sum()) * int(b.sum()) for a, b in some) for some in (every, asked)]
    once = same and products[0] <= products[1]
    for left, right in every if products[0] <= products[1] else asked:
        left, right = np.flatnonzero(left), np.flatnonzero(right)
        own, other, away = x.v[left], y.v[right], y.away[right]
        for start in range(0, len(left), 256):
            i = left[start : start + 256]
            low, high = np.searchsorted(away, [x.away[i[0]] - reach, x.away[i[-1]] + reach + 1e-12])
            if low == high:
                continue
            cos = own[start : start + 256] @ other[low:high].T
            a, b = np.nonzero(cos >= theta - SLACK)
            c = cos[a, b]
            a, b = i[a], right[low + b]
            if once:
                kept = a < b
                a, b, c = a[kept], b[kept], c[kept]
            yield a, b, c


def _compared(rows: DataFrame, width: int, block: int, found: Callable[[_Block, _Block, bool], Iterator[list[np.ndarray]]], kinds: str, name: str, once_more: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What is found in all tiles, stored. Blocks lie in the shared folder once, tasks read them from there two at a time, and nothing but what is found is shuffled; blocks go when it is stored."""
    spark = rows.sparkSession
    folder = fresh_folder(spark, "blocks")
    tiles = stored(_tiles(blocks := stored(_blocks(rows, block, folder), "block-places")), "tiles", instead_of=blocks)
    n, cores = tiles.count(), spark.sparkContext.defaultParallelism
    edge = max(1, min(8, int((n / (8 * cores)) ** 0.5)))  # tiles of a square tell of few rows: it is a task's, unless there are few
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_fs(folder)

        @lru_cache(2)
        def read(file: str, start: int, size: int) -> _Block:
            with files.open_input_file(f"{path}/{file}") as f:
                return _Block(pa.ipc.open_stream(f.read_at(size, start)).read_all(), width)

        for part in parts:
            for t in part.to_pylist():
                one, other = (tuple(t[f"{side}_{c}"] for c in ("file", "start", "size")) for side in "xy")
                for out in found(read(*one), read(*other), one == other):
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    square = ["g", "cell", "of", F.expr(f"x_no div {edge}"), F.expr(f"y_no div {edge}")]
    dealt = tiles.repartitionByRange(max(1, min(n, max(4 * cores, n // 64))), *square).sortWithinPartitions("x_file", "x_start")
    out = stored(once_more(dealt.mapInArrow(run, kinds)), name)
    forget(tiles)
    drop(folder)
    return out


def pairs(rows: DataFrame, width: int, theta: float, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), cosine of the placed rows of a group that are close enough."""
    reach = radius(theta)

    def found(x: _Block, y: _Block, same: bool) -> Iterator[list[np.ndarray]]:
        for a, b, cosine in _near(x, y, same, theta, reach):
            yield [np.minimum(x.k[a], y.k[b]), np.maximum(x.k[a], y.k[b]), cosine]

    return _compared(rows, width, block, found, "a long, b long, cosine double", "pairs")


def earliest(rows: DataFrame, width: int, theta: float, block: int = BLOCK) -> DataFrame:
    """k and ``least``: for placed rows that ask, the smallest k of those that serve, come before it and are close enough. A tile tells one a row, whatever its pairs."""
    reach = radius(theta)

    def found(x: _Block, y: _Block, same: bool) -> Iterator[list[np.ndarray]]:
        least = [np.full(len(side.k), np.iinfo(np.int64).max) for side in (x, y)]
        for a, b, _ in _near(x, y, same, theta, reach):
            for own, i, other, j, to in ((x, a, y, b, least[0]), (y, b, x, a, least[1])):
                good = own.asks[i] & other.serves[j] & (other.k[j] < own.k[i])
                np.minimum.at(to, i[good], other.k[j[good]])
        for side, to in zip((x, y), least, strict=True):
            told = np.flatnonzero(to < np.iinfo(np.int64).max)
            yield [side.k[told], to[told]]

    return _compared(rows, width, block, found, "k long, least long", "earliest", lambda each: each.groupBy("k").agg(F.min("least").alias("least")))


def met(rows: DataFrame, into: Cells, theta: float, block: int = BLOCK) -> DataFrame:
    """:func:`earliest` of rows ``k, g, serves, asks, v``; those that do neither are not placed."""
    return earliest(placed(rows.where("serves or asks"), into, theta), into.width, theta, block)


def led(nodes: DataFrame, into: Cells, theta: float, block: int = BLOCK) -> DataFrame:
    """From ``k`` (unique, the order), ``g``, ``hash``, ``v``: the k of rows that lead.

    The lexicographically first independent set, as a fixpoint: a row leads if no undecided row before it is close to it or has its hash; what a leader is close to, or shares a hash with, is
    decided; the others go on. Rounds are as many as the longest chain of rows that wait for each other, not as rows; each is a search over what is undecided.
    """
    left = stored(nodes.select("k", "g", "hash", "v"), "undecided")
    found = left.select("k").limit(0)
    while not left.isEmpty():
        waits = met(left.withColumns({"serves": F.lit(True), "asks": F.lit(True)}), into, theta, block)
        by_hash = left.groupBy("g", "hash").agg(F.min("k").alias("first"))
        now = left.select("k", "g", "hash").join(by_hash, ["g", "hash"]).join(waits, "k", "left").withColumn("leads", F.col("least").isNull() & (F.col("k") == F.col("first")))
        now = stored(now.select("k", "g", "hash", "leads"), "round", instead_of=waits)  # vectors stay with what is undecided
        claims = left.select("k", "g", "v").join(now.select("k", "leads"), "k").select("k", "g", F.col("leads").alias("serves"), (~F.col("leads")).alias("asks"), "v")
        claimed = met(claims, into, theta, block)
        hashes = now.where("leads").select("g", "hash").distinct()
        rest = now.where("not leads").join(claimed, "k", "left_anti").join(hashes, ["g", "hash"], "left_anti")
        left = stored(left.join(rest.select("k"), "k", "left_semi"), "undecided", instead_of=left)
        found = stored(found.union(now.where("leads").select("k")), "leaders", instead_of=found)
        forget(claimed)
        forget(now)
    return found
