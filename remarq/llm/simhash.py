"""Operator 10: near duplicates by SimHash, found by covering locality-sensitive hashing.

Every bit position has a vector of four bits. For each of the 15 non-zero vectors v, a mask keeps the
positions whose vector has odd overlap with v. Three differing positions span three dimensions at most, so some
v is orthogonal to all of them: its mask drops exactly such positions, and the two fingerprints
collide in its table. That holds for every pair within the radius, without exception.

Only distinct fingerprints enter the tables. A bucket with more than ``BUCKET`` of them goes to another level: 15 masks
from other vectors split it further, under the same guarantee, on the positions still open. Three
levels leave 18 open positions at most (for a radius of three): a bucket that is still large looks up each fingerprint with up to three of
these flipped, which takes time in proportion to its size. A bucket gives a spanning
forest of its links, never all pairs, and components join the forests.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a null doc_id keeps
its row and never names a component unless the whole component has none; repeated rows stay
repeated; a very long text is hashed whole, its shingles' bits summed in blocks; empty tables give empty results; other columns are
ignored whatever their names. Of a component ``one_of_each`` keeps the row with the smallest doc_id (one with a doc_id before one
without), among equal ones that with the smallest hash of its text, and of rows equal in both any one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .columns import column, columns, free
from .components import components

RADIUS = 3
BITS = 64
SHINGLE = 3
SEED = 42
#: Distinct fingerprints of a bucket that are compared at once; larger buckets are split.
BUCKET = 4096
LEVELS = 3
#: Hashes whose bits are summed at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    array = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(array[i : i + CHUNK], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(array), CHUNK))
    return int.from_bytes(np.packbits(2 * ones > len(array)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the text's own hash and the fingerprint, both as signed 64-bit integers; one pass, no shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in part.column(2)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found.view(np.int64))], names=["doc_id", "digest", "fp"])

    return with_digest(df, text, key).mapInArrow(run, "doc_id long, digest long, fp long")


def with_digest(df: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, a 64-bit hash of the text, and the text: doc_id and hash tell rows apart that are not equal in both."""
    return df.select(column(key).cast("long").alias("doc_id"), F.xxhash64(column(text)).alias("digest"), column(text).alias("text"))


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """The covering masks of a level. Position i has vector 1 + (i * step + level) mod 15, which spreads all vectors evenly;
    the step differs by level, so that each level cuts across the one before."""
    dims = radius + 1
    vectors = [1 + (i * (1, 2, 4)[level] + i // 15 * level + level) % (2**dims - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2**dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(level: int, radius: int, fp: Column, fixed: Column) -> Column:
    """One struct per mask: the positions fixed so far with the mask's, and the fingerprint's bits there."""
    each = []
    for m in masks(level, radius):
        now = fixed.bitwiseOR(F.lit(_signed(m)))
        each.append(F.struct(now.alias("fixed"), fp.bitwiseAND(now).alias("bits")))
    return F.explode(F.array(*each))


def _by_flips(fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links inside one large sorted bucket: each fingerprint with up to ``radius`` of the bucket's differing bits flipped is looked up."""
    spread = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << i for i in range(BITS) if spread >> i & 1]
    left, right = [], []
    for r in range(1, radius + 1):
        for some in combinations(bits, r):
            other = fp ^ np.uint64(sum(some))
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            own = np.flatnonzero((fp[at] == other) & (at > np.arange(len(fp))))
            left.append(own)
            right.append(at[own])
    return left, right


def _forest(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the radius inside each run; rows of a run are adjacent, and sorted as signed numbers."""
    label = np.arange(len(fp))
    left, right = [], []
    edges = np.flatnonzero(np.diff(run)) + 1
    for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
        if end - begin > BUCKET:
            order = np.argsort(fp[begin:end], kind="stable") + begin
            a, b = _by_flips(fp[order], radius)
            left += [order[i] for i in a]
            right += [order[j] for j in b]
            run = np.where((np.arange(len(run)) >= begin) & (np.arange(len(run)) < end), -1 - np.arange(len(run)), run)  # done: nothing is left to compare
    for step in range(1, len(fp)):
        same = np.flatnonzero(run[step:] == run[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + step]) <= radius]
        left.append(near)
        right.append(near + step)
    if not left:
        return label[:0], label[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    while True:
        least = np.minimum(label[i], label[j])
        moved = label.copy()
        np.minimum.at(moved, i, least)
        np.minimum.at(moved, j, least)
        moved = moved[moved]
        if (moved == label).all():
            break
        label = moved
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def _link(rows: DataFrame, radius: int, most: int | None) -> DataFrame:
    """From rows ``fixed, bits, fp`` grouped and sorted by bucket: links (a, b), and under ``b is null`` the rows of too large buckets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "fixed"]
        held: list[np.ndarray] = []
        n_held, large = 0, None

        def out(a, b, fixed):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(fixed, pa.int64())], names=names)

        def done(rows: np.ndarray):
            change = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            sizes = np.bincount(group)
            if most is not None and (sizes > most).any():
                over = sizes[group] > most
                big = rows[over]
                yield out(big[:, 2], pa.nulls(len(big), pa.int64()), big[:, 0])
                rows, group = rows[~over], group[~over]
            several = np.bincount(group, minlength=1)[group] > 1 if len(rows) else np.zeros(0, bool)
            rows, group = rows[several], group[several]
            if len(rows):
                fp = rows[:, 2].copy()
                i, j = _forest(fp.view(np.uint64), group, radius)
                if len(i):
                    yield out(fp[i], fp[j], pa.nulls(len(i), pa.int64()))

        for part in parts:
            if not part.num_rows:
                continue
            new = np.column_stack([c.to_numpy() for c in part.columns])
            if large is not None:  # more rows of a bucket that is known to be too large
                same = np.all(new[:, :2] == large, axis=1)
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield out(new[:n, 2], pa.nulls(n, pa.int64()), new[:n, 0])
                    new = new[n:]
                if not len(new):
                    continue
                large = None
            rows = np.concatenate([*held, new])
            last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from done(rows[:cut])
            held = [rows[cut:]]
            n_held = len(rows) - cut
            if most is not None and n_held > most:
                big = held[0]
                yield out(big[:, 2], pa.nulls(n_held, pa.int64()), big[:, 0])
                large, held = big[-1, :2].copy(), []
        if held and len(held[0]):
            yield from done(np.concatenate(held))

    return rows.mapInArrow(run, "a long, b long, fixed long")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """A spanning set of links (a, b) between the distinct fingerprints in column ``fp`` within the radius."""
    rows = distinct.select("fp", F.lit(0).cast("long").alias("fixed"))
    found = None
    for level in range(levels):
        keyed = rows.select("fp", _keys(level, radius, F.col("fp"), F.col("fixed")).alias("k")).select("k.fixed", "k.bits", "fp")
        dealt = keyed.repartition("fixed", "bits").sortWithinPartitions("fixed", "bits", "fp")
        here = stored(_link(dealt, radius, bucket if level < levels - 1 else None), "simhash-links")
        own = here.where("b is not null").select("a", "b")
        found = own if found is None else found.union(own)
        over = here.where("b is null").select(F.col("a").alias("fp"), "fixed")
        if level == levels - 1 or over.isEmpty():
            break
        rows = over
    return found


def _named(df: DataFrame, text: str, key: str, radius: int) -> DataFrame:
    """Per document: doc_id, digest, fp, label (of its component) and component_id."""
    marked = stored(fingerprints(df, text, key), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    grouped = distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    of_label = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.join(grouped.join(of_label, "label").select("fp", "label", "component_id"), "fp")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id it is linked to, itself included)."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _named(df, text, key, radius).select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` with one document of every component; which one, the module says."""
    return keep_one(df, _named(df, text, key, radius), text, key)


def keep_one(df: DataFrame, named: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``df`` that come first in their group; ``named`` has doc_id, digest and label of all rows.

    A group's first row comes from an aggregation that combines before its shuffle. Only the keys of rows that go meet the texts again.
    """
    rows = stored(named.groupBy("label", "doc_id", "digest").agg(F.count("*").alias("n")), "rows-of-groups")
    first = rows.groupBy("label").agg(F.min_by(F.struct("doc_id", "digest"), F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("f"))
    met = rows.join(first, "label").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("digest") == F.col("f.digest")))
    k, h, k2, h2 = free(df, "row_key", "row_digest", "own_key", "own_digest")
    marked = df.withColumns({k: column(key).cast("long"), h: F.xxhash64(column(text))})
    rest = met.where("not stays").select(F.col("doc_id").alias(k2), F.col("digest").alias(h2))
    # the digest comes first and is never null, so rows without a key are dealt out by their texts
    kept = marked.join(rest, (F.col(h) == F.col(h2)) & F.col(k).eqNullSafe(F.col(k2)), "left_anti")
    if not met.where("stays and n > 1").isEmpty():
        kept = kept.dropDuplicates([k, h])
    return kept.select(*columns(df))
