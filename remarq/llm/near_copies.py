"""Near copies by the Jaccard similarity of word shingles: every pair at or above the least similarity is found.

A document is the set of its five-word shingles (of fewer words, one shingle of them all). Sets of n that share four fifths of their union share
a shingle among the first n // 5 + 1 of each, in any order that holds for all sets. The order here puts shingles
that a sample of the documents shows to be common last, so that the rest decides. Documents that meet on such a shingle are
candidates unless their sizes, the shingle's places, or signatures of the sets rule the similarity out, and candidates are compared shingle by shingle. The first shingle
that two share tells most: all that they share follows it, so pages of one notice and some words of their own, which come first, are no candidates.

Distinct texts lie in a table that is bucketed by their id, so a round moves only the texts that are compared, to the one they are compared with.

SimHash (``simhash``, three bits) comes first: what it links is compared shingle by shingle, and what is alike there is one group from then on. It links
neither all copies nor only copies, so the rest follows: in a bucket, members of different groups whose signatures allow it are candidates. A member gets a few partners in a
round; buckets that have more come again once those are joined, and in the last round whatever still lies
in different groups meets in pairs. So a large group of near copies costs a multiple of its size, and no pair is given up.

Defined cases: texts of equal words are copies, those that are null or blank too; words end at ASCII white space and A-Z count as a-z.
Shingles, and the words of a whole text, are told apart by 64-bit hashes. Null and equal keys, empty tables, very long texts, which row of a group
stays, and other columns are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_folder, stored
from .components import components
from .simhash import SEED, fingerprint, keep_one, with_digest
from .simhash import links as links_within

SHINGLE = 5
#: Documents whose shingles are counted: one of so many, so many at least; and the most shingles that are put last (16 bytes each in every task).
SHARE, SAMPLE, COMMON = 20, 10_000, 500_000
#: Rounds in which a row meets so many of its bucket at most; what is left meets in pairs.
ROUNDS, FEW_PAIRS = 5, 10
#: Rows that a row looks at first, and twice as many each time after.
WIDTH = 64
#: Rows of an output batch.
BATCH = 1 << 18
#: Bits of a signature, and of what of it goes with every mark.
BITS, FOLD = 1024, 512
#: Partners of a document that one task compares with it.
PARTNERS = 500


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def node(text: str | None) -> int:
    """What texts of equal words share, signed."""
    found = xxhash.xxh3_64_intdigest(b" ".join(_words(text)), SEED)
    return found - (1 << 64) if found >= 1 << 63 else found


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    words = _words(text)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _marks(texts: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """A row per deciding shingle of a text: its hash, the text's node, the set's size, and the shingle's place in the order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["m", "id", "n", "pos"]
        held, rows = [], 0
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = shingles(text.as_py())
                often = np.zeros(len(own), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    often = np.where(common[at] == own, counts[at], 0)
                first = own[np.lexsort((own, often))][: len(own) // 5 + 1]
                k = len(first)
                held.append((first, np.full(k, i, np.int64), np.full(k, len(own), np.int32), np.arange(k, dtype=np.int32)))
                rows += k
                if rows >= BATCH:
                    yield _batch([np.concatenate(c) for c in zip(*held, strict=True)], names)
                    held, rows = [], 0
        if held:
            yield _batch([np.concatenate(c) for c in zip(*held, strict=True)], names)

    return texts.select("id", "t").mapInArrow(run, "m long, id long, n int, pos int")


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of sorted batches, cut between buckets only."""
    held: list[np.ndarray] = []
    for part in parts:
        if not part.num_rows:
            continue
        new = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns[:5]])
        if len(part.columns) > 5:
            new = np.hstack([new, np.frombuffer(b"".join(part.column(5).to_pylist()), np.int64).reshape(len(new), -1)])
        cut = int(np.searchsorted(new[:, 0], new[-1, 0]))
        if cut or (held and held[-1][-1, 0] != new[-1, 0]):
            yield np.concatenate([*held, new[:cut]])
            held = [new[cut:]]
        else:
            held.append(new)
    if held:
        yield np.concatenate(held)


def _shared(marks: DataFrame) -> DataFrame:
    """The rows of buckets with two members or more."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(parts):
            same = rows[1:, 0] == rows[:-1, 0]
            rows = rows[np.append(same, False) | np.append(False, same)]
            yield _batch([rows[:, 0], rows[:, 1], rows[:, 2].astype(np.int32), rows[:, 3].astype(np.int32)], ["m", "id", "n", "pos"])

    return marks.repartition("m").sortWithinPartitions("m").mapInArrow(run, "m long, id long, n int, pos int")


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows (bucket, id, n, pos, label, words of a signature) may be alike: in different groups, what follows the shared shingle is enough with it, and the
    signatures differ in no more bits than sets that are alike differ in elements. (What precedes the shingle is not shared, or the two meet in an earlier bucket, where that is looked at.)"""
    n, m, p, q = a[:, 2], b[:, 2], a[:, 3], b[:, 3]
    most = np.minimum(n - p, m - q)
    good = (a[:, 4] != b[:, 4]) & (9 * most >= 4 * (n + m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
    if a.shape[1] > 5:
        at = np.flatnonzero(good)
        apart = np.bitwise_count((a[at, 5:] ^ b[at, 5:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        good[at] = 9 * apart <= (n + m)[at]
    return good


def _main(bucket: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which rows are of their bucket's largest group."""
    order = np.lexsort((label, bucket))
    of, labels = bucket[order], label[order]
    starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (labels[1:] != labels[:-1])]))
    sizes = np.diff(np.append(starts, len(of)))
    by_size = np.lexsort((sizes, of[starts]))  # the last of a bucket is its largest
    largest = np.zeros(int(of[-1]) + 1, np.int64)
    largest[of[starts][by_size]] = labels[starts][by_size]
    return label == largest[bucket]


def _met(rows: np.ndarray, most: int | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs of row numbers that may be alike, and the buckets (their shingles) in which a row has more partners than the ``most`` it is given.

    Rows lie by bucket and size. Two of a bucket's largest group are never compared, and a row that has its partners looks for no more: a group of
    near copies costs a multiple of its rows, however large it is.
    """
    bucket = np.concatenate([[0], np.cumsum(rows[1:, 0] != rows[:-1, 0])])
    main = _main(bucket, rows[:, 4])
    own = np.flatnonzero(~main)
    n = rows[:, 2]
    keys = bucket << 32 | n
    end = np.searchsorted(keys, bucket[own] << 32 | 5 * n[own] // 4, side="right")
    begin = np.searchsorted(keys, bucket[own] << 32 | -(-4 * n[own] // 5), side="left")
    # a row looks at all rows behind it, and before it at those of the largest group, which do not look
    row = np.concatenate([own, own])
    sign = np.repeat([1, -1], len(own))
    left = np.concatenate([end - own - 1, own - begin])
    done = np.zeros(len(row), np.int64)
    given = np.zeros(len(rows), np.int64)
    over = np.zeros(int(bucket[-1]) + 1, bool)
    found = []
    width = WIDTH
    open_ = np.flatnonzero(left > 0)
    while len(open_):
        for part in np.split(open_, np.flatnonzero(np.diff(np.cumsum(np.minimum(left[open_], width)) // BATCH)) + 1):
            take = np.minimum(left[part], width)
            of = np.repeat(np.arange(len(part)), take)
            step = np.arange(len(of)) - np.repeat(np.cumsum(take) - take, take) + 1
            i = row[part][of]
            j = i + sign[part][of] * (done[part][of] + step)
            good = np.flatnonzero((sign[part][of] > 0) | main[j])
            good = good[_possible(rows[i[good]], rows[j[good]])]
            i, j = i[good], j[good]
            if most is not None and len(i):
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                counts = np.diff(np.append(first, len(i)))
                rank = np.arange(len(i)) - np.repeat(first, counts) + given[i]
                over[bucket[i[rank >= most]]] = True
                given[i[first]] += counts
                i, j = i[rank < most], j[rank < most]
            found.append((i, j))
        done[open_] += width
        left[open_] -= width
        open_ = open_[left[open_] > 0]
        if most is not None:
            full = given[row[open_]] >= most
            over[bucket[row[open_[full]]]] = True
            open_ = open_[~full]
        width *= 2
    return found, rows[np.flatnonzero(np.concatenate([[True], np.diff(bucket) > 0]))[over], 0]


def _pairs(buckets: DataFrame, round_: int | None) -> DataFrame:
    """Candidates (a, b) from rows (m, id, n, pos, label) and, where there is one, sig: up to ``FEW_PAIRS`` partners of a row in a bucket, or (no round) all of them.
    Under ``b is null`` the buckets (a) that have more; what is in one group then needs no pair in the next round."""
    most = None if round_ is None else max(1, FEW_PAIRS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(parts):
            mixed = (rows[:, 1].view(np.uint64) ^ np.uint64((round_ or 0) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
            rows = rows[np.lexsort((mixed, rows[:, 2], rows[:, 0]))]
            found, more = _met(rows, most)
            for i, j in found:
                a, b = rows[i, 1], rows[j, 1]
                yield _batch([np.minimum(a, b), np.maximum(a, b)], ["a", "b"])
            if len(more):
                yield pa.RecordBatch.from_arrays([pa.array(more), pa.nulls(len(more), pa.int64())], names=["a", "b"])

    return buckets.repartition("m").sortWithinPartitions("m").mapInArrow(run, "a long, b long").distinct()


def signature(own: np.ndarray) -> bytes:
    """For each of ``BITS`` classes of hashes, whether an odd number of the set's is in it. Two sets' signatures differ in no more bits than
    the sets differ in elements."""
    counts = np.bincount((own.view(np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits(counts & 1).tobytes()


def folded(signs: bytes) -> list[bytes]:
    """Signatures of ``FOLD`` bits, of which the same holds, from those of ``BITS`` bits one after the other."""
    parts = np.frombuffer(signs, np.uint8).reshape(-1, BITS // FOLD, FOLD // 8)
    return [s.tobytes() for s in np.bitwise_xor.reduce(parts, axis=1)]


def _signatures(texts: DataFrame) -> DataFrame:
    """id, n (the set's size), sig and fp (the SimHash) of every text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, signs, points = [], [], []
            for text in part.column(1):  # a text's shingles are held at a time, not a batch's
                own = shingles(text.as_py())
                sizes.append(len(own))
                signs.append(signature(own))
                points.append(fingerprint(text.as_py()))
            numbers = np.array(points, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary()), pa.array(numbers)], names=["id", "n", "sig", "fp"])

    return texts.select("id", "t").mapInArrow(run, "id long, n int, sig binary, fp long")


def _by_simhash(signatures: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: every text with one of its fingerprint, and those with one another along a spanning set of links; no more than a multiple of the texts."""
    hubs = stored(signatures.groupBy("fp").agg(F.min("id").alias("hub")), "fingerprints")
    same = signatures.join(hubs, "fp").where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    one, other = (hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}")) for c in ("a", "b"))
    near = links_within(hubs.select("fp")).join(one, "a").join(other, "b").select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b"))
    return same.union(near).distinct()


def _plausible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs whose signatures do not differ in more bits than sets that are alike can differ in elements: no such pair is lost."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            size = part.column(2).to_numpy().astype(np.int64) + part.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(9 * apart <= size))

    one, other = (signatures.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are alike. Their texts meet at one of the two, the hub, which is dealt to several tasks where it has many partners."""
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("shares"))
    dealt = pairs.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("salt"))
    hubs = dealt.select(F.col("a").alias("id"), F.col("a").alias("hub"), "salt", F.lit(0).alias("role")).distinct()
    wanted = hubs.union(dealt.select(F.col("b").alias("id"), F.col("a").alias("hub"), "salt", F.lit(1).alias("role")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.int64)
        for part in parts:
            good: list[tuple[int, int]] = []
            for a, b, role, text in zip(*(c.to_pylist() for c in part.columns[:3]), part.column(3), strict=True):
                found = shingles(text.as_py())
                if not role:
                    hub, own = a, found
                elif a == hub and alike(own, found):
                    good.append((a, b))
            yield _batch([np.array([g[i] for g in good], np.int64) for i in (0, 1)], ["a", "b"])

    met = texts.join(wanted, "id").select("hub", "id", "role", "t", "salt")
    sorted_ = met.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return stored(sorted_.select("hub", "id", "role", "t").mapInArrow(run, "a long, b long"), "alike", instead_of=pairs)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and in how many. They only steer the order: results do not depend on them."""
    n = texts.count()
    part = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max(1 / SHARE, SAMPLE / max(n, 1)))))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in parts:
            for i in range(0, some.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t.as_py()) for t in some.column(0).slice(i, 500)]))], names=["m"])

    counted = part.select("t").mapInArrow(run, "m long").groupBy("m").count().where("count > 2").orderBy(F.desc("count"), "m").limit(COMMON).toArrow()
    found, counts = counted.column(0).to_numpy(), counted.column(1).to_numpy()
    order = np.argsort(found)
    return found[order], counts[order]


def _of_documents(shared: DataFrame, signatures: DataFrame) -> DataFrame:
    """Shared marks, a row per document, and its signature."""
    return shared.groupBy("id").agg(F.first("n").alias("n"), F.collect_list(F.struct("m", "pos")).alias("marks")).join(signatures.select("id", "sig"), "id")


def _marks_of(documents: DataFrame) -> DataFrame:
    """From ``id, n, marks, label, sig`` the rows (m, id, n, pos, label, sig); the signatures are folded to ``FOLD`` bits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 2000):
                some = part.slice(start, 2000)
                marks = some.column(2)
                sizes = np.diff(marks.offsets.to_numpy())
                of = np.repeat(np.arange(len(sizes)), sizes)
                own = marks.flatten()
                ids, n, label = (some.column(i).to_numpy()[of] for i in (0, 1, 3))
                signs = folded(b"".join(some.column(4).to_pylist()))
                columns = [*(pa.array(c) for c in (own.field("m").to_numpy(), ids, n, own.field("pos").to_numpy(), label)), pa.array(signs, pa.binary()).take(pa.array(of))]
                yield pa.RecordBatch.from_arrays(columns, names=["m", "id", "n", "pos", "label", "sig"])

    return documents.select("id", "n", "marks", "label", "sig").mapInArrow(run, "m long, id long, n int, pos int, label long, sig binary")


def _labelled(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The marks with the labels of their documents' groups."""
    labels = components(found).select(F.col("node").alias("id"), F.col("label"))
    return _marks_of(documents.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))


def links(texts: DataFrame) -> DataFrame:
    """From distinct texts ``id, t``: pairs (a, b) at or above the least similarity that join all that such pairs join."""
    shared = stored(_shared(_marks(texts, *_common(texts))), "shared-marks")
    signatures = stored(_signatures(texts), "signatures")
    documents = stored(_of_documents(shared, signatures), "marks-of-documents", instead_of=shared)
    # what SimHash links and the shingles confirm is joined before any bucket is looked at
    found = _checked(stored(_plausible(_by_simhash(signatures), signatures), "candidates"), texts)
    rows, open_, last = documents.count(), None, False
    for round_ in range(ROUNDS + 1):
        labelled = _labelled(documents, found)
        if open_ is not None:
            labelled = labelled.join(open_.where("b is null").select(F.col("a").alias("m")), "m", "left_semi")
        last = last or round_ == ROUNDS
        met = stored(_pairs(labelled, None if last else round_), "met", instead_of=open_)
        pairs = stored(_plausible(met.where("b is not null"), signatures), "candidates")
        n = pairs.count()
        here = _checked(pairs, texts)
        found = found.union(here)
        if last or met.where("b is null").isEmpty():
            break
        # partners are few, or join little: all that is left meets
        open_, last = met, 100 * n <= rows or 2 * here.count() < n
    return found


def _table_by_id(texts: DataFrame) -> tuple[DataFrame, str]:
    """Distinct texts written in buckets of their id, so that every round finds those it needs without moving the others; and the table's name in the catalog."""
    spark = texts.sparkSession
    folder = fresh_folder(spark, "distinct-texts")
    name = "distinct_texts_" + folder.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, "id").option("path", folder).saveAsTable(name)
    return spark.table(name), name


def _named(df: DataFrame, text: str, key: str) -> DataFrame:
    """Per document: doc_id, digest (of its text), label (of its group) and component_id."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = [node(t.as_py()) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.int64()), part.column(2)], names=["doc_id", "digest", "id", "t"])

    own = with_digest(df, text, key).mapInArrow(run, "doc_id long, digest long, id long, t string")
    marked = stored(own.select("doc_id", "digest", "id"), "nodes")
    distinct, name = _table_by_id(own.groupBy("id").agg(F.min("doc_id").alias("least"), F.min("t").alias("t")))
    firsts = stored(distinct.select("id", "least"), "distinct-ids")
    try:
        labels = components(links(distinct.select("id", "t"))).withColumnRenamed("node", "id")
    finally:
        df.sparkSession.sql(f"DROP TABLE {name}")  # its files go with the shared folder
    grouped = firsts.join(labels, "id", "left").select("id", "least", F.coalesce("label", "id").alias("label"))
    of_label = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.join(grouped.join(of_label, "label").select("id", "label", "component_id"), "id")


def groups(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, component_id (the smallest doc_id it is linked to, itself included)."""
    return _named(df, text, key).select("doc_id", "component_id")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with one document of every group of near copies; which one, ``simhash`` says."""
    return keep_one(df, _named(df, text, key), text, key)
