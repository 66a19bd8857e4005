"""Operator 7: toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary texts and one on windows of toxic texts. A text is cut into
windows, and each is compressed twice: with the ordinary dictionary, and with the toxic dictionary before the ordinary one, so
the difference is what toxic text adds to what ordinary text explains. Windows that get shorter by a
calibrated number of bytes are the text's hits; a logistic curve over the hits and their share of the windows gives its score.

Most of a toxic text is ordinary. So besides the toxic windows as they are, training tries those that the toxic texts' other half
explains: a dictionary of each half is tried on the windows of the other, and windows that it shortens by ``SHARED`` bytes or more make
the sample. Only lengths of compressed windows choose; no word is looked at. Which of these dictionaries counts, and the bytes that make a hit, are
those with the least log loss on calibration rows, which no dictionary was trained on.

The model is fitted on a bounded sample of labelled rows: of each label at most ``SAMPLE_ROWS`` rows, those with the smallest hashes of
their key, and of these, in that order, texts of ``LONGEST`` bytes at most while they stay within ``SAMPLE_BYTES``. The ordinary dictionary is trained on at most
``ORDINARY_WINDOWS`` of the sample's windows, evenly spread. All documents are scored whole, very long ones too, by the same windows.

Defined cases: null and empty texts have one blank window and get the score of no hits; several labels of a
document count as toxic if any is, and so do equal texts with both labels; of a repeated doc_id the text with the smallest hash is learnt from; labels
without a document, or null, are ignored; without training rows of both
labels every score is the share of toxic rows (0 without rows); repeated documents are scored alike; empty
tables give empty results; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import column, columns

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 16 << 20
LONGEST = 2 << 20
FOLDS = 5
#: A window's bytes, and from one window's start to the next; what overlaps holds a whole word.
WINDOW, STEP = 80, 64
LEVEL = 6
ORDINARY_BYTES = 64 << 10
#: Windows that the ordinary dictionary is trained on, at most.
ORDINARY_WINDOWS = 40_000
#: Windows that a toxic dictionary is trained on: their bytes and step, short so that what toxic texts share makes much of one.
TOXIC_WINDOW, TOXIC_STEP = 32, 16
#: Sizes of toxic dictionaries, and sets of byte gains that count as hits: what calibration chooses from.
TOXIC_BYTES = (1024, 2048, 4096)
GAINS = ((2,), (3,), (4,), (5,), (2, 4))
#: Bytes by which the other half's dictionary must shorten a window.
SHARED = 3
#: Where the entropy tables of a trained dictionary end and its content begins: its three first offsets. Fixed by the format.
OFFSETS = struct.pack("<III", 1, 4, 8)


def windows(text: str | None, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Overlapping windows over the whole text, in small letters."""
    data = f" {(text or '').lower()} ".encode()
    return [data[i : i + size] for i in range(0, max(1, len(data) - (size - step)), step)]


def _parameters():
    return zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)


def _compressor(content: bytes):
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=_parameters())
    return zstandard.ZstdCompressor(dict_data=known, compression_params=_parameters()).compress


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    gains: tuple[int, ...]
    #: Of the calibration: what hits and their share of the windows say; without dictionaries the constant alone counts.
    weights: list[float]

    def scorer(self):
        """A function from a text to its score."""
        if not self.toxic:
            return lambda text: self.weights[0]
        gained = gainer(self.ordinary, self.toxic)
        return lambda text: _chance(self.weights, _features(gained(windows(text)), self.gains))


def gainer(ordinary: bytes, toxic: bytes):
    """A function from windows to the bytes by which the toxic dictionary shortens each."""
    plain, marked = _compressor(ordinary), _compressor(toxic + ordinary)
    return lambda own: np.fromiter((len(plain(w)) - len(marked(w)) for w in own), np.int32, len(own))


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on all samples; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6, accel=1, split_point=1.0).as_bytes().split(OFFSETS, 1)[-1]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def shared_windows(halves: list[list[bytes]], ordinary: bytes) -> list[bytes]:
    """Of both halves' windows those that a dictionary trained on the other half shortens."""
    out = []
    for own, other in (halves, halves[::-1]):
        gains = gainer(ordinary, trained(other, max(TOXIC_BYTES)))(own)
        out += [w for w, g in zip(own, gains.tolist(), strict=True) if g >= SHARED]
    return out


def toxic_dictionaries(texts: list[str], ordinary: bytes) -> list[bytes]:
    """The dictionaries that calibration chooses from, each trained on windows of toxic texts."""
    cut = [windows(t, TOXIC_WINDOW, TOXIC_STEP) for t in texts]
    halves = [[w for own in cut[i::2] for w in own] for i in (0, 1)]
    whole, shared = halves[0] + halves[1], shared_windows(halves, ordinary) if all(halves) else []
    out = [trained(whole, size) for size in TOXIC_BYTES]
    if shared:
        out += [trained(shared, size) for size in TOXIC_BYTES]
    return list(dict.fromkeys(d for d in out if d))


def _features(gains: np.ndarray, least: tuple[int, ...]) -> list[float]:
    out = [1.0]
    for n in least:
        hits = int((gains >= n).sum())
        out += [math.log1p(hits), math.log1p(100.0 * hits / len(gains)), float(hits > 0)]
    return out


def _logistic(rows: list[list[float]], labels: list[int], ridge: float = 1.0, steps: int = 30) -> list[float]:
    """Weights of a ridge logistic regression by Newton's method; the constant is not shrunk."""
    x, y = np.array(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
        w = w - change
        if np.abs(change).max() < 1e-9:
            break
    return w.tolist()


def _chance(weights: list[float], features: list[float]) -> float:
    z = sum(a * b for a, b in zip(weights, features, strict=True))
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def fit(rows: list[tuple[str, int]]) -> Model:
    """From (text, toxic) rows. Equal texts count once, as toxic if any is; every other row calibrates."""
    seen: dict[str, int] = {}
    for t, y in rows:
        seen[t] = max(y, seen.get(t, 0))
    unique = list(seen.items())
    train, check = unique[::2], unique[1::2]
    toxic, ordinary = ([t for t, y in train if y == k] for k in (1, 0))
    if not toxic or not ordinary or len({y for _, y in check}) < 2:
        share = sum(y for _, y in unique) / len(unique) if unique else 0.0
        return Model(b"", b"", (), [share])
    every = [w for t in ordinary for w in windows(t)]
    base = trained(every[:: -(-len(every) // ORDINARY_WINDOWS)], ORDINARY_BYTES)
    best: tuple[float, Model] | None = None
    labels = [y for _, y in check]
    cut = [windows(t) for t, _ in check]
    for content in toxic_dictionaries(toxic, base):
        gained = gainer(base, content)
        found = [gained(own) for own in cut]
        for least in GAINS:
            features = [_features(g, least) for g in found]
            weights = _logistic(features, labels)
            loss = -sum(math.log(max(1e-6, p if y else 1 - p)) for y, p in zip(labels, (_chance(weights, f) for f in features), strict=True))
            if best is None or loss < best[0] - 1e-9:
                best = loss, Model(base, content, least, weights)
    return best[1] if best else Model(b"", b"", (), [sum(labels) / len(labels)])


def held_out(key: Column) -> Column:
    """Rows that no model learns from: crc32 of the key's text, a fifth of all."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> list[tuple[str, int]]:
    """The bounded sample, in the order of its hashes. Its size is bounded in rows before the join and in bytes after."""
    known = labels.select(column(key).alias("k"), column(label).cast("int").alias("y")).where("k is not null and y is not null")
    known = known.where(~held_out(F.col("k"))).groupBy("k").agg((F.max("y") > 0).cast("int").alias("y")).withColumn("h", F.xxhash64("k"))
    sample = [known.where(F.col("y") == y).orderBy("h", "k").limit(SAMPLE_ROWS) for y in (0, 1)]
    chosen = sample[0].union(sample[1])
    texts = docs.select(column(key).alias("k"), column(text).alias("t")).where("t is not null").where(F.octet_length("t") <= LONGEST)
    met = texts.join(F.broadcast(chosen), "k").groupBy("k", "y", "h").agg(F.min(F.struct(F.xxhash64("t").alias("d"), F.col("t"))).alias("s")).select("k", "y", "h", F.col("s.t").alias("t"))
    running = F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy("h", "k"))
    rows = met.withColumn("bytes", running).where(F.col("bytes") <= SAMPLE_BYTES).select("h", "k", "t", "y").collect()
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["h"], r["k"]))]


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted per document: one pass over the texts, no shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for part in parts:
            found = np.fromiter((scorer(t.as_py()) for t in part.column(1)), np.float64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(column(key).alias("doc_id"), column(text).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Fit on the labels' sample, then score every document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(training_rows(docs, labels, text, key, label)), text, key)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The documents not predicted toxic, all columns as they are; no shuffle."""
    model = fit(training_rows(docs, labels, text, key, label))

    names, place = docs.columns, docs.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for part in parts:
            yield part.filter(pa.array((scorer(t.as_py()) < 0.5 for t in part.column(place)), pa.bool_())).rename_columns(names)

    return docs.select(*columns(docs)).mapInArrow(run, docs.schema)
