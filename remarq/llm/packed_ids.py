"""Operator 6: token ids bit-packed at fixed width.

Each id takes the least number of bits that hold every id of the vocabulary. A file has blocks of
``BLOCK`` ids and a table of block offsets, so ids i..j are read by seeking to the blocks around
them; unpacking is numpy arithmetic on whole blocks, whatever the width.

File format, little-endian: magic ``RMQIDS1\\0``, then packed blocks (each of whole bytes), then the
document table (doc_id int64, 1 where it is not null uint8, end uint64 for each document), then the block table (offset
uint64 each, and the end of the last block), then the footer: counts of documents, ids and blocks (uint64 each), ids a
block and bits an id (uint32 each), magic again.

Documents are dealt out by ranges of doc_id, so the files, in the order of their ranges, hold all
documents in ascending order. A document's ``start`` is its place in its file plus the ids of all
earlier files; those sums come from one row per file.

Defined cases: a null text counts as empty and has only the end id; a null doc_id sorts first;
repeated rows stay apart, ordered by their text among equal doc_ids; a very long text is encoded whole by its task and packed block by block; empty tables give no file and no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh_folder, open_fs, stored
from .pieces import batches, cut, load, special_strings
from .storage import new_file

MAGIC = b"RMQIDS1\0"
BLOCK = 1 << 16
FOOTER = struct.Struct("<QQQII8s")
DOCS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("end", "<u8")])
#: Text bytes cut at a time (each batch's pieces are looked up once), pieces whose ids are put together at a time, ids read at a time, and pieces that a worker remembers.
BATCH_BYTES = 4 << 20
CHUNK = 1 << 16
READ_IDS = 1 << 20
REMEMBERED = 400_000
#: Text bytes of one file, about.
FILE_BYTES = 64 << 20
#: How the vocabulary writes the byte of a space.
SPACE = "\u0120"


def bits_for(n_ids: int) -> int:
    """Bits an id needs in a vocabulary with ids below ``n_ids``."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, most significant bit first, padded with zero bits to a whole byte."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    if bits == 32:
        return ids.astype(">u4").tobytes()
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    if bits == 32:
        return np.frombuffer(data, ">u4", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class Encoder:
    """The library's ids for texts; pieces that occur again are encoded once."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.specials = special_strings(path)
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0
        self.begin = np.zeros(1, np.int64)
        self.length = np.zeros(1, np.int64)
        self.leads = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.leads[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the length of each piece's.

        Pieces that begin with a space, which is their only one, are encoded in one string: a token that begins with a space begins a piece.
        """
        lengths = np.zeros(len(pieces), np.int64)
        alone = [i for i, p in enumerate(pieces) if p[:1] != " " or p[-1].isspace()]
        parts: dict[int, np.ndarray] = {}
        for i, ids in zip(alone, self._plain([pieces[i] for i in alone]), strict=True):
            parts[i] = np.array(ids, self.flat.dtype)
            lengths[i] = len(ids)
        if not parts:
            rest = range(len(pieces))
        else:
            rest = [i for i in range(len(pieces)) if i not in parts]
        chunks = []
        if len(rest):
            joined = ["".join([pieces[i] for i in rest[a : a + 2000]]) for a in range(0, len(rest), 2000)]
            for ids, a in zip(self._plain(joined), range(0, len(rest), 2000), strict=True):
                ids = np.array(ids, self.flat.dtype)
                own = np.diff(np.append(np.flatnonzero(self.leads[ids]), len(ids)))
                lengths[np.asarray(rest[a : a + 2000])] = own
                chunks.append(ids)
        flat = np.concatenate(chunks) if chunks else np.zeros(0, self.flat.dtype)
        if parts:  # back into the order of the pieces
            of_rest = iter(np.split(flat, np.cumsum(lengths[np.asarray(rest, np.int64)])[:-1])) if len(rest) else iter(())
            flat = np.concatenate([parts[i] if i in parts else next(of_rest) for i in range(len(pieces))])
        return flat, lengths

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by ``end_id``, and where each ends."""
        cutting = cut(texts, self.specials)
        place = self.place
        at = np.fromiter((place.get(p, -1) for p in cutting.distinct), np.int64, len(cutting.distinct))
        new = np.flatnonzero(at < 0)
        flat, lengths = self._encode([cutting.distinct[i] for i in new])
        begin_of, length_of = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        old = at >= 0
        begin_of[old], length_of[old] = self.begin[at[old]], self.length[at[old]]
        length_of[new] = lengths
        begin_of[new] = self.used + np.cumsum(lengths) - lengths
        pool = np.concatenate([self.flat[: self.used], flat])
        room = max(0, REMEMBERED - len(place))
        if room and len(new):  # the first pieces seen are the frequent ones
            stay = new[:room]
            first = len(self.begin)
            place.update((cutting.distinct[i], first + k) for k, i in enumerate(stay))
            self.begin = np.concatenate([self.begin, begin_of[stay]])
            self.length = np.concatenate([self.length, length_of[stay]])
            self.used += int(lengths[:room].sum())
            self.flat = pool[: self.used].copy()
        starts = np.concatenate([[0], cutting.ends[:-1]]).astype(np.int64)
        running = np.zeros(len(cutting.codes) + 1, np.int64)
        np.cumsum(length_of[cutting.codes], out=running[1:])
        sizes = running[cutting.ends] - running[starts] + 1
        first = running[starts]
        odd = {}
        for i, ids in zip(cutting.odd, self._plain([texts[int(i)].as_py() for i in cutting.odd]), strict=True):
            odd[int(i)] = ids
            sizes[i] = len(ids) + 1
        ends = np.cumsum(sizes)
        out = np.full(int(ends[-1]) if len(ends) else 0, end_id, self.flat.dtype)
        # ids of occurrence k go to the ids before it in its row, from where the row's begin
        shift = (ends - sizes) - first
        for a in range(0, len(cutting.codes), CHUNK):
            codes = cutting.codes[a : a + CHUNK]
            rows = np.searchsorted(cutting.ends, np.arange(a, a + len(codes)), side="right")
            if odd:
                keep = ~np.isin(rows, cutting.odd)
                codes, rows, before = codes[keep], rows[keep], running[a : a + len(keep)][keep]
            else:
                before = running[a : a + len(codes)]
            n = length_of[codes]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(before + shift[rows], n) + step] = pool[np.repeat(begin_of[codes], n) + step]
        for i, ids in odd.items():
            out[ends[i] - sizes[i] : ends[i] - 1] = ids
        return out, ends


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    """Writes one file block by block; holds a block of ids and the tables."""

    def __init__(self, out: pa.NativeFile, bits: int):
        self.out, self.bits = out, bits
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.offsets = [len(MAGIC)]
        self.docs: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        table = np.zeros(len(ends), DOCS)
        table["known"] = doc_ids.is_valid().to_numpy(zero_copy_only=False)
        table["doc_id"] = doc_ids.fill_null(0).to_numpy()
        table["end"] = self.n_ids + ends
        self.docs.append(table)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            ready = np.concatenate(self.waiting)
            full = len(ready) // BLOCK * BLOCK
            for a in range(0, full, BLOCK):
                self._block(ready[a : a + BLOCK])
            self.waiting, self.n_waiting = [ready[full:]], len(ready) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> tuple[int, int]:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, DOCS)
        self.out.write(docs.tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(len(docs), self.n_ids, len(self.offsets) - 1, BLOCK, self.bits, MAGIC))
        return len(docs), self.n_ids


class Reader:
    """Random access to a file of packed ids by range reads."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        n_docs, self.n_ids, n_blocks, self.block, self.bits, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"no file of packed ids: {uri}")
        tables = n_docs * DOCS.itemsize + (n_blocks + 1) * 8
        raw = self.file.read_at(tables, size - FOOTER.size - tables)
        self.docs = np.frombuffer(raw, DOCS, n_docs)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, n_docs * DOCS.itemsize)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; reads only the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        begin = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - begin, begin)
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(data[int(self.offsets[b]) - begin : int(self.offsets[b + 1]) - begin], n, self.bits))
        whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return whole[start - first * self.block : end - first * self.block]

    def close(self) -> None:
        self.file.close()


def write_ids(df: DataFrame, vocabulary: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode all texts and write the files; the result, already stored, has one row per file:
    ``file``, ``place`` (files sort by it as their documents do), ``n_docs`` and ``n_ids``.

    The texts are shuffled once, by ranges of ``key``. A file's row is only there if its task ended
    well; what a lost task wrote has a name of its own and no row.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, "ids")
    load(vocabulary)
    size = load(vocabulary).get_vocab_size()
    bits = bits_for(max(size, end_id + 1))
    chosen = df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = chosen.repartitionByRange(_files(chosen), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        encoder = _encoder(vocabulary)
        part = next(parts, None)
        while part is not None and part.num_rows == 0:
            part = next(parts, None)
        if part is None:
            return
        with new_file(folder, f"{place:06d}.ids") as (out, uri):
            writer = Writer(out, bits)
            while part is not None:
                for a, b in batches(part.column(1), BATCH_BYTES):
                    ids, ends = encoder.encode(part.column(1).slice(a, b - a), end_id)
                    writer.add(part.column(0).slice(a, b - a), ids, ends)
                part = next(parts, None)
            n_docs, n_ids = writer.close()
        yield pa.RecordBatch.from_pylist([{"file": uri, "place": place, "n_docs": n_docs, "n_ids": n_ids}])

    return stored(dealt.mapInArrow(run, "file string, place long, n_docs long, n_ids long"), "id-files")


def _files(df: DataFrame) -> int:
    """How many files: by the text's bytes, so that a file stays near FILE_BYTES at any size."""
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // FILE_BYTES))


def read_ids(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32; from the files that ``files`` lists.

    ``start`` adds the ids of earlier files, a running sum over one row per file.
    """
    earlier = F.sum("n_ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.withColumn("base", F.coalesce(earlier, F.lit(0))).select("file", "base")
    spread = listed.repartition(max(1, files.count()), "file")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                reader = Reader(row["file"])
                ends = reader.docs["end"].astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                for a, b in _runs(ends, READ_IDS):
                    ids = reader.ids(int(starts[a]), int(ends[b - 1])).astype("<u4")
                    view = memoryview(ids).cast("B")
                    origin = int(starts[a])
                    crcs = [zlib.crc32(view[4 * (s - origin) : 4 * (e - origin)]) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    docs = reader.docs[a:b]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs["doc_id"].astype(np.int64), mask=docs["known"] == 0),
                            pa.array(row["base"] + starts[a:b]),
                            pa.array(ends[a:b] - starts[a:b]),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                reader.close()

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _runs(ends: np.ndarray, most: int):
    begin = 0
    while begin < len(ends):
        base = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield begin, end
        begin = end


def round_trip(df: DataFrame, vocabulary: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the files, then read every document back from them."""
    return read_ids(write_ids(df, vocabulary, end_id, text, key))
