import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from remarq.llm import packed_ids, token_counts
from remarq.llm.pieces import batches, load

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", " '", "é", "ß", "中", "1", "22", ".", "!!", "\t", "　", "\x85", "\x1c", "<|endoftext|>", "<|", "😀", "the", " the", "ing", "\r", "\r\n", "ñ"]


def encoded(text):
    return load(VOCABULARY).encode(text or "", add_special_tokens=False).ids


def texts(n, most, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_every_prefix_has_the_librarys_count():
    table = token_counts.PrefixTable(VOCABULARY)
    for t in texts(300, 12):
        assert table.of_text(t).tolist() == [len(encoded(t[:k])) for k in range(1, len(t) + 1)], repr(t)


def test_counts_of_a_table_with_clashing_columns(spark):
    rows = [(1, "one two\n three", "x", 9), (2, None, None, 9), (3, "", "y", 9), (1, "one two\n three", "x", 9), (None, "word " * 5000, "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, over_limit long")
    found = token_counts.over_limit(df, VOCABULARY)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(encoded(t)), len(encoded(t)) > 512) for i, t, *_ in rows)
    assert token_counts.over_limit(df.limit(0), VOCABULARY).count() == 0


def test_budget_questions_need_no_encoder(spark):
    text = "Lower than the other, it's  said\n\nétait."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    steps = {r.doc_id: r.prefix_steps for r in token_counts.prefix_counts(df, VOCABULARY, with_steps=True).collect()}
    assert [token_counts.count_at(steps[1], k) for k in range(len(text) + 1)] == [len(encoded(text[:k])) for k in range(len(text) + 1)]
    for budget in range(0, 14):
        best = max(k for k in range(len(text) + 1) if len(encoded(text[:k])) <= budget)
        assert token_counts.longest_within(steps[1], budget) == best
    kept = {r.doc_id: r.kept_text for r in token_counts.truncate(df, VOCABULARY, 5).collect()}
    assert kept[2] == "" and len(encoded(kept[1])) <= 5


@pytest.mark.parametrize("bits", [1, 3, 11, 16, 17, 20, 32])
def test_packing_is_lossless(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** min(bits, 31), 1001).astype(np.uint32)
    assert (packed_ids.unpack(packed_ids.pack(ids, bits), 1001, bits) == ids).all()


def test_encoder_gives_the_librarys_ids():
    encoder = packed_ids.Encoder(VOCABULARY)
    for seed in range(20):
        own = [None, *texts(15, 14, seed)]
        ids, ends = encoder.encode(pa.array(own, pa.string()), 2)
        assert [a.tolist() for a in np.split(ids, ends)[:-1]] == [encoded(t) + [2] for t in own]


def test_round_trip_of_packed_files(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(60, 10, 5))] + [(7, "twice", "x"), (7, "twice", "x"), (99, None, "x"), (100, "long " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = sorted(packed_ids.round_trip(df, VOCABULARY).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, *_ in rows)
    at = 0
    by_id = {}
    for i, t, _ in rows:
        by_id.setdefault(i, []).append(encoded(t) + [2])
    for r in got:
        own = next(x for x in by_id[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        assert (r.start, r.n_tokens) == (at, len(own))
        at += len(own)
    assert packed_ids.round_trip(df.limit(0), VOCABULARY).count() == 0


def test_random_access_reads_only_the_blocks_around_it(spark):
    df = spark.createDataFrame([(i, "some words here " * 900) for i in range(60)], "doc_id long, text string")
    (file,) = [r.file for r in packed_ids.write_ids(df, VOCABULARY, 2).collect()]
    reader = packed_ids.Reader(file)
    whole = np.concatenate([encoded("some words here " * 900) + [2] for _ in range(60)])
    assert reader.n_ids == len(whole) > packed_ids.BLOCK
    for a, b in ((0, 1), (packed_ids.BLOCK - 3, packed_ids.BLOCK + 5), (len(whole) - 4, len(whole)), (9, 9)):
        assert (reader.ids(a, b) == whole[a:b]).all()


def test_encoding_a_table_holds_little_memory():
    column = pa.array(["some words of a text that is not very long " * 100] * 2000, pa.string())
    encoder = packed_ids.Encoder(VOCABULARY)
    tracemalloc.start()
    try:
        n = sum(len(encoder.encode(column.slice(a, b - a), 2)[0]) for a, b in batches(column, packed_ids.BATCH_BYTES))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2000 * (len(encoded(column[0].as_py())) + 1)
    assert most < 64 << 20


def test_pieces_of_a_batch_are_encoded_without_anything_between_them(monkeypatch):
    own = [f"w{i} word{i}, ción{i}.\nNd" + "".join(f" x{i}y{j}é" for j in range(9)) for i in range(700)]
    encoder = packed_ids.Encoder(VOCABULARY)
    given, plain = [], encoder._plain
    monkeypatch.setattr(encoder, "_plain", lambda texts: given.extend(texts) or plain(texts))
    ids, ends = encoder.encode(pa.array(own, pa.string()), 2)
    assert [a.tolist() for a in np.split(ids, ends)[:-1]] == [encoded(t) + [2] for t in own]
    assert sum(map(len, given)) <= sum(len(t) + len(t.split(" ")[0]) + 1 for t in own)  # a first word is there with a space, too
