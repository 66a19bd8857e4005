"""Operator 9: benchmark decontamination, with DataFrame functions only.

The distinct n-word windows of the benchmark make a hash set; every word is hashed once, and a window's hash is that of its words' hashes. While it has at most ``SET_LIMIT``
windows, checked by a count, the set travels with the plan to every task, and each document's
token windows are looked up where the document is read: no shuffle of texts, and only hits leave the row. A hit counts once its
words equal a benchmark window's; hashes only select.

A larger benchmark takes another way with the same results: windows of the lengths that the benchmark has become rows of text digest, place and hash, and meet the
benchmark's hashes, by broadcast up to ``BROADCAST_LIMIT`` windows and by a shuffle of these narrow rows beyond. Only texts with hits meet again, and their hits are verified.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no
window; an item with fewer words than a window is one window; equal windows of several items
count for each of them, equal items once for each item_id; repeated rows stay repeated; a very long text is an array of words in the task that reads it; empty tables give empty or unmarked results; further
columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from ..functions.bind import once
from .columns import column, columns, free

WINDOW = 10
#: Benchmark windows that travel as a set in the plan; 8 bytes of hash and about 100 of text each.
SET_LIMIT = 50_000
#: Benchmark windows whose hashes are broadcast as a table: some 32 bytes each, 64 MB in all.
BROADCAST_LIMIT = 2_000_000
#: Fixed value: what separates words, as a Java pattern: all ASCII but digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words in order; only A-Z change case, whatever other scripts it holds."""
    plain = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(plain) == F.char_length(plain)
    lowered = F.when(ascii_only, F.lower(plain)).otherwise(F.translate(plain, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _starts(n: Column, length: int) -> Column:
    """1-based starts of the windows of a length in n words."""
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _hash(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.slice(hashes, start, F.lit(length)))


def _gram(w: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(w, start, F.lit(length)), " ")


def benchmark_windows(benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """gram, length, hash and the items (as strings) that hold it; one row per distinct window."""
    split = benchmark.select(F.coalesce(column(item).cast("string"), F.lit("")).alias("item"), words(column(text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    each = split.select("item", length.alias("length"), F.explode(F.transform(starts, lambda s: F.slice("w", s, length))).alias("g"))
    return each.groupBy(F.array_join("g", " ").alias("gram"), "length").agg(F.collect_set("item").alias("items"), F.first(F.xxhash64(word_hashes(F.col("g")))).alias("hash"))


class Benchmark:
    """The windows, and while they are few enough their hashes for the plan."""

    def __init__(self, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW):
        self.windows = benchmark_windows(benchmark, text, item, window)
        few = self.windows.select("length", "hash", "gram").limit(SET_LIMIT + 1).collect()
        self.small = len(few) <= SET_LIMIT
        self.hashes: dict[int, list[int]] = {}
        self.grams: dict[int, list[str]] = {}
        if self.small:
            self.lengths = sorted({r["length"] for r in few})
            self.hashes = {n: [r["hash"] for r in few if r["length"] == n] for n in self.lengths}
            self.grams = {n: [r["gram"] for r in few if r["length"] == n] for n in self.lengths}
            return
        self.windows = stored(self.windows, "benchmark-windows")
        counts = self.windows.groupBy("length").count().collect()  # one row per length, ``window`` at most
        self.lengths = sorted(r["length"] for r in counts)
        self.broadcast = sum(r["count"] for r in counts) <= BROADCAST_LIMIT

    def hit_starts(self, hashes: Column, length: int) -> Column:
        """Starts whose window has the hash of a benchmark window."""
        return F.filter(_starts(F.size(hashes), length), lambda s: _hash(hashes, s, length).isin(self.hashes[length]))

    def contains(self, w: Column, hashes: Column) -> Column:
        """Whether any window of the words equals one of the benchmark; only while the set is small."""
        found = F.lit(False)
        for n in self.lengths:
            found = found | self._holds(w, hashes, n)
        return found

    def _holds(self, w: Column, hashes: Column, n: int) -> Column:
        return F.exists(self.hit_starts(hashes, n), lambda s: _gram(w, s, n).isin(self.grams[n]))

    def narrow(self, table: DataFrame) -> DataFrame:
        """A table of one small row per window, for a broadcast while that is within its bound."""
        return F.broadcast(table) if self.small or self.broadcast else table


def _with_gram(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(n).alias("length"), _gram(F.col("w"), s, n).alias("gram")))


def _with_hash(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(n).alias("length"), _hash(F.col("h"), s, n).alias("hash")))


def _candidates(split: DataFrame, bench: Benchmark) -> DataFrame:
    """Rows ``row, doc_id, n_words, start, length, gram``: hash hits, and one row without a start for documents with none; only while the set is small."""
    keep = ["row", "doc_id", "n_words"]
    grams = [_with_gram(bench.hit_starts(F.col("h"), n), n) for n in bench.lengths]
    if not grams:
        return split.select(*keep, F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("gram"))
    hits = split.select(*keep, (F.concat(*grams) if len(grams) > 1 else grams[0]).alias("hits"))
    return hits.select(*keep, F.explode_outer("hits").alias("h")).select(*keep, "h.start", "h.length", "h.gram")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def window_rows(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """From ``digest, h`` (the words' hashes): a row ``digest, start, length, hash`` for every window of the lengths."""
    each = [_with_hash(_starts(F.size("h"), n), n) for n in lengths]
    return texts.select("digest", F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("x")).select("digest", "x.start", "x.length", "x.hash")


def _verified(docs: DataFrame, bench: Benchmark, text: str) -> DataFrame:
    """``digest, start, length, items`` of the windows of the benchmark in the texts; for any size of it."""
    split = docs.select(_digest(column(text)).alias("digest"), words(column(text)).alias("w"))
    hashes = bench.narrow(bench.windows.select("hash", "length").distinct())
    hits = window_rows(split.select("digest", word_hashes(F.col("w")).alias("h")), bench.lengths).join(hashes, ["hash", "length"], "left_semi")
    of_text = stored(hits.groupBy("digest").agg(F.collect_set(F.struct("start", "length")).alias("hits")), "window-hits")
    met = split.join(of_text, "digest")  # only texts with hits go on
    each = met.select("digest", "w", F.explode("hits").alias("x")).select("digest", "x.start", "x.length", F.expr("array_join(slice(w, x.start, x.length), ' ')").alias("gram"))
    return each.join(bench.windows.select("gram", "length", "items"), ["gram", "length"]).select("digest", "start", "length", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a benchmark window), n_items, items (sorted
    strings), spans (start, length of the hit windows, 1-based, in words)."""
    bench = Benchmark(benchmark, item_text, item, window)
    if bench.small:
        split = docs.select(F.monotonically_increasing_id().alias("row"), column(key).alias("doc_id"), words(column(text)).alias("w")).withColumns({"n_words": F.size("w"), "h": word_hashes(F.col("w"))})
        # written before they are grouped: a row's number is that of the one attempt that wrote it
        joined = stored(_candidates(split, bench), "window-candidates").join(F.broadcast(bench.windows.select("gram", "length", "items")), ["gram", "length"], "left")
        verified = F.col("items").isNotNull()
        by_doc = joined.groupBy("row", "doc_id", "n_words").agg(
            F.collect_list(F.when(verified, F.struct("start", "length"))).alias("spans"),
            F.collect_set(F.when(verified, F.col("items"))).alias("sets"),
        )
    else:
        found = _verified(docs, bench, text).groupBy("digest").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("sets"))
        own = docs.select(column(key).alias("doc_id"), F.size(words(column(text))).alias("n_words"), _digest(column(text)).alias("digest"))
        empty = {"spans": "array<struct<start: int, length: int>>", "sets": "array<array<string>>"}
        by_doc = own.join(found, "digest", "left").select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in empty.items()))
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    return by_doc.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(inside).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"),
        F.array_sort("spans").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, all columns as they are; with a small benchmark without a shuffle."""
    bench = Benchmark(benchmark, item_text, item, window)
    if not bench.lengths:
        return docs
    if bench.small:
        # bound, since a filter on a plain column would be pushed below it and split the text anew for every window
        w, h = free(docs, "own_words", "own_hashes")
        bound = once(once(docs, **{w: words(column(text))}), **{h: word_hashes(F.col(w))})
        return bound.where(~bench.contains(F.col(w), F.col(h))).select(*columns(docs))
    (digest,) = free(docs, "own_digest")
    hit = _verified(docs, bench, text).select(F.col("digest").alias(digest)).distinct()
    return docs.withColumn(digest, _digest(column(text))).join(hit, digest, "left_anti").select(*columns(docs))


def report(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """:func:`contamination` as figures and digests."""
    found = contamination(docs, benchmark, **columns)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def report_sql(window: int = WINDOW) -> str:
    """The same rows in DuckDB SQL, for the columns of the documents and benchmark tables."""
    split = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH b AS (SELECT item_id, {split} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[s : s + least(len(w), {window}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS s FROM b WHERE len(w) > 0)
),
d AS (SELECT doc_id, {split} AS w FROM documents),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
h AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
