"""Operator 5: token counts by prefix dynamic programming.

For a byte-level BPE vocabulary the encoding of a text's prefix ends in exactly one token, and
without that token it is the encoding of a shorter prefix. So ``count[i] = count[i - len(last)] + 1``,
where ``last`` is the one vocabulary entry that ends at i and that BPE leaves apart from
the last token before it. Running this over every distinct piece of a batch gives the exact number of
tokens of every prefix; sums over pieces carry it through the whole text. The table answers
"how many tokens are the first n characters" and "which prefix fits the budget" with no encoder.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); empty tables give empty results;
repeated rows give repeated rows; a very long text is cut into pieces of words in batches of one text, and only its own prefix steps (asked for by
name) take memory in proportion to it; other columns, whatever their names, are left out of the
result unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PRETOKEN, UNIT, WHITE_RUN, batches, cut, load, special_strings

#: Pieces that a worker remembers; later ones are computed anew.
REMEMBERED = 400_000
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=4)
def _alphabet(path: str) -> list[str]:
    """The character that the vocabulary writes for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + len(chars) - len(printable))
    return [chars[b] for b in range(256)]


class PrefixTable:
    """Token counts of all prefixes of pieces and texts for one vocabulary."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.vocab))
        self.specials = special_strings(path)
        self.byte_char = _alphabet(path)
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, np.ndarray] = {}
        self.totals: dict[str, int] = {}

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether BPE over the two tokens' bytes gives just these two tokens."""
        key = (left, right)
        if (known := self.apart.get(key)) is None:
            found = self.model.tokenize(left + right)
            known = len(found) == 2 and found[0].value == left
            if len(self.apart) < 4 * REMEMBERED:
                self.apart[key] = known
        return known

    def word(self, word: str) -> tuple[int, ...]:
        """Counts after each character of one pre-token."""
        if (known := self.words.get(word)) is not None:
            return known
        if word.isascii():
            coded, ends = word if word.isalpha() else "".join(self.byte_char[ord(c)] for c in word), None
        else:
            coded = "".join(self.byte_char[b] for b in word.encode())
            ends = np.cumsum([len(c.encode()) for c in word]).tolist()
        vocab, apart, longest = self.vocab, self.apart, self.longest
        count, last = [0], [""]
        for i in range(1, len(coded) + 1):
            for j in range(max(0, i - longest), i):
                token = coded[j:i]
                if token in vocab:
                    if j == 0:
                        break
                    before = last[j]
                    ok = apart.get((before, token))
                    if ok or ok is None and self.stays_apart(before, token):
                        break
            count.append(count[j] + 1)
            last.append(token)
        known = tuple(count[1:]) if ends is None else tuple(count[e] for e in ends)
        if len(self.words) < REMEMBERED and len(word) < 40:
            self.words[word] = known
        return known

    def unit(self, unit: str) -> list[int]:
        """Counts after each character of a white space run with what follows it, or of either alone."""
        white = WHITE_RUN.match(unit).end()
        rest = unit[white:]
        if white == 0:
            if rest[0] == "'" and len(rest) > 2 and rest[1:].isalpha():  # shorter prefixes are no contraction
                return [self.plain(rest[:k]) for k in range(1, len(rest))] + [self.word(rest)[-1]]
            return list(self.word(rest))
        counts = list(self.word(unit[:white]))
        if rest:
            joined = unit[white - 1] == " "
            base = self.word(unit[: white - 1])[-1] if white > 1 else 0
            if joined:
                inner = self.word(" " + rest)
            else:
                base += self.word(unit[white - 1])[-1]
                inner = [0, *self.unit(rest)][1:]
            counts += [base + c for c in (inner[1:] if joined else inner)]
        return counts

    def plain(self, text: str) -> int:
        """Tokens of a text whose special strings are ordinary; for the few places where context matters."""
        return sum(self.word(w)[-1] for w in PRETOKEN.findall(text))

    def of_piece(self, piece: str) -> list[int]:
        out: list[int] = []
        base = 0
        for unit in UNIT.findall(piece):
            counts = self.unit(unit)
            out += counts if not base else [base + c for c in counts]
            base = out[-1]
        return out

    def of_text(self, text: str) -> np.ndarray:
        """Counts of all prefixes of any text, special strings included; entry i is that of the first i + 1 characters."""
        at = [i for s in self.specials for i in _places(text, s)]
        if not at:
            return np.array(self.of_piece(text), np.int64)
        out: list[int] = []
        begin, base = 0, 0
        while begin < len(text):
            found = min(((i, s) for s in self.specials if (i := text.find(s, begin)) >= 0), default=(len(text), ""))
            segment = text[begin : found[0]]
            counts = self.of_piece(segment)
            out += [base + c for c in counts]
            if found[1]:
                units = UNIT.findall(segment)
                tail = units[-1] if units else ""
                before = base + (counts[len(segment) - len(tail) - 1] if len(segment) > len(tail) else 0)
                out += [before + self.plain(tail + found[1][:k]) for k in range(1, len(found[1]))]
                base += (counts[-1] if counts else 0) + 1
                out.append(base)
            begin = found[0] + len(found[1])
        return np.array(out, np.int64)

    def total(self, piece: str) -> int:
        if (known := self.totals.get(piece)) is None:
            counts = self.of_piece(piece)
            known = counts[-1] if counts else 0
            if len(self.totals) < REMEMBERED:
                self.totals[piece] = known
        return known

    def steps(self, piece: str) -> np.ndarray:
        """The table of a piece as differences from prefix to prefix, which may be below zero."""
        if (known := self.pieces.get(piece)) is None:
            known = np.diff(self.of_piece(piece), prepend=0).astype(np.int16)
            if len(self.pieces) < REMEMBERED:
                self.pieces[piece] = known
        return known


def _places(text: str, part: str) -> list[int]:
    found, i = [], text.find(part)
    while i >= 0:
        found.append(i)
        i = text.find(part, i + len(part))
    return found


@lru_cache(maxsize=2)
def _table(path: str) -> PrefixTable:
    return PrefixTable(path)


def _count(table: PrefixTable, texts: pa.Array, with_steps: bool) -> tuple[np.ndarray, list[bytes] | None]:
    pieces = cut(texts, table.specials)
    starts = np.concatenate([[0], pieces.ends[:-1]]).astype(np.int64)
    totals = np.array([table.total(p) for p in pieces.distinct], np.int64)
    running = np.concatenate([[0], np.cumsum(totals[pieces.codes])])
    counts = running[pieces.ends] - running[starts]
    steps = None
    if with_steps:
        each = [table.steps(p) for p in pieces.distinct]
        steps = [b"".join(each[c].tobytes() for c in pieces.codes[a:b]) for a, b in zip(starts, pieces.ends, strict=True)]
    for i in pieces.odd:
        whole = table.of_text(texts[i].as_py())
        counts[i] = whole[-1]
        if steps is not None:
            steps[i] = np.diff(whole, prepend=0).astype(np.int16).tobytes()
    return counts, steps


def prefix_counts(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_steps: bool = False) -> DataFrame:
    """``keep`` columns, then ``n_bytes`` and ``n_tokens`` of the whole text, and with ``with_steps``
    the table itself: ``prefix_steps``, 16-bit little-endian differences of the count from each
    character's prefix to the next. One pass over the text column, no shuffle.
    """
    with_steps = bool(with_steps)
    chosen = df.select(*(df[c] for c in keep), df[text].alias("__text"))
    extra = ", n_bytes long, n_tokens long" + (", prefix_steps binary" if with_steps else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + extra

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(vocabulary)
        for part in parts:
            for a, b in batches(part.column(len(keep)), BATCH_BYTES):
                rows = part.slice(a, b - a)
                texts = rows.column(len(keep))
                counts, steps = _count(table, texts, with_steps)
                columns = [*(rows.column(i) for i in range(len(keep))), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(counts, pa.int64())]
                names = [*keep, "n_bytes", "n_tokens"]
                if steps is not None:
                    columns.append(pa.array(steps, pa.binary()))
                    names.append("prefix_steps")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return chosen.mapInArrow(run, schema)


def count_at(steps: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters, read off a stored table."""
    return int(np.frombuffer(steps, "<i2")[: max(0, n_chars)].sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix with ``budget`` tokens at most; counts may fall as a prefix grows, so all are looked at."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)])
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def truncate(df: DataFrame, vocabulary: str, budget: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, the longest prefix of each text that fits ``budget`` tokens, and its length in characters."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def fits(steps):
        return steps.map(lambda s: longest_within(s, budget))

    counted = prefix_counts(df, vocabulary, text, keep=(key, text), with_steps=True)
    sized = counted.withColumn("kept_chars", fits("prefix_steps"))
    return sized.select(key, F.substring(F.coalesce(F.col(text), F.lit("")), F.lit(1), F.col("kept_chars")).alias("kept_text"), "kept_chars")


def over_limit(df: DataFrame, vocabulary: str, limit: int = 512, **columns) -> DataFrame:
    """:func:`prefix_counts` with the answer to a budget question: ``over_limit`` is whether the whole text exceeds ``limit``."""
    return prefix_counts(df, vocabulary, **columns).withColumn("over_limit", F.col("n_tokens") > limit)
