"""Cutting texts for a byte-level BPE vocabulary into pieces that encode independently.

The vocabulary's pre-tokenizer never lets a token cross from one word into the next, and white
space joins the word that follows only as a single leading space. So a text without runs of white
space around a space is the concatenation of its space-separated pieces, each but the first
with the space before it, and every piece encodes the same wherever it stands. Arrow splits a
whole batch and numbers its distinct pieces; only those reach Python.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Texts in which pieces between spaces are not independent: white space beside a space, special strings.
WHITE = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"
#: A run of white space with the word, number or sign run after it; what the pre-tokenizer makes of it does not depend on its neighbours.
UNIT = regex.compile(r"\s*(?:(?<! )'(?:[sdmt]|ll|ve|re)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
WHITE_RUN = regex.compile(r"\s*")
#: The pre-tokenizer's pattern.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizers library's object for a vocabulary file, once a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


@dataclass
class Pieces:
    """A batch of texts as numbers into ``distinct``; ``ends[i]`` is where row i's numbers end.

    Rows in ``odd`` have no numbers: their pieces depend on each other and the caller takes the whole text.
    """

    distinct: list[str]
    codes: np.ndarray
    ends: np.ndarray
    odd: np.ndarray


def cut(texts: pa.Array, specials: tuple[str, ...]) -> Pieces:
    """Split a string array; nulls count as empty texts. Pieces after the first carry their leading space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd_at = "|".join([f" {WHITE}", f"{WHITE} ", *(regex.escape(s) for s in specials)])
    odd = pc.match_substring_regex(texts, odd_at).to_numpy(zero_copy_only=False)
    regular = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
    lists = pc.split_pattern(regular, " ")
    offsets = lists.offsets.to_numpy()
    ends, values = offsets[1:] - offsets[0], lists.flatten()
    coded = values.dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    starts = np.concatenate([[0], ends[:-1]])
    first = pc.take(values, pa.array(starts)).dictionary_encode() if len(starts) else None
    distinct = [" " + w for w in words]
    if first is not None:
        codes[starts] = first.indices.to_numpy() + len(distinct)
        distinct += first.dictionary.to_pylist()
    return Pieces(distinct, codes, ends, np.flatnonzero(odd))


def batches(texts: pa.ChunkedArray | pa.Array, most_bytes: int):
    """(first row, end row) ranges with about ``most_bytes`` of text each, one row at least: bounds what a worker holds."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
        yield begin, end
        begin = end
