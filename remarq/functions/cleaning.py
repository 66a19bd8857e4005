"""The cleaning rules of ``text`` on Arrow batches, in one pass over a text's bytes.

Most of a text is ASCII, where a table of bytes tells signs from letters; of the rest only its distinct characters are looked at. A text with letters that
Unicode got after its version 3.2, or with a capital sigma, whose small form hangs on its neighbours, gives null here, since libraries differ there: ``text`` has the same rules as Spark expressions.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .match import SLICE
from .text import ADVERTS, EMOJI, FLOOD, PUNCTUATION_KEPT, SHORT_BUT_TELLING

#: Java's white space and Unicode's separators, as ``text.SPACE`` has them.
BLANK = " \\t\\n\\x0b\\f\\r\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ASCII = bytes(range(128))
BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{BLANK}]", c))
MENTION, TAG = re.compile(f"@[^{BLANK}]+"), re.compile("<[^>]+>")
FURNITURE = ("作者", "置顶评论", "回复", "赞")
BETWEEN = re.compile(f"(^|[{BLANK}])({'|'.join(FURNITURE)})([{BLANK}]|$)")
REPLIES = re.compile(f"展开[{BLANK}]*[0-9]+[{BLANK}]*条回复")
ADVERT = re.compile("|".join(ADVERTS), re.IGNORECASE | re.ASCII)
ADVERT_SIGNS = tuple("://" if "://" in a else a.lower() for a in ADVERTS)
CJK, LATIN = re.compile("[一-鿿]"), re.compile("[A-Za-z]")
ROW = pa.struct([("cleaned_content", pa.string()), ("quality_score", pa.float64()), ("language", pa.string()), ("content_hash", pa.string())])


def to_spaces(signs: frozenset[str]) -> bytes:
    """A table for ``bytes.translate``: ASCII signs to spaces, all other bytes as they are."""
    return bytes(32 if i < 128 and chr(i) in signs else i for i in range(256))


BLANK_TABLE = to_spaces(BLANKS)
NOT_HASHED = bytes(i for i in range(128) if not chr(i).isalnum() and i != 95)
ODD_TABLE = to_spaces(frozenset(c for c in map(chr, range(128)) if not c.isalnum() and c not in "_-" + PUNCTUATION_KEPT and c not in BLANKS))


def collapse(text: str) -> str:
    """Runs of spaces to one, none at the ends."""
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def others(text: str) -> set[str]:
    """The distinct characters beyond ASCII."""
    return set() if text.isascii() else set(text.encode().translate(None, ASCII).decode())


@lru_cache(maxsize=1 << 16)
def odd(c: str) -> bool | None:
    """Whether a character beyond ASCII is neither letter, number, kept punctuation nor blank; None if that hangs on Unicode's version."""
    if c in PUNCTUATION_KEPT or c in BLANKS:
        return False
    kind = unicodedata.category(c)[0]
    if kind not in "LN":
        return True
    return False if unicodedata.ucd_3_2_0.category(c)[0] == kind else None


def normal(text: str) -> str | None:
    """``text.normalize`` of the collapsed text; None if its characters are not all settled."""
    beyond = others(text)
    signs = {c for c in beyond if odd(c) is not False}
    if "Σ" in beyond or any(odd(c) is None for c in signs):
        return None
    text = text.encode().translate(BLANK_TABLE).decode()
    for c in beyond & BLANKS:
        text = text.replace(c, " ")
    text = collapse(text)
    if beyond:
        for sign, word in EMOJI:
            text = text.replace(sign, word)
    if "@" in text:
        text = MENTION.sub(" ", text)
    if beyond and any(s in text for s in FURNITURE):
        text = BETWEEN.sub(" ", text)
    if beyond and "展开" in text:
        text = REPLIES.sub(" ", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    text = text.encode().translate(ODD_TABLE).decode()
    for c in signs:
        text = text.replace(c, " ")
    return collapse(text)


def quality(text: str) -> float:
    """``text.quality_score`` of a cleaned text."""
    low = text.lower()
    short = low.replace(" ", "") if len(text) < 200 else low
    size = len(short)  # from 36 characters on the score is one, and a cleaned text of 200 has a hundred beside its spaces
    if short in FLOOD:
        return 0.0
    if any(s in low for s in ADVERT_SIGNS) and ADVERT.search(text):
        return 0.1
    if size <= 1:
        return 0.0
    if size <= 4 and short not in SHORT_BUT_TELLING:
        return 0.45
    return min(1.0, 0.55 + size / 80.0)


def language(text: str) -> str:
    """``text.language`` of a text."""
    if not text.isascii() and CJK.search(text):
        return "zh" if len(CJK.findall(text)) >= len(LATIN.findall(text)) else "en"
    return "en" if LATIN.search(text) else "zh"


def content_hash(text: str) -> str:
    """``text.content_hash`` of a cleaned text."""
    low = text.lower()
    form = low.encode().translate(None, NOT_HASHED)
    for c in others(low):
        if unicodedata.category(c)[0] not in "LN":
            form = form.replace(c.encode(), b"")
    return hashlib.sha1(form, usedforsecurity=False).hexdigest()


def _rows(texts: list[str | None]) -> pa.Array:
    found = [normal(t or "") for t in texts]
    scores = [None if t is None else quality(t) for t in found]
    kinds = [None if t is None else language(t) for t in found]
    hashes = [None if t is None else content_hash(t) for t in found]
    return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(kinds, pa.string()), pa.array(hashes, pa.string())], fields=list(ROW), mask=pa.array([t is None for t in found], pa.bool_()))


def cleaned(text: Column) -> Column:
    """A struct of cleaned_content, quality_score, language and content_hash; null where the Spark expressions have to tell. Null texts count as empty."""

    @F.arrow_udf(T.StructType([T.StructField("cleaned_content", T.StringType()), T.StructField("quality_score", T.DoubleType()), T.StructField("language", T.StringType()), T.StructField("content_hash", T.StringType())]))
    def every(texts: pa.Array) -> pa.Array:
        parts = [_rows(texts.slice(i, SLICE).to_pylist()) for i in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], ROW)

    return every(text)
