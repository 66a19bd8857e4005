"""Domain tokens, document frequencies and word clouds."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import BLANK, collapse, others, to_spaces
from ..functions.lexicon import Taxonomy
from ..functions.match import by_slices, places, vocabulary
from ..functions.text import PUNCTUATION_CUT
from ..storage import stored

LATIN_WORD = "[A-Za-z][A-Za-z0-9_-]+"
CJK_RUN = "[一-鿿]{2,}"
WORD = re.compile(f"{LATIN_WORD}|{CJK_RUN}")
ADDRESS, MENTION, TOPIC = re.compile(f"https?://[^{BLANK}]+"), re.compile(f"@[^{BLANK}]+"), re.compile("#([^#]+)#")
CUT = frozenset(c for c in map(chr, range(0x10000)) if re.match(f"[{PUNCTUATION_CUT}{BLANK}]", c))
CUT_TABLE = to_spaces(CUT)
DIGITS, PLAIN = re.compile(r"\d+"), re.compile("[0-9a-zA-Z_-]+")
#: All but what Latin words are made of, hyphens too, which ``CUT`` has.
APART = bytes(i if i < 128 and (chr(i).isalnum() or i == 95) else 32 for i in range(256))
NUMBERED, CJK = re.compile("[0-9_]"), re.compile("[一-鿿]")


def prepared(text: str) -> str:
    """Addresses, mentions and punctuation to spaces, topics without their signs; spaces collapsed."""
    if "://" in text:
        text = ADDRESS.sub(" ", text)
    if "@" in text:
        text = MENTION.sub(" ", text)
    if "#" in text:
        text = TOPIC.sub(r" \1 ", text)
    body = text.encode().translate(CUT_TABLE).decode()
    for c in others(text) & CUT:
        body = body.replace(c, " ")
    return collapse(body)


def keep(token: str, stop_words: frozenset[str]) -> bool:
    t = token.strip(" ")
    return len(t) > 1 and t.lower() not in stop_words and not DIGITS.fullmatch(t) and not (len(t) <= 2 and PLAIN.fullmatch(t))


class _Finder:
    """Tokens of texts. Words of Latin letters alone, the most of them, are cut at all other bytes and told apart before any is looked at."""

    def __init__(self, known_terms: tuple[str, ...], stop_words: tuple[str, ...]):
        self.stop = frozenset(stop_words)
        self.terms = sorted((t.strip() for t in known_terms if len(t.strip()) > 1 and t.lower() not in self.stop), key=lambda t: (-len(t), t))
        self.lows = vocabulary(known_terms)
        self.known = frozenset(self.lows)
        self.at: dict[str, list[int]] = {}
        for i, t in enumerate(self.terms):
            if keep(t, self.stop):
                self.at.setdefault(t.lower(), []).append(i)

    def of(self, text: str) -> list[str]:
        body = prepared(text)
        found = [self.lows[i] for i in places(body.lower(), self.lows)]
        out: dict[str, str] = {}
        for i in sorted(i for t in found for i in self.at.get(t, ())):
            out.setdefault(self.terms[i].lower(), self.terms[i])
        if not body.isascii() and CJK.search(body):
            self._mixed(body, found, out)
            return list(out.values())
        words = body.encode().translate(APART).decode()
        stop = self.stop
        for word in dict.fromkeys(WORD.findall(words) if NUMBERED.search(words) else words.split()):
            if len(word) > 2:  # what ``keep`` asks of a Latin word, but for stop words
                key = word.lower()
                if key not in out and key not in stop:
                    out[key] = word
        return list(out.values())

    def _mixed(self, body: str, found: list[str], out: dict[str, str]) -> None:
        """Latin words, and CJK runs that are or hold a term."""
        longer = [t for t in found if len(t) >= 2]  # a word of the text can only hold a term that the text holds
        for word in WORD.findall(body):
            key = word.lower()
            if key not in out and keep(word, self.stop) and (word[0] < "一" or key in self.known or (len(word) <= 6 and any(t in key for t in longer))):
                out[key] = word


@lru_cache(maxsize=8)
def _finder(known_terms: tuple[str, ...], stop_words: tuple[str, ...]) -> _Finder:
    """One of each list in a worker, for all its tasks."""
    return _Finder(known_terms, stop_words)


def tokens(text: Column, tax: Taxonomy) -> Column:
    """Known terms that occur, the longest first and equals by spelling; then Latin words and CJK runs that are or hold a
    term. Of tokens that differ in case alone the first stays.

    One pass over Arrow batches: a call a word is what costs most here, and Spark interprets the lambdas of its array functions.
    """
    known, stop = tuple(tax.known_terms), tuple(tax.stop_words)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def every(texts: pa.Array) -> pa.Array:
        own = _finder(known, stop)
        return by_slices(texts, lambda t: own.of(t or ""), pa.list_(pa.string()))

    return every(text)


def document_frequency(df: DataFrame) -> DataFrame:
    """key (small letters), word (as first seen) and in how many rows it occurs, of the non-duplicates' ``tokens``."""
    each = df.where(~F.col("is_duplicate")).select("seq", F.posexplode("tokens").alias("pos", "word"))
    return each.groupBy(F.lower("word").alias("key")).agg(F.min_by("word", F.struct("seq", "pos")).alias("word"), F.count("*").alias("df"))


def boost(key: Column, tax: Taxonomy) -> Column:
    lows = sorted({t.lower() for t in tax.known_terms})
    inside = F.exists(F.array(*map(F.lit, lows)), lambda t: key.contains(t)) if lows else F.lit(False)
    return F.when(key.isin(*lows), 1.75).when((F.length(key) >= 4) & inside, 1.35).otherwise(1.0)


def word_cloud(df: DataFrame, tax: Taxonomy, limit: int = 60) -> DataFrame:
    """word, df, weight of the most telling tokens. Tokens are distinct in a row, so term and document frequency are one.

    The number of rows with tokens joins as a single row; the largest score is that of the first of the top, so nothing else is global.
    """
    n = df.where(~F.col("is_duplicate") & (F.size("tokens") > 0)).agg(F.count("*").alias("n"))
    scored = document_frequency(df).join(F.broadcast(n), F.lit(True)).withColumn("score", F.col("df") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1) * boost(F.col("key"), tax))
    top = scored.orderBy(F.desc("score"), "key").limit(limit)
    return top.select("word", "df", F.round(1 + F.col("score") / F.max("score").over(Window.partitionBy()) * 9, 3).alias("weight"))


CLOUDS = ("all", "positive", "negative")


def word_clouds(df: DataFrame, tax: Taxonomy, limit: int = 60) -> DataFrame:
    """cloud ("all", "positive", "negative"), word, df, weight: :func:`word_cloud` of each polarity from one pass over the tokens.

    A row counts for the clouds that take it; its tokens, and a null for the row itself, are counted by cloud before they are shuffled, once. The best of a cloud are
    found by ranks that are limited before their shuffle.
    """
    taken = F.array_compact(F.array(*(F.when(polar(c), F.lit(c)) for c in CLOUDS)))
    rows = df.where(~F.col("is_duplicate") & (F.size("tokens") > 0)).select("seq", taken.alias("clouds"), F.posexplode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    each = rows.select(F.explode("clouds").alias("cloud"), "seq", "pos", "word")
    counted = stored(each.groupBy("cloud", F.lower("word").alias("key")).agg(F.min_by("word", F.struct("seq", "pos")).alias("word"), F.count("*").alias("df")), "cloud-words")
    n = counted.where("key is null").select("cloud", F.col("df").alias("n"))  # a row a cloud
    met = counted.where("key is not null").join(F.broadcast(n), "cloud")
    scored = met.withColumn("score", F.col("df") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1) * boost(F.col("key"), tax))
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("cloud").orderBy(F.desc("score"), "key"))).where(F.col("place") <= limit)
    return top.select("cloud", "word", "df", F.round(1 + F.col("score") / F.max("score").over(Window.partitionBy("cloud")) * 9, 3).alias("weight"))


def shown_words(cloud: DataFrame, most: int = 50) -> DataFrame:
    """What a chart shows of a cloud: the first words of 2 to 12 characters, at a weight of one at least."""
    tidy = cloud.withColumn("word", F.trim("word")).where(F.length("word").between(2, 12))
    return tidy.orderBy(F.desc("weight"), "word").limit(most).withColumn("weight", F.greatest(F.col("weight"), F.lit(1.0)))


def polar(polarity: str) -> Column:
    """Whether a word cloud of a polarity takes a row."""
    score, label = F.col("sentiment.score"), F.col("sentiment.label")
    if polarity == "positive":
        return (score > 0.1) | label.endswith("positive")
    if polarity == "negative":
        return (score < -0.1) | label.endswith("negative")
    return F.lit(True)


def of_polarity(df: DataFrame, polarity: str) -> DataFrame:
    """Rows that a word cloud of a polarity takes."""
    return df.where(polar(polarity))


# The clouds' captions.
CAPTIONS = {
    "all": "全量词云基于 %d 条去重评论，用 TF-IDF 并提升领域词权重生成。",
    "positive": "正向词云只统计 %d 条正向评论，用于观察被认可的选题角度。",
    "negative": "负向词云只统计 %d 条负向评论，用于定位争议和风险表达。",
}
# End of fixed values.


def captions(df: DataFrame) -> DataFrame:
    """How many non-duplicates each of the three clouds describes, and the clouds' captions."""
    own = df.where(~F.col("is_duplicate"))
    score = F.col("sentiment.score")
    counts = own.agg(F.count("*").alias("n_all"), F.count_if(score > 0.1).alias("n_positive"), F.count_if(score < -0.1).alias("n_negative"))
    return counts.select("*", *(F.format_string(text, f"n_{c}").alias(f"caption_{c}") for c, text in CAPTIONS.items()))
