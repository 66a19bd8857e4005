"""Scalar text functions, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

# The cleaning rules' words and patterns.
EMOJI = (("👍", " 好评 "), ("❤️", " 喜欢 "), ("🔥", " 火热 "), ("😡", " 生气 "), ("😭", " 难受 "))
FLOOD = ("666", "111", "顶", "路过", "签到")
SHORT_BUT_TELLING = ("太爽了", "真恶心", "真香", "好玩", "难受")
ADVERTS = ("加微", "VX", "兼职", "开户链接", r"https?://\S+", "点点关注", "点点赞", "多多转发")
PUNCTUATION_KEPT = "，。！？、,.!?：:；;（）()"
PUNCTUATION_CUT = "，。！？、；：,.!?;:()\\[\\]{}<>《》“”\"'|/\\\\\\-"
# End of fixed values.

SPACE = r"[\s\p{Z}]"
NO_SPACE = r"[^\s\p{Z}]"
EMBEDDING_SIZE = 64


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def _spaced(text: Column, pattern: str, *signs: str) -> Column:
    """Matches to spaces; the pattern, which only matches texts with one of the signs, goes over no others."""
    return let(text, lambda t: F.when(reduce(Column.__or__, (t.contains(s) for s in signs)), F.regexp_replace(t, pattern, " ")).otherwise(t))


def normalize(text: Column) -> Column:
    """Emoji to words; mentions, page furniture, tags and odd signs to spaces; spaces collapsed. Null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for sign, word in EMOJI:
        out = F.replace(out, F.lit(sign), F.lit(word))
    out = _spaced(out, f"@{NO_SPACE}+", "@")
    out = _spaced(out, rf"(^|{SPACE})(作者|置顶评论|回复|赞)({SPACE}|$)", "作者", "置顶评论", "回复", "赞")
    out = _spaced(out, rf"展开{SPACE}*\d+{SPACE}*条回复", "展开")
    out = _spaced(out, "<[^>]+>", "<")
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{PUNCTUATION_KEPT}\-\s\p{{Z}}]+", " ")
    return collapsed(out)


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"{SPACE}+", ""))


def quality_score(text: Column) -> Column:
    """0 for flooding and single characters, 0.1 for adverts, 0.45 for very short texts, else by length."""

    def of(short: Column) -> Column:
        size = F.length(short)
        return (
            F.when(short.isin(*FLOOD), 0.0)
            .when(text.rlike("(?i)" + "|".join(ADVERTS)), 0.1)
            .when(size <= 1, 0.0)
            .when((size <= 4) & ~short.isin(*SHORT_BUT_TELLING), 0.45)
            .otherwise(F.least(F.lit(1.0), F.lit(0.55) + size / F.lit(80.0)))
        )

    return let(compact(text), of)


def language(text: Column) -> Column:
    """zh if there are as many CJK characters as ASCII letters, else en."""
    cjk = F.length(F.regexp_replace(text, "[^一-鿿]+", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    some = F.when(text.rlike("[A-Za-z]"), "en").otherwise("zh")  # without CJK characters one letter decides
    return F.when(text.rlike("[一-鿿]"), F.when(cjk >= latin, "zh").otherwise("en")).otherwise(some)


def hash_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def content_hash(text: Column) -> Column:
    return F.sha1(hash_form(text).cast("binary"))


def group_id(hash_: Column) -> Column:
    return F.substring(hash_, 1, 12)


def surrogate_id(content: Column) -> Column:
    return F.concat(F.lit("upload-"), F.substring(F.sha1(content.cast("binary")), 1, 16))


def author_hash(*ids: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(*ids).cast("string").cast("binary")), 1, 16)


def safe_int(value: Column) -> Column:
    """Truncated towards zero; what is no number is 0."""
    return F.coalesce(value.try_cast("double").try_cast("bigint"), F.lit(0))


def epoch_iso(value: Column, millis: bool = True) -> Column:
    """Seconds or milliseconds since 1970 as an ISO time in UTC; missing values are 1970, what is no number is empty.

    Numbers above 1e10 count as milliseconds, unless ``millis`` says that there are none: seconds go on beyond the year 2286.
    """
    number = F.when(value.isNull(), F.lit(0.0)).otherwise(value.try_cast("double"))
    seconds = F.when(number > 1e10, number / 1000.0).otherwise(number) if millis else number
    whole = F.floor(seconds)
    micros = F.round((seconds - whole) * 1_000_000).cast("long")
    stamp = F.timestamp_micros(whole * 1_000_000 + micros)
    base = F.ltrim(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+"))  # years of five digits have a sign there
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.when(number.isNull(), "").otherwise(F.concat(base, fraction, F.lit("+00:00")))


def html_text(text: Column) -> Column:
    """Tags to spaces and collapsed; texts without angle brackets only collapse."""
    out = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return collapsed(F.when(out.contains("<") & out.contains(">"), plain).otherwise(out))


def html_images(text: Column, most: int = 4) -> Column:
    """Distinct http(s) image addresses, from src or else data-src."""
    tags = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(<img\b[^>]*>)"), 1)

    def address(tag: Column) -> Column:
        src = F.regexp_extract(tag, r"""(?i)\ssrc\s*=\s*["']([^"']*)["']""", 1)
        lazy = F.regexp_extract(tag, r"""(?i)\sdata-src\s*=\s*["']([^"']*)["']""", 1)
        own = F.when(src != "", src).otherwise(lazy)
        return F.when(own.startswith("//"), F.concat(F.lit("https:"), own)).otherwise(own)

    return F.slice(F.array_distinct(F.filter(F.transform(tags, address), lambda u: u.rlike("^https?://"))), 1, most)


def board(titles: Column, site: str) -> Column:
    """Of breadcrumb titles without the site's own: the second-last, else the only one, else empty."""
    own = F.filter(F.coalesce(titles, F.array().cast("array<string>")), lambda t: t != site)
    return F.when(F.size(own) >= 2, F.try_element_at(own, F.lit(-2))).otherwise(F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("")))


def percent(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio.cast("double") * 100)


def embedding(text: Column, size: int = EMBEDDING_SIZE) -> Column:
    """Hashed counts of the text's words, scaled to length one and rounded to six places."""

    def words(lowered: Column) -> Column:
        return let(F.regexp_extract_all(lowered, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(lowered)))

    def counts(buckets: Column) -> Column:
        # taking a bucket's words away is one quick pass a bucket, where a filter would be a call a word
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.size(buckets) - F.size(F.array_remove(buckets, i.cast("long")))).cast("double"))

    def scaled(own: Column) -> Column:
        norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, v: s + v * v))
        return let(norm, lambda n: F.transform(own, lambda v: F.round(v / n, 6)))

    found = let(F.lower(F.coalesce(text, F.lit(""))), words)
    buckets = F.transform(found, lambda w: F.pmod(F.conv(F.substring(F.sha1(w.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size)))
    return let(let(buckets, counts), scaled)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def norm(x: Column) -> Column:
        n = F.sqrt(dot(x, x))
        return F.when(n == 0, 1.0).otherwise(n)

    return dot(a, b) / (norm(a) * norm(b))
