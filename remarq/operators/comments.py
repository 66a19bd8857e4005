"""Row operators over comments: id dedup, cleaning, scores and labels. Every one is DataFrame to DataFrame.

A comment has at least ``seq`` (its place at ingest, unique), ``id``, ``content`` and ``like_count``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, match, text
from ..functions.bind import once
from ..functions.lexicon import SENTIMENT, Lexicon, Taxonomy, taxonomy


def last_of_each(df: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of every key, at the place of its first; rows without a key go. Pre-aggregates, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in (key, order)]
    kept = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    grouped = kept.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last"), F.min(order).alias(order))
    return grouped.select(*(F.col(c) if c in (key, order) else F.col("last")[c].alias(c) for c in df.columns))


def clean(df: DataFrame) -> DataFrame:
    """Cleaned text, language, quality and the cleaned text's hash; empty and low-quality rows go."""
    met = once(df, __row=cleaning.cleaned(F.col("content")))
    row, slow = F.col("__row"), text.normalize(text.collapsed(F.coalesce("content", F.lit(""))))
    cleaned = once(met, cleaned_content=F.when(row.isNotNull(), row["cleaned_content"]).otherwise(slow)).where("cleaned_content != ''")
    body = F.col("cleaned_content")
    scored = once(cleaned, quality_score=F.when(row.isNotNull(), row["quality_score"]).otherwise(text.quality_score(body)))
    more = {"language": text.language(body), "content_hash": text.content_hash(body)}
    return scored.where("quality_score > 0.2").withColumns({n: F.when(row.isNotNull(), row[n]).otherwise(slow) for n, slow in more.items()}).drop("__row")


def scored(df: DataFrame, lexicon: Lexicon = SENTIMENT, domain: str | Taxonomy = "basketball") -> DataFrame:
    """:func:`sentiment` and :func:`labels` from one pass over the texts for all their terms."""
    tax = taxonomy(domain) if isinstance(domain, str) else domain
    met, hits = match.with_hits(df, "__hits", F.col("cleaned_content"), [*match.lexicon_terms(lexicon), *match.label_terms(tax)])
    return labels(sentiment(met, lexicon, hits), tax, hits).drop("__hits")


def sentiment(df: DataFrame, lexicon: Lexicon = SENTIMENT, hits: match.Hits | None = None) -> DataFrame:
    """Struct ``sentiment`` with label, score and confidence."""
    scored = df.withColumn("__h", match.sentiment_hundredths(F.col("cleaned_content"), lexicon, hits))
    h = F.greatest(F.lit(-100), F.least(F.lit(100), F.col("__h")))
    label = F.when(h >= 55, "strong_positive").when(h >= 15, "positive").when(h <= -55, "strong_negative").when(h <= -15, "negative").otherwise("neutral")
    score = h / F.lit(100.0)
    return scored.withColumn("sentiment", F.struct(label.alias("label"), score.alias("score"), F.least(F.lit(0.95), F.lit(0.55) + F.abs(score) * 0.4).alias("confidence"))).drop("__h")


def labels(df: DataFrame, domain: str | Taxonomy = "basketball", hits: match.Hits | None = None) -> DataFrame:
    """Structs ``painpoint`` (negative rows), ``positive_attribution`` (positive rows) and ``stance`` (all rows)."""
    tax = taxonomy(domain) if isinstance(domain, str) else domain
    score, body = F.col("sentiment.score"), F.col("cleaned_content")

    def named(found, reason: str):
        return F.struct(found["label"].alias("category"), found["confidence"].alias("confidence"), F.concat(F.lit(reason), found["term"]).alias("reason"))

    stance = match.first_label(body, tax, hits=hits)
    return df.withColumns(
        {
            "painpoint": F.when(score < -0.1, named(match.longest_label(body, tax, "negative", hits), "term: ")),
            "positive_attribution": F.when(score > 0.1, named(match.longest_label(body, tax, "positive", hits), "term: ")),
            "stance": F.struct(stance["label"].alias("label"), stance["confidence"].alias("confidence"), F.concat(F.lit("term: "), stance["term"]).alias("reason")),
        }
    )
