"""Comments and events over time, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.match import sentiment_hundredths
from ..functions.lexicon import SENTIMENT, Lexicon


def trend(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and kind, for streams and tables alike; a stream drops what comes later than ``late``.

    State is one row per open window and kind, however many events there are.
    """
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("kind"))
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")


def sentiment_trend(comments: DataFrame, ts: str = "ts", lexicon: Lexicon = SENTIMENT, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Comments and summed sentiment (hundredths) per window."""
    scored = comments.withColumn("h", sentiment_hundredths(text.normalize(F.col("content")), lexicon))
    grouped = scored.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum("h").alias("hundredths")).select(F.col("w.start").alias("window_start"), "n", "hundredths")


def fresh_only(comments: DataFrame, ts: str = "ts", key: str = "id", late: str = "1 hour") -> DataFrame:
    """The first comment of every id; state is dropped with the watermark."""
    return comments.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
