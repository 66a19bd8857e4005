"""Grouped reports over comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The warning of the quality report, the title of a thread without one.
SMALL_SAMPLE = "样本量较小，仅适合演示"
UNNAMED = "未命名帖子"


def tier(n: Column) -> Column:
    return F.when(n < 100, "low").when(n < 300, "medium").otherwise("high")


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def quality_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: counts, duplicate and noise shares, language histogram, confidence tier, warning. One pass over each table."""
    by_language = cleaned.groupBy("language").agg(F.count("*").alias("n"), F.count_if(~F.col("is_duplicate")).alias("kept"))
    counts = by_language.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("clean_count"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("dedup_count"),
        F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("language_distribution"),
    )
    one = raw.agg(F.count("*").alias("raw_count")).join(F.broadcast(counts), F.lit(True))
    return one.select(
        "raw_count",
        "clean_count",
        "dedup_count",
        _ratio(F.col("clean_count") - F.col("dedup_count"), F.col("clean_count")).alias("duplicate_ratio"),
        _ratio(F.greatest(F.lit(0), F.col("raw_count") - F.col("clean_count")), F.col("raw_count")).alias("noise_ratio"),
        "language_distribution",
        tier(F.col("dedup_count")).alias("sample_confidence_level"),
        F.when(F.col("dedup_count") < 100, SMALL_SAMPLE).otherwise("").alias("warning"),
    )


def with_noise_ratio(quality: DataFrame, noise: DataFrame) -> DataFrame:
    """A quality report whose noise share is the clusters', where a run has rows; both are tables of one row."""
    own = noise.select(F.col("noise_ratio").alias("__of_clusters"))
    return quality.join(F.broadcast(own), F.lit(True)).withColumn("noise_ratio", F.when(F.col("dedup_count") > 0, F.col("__of_clusters")).otherwise(F.col("noise_ratio"))).drop("__of_clusters")


def fallback_quality(cleaned: DataFrame) -> DataFrame:
    """The quality report where none was kept: from the comments alone, as if they were the raw ones."""
    return quality_report(cleaned, cleaned)


def dashboard(tasks: DataFrame) -> DataFrame:
    """One row over a table of tasks: all, completed, and of each sport."""
    return tasks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), *(F.count_if(F.col("domain") == d).alias(d) for d in ("basketball", "football")))


def distribution(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))


def sentiment_overview(df: DataFrame) -> DataFrame:
    """One row: the mean score of the non-duplicates (three places) and a count for each label."""
    names = ("strong_positive", "positive", "neutral", "negative", "strong_negative")
    own = df.where(~F.col("is_duplicate"))
    return own.agg(F.round(F.coalesce(F.sum(F.round(F.col("sentiment.score") * 100).cast("long")) / F.greatest(F.lit(1), F.count("*")) / F.lit(100.0), F.lit(0.0)), 3).alias("mean_score"), *(F.count_if(F.col("sentiment.label") == n).alias(n) for n in names))


def negative_ratio(df: DataFrame) -> DataFrame:
    own = df.where(~F.col("is_duplicate"))
    bad = F.count_if(F.col("sentiment.label").isin("negative", "strong_negative"))
    return own.agg(_ratio(bad, F.count("*")).alias("negative_ratio"))


def label_report(df: DataFrame, field: str) -> DataFrame:
    """A row per category of a label struct: count, share of the non-duplicates, top 3 by likes, sentiment histogram.

    One pass counts, the rows without a label too; another keeps three rows of a category in every task before they are shuffled.
    """
    own = df.where(~F.col("is_duplicate")).select(F.col(f"{field}.category").alias("category"), F.col("sentiment.label").alias("mood"))
    cells = own.groupBy("category", "mood").agg(F.count("*").alias("c"))
    counts = cells.groupBy("category").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("mood", "c"))).alias("sentiment_distribution"))
    shares = counts.withColumn("total", F.sum("n").over(Window.partitionBy())).where("category is not null")  # a row per category
    top = label_examples(df, field).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cleaned_content"))), lambda x: x["cleaned_content"]).alias("examples"))
    return shares.join(F.broadcast(top), "category").select("category", "n", _ratio(F.col("n"), F.col("total")).alias("ratio"), "examples", "sentiment_distribution").orderBy(F.desc("n"), "category")


def label_examples(df: DataFrame, field: str, k: int = 3) -> DataFrame:
    """category, rank, seq, like_count, cleaned_content of the k most liked non-duplicates per category."""
    named = df.where(~F.col("is_duplicate") & F.col(field).isNotNull()).withColumn("category", F.col(f"{field}.category"))
    order = Window.partitionBy("category").orderBy(F.desc("like_count"), "seq")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("category", "rank", "seq", "like_count", "cleaned_content")


def _given(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def threads(df: DataFrame, k: int = 10) -> DataFrame:
    """The first k threads in order of appearance: key (thread, else url, else id), title (else topic), excerpt, url, comments, first text."""
    have = df.withColumns({c: F.lit(None).cast("string") for c in ("thread_title", "thread_excerpt", "topic") if c not in df.columns})
    keyed = have.withColumn("thread_key", F.coalesce(_given("thread_id"), _given("source_url"), F.col("id")))
    first = F.min_by(F.struct(F.coalesce(_given("thread_title"), _given("topic"), F.lit(UNNAMED)).alias("title"), F.coalesce("thread_excerpt", F.lit("")).alias("excerpt"), F.coalesce("source_url", F.lit("")).alias("url"), "content"), "seq")
    grouped = keyed.groupBy("thread_key").agg(F.count("*").alias("n_comments"), F.min("seq").alias("first_seq"), first.alias("f"))
    return grouped.orderBy("first_seq").limit(k).select("thread_key", "f.title", "f.excerpt", "f.url", "n_comments", "first_seq", F.col("f.content").alias("first_content"))


def thread_contents(df: DataFrame, per_thread: int = 3) -> DataFrame:
    """thread_id, rank, seq, content of each thread's first rows."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_thread).select("thread_id", "rank", "seq", "content")


def capped(df: DataFrame, per_thread: int, total: int) -> DataFrame:
    """At most ``per_thread`` rows of each thread and ``total`` in all, in order."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= per_thread).drop("__rank").orderBy("seq").limit(total)


def run_summary(raw: DataFrame, df: DataFrame) -> DataFrame:
    """One row of counters over a finished run."""
    own = ~F.col("is_duplicate")
    counts = df.agg(
        F.count("*").alias("n_clean"),
        F.count_if(own).alias("n_dedup"),
        F.count_if(own & F.col("painpoint").isNotNull()).alias("n_pain"),
        F.count_if(own & F.col("positive_attribution").isNotNull()).alias("n_positive"),
        F.count_distinct(F.when(own & (F.col("cluster_id") >= 0), F.col("cluster_id"))).alias("n_clusters"),
    )
    return raw.agg(F.count("*").alias("n_raw")).join(counts, F.lit(True))


def dominant_topic(clusters: DataFrame) -> DataFrame:
    return clusters.where(~F.col("is_noise")).orderBy(F.desc("cluster_size"), "cluster_id").limit(1)


def drill_down(df: DataFrame, keyword: str | None = None, label: str | None = None, cluster_id: int | None = None, k: int = 36) -> DataFrame:
    """Rows by keyword (any case), sentiment label or cluster; without any of these the first k that represent their cluster."""
    out = df
    if keyword:
        out = out.where(F.lower("cleaned_content").contains(keyword.lower()))
    if label:
        out = out.where(F.col("sentiment.label") == label)
    if cluster_id is not None:
        out = out.where(F.col("cluster_id") == cluster_id)
    if not keyword and not label and cluster_id is None:
        return out.where(F.col("representative_reason") != "").orderBy("seq").limit(k)
    return out


def remapped(df: DataFrame, task: str) -> DataFrame:
    """Rows under ids that are unique over all tasks, with the id that they had."""
    return df.withColumns({"original_id": F.col("id"), "id": F.concat_ws(":", F.lit(task), F.col("id"))})


def annotated(df: DataFrame, representatives: DataFrame | None = None, reason: str = "representative") -> DataFrame:
    """The read model: a comment with its scores, and why it represents its cluster if it does."""
    out = df.select("seq", "id", "platform", "content", "cleaned_content", "language", "like_count", "quality_score", "is_duplicate", "cluster_id", F.col("sentiment.label").alias("sentiment_label"), F.col("sentiment.score").alias("sentiment_score"), F.col("painpoint.category").alias("painpoint_category"), F.col("positive_attribution.category").alias("positive_category"), F.col("stance.label").alias("stance_label"))
    if representatives is None:
        return out
    return out.join(representatives.select("seq", F.lit(reason).alias("representative_reason")), "seq", "left")
