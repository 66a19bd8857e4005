"""A whole analysis run: from sources to cards. Tables are DataFrames; a run collects a row per label, cluster, card and source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.bind import once
from ..functions.lexicon import LATIN_SENTIMENT, SENTIMENT, Lexicon, taxonomy
from ..operators import aggregates, cards, clusters, comments, dedup, density, media, tokens
from ..sources import articles, router
from ..storage import stored
from .config import AnalysisConfig
from .insight import insight

TASK = "task"
#: Rows of small tables that facts and reports hold.
MOST_LABELS, MOST_CLUSTERS = 20, 20


@dataclass
class AnalysisResult:
    """The artefacts of a run; every one is a DataFrame but for the insight and the steps."""

    raw: DataFrame
    comments: DataFrame
    quality: DataFrame
    clusters: DataFrame
    representatives: DataFrame
    painpoints: DataFrame
    positives: DataFrame
    cards: DataFrame
    word_cloud: DataFrame
    threads: DataFrame
    news: DataFrame
    media: DataFrame
    insight: dict[str, Any]
    config: AnalysisConfig = field(default_factory=AnalysisConfig)
    steps: dict[str, dict[str, Any]] = field(default_factory=dict)


def analysed(cleaned: DataFrame, domain: str, lexicon: Lexicon | None = None) -> DataFrame:
    """Hash, scores, labels, tokens, noise flag and rule cluster of cleaned comments: each row on its own, in one pass."""
    tax = taxonomy(domain)
    scored = comments.scored(cleaned, lexicon or (LATIN_SENTIMENT if domain == "latin" else SENTIMENT), tax)
    marked = clusters.noise(once(scored, tokens=tokens.tokens(F.col("cleaned_content"), tax)), tax)
    keyed = clusters.rule_key(marked, tax)
    return keyed if "content_hash" in keyed.columns else keyed.withColumn("content_hash", text.content_hash(F.col("cleaned_content")))


def with_clusters(df: DataFrame) -> DataFrame:
    """``cluster_id`` from the keys of the non-duplicates; duplicates have none. Keys are as many as labels, so they are broadcast."""
    ids = clusters.numbered(df.where(~F.col("is_duplicate"))).select("cluster_key", "cluster_id")
    return df.join(F.broadcast(ids), "cluster_key", "left").withColumn("cluster_id", F.when(~F.col("is_duplicate"), F.col("cluster_id")))


def by_kmeans(df: DataFrame) -> DataFrame:
    """``cluster_id`` from k-means over the non-duplicates' vectors, numbered by size with noise as -1."""
    own = clusters.kmeans_clusters(df.where(~F.col("is_duplicate"))).withColumn("cluster_key", F.when(F.col("cluster_label") == -1, clusters.NOISE_KEY).otherwise(F.col("cluster_label").cast("string"))).drop("cluster_label")
    return with_clusters(own).unionByName(df.where("is_duplicate").withColumn("cluster_id", F.lit(None).cast("int")))


def by_density(df: DataFrame) -> DataFrame:
    """``cluster_id`` from density clusters of the non-duplicates' vectors, numbered by size with what is in none as -1; for a task that the ladder allows."""
    found = density.density_clusters(df.where(~F.col("is_duplicate"))).select(F.col("key").alias("seq"), F.when(F.col("cluster_label") == density.NOISE, clusters.NOISE_KEY).otherwise(F.col("cluster_label").cast("string")).alias("cluster_key"))
    return with_clusters(df.drop("cluster_key").join(found, "seq", "left"))


class _Steps:
    """Names, times and outcomes of a run's steps."""

    def __init__(self, progress: Callable[[dict[str, dict[str, Any]]], None] | None):
        self.done: dict[str, dict[str, Any]] = {}
        self.progress = progress

    @contextmanager
    def step(self, name: str, summary: Callable[[], str] = lambda: "") -> Iterator[None]:
        began = time.perf_counter()
        self._tell(name, "running", None)
        try:
            yield
        except Exception as e:
            self._tell(name, "error", began, error=str(e))
            raise
        self._tell(name, "completed", began, output_summary=summary())

    def _tell(self, name: str, status: str, began: float | None, **more: str) -> None:
        took = None if began is None else max(1, int(1000 * (time.perf_counter() - began)))
        self.done[name] = {"status": status, "duration_ms": took, "error": "", "output_summary": "", **more}
        if self.progress:
            self.progress(self.done)


def _rows(df: DataFrame, most: int) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def images(raw: DataFrame, news: DataFrame, config: AnalysisConfig, service: Callable[[dict], dict] | None) -> DataFrame:
    """The run's context images, ranked, within budget, with what a service says of them."""
    candidates = media.thread_candidates(raw).unionByName(media.news_candidates(news))
    terms = tuple(t for t in (config.home_team, config.away_team, config.match_name) if t)
    chosen = media.budgeted_images(media.ranked_sources(media.source_score(candidates, terms)), config.max_images, config.enable_images)
    chosen = stored(chosen, "images")
    return media.with_answers(chosen, media.analysed(chosen, service))


def run_pipeline(
    spark: SparkSession,
    config: AnalysisConfig,
    raw: DataFrame | None = None,
    service: Callable[[str], str | dict[str, Any]] | None = None,
    vision: Callable[[dict], dict] | None = None,
    fetch: Callable[[str], str] | None = None,
    pages: DataFrame | None = None,
    progress: Callable[[dict[str, dict[str, Any]]], None] | None = None,
) -> AnalysisResult:
    """One task, bounded by its comment limit. What several steps read is written once to the shared folder.

    ``service`` answers prompts, ``vision`` describes images, ``fetch`` reads addresses, ``pages`` are stored forum pages: all optional.
    """
    tax, steps, counts = taxonomy(config.domain), _Steps(progress), {}
    with steps.step("crawl", lambda: f"raw_comments={counts['raw']}"):
        if raw is None:
            options = {"path": config.source_path, "pages": pages, "urls": config.thread_urls, "sport": config.domain, "topic": config.match_name or config.semantic_query, "board": config.board, "mapping": config.field_mapping}
            raw = router.collect(spark, router.plans(config.data_source, list(config.platforms), config.max_comments, options))
        raw = stored(comments.last_of_each(raw), "raw")
        counts["raw"] = raw.count()
    with steps.step("context", lambda: f"news_context={counts['read']}/{counts['news']}"):
        news = stored(articles.context(spark, config.news_context, list(config.news_urls), fetch), "news")
        news_rows = _rows(news.orderBy("seq").drop("image_urls"), articles.MOST_URLS + 1)
        counts |= {"news": len(news_rows), "read": sum(n["status"] != "error" for n in news_rows)}
    with steps.step("media", lambda: f"context_media={counts['media']}, included={counts['included']}"):
        pictures = stored(images(raw, news, config, vision), "media")
        evidence = _rows(media.evidence_view(pictures), 8)
        counts |= {"media": pictures.count(), "included": len(evidence)}
    with steps.step("clean", lambda: f"comments={counts['clean']}"):
        rows = stored(analysed(comments.clean(raw), config.domain).withColumn("task_id", F.lit(TASK)), "analysed")
        counts["clean"] = rows.count()
    with steps.step("dedup", lambda: f"comments={counts['clean']}, deduped={counts['dedup']}"):
        marked = stored(dedup.near(rows, config.dedup_threshold), "deduped", instead_of=rows)
        own = marked.where(~F.col("is_duplicate"))
        counts["dedup"] = own.count()
    with steps.step("cluster", lambda: f"clusters={counts['clusters']}"):
        method = clusters.method_for(counts["dedup"], clusters.have_vectors(own), config.density_clusters)
        by = {"density": by_density, "kmeans": by_kmeans, "rules": with_clusters}[method]
        done = stored(by(marked), "clustered", instead_of=marked)
        found = stored(clusters.summary(done, tax, method), "clusters")
        counts["clusters"] = found.count()
    with steps.step("quality"):
        quality = stored(aggregates.with_noise_ratio(aggregates.quality_report(raw, done), clusters.noise_ratio(done)), "quality")
    with steps.step("sample", lambda: f"representatives={counts['representatives']}"):
        chosen = stored(clusters.representatives(done), "representatives")
        counts["representatives"] = chosen.count()
    pain, positive = (stored(aggregates.label_report(done, f), f) for f in ("painpoint", "positive_attribution"))
    notes = stored(aggregates.threads(raw), "threads")
    with steps.step("insight"):
        facts = {
            "match_name": config.match_name,
            "home_team": config.home_team,
            "away_team": config.away_team,
            "data_quality": quality.first().asDict(recursive=True),
            "painpoints": _rows(pain.orderBy(F.desc("n"), "category"), MOST_LABELS),
            "positives": _rows(positive.orderBy(F.desc("n"), "category"), MOST_LABELS),
            "clusters": _rows(found.orderBy(F.desc("cluster_size"), "cluster_id"), MOST_CLUSTERS),
            "threads": _rows(notes.orderBy("first_seq"), 10),
            "representatives": _rows(done.select("seq", "cleaned_content").join(F.broadcast(chosen), "seq").orderBy("cluster_id", "rank"), 12),
            "news": news_rows,
            "media": [e | {"included_in_summary": True} for e in evidence],
        }
        prose = insight(facts, service if config.mode == "configured" or service else None, config.enable_insight)
    return AnalysisResult(raw, done, quality, found, chosen, pain, positive, cards.cards(done, found), tokens.word_clouds(done, tax), notes, news, pictures, prose, config, steps.done)


def visualizations(result: AnalysisResult) -> dict[str, DataFrame]:
    """The charts of a run, each a small table."""
    own = result.comments.where(~F.col("is_duplicate"))
    cloud = result.word_cloud
    return {
        "comment_trend": own.agg(F.lit("demo").alias("date"), F.count("*").alias("count")),
        "platform_distribution": aggregates.distribution(own, "platform"),
        "sentiment_distribution": aggregates.distribution(own.withColumn("label", F.col("sentiment.label")), "label"),
        "positive_topn": result.positives,
        "painpoint_topn": result.painpoints,
        "cluster_bubbles": result.clusters,
        "keyword_wordcloud": cloud.where("cloud = 'all'").drop("cloud"),
        "positive_wordcloud": cloud.where("cloud = 'positive'").drop("cloud"),
        "negative_wordcloud": cloud.where("cloud = 'negative'").drop("cloud"),
        "wordcloud_explanations": tokens.captions(result.comments).select("caption_all", "caption_positive", "caption_negative"),
        "representative_comments": result.representatives,
    }
