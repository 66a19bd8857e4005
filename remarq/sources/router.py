"""From a configuration to comments of its source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, paged, synthetic, threads

#: Columns of threads that a source without them has as nulls.
THREAD = {"thread_id": "string", "thread_title": "string", "thread_excerpt": "string", "thread_image_urls": "array<string>", "board": "string"}


@dataclass(frozen=True)
class Plan:
    source: str
    platform: str
    most: int
    options: dict[str, Any]


def _file(spark: SparkSession, plan: Plan) -> DataFrame:
    return files.comments_from_file(spark, plan.options["path"], plan.most, platform=plan.platform, topic=plan.options.get("topic", ""), mapping=plan.options.get("mapping"))


def _mock(spark: SparkSession, plan: Plan) -> DataFrame:
    o = plan.options
    most = min(plan.most, len(synthetic.SENTENCES["basketball"]))
    return synthetic.comments(spark, o.get("sport", "basketball"), most, plan.platform, o.get("topic", ""), o.get("task", "0"), o.get("board", ""))


def _threads(spark: SparkSession, plan: Plan) -> DataFrame:
    """Stored pages: the manifest of stored threads, of which those of the addresses are read as far as their share; a table of ``html, url``; or the path of one page.
    Each of the distinct threads has an even share, rounded up."""
    pages, urls, order = plan.options.get("pages"), list(dict.fromkeys(plan.options.get("urls") or ())), None
    if plan.options.get("manifest"):
        wanted = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, place int").select(threads.thread_id(F.col("url")).alias("thread_id"), "place").dropna().dropDuplicates(["thread_id"])
        ids = [r["thread_id"] for r in wanted.collect()]  # the run's addresses
        read = paged.stored_threads(spark, plan.options["manifest"], share=-(-plan.most // max(1, len(urls))))
        pages = read.where(F.col("thread_id").isin(ids)).join(F.broadcast(wanted), "thread_id")
        order = F.col("place") * F.lit(1 << 32) + F.col("page")
    if pages is None:
        if not plan.options.get("path"):
            raise ValueError("a forum source takes stored pages: a table of html and url, or the path of one")
        pages = spark.read.option("wholetext", True).text(plan.options["path"]).select(F.col("value").alias("html"), F.lit(urls[0] if urls else plan.options["path"]).alias("url"))
    rows = threads.capped(threads.parse_pages(pages, order=order), plan.most, max(1, len(urls)))
    return rows.select(F.monotonically_increasing_id().alias("seq"), "id", F.lit(plan.platform).alias("platform"), "topic", "content", "author_hash", "like_count", "reply_count", "publish_time", "source_url", F.lit(None).cast("string").alias("parent_id"), *THREAD)


# Names of sources; unknown ones mean the generated one.
REGISTRY: dict[str, Callable[[SparkSession, Plan], DataFrame]] = {
    "mock": _mock,
    "hupu_public": _threads,
    "csv": _file,
    "json": _file,
    "mediacrawler": _file,
}
FILES = ("csv", "json", "mediacrawler")
NO_PLATFORM = "sample"
# End of fixed values.


def plans(source: str, platforms: list[str], most: int, options: dict[str, Any]) -> list[Plan]:
    """A file is one plan, of the first platform, with the whole cap; else the platforms share it evenly, one row at least."""
    name = source if source in REGISTRY else "mock"
    if name in FILES:
        return [Plan(name, platforms[0] if platforms else NO_PLATFORM, most, options)]
    return [Plan(name, p, max(1, most // max(1, len(platforms))), options) for p in platforms]


def collect(spark: SparkSession, found: list[Plan]) -> DataFrame:
    """All plans' comments, plan after plan."""
    parts = []
    for i, p in enumerate(found):
        rows = REGISTRY[p.source](spark, p)
        rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in THREAD.items() if c not in rows.columns})
        parts.append(rows.withColumn("seq", F.lit(i) * F.lit(1 << 50) + F.col("seq")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
