"""Forum threads from stored pages: the JSON that a page embeds, to comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

POST = "struct<pid:string,authorId:string,puid:string,content:string,allLightCount:string,replyNum:string,createdAt:string,isDelete:string,isSelfDelete:string,isHidden:string>"
SCHEMA = (
    "struct<props:struct<pageProps:struct<detail:struct<breadCrumb:array<struct<title:string,url:string>>,"
    "thread:struct<tid:string,title:string,content:string>,"
    f"replies:struct<total:string,size:string,list:array<{POST}>>,lights:array<{POST}>>>>>"
)
SCRIPT = r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
PAGE_SIZE = 20
# Hosts of the forum, its threads' path, its name among breadcrumbs.
HOSTS = ("bbs.hupu.com", "m.hupu.com")
THREAD_PATH = r"^/(?:bbs/)?(\d+)(?:-\d+)?(?:\.html)?$"
SITE = "虎扑社区"
# End of fixed values.


def thread_id(url: Column) -> Column:
    """The thread's number, null for other addresses."""
    scheme, host = (F.regexp_extract(F.coalesce(url, F.lit("")), r"^(https?)://([^/?#:]+)(?::\d+)?([^?#]*)", i) for i in (1, 2))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(https?)://([^/?#:]+)(?::\d+)?([^?#]*)", 3)
    found = F.regexp_extract(path, THREAD_PATH, 1)
    return F.when((scheme != "") & F.lower(host).isin(*HOSTS) & (found != ""), found)


def _shown(flag: Column) -> Column:
    return F.coalesce(~F.lower(flag).isin("true", "1"), F.lit(True))


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url", site: str = SITE, order: Column | None = None) -> DataFrame:
    """A row per visible post with text, replies before highlights, in page order; posts seen before go. Pages are in the ``order`` given, else as they are read."""
    body = F.from_json(F.regexp_extract(F.col(html), SCRIPT, 1), SCHEMA)
    d = F.col("detail")
    none = F.array().cast(f"array<{POST}>")
    opened = pages.withColumn("page_seq", F.monotonically_increasing_id() if order is None else order).withColumn("detail", body["props"]["pageProps"]["detail"]).where(d.isNotNull())
    posts = F.concat(F.coalesce(d["replies"]["list"], none), F.coalesce(d["lights"], none))
    each = opened.select("page_seq", F.col(url).alias("source_url"), "detail", F.posexplode(posts).alias("pos", "p"))
    p = F.col("p")
    rows = each.where(_shown(p["isDelete"]) & _shown(p["isSelfDelete"]) & _shown(p["isHidden"])).withColumn("content", text.html_text(p["content"])).where("content != ''")
    author = F.coalesce(p["authorId"], p["puid"], p["pid"])
    found = rows.select(
        F.struct("page_seq", "pos").alias("place"),
        p["pid"].alias("id"),
        F.coalesce(d["thread"]["title"], F.lit("")).alias("topic"),
        "content",
        text.author_hash(author).alias("author_hash"),
        text.safe_int(p["allLightCount"]).cast("int").alias("like_count"),
        text.safe_int(p["replyNum"]).cast("int").alias("reply_count"),
        text.epoch_iso(p["createdAt"]).alias("publish_time"),
        "source_url",
        F.coalesce(d["thread"]["tid"], thread_id(F.col("source_url"))).alias("thread_id"),
        F.coalesce(d["thread"]["title"], F.lit("")).alias("thread_title"),
        F.substring(text.html_text(d["thread"]["content"]), 1, 500).alias("thread_excerpt"),
        text.html_images(d["thread"]["content"]).alias("thread_image_urls"),
        text.board(F.transform(d["breadCrumb"], lambda b: b["title"]), site).alias("board"),
        F.ceil(text.safe_int(d["replies"]["total"]) / F.greatest(F.lit(1), F.coalesce(text.safe_int(d["replies"]["size"]), F.lit(PAGE_SIZE)))).cast("int").alias("total_pages"),
    )
    names = [c for c in found.columns if c != "id"]
    first = found.groupBy("id").agg(F.min_by(F.struct(*names), "place").alias("r"))
    return first.select("id", *(F.col(f"r.{c}").alias(c) for c in names))


def capped(rows: DataFrame, most: int, n_threads: int) -> DataFrame:
    """An even share of each thread, ``most`` in all."""
    share = -(-most // max(1, n_threads))
    order = Window.partitionBy("thread_id").orderBy("place")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= share).drop("__n").orderBy("place").limit(most)
