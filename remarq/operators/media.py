"""Ranking of source images and the checks on what a vision service says of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sources and words that mark them as informative.
OFFICIAL_DOMAINS = ("nba.com", "fifa.com", "uefa.com", "the-afc.com", "thecfa.cn", "cbaleague.com")
AUTHORITY_TERMS = ("官方", "官网", "流言板", "裁判报告", "联盟公告", "球队公告", "数据统计", "技术统计")
REFERENCE_TERMS = ("官方", "官网", "裁判报告", "联盟公告")
INFORMATION_TERMS = ("数据", "统计", "正负值", "命中率", "投篮", "三分", "篮板", "助攻", "抢断", "盖帽", "失误", "比分", "效率", "轮换", "阵容", "伤病", "判罚", "裁判", "战术", "热区", "薪资")
OCR_TERMS = ("pts", "reb", "ast", "stl", "blk", "fg", "3pt", "score", "final", "injury", "out", "questionable", "referee", "official", "report", "得分", "篮板", "助攻", "抢断", "盖帽", "命中率", "伤病", "缺阵", "裁判", "报告")
AUTHORITY_RANK = {"official": 4, "official_reference": 3, "editorial": 2, "community_data": 1}
OFFICIAL_REASON, AUTHORITY_REASON, INFORMATION_REASON, MATCH_REASON = "官方体育域名", "权威来源信号：", "数据/赛事信号：", "匹配当前比赛或球队"
LOW_VALUE, NO_SIGNAL, NO_RELEVANCE = "图片信息量低", "OCR 未提供足够的可见数据或报告信号", "与当前比赛相关性不足"
RELEVANCE, LEVELS = ("high", "medium", "low", "unrelated"), ("high", "medium", "low")
# End of fixed values.
#: Fields of an answer about an image.
ANSWER = "url string, status string, summary string, ocr_text string, data_points array<string>, relevance string, information_value string, confidence string, model string, entities array<string>, image_count int, error string"


def _hits(body: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur, in order of spelling."""
    return F.array_sort(F.filter(F.array(*map(F.lit, terms)), lambda t: body.contains(t))) if terms else F.array().cast("array<string>")


def source_score(df: DataFrame, match_terms: tuple[str, ...] = (), information: tuple[str, ...] = INFORMATION_TERMS) -> DataFrame:
    """``information_score``, ``authority_level`` and ``selection_reasons`` from title, summary, source_url and source_kind."""
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce("source_url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    official = F.lit(False)
    for domain in OFFICIAL_DOMAINS:
        official = official | (host == domain) | host.endswith(f".{domain}")
    found, told, ours = _hits(body, AUTHORITY_TERMS), _hits(body, information), F.size(_hits(body, match_terms)) > 0
    score = F.when(official, 4).otherwise(0) + F.when(F.size(found) > 0, 3).otherwise(0) + F.least(F.lit(4), F.size(told)) + F.when(ours, 1).otherwise(0)
    level = F.when(official, "official").when(F.size(_hits(body, REFERENCE_TERMS)) > 0, "official_reference").when((F.col("source_kind") == "news") | body.contains("流言板"), "editorial").otherwise("community_data")
    reasons = F.array_compact(
        F.array(
            F.when(official, F.lit(OFFICIAL_REASON)),
            F.when(F.size(found) > 0, F.concat(F.lit(AUTHORITY_REASON), F.array_join(F.slice(found, 1, 3), "、"))),
            F.when(F.size(told) > 0, F.concat(F.lit(INFORMATION_REASON), F.array_join(F.slice(told, 1, 4), "、"))),
            F.when(ours, F.lit(MATCH_REASON)),
        )
    )
    return df.withColumns({"information_score": score, "authority_level": level, "selection_reasons": reasons})


def thread_candidates(df: DataFrame) -> DataFrame:
    """The first comment of each thread (by its id, else its url) if that has images: title (else topic), summary, url, images."""
    kinds = {"thread_id": "string", "thread_title": "string", "thread_excerpt": "string", "topic": "string", "source_url": "string", "thread_image_urls": "array<string>"}
    whole = df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})

    def given(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    keyed = whole.withColumn("key", F.coalesce(given("thread_id"), given("source_url"))).where("key is not null")
    first = keyed.groupBy("key").agg(F.min_by(F.struct("seq", F.coalesce(given("thread_title"), "topic", F.lit("")).alias("title"), "thread_excerpt", "source_url", "thread_image_urls"), "seq").alias("f"))
    images = informative_images(F.coalesce("f.thread_image_urls", F.array().cast("array<string>")))
    found = first.select(F.col("f.seq").alias("seq"), F.col("f.title").alias("title"), F.coalesce("f.thread_excerpt", F.lit("")).alias("summary"), F.coalesce("f.source_url", F.lit("")).alias("source_url"), images.alias("image_urls"), F.lit("thread").alias("source_kind"))
    return found.where(F.size("image_urls") > 0)


def news_candidates(items: DataFrame) -> DataFrame:
    """Context items that were read and have images."""
    usable = items.where(F.col("status") != "error").withColumn("image_urls", informative_images(F.coalesce("image_urls", F.array().cast("array<string>"))))
    return usable.where(F.size("image_urls") > 0).select("seq", "title", "summary", "source_url", "image_urls", F.lit("news").alias("source_kind"))


def informative_images(urls: Column, most: int = 4) -> Column:
    """Images by hints in their address, then length; those without hints only if no other, and then one."""
    own = F.array_distinct(F.filter(urls, lambda u: u.rlike("^https?://") & ~F.lower(u).contains(".gif")))
    rated = F.transform(own, lambda u: F.struct((F.when(F.lower(u).contains(".png"), 3).otherwise(0) + F.when(F.lower(u).contains("news-editor"), 2).otherwise(0)).alias("hint"), F.length(u).alias("size"), u.alias("url")))
    ordered = F.array_sort(rated, lambda a, b: F.when(a["hint"] != b["hint"], b["hint"] - a["hint"]).when(a["size"] != b["size"], b["size"] - a["size"]).otherwise(0))
    hinted = F.filter(ordered, lambda r: r["hint"] > 0)
    return F.transform(F.when(F.size(hinted) > 0, F.slice(hinted, 1, most)).otherwise(F.slice(ordered, 1, 1)), lambda r: r["url"])


def _of_run(task: str | None) -> list[str]:
    return [] if task is None else [task]


def ranked_sources(candidates: DataFrame, least: int = 2, task: str | None = None) -> DataFrame:
    """Candidates worth looking at with their ``rank``: authority, then score, then place. Sources of a run are few (threads and articles, not comments); with a
    ``task`` column those of many runs are ranked side by side, each run in its own window."""
    level = F.create_map(*(F.lit(x) for kv in AUTHORITY_RANK.items() for x in kv))[F.col("authority_level")]
    order = Window.partitionBy(*_of_run(task)).orderBy(F.desc(level), F.desc("information_score"), F.col("source_kind") == "news", "seq")
    return candidates.where(F.col("information_score") >= least).withColumn("rank", F.row_number().over(order))


def budgeted_images(ranked: DataFrame, budget: int, enabled: bool = True, task: str | None = None) -> DataFrame:
    """A row per distinct image in rank order, with its source; beyond the budget its status is ``skipped_limit``, without analysis ``disabled``. With a ``task`` column
    every run has its own images and budget."""
    run = _of_run(task)
    each = ranked.select(*run, "rank", "title", "source_url", "source_kind", "authority_level", "information_score", *(["selection_reasons"] if "selection_reasons" in ranked.columns else []), F.posexplode(informative_images(F.col("image_urls"))).alias("pos", "url"))
    rest = [c for c in each.columns if c not in ("url", "rank", "pos", *run)]
    first = each.groupBy(*run, "url").agg(F.min(F.struct("rank", "pos")).alias("place"), F.min_by(F.struct(*rest), F.struct("rank", "pos")).alias("source")).select(*run, "url", "place.*", "source.*")
    place = F.row_number().over(Window.partitionBy(*run).orderBy("rank", "pos"))
    return first.withColumn("status", F.when(place <= budget, "selected").otherwise("skipped_limit") if enabled else F.lit("disabled"))


def answer(url: str, reply: dict, model: str = "") -> dict:
    """A service's reply about an image in bounded, known values."""

    def text(value, most: int) -> str:
        return ("；".join(str(x).strip() for x in value if str(x).strip()) if isinstance(value, list) else str(value or "").strip())[:most]

    def choice(name: str, allowed: tuple[str, ...], fallback: str) -> str:
        value = str(reply.get(name) or "").strip().lower()
        return value if value in allowed else fallback

    points = reply.get("data_points") or []
    points = [text(p, 500) for p in (points if isinstance(points, list) else [points])]
    named = reply.get("entities") or []
    entities = [text(e, 500) for e in (named if isinstance(named, list) else [named])]
    return {
        "url": url, "status": "completed", "summary": text(reply.get("summary"), 800), "ocr_text": text(reply.get("ocr_text"), 500), "data_points": [p for p in points if p][:16], "entities": [e for e in entities if e][:12], "image_count": 1,
        "relevance": choice("relevance", RELEVANCE, "medium"), "information_value": choice("information_value", LEVELS, "low"), "confidence": choice("confidence", LEVELS, "low"), "model": model,
    }


def passing(fault: Exception) -> bool:
    """Whether a service's fault may pass by itself: transport, too many requests, or the server's own; a status is looked for on the fault and on its response."""
    status = next((v for of in (fault, getattr(fault, "response", None)) for v in (getattr(of, "status_code", None), getattr(of, "code", None)) if isinstance(v, int)), None)
    return status == 429 or status >= 500 if status is not None else isinstance(fault, OSError)


def analysed(images: DataFrame, service: Callable[[dict], dict] | None, model: str = "", tries: int = 2) -> list[dict]:
    """An answer for each selected image. The service takes a source with one image; it is called on the driver, for each of a bounded number
    of images once, or up to ``tries`` times while its fault is one that passes (connections and time-outs are OSErrors); its failures are answers too."""
    out = []
    for row in images.where("status = 'selected'").orderBy("rank", "pos").collect():
        if service is None:
            out.append({"url": row["url"], "status": "skipped_missing_key", "model": model})
            continue
        for attempt in range(tries):
            try:
                out.append(answer(row["url"], service({**row.asDict(recursive=True), "image_urls": [row["url"]]}), model))
                break
            except Exception as fault:  # noqa: BLE001  whatever the service throws
                if attempt == tries - 1 or not passing(fault):
                    out.append({"url": row["url"], "status": "error", "model": model, "image_count": 1, "error": str(fault)[:300]})
                    break
    return out


def with_answers(images: DataFrame, answers: list[dict]) -> DataFrame:
    """The images with what the service said of them, whether they count and, if analysed in vain, why not."""
    said = images.sparkSession.createDataFrame([tuple(a.get(c.split()[0]) for c in ANSWER.split(", ")) for a in answers], ANSWER)
    met = images.withColumnRenamed("status", "planned").join(F.broadcast(said), "url", "left")
    return included(met.withColumn("status", F.coalesce("status", "planned")).drop("planned"))


def ocr_informative(ocr: Column) -> Column:
    """Text in an image that says something: no live scoreboard, and two numbers or a telling word."""
    body = F.trim(F.coalesce(ocr, F.lit("")))
    low = F.lower(body)
    period = low.rlike(r"\b(?:1st|2nd|3rd|4th|q[1-4])\b") | body.rlike("第[一二三四1-4]节")
    clock = body.rlike(r"\b\d{1,2}:\d{2}\b")
    numbers = F.size(F.regexp_extract_all(body, F.lit(r"(\d+(?:\.\d+)?)"), 1))
    return (F.length(body) >= 6) & ~(period & clock) & ((numbers >= 2) | (F.size(_hits(low, OCR_TERMS)) > 0))


def included(df: DataFrame) -> DataFrame:
    """``included_in_summary`` of analysed images, and ``exclusion_reason``."""
    good, done, told = ("high", "medium"), F.col("status") == "completed", ocr_informative(F.col("ocr_text"))
    counts = F.coalesce(done & F.col("relevance").isin(*good) & F.col("information_value").isin(*good) & told, F.lit(False))
    why = F.when(done & ~counts, F.when(F.col("information_value") == "low", LOW_VALUE).when(~told, NO_SIGNAL).otherwise(NO_RELEVANCE)).otherwise("")
    return df.withColumns({"included_in_summary": counts, "exclusion_reason": F.coalesce(why, F.lit(""))})


def evidence_view(df: DataFrame, most: int = 8) -> DataFrame:
    """What prompts and reports show of the images that count."""
    chosen = df.where("included_in_summary").orderBy("rank", "pos").limit(most)
    return chosen.select("source_kind", "title", "source_url", "authority_level", "selection_reasons", F.col("summary").alias("visual_summary"), "ocr_text", "data_points", "relevance", "information_value", "confidence", "model", F.array("url").alias("image_urls"))
