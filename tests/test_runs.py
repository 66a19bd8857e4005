import json

import pytest
from pyspark.sql import functions as F

from remarq.operators import cards, media
from remarq.plans import insight, pipeline, queries, sinks
from remarq.plans.config import AnalysisConfig
from remarq.sources import articles, files, router, synthetic, threads
from remarq.streaming import trend


def card_rows(spark, n=120, hits=18):
    rows = [(i, str(i), f"text {i}", f"text {i}", "", i, False, ("裁判判罚争议", 0.8, "") if i < hits else None, None) for i in range(n)]
    label = "struct<category:string,confidence:double,reason:string>"
    return spark.createDataFrame(rows, f"seq long, id string, content string, cleaned_content string, source_url string, like_count long, is_duplicate boolean, painpoint {label}, positive_attribution {label}")


def test_evidence_card(spark):
    (card,) = cards.cards(card_rows(spark)).collect()
    assert (card.evidence_count, card.sample_size, card.affected_ratio, card.confidence) == (18, 120, 0.15, "high")
    assert card.evidence_comment_ids == ["17", "16", "15"] and card.title == "用事实拆解「裁判判罚争议」争议"
    assert card.confidence_reason == "证据 18 条，占 120 条样本的 15.0%，覆盖稳定。"
    assert cards.cards(card_rows(spark, 1, 1)).count() == 0
    assert json.loads(cards.exported(cards.cards(card_rows(spark))).first().json)["card_type"] == cards.RISK
    assert cards.drafts(cards.cards(card_rows(spark))).first().primary_metric == cards.DESIGN["primary_metric"]


def test_csv_and_json_files(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text("﻿comment_id,comment_text,likes,url\n1,first,7,http://x\n,second,,\n", encoding="utf-8")
    rows = [{"comment_id": "1", "comment_text": "first", "likes": 7, "url": "http://x"}, {"comment_id": None, "comment_text": "second"}]
    (tmp_path / "b.json").write_text(json.dumps({"total": 2, "items": rows}))
    (tmp_path / "c.json").write_text(json.dumps(rows))
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for path in ("a.csv", "b.json", "c.json", "d.jsonl"):
        got = files.comments_from_file(spark, str(tmp_path / path)).orderBy("seq").collect()
        assert [(r.content, r.like_count) for r in got] == [("first", 7), ("second", 0)], path
        assert got[0].id == "1" and got[1].id.startswith("upload-") and len(got[1].id) == 23
    seen = files.inspect(spark, str(csv))
    assert seen.status == "ready" and seen.n_rows == 2 and seen.mapping["content"] == "comment_text"
    mapped = files.comments_from_file(spark, str(csv), mapping={"content": "url"}).orderBy("seq").collect()
    assert [r.content for r in mapped] == ["http://x", ""]
    assert files.mapping_errors({}, ["a"]) and files.with_mapping({}, {"content": "a", "odd": "a"}, ["a"]) == ({"content": "a"}, "ready")
    with pytest.raises(ValueError):
        files.read_rows(spark, "x.xls")


def thread_page():
    post = {"pid": 5, "authorId": 9, "content": "<p>great <b>game</b></p>", "allLightCount": 42, "replyNum": 3, "createdAt": 1700000000000}
    hidden, blank = post | {"pid": 6, "isDelete": True}, post | {"pid": 7, "content": "<p> </p>"}
    detail = {"breadCrumb": [{"title": threads.SITE}, {"title": "board"}, {"title": "thread"}], "thread": {"tid": 77, "title": "a title", "content": '<p>see <img src="https://i/x.png"></p>'}, "replies": {"total": 30, "size": 20, "list": [post, hidden, blank]}, "lights": [post]}
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"detail": detail}}})}</script></html>'


def test_thread_page(spark):
    pages = spark.createDataFrame([(thread_page(), "https://bbs.hupu.com/77.html"), ("<html></html>", "u"), (None, None)], "html string, url string")
    (row,) = threads.parse_pages(pages).collect()
    assert (row.id, row.content, row.like_count, row.thread_id, row.board, row.total_pages) == ("5", "great game", 42, "77", "board", 2)
    assert row.thread_image_urls == ["https://i/x.png"] and row.publish_time.startswith("2023-11-14T22:13:20")
    ids = spark.createDataFrame([("https://bbs.hupu.com/123.html",), ("https://other.com/123.html",), ("ftp://bbs.hupu.com/1.html",)], "u string").select(threads.thread_id(F.col("u")).alias("t")).collect()
    assert [r.t for r in ids] == ["123", None, None]


def test_titles_as_written(spark, tmp_path):
    """What the operator decodes, the query compares with SQL as the page has it, ampersands aside."""
    given = ["<html>\n<head>\n <title>a &amp; b &quot;c&quot; d&amp</title></head>", "<title>x</title><svg><title>y</title></svg>", "<p>none</p>", None]
    pages = spark.createDataFrame([(i, f"https://a.com/{i}", h) for i, h in enumerate(given)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.url[-1]: r.title for r in queries.article_fields(spark, str(tmp_path)).collect()}
    assert got == {"0": "a & b &quot;c&quot; d&amp", "1": "x", "2": "", "3": None}
    assert {r.title for r in articles.articles(pages).collect()} == {'a & b "c" d&', "x", ""}


def test_articles(spark):
    html = '<html><head><title>T</title><meta property="og:title" content="Real title"><meta name="description" content="In short."><meta property="og:image" content="/a.png"></head><body><article><p>A paragraph with more than twenty-four characters.</p><p>short</p><img src="/b.png"><img src="/c.gif"></article></body></html>'
    pages = spark.createDataFrame([("https://news.example.com/x", html), ("http://127.0.0.1/x", html)], "url string, html string")
    got = {r.url: r for r in articles.articles(pages).collect()}
    good = got["https://news.example.com/x"]
    assert good.title == "Real title" and good.summary.startswith("In short.") and good.image_urls == ["https://news.example.com/a.png", "https://news.example.com/b.png"]
    assert got["http://127.0.0.1/x"].status == "error"
    assert [articles.public_url(u) for u in ("https://a.com", "http://localhost/x", "http://10.0.0.1", "file:///x", "http://8.8.8.8/")] == [True, False, False, False, True]
    assert articles.manual(spark, " note ").first().summary == "note"


def test_media_ranking(spark):
    rows = [(1, "官方 数据统计", "", "https://www.nba.com/x", "news", ["http://i/a.png", "http://i/b.jpg", "http://i/c.gif"]), (2, "无关", "", "https://x.com", "thread", ["http://i/d.jpg"]), (3, "比分 数据", "", "https://x.com", "thread", ["http://i/longer.jpg", "http://i/e.jpg"])]
    df = spark.createDataFrame(rows, "seq long, title string, summary string, source_url string, source_kind string, image_urls array<string>")
    ranked = media.ranked_sources(media.source_score(df))
    assert [(r.seq, r.authority_level, r.information_score) for r in ranked.orderBy("rank").collect()] == [(1, "official", 9), (3, "community_data", 2)]
    images = media.budgeted_images(ranked, 1)
    assert {r.url: r.status for r in images.collect()} == {"http://i/a.png": "selected", "http://i/longer.jpg": "skipped_limit"}
    ocr = spark.createDataFrame([("PTS 30 REB 11",), ("Q4 02:13 LAL 99",), ("hello world",), ("final report",), (None,)], "t string")
    assert [r.x for r in ocr.select(media.ocr_informative(F.col("t")).alias("x")).collect()] == [True, False, False, True, False]


def facts(said, **more):
    return {"match_name": "红队 vs 蓝队", "home_team": "蓝队", "away_team": "红队", "news": [{"status": "provided", "summary": said}], "clusters": [{"cluster_name": "篮板｜防守｜负向", "is_noise": False}], **more}


def test_outcome_guard():
    known = facts("红队客场 105-95 击败蓝队，系列赛领先。")
    assert insight.outcome(known) == ("红队", "蓝队")
    assert insight.outcome(facts("红队终场前击败强大的蓝队")) is None  # the loser must follow the verb
    assert insight.outcome(facts("红队赢了。随后击败蓝队")) is None  # a new sentence
    assert insight.outcome(facts("红队，主场作战，力克蓝队")) == ("红队", "蓝队")
    assert insight.outcome({**known, "home_team": ""}) is None
    assert insight.outcome({**known, "news": [{"status": "error", "summary": "红队击败蓝队"}]}) is None
    report = insight.empty() | {"summary": "部分球迷对红队的失利表示不满。", "negative_insights": ["红队失利源于进攻问题", "红队很好，对手落败"], "risks": ["蓝队最终取胜"], "fact_opinion_gaps": ["a"]}
    out = insight.guarded(report, known)
    assert "失利" not in out["summary"] and "篮板" in out["summary"] and "负向" not in out["summary"]
    assert out["negative_insights"] == ["红队很好，对手落败"] and out["risks"] == []  # a comma begins another clause
    assert out["fact_opinion_gaps"] == ["a", insight.GUARD_NOTE]
    assert insight.guarded(report, facts("没有结果")) == report


def test_insight_of_a_service():
    plain = insight.insight(facts("x", painpoints=[{"category": "p"}], positives=[{"category": "q"}]))
    assert set(plain) == {*insight.TEXTS, *insight.LISTS} and "「q」" in plain["summary"] and plain["key_viewpoints"] == ["篮板｜防守｜负向"]
    assert plain["news_context_summary"] == insight.NEWS.format(n=1)
    assert insight.insight({})["news_context_summary"] == insight.NO_NEWS

    def broken(_):
        raise RuntimeError("down")

    failed = insight.insight({}, broken, name="s")
    assert failed["summary"] == insight.FAILED_SUMMARY.format(service="s", error="down") and failed["risks"] == [insight.FAILED_RISK.format(service="s")]
    assert insight.insight({}, enabled=False)["summary"] == insight.DISABLED
    asked = []
    reply = 'Here: {"summary": {"a": 1, "b": ""}, "risks": "one", "key_viewpoints": [{"x": ["y", "z"]}, ""], "positive_insights": {"k": "v"}} done'
    out = insight.insight(facts("x", representatives=[{"i": i} for i in range(20)]), lambda p: asked.append(p) or reply)
    assert out["summary"] == "a：1" and out["risks"] == ["one"] and out["key_viewpoints"] == ["x：y；z"] and out["positive_insights"] == ["k：v"] and out["controversies"] == []
    assert '{"i": 11}' in asked[0] and '{"i": 12}' not in asked[0]
    assert insight.insight({}, lambda p: "no object")["summary"].startswith("LLM provider")


def test_config():
    c = AnalysisConfig.from_dict({"domain": "nope", "keywords": "a， b,a\nc d", "max_images": 99, "dedup_threshold": 0.0, "enable_images": False})
    assert (c.domain, c.keywords, c.max_images, c.dedup_threshold, c.enable_images) == ("basketball", ("a", "b", "c d"), 20, 0.86, False)
    assert (c.max_comments, AnalysisConfig().max_images, c.board, c.data_source) == (120, 6, "nba", "mock")
    for bad in ({"max_comments": 0}, {"domain": "x"}, {"data_source": "x"}, {"mode": "x"}, {"max_images": 21}, {"dedup_threshold": 2.0}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad)
    assert [(p.platform, p.most) for p in router.plans("mock", ["a", "b"], 9, {})] == [("a", 4), ("b", 4)]
    assert [(p.source, p.platform, p.most) for p in router.plans("mediacrawler", ["a", "b"], 9, {})] == [("mediacrawler", "a", 9)]
    assert router.plans("unheard of", ["a"], 9, {})[0].source == "mock" and router.plans("csv", [], 9, {})[0].platform == "sample"


def test_threads_share_the_limit(spark):
    post = {"pid": 5, "authorId": 9, "content": "text", "allLightCount": 1, "replyNum": 0, "createdAt": 1}
    rows = []
    for t in (1, 2):
        detail = {"thread": {"tid": t, "title": f"t{t}", "content": ""}, "replies": {"total": 9, "size": 20, "list": [post | {"pid": 10 * t + i} for i in range(9)]}, "lights": []}
        rows.append((f'<script id="__NEXT_DATA__">{json.dumps({"props": {"pageProps": {"detail": detail}}})}</script>', f"https://bbs.hupu.com/{t}.html"))
    pages = spark.createDataFrame(rows, "html string, url string")
    found = router.collect(spark, router.plans("hupu_public", ["hupu"], 5, {"pages": pages, "urls": ["u1", "u2", "u1"]})).collect()
    assert sorted(r.thread_id for r in found) in (["1", "1", "1", "2", "2"], ["1", "1", "2", "2", "2"])
    with pytest.raises(ValueError):
        router.collect(spark, router.plans("hupu_public", ["hupu"], 5, {}))


def test_failed_addresses_are_rows(spark):
    def fetch(url):
        if url.endswith("bad"):
            raise OSError("gone")
        return "<title>T</title>"

    got = [(r.source_url, r.status, r.title) for r in articles.context(spark, " note ", ["https://a.com/bad", "https://a.com/x", "http://127.0.0.1/"], fetch).orderBy("seq").collect()]
    assert got == [("", "provided", articles.MANUAL_TITLE), ("https://a.com/bad", "error", articles.FAILED_TITLE), ("https://a.com/x", "fetched", "T"), ("http://127.0.0.1/", "error", articles.FAILED_TITLE)]
    assert articles.context(spark, "", []).count() == 0


def test_images_of_a_run(spark):
    raw = spark.createDataFrame([(i, f"t{i}", "官方 数据 统计 " + str(i), "", "https://x.com", ["http://i/%d.png" % i, "http://i/gone.png"]) for i in range(3)] + [(9, "low", "无关", "", "", ["http://i/9.png"])], "seq long, thread_id string, thread_title string, thread_excerpt string, source_url string, thread_image_urls array<string>")
    news = spark.createDataFrame([], "seq long, title string, summary string, source_url string, image_urls array<string>, status string")
    replies = {"http://i/0.png": {"relevance": "HIGH", "information_value": "high", "ocr_text": "PTS 30 REB 11", "data_points": "x"}, "http://i/1.png": {"relevance": "high", "information_value": "odd", "ocr_text": "PTS 30"}}
    calls = []

    def vision(source):
        calls.append(source["image_urls"])
        if source["image_urls"][0] not in replies:
            raise ConnectionError("gone")
        return replies[source["image_urls"][0]]

    got = {r.url: r for r in pipeline.images(raw, news, AnalysisConfig(max_images=3), vision).collect()}
    assert got["http://i/0.png"].included_in_summary and got["http://i/0.png"].data_points == ["x"]
    assert got["http://i/gone.png"].status == "error" and calls.count(["http://i/gone.png"]) == 2
    assert got["http://i/1.png"].exclusion_reason == media.LOW_VALUE and got["http://i/2.png"].status == "skipped_limit" and "http://i/9.png" not in got
    assert {r.status for r in pipeline.images(raw, news, AnalysisConfig(enable_images=False), vision).collect()} == {"disabled"}
    assert {r.status for r in pipeline.images(raw, news, AnalysisConfig(max_images=2), None).collect()} == {"skipped_missing_key", "skipped_limit"}


def test_a_whole_run_twice(spark, tmp_path):
    config = AnalysisConfig(name="demo", dedup_threshold=0.92, max_comments=30, match_name="马刺 vs 尼克斯 G6", home_team="马刺", away_team="尼克斯", news_context="马刺在系列赛中暂时 3-2 领先，本场为第六场。")
    seen = []
    result = pipeline.run_pipeline(spark, config, progress=lambda steps: seen.append({k: v["status"] for k, v in steps.items()}))
    quality = result.quality.first()
    assert quality.raw_count >= 12 and quality.dedup_count >= 6 and result.news.count() == 1
    assert result.insight["summary"] and result.insight["fact_opinion_gaps"]
    sizes = {r.cluster_id: r.cluster_size for r in result.clusters.collect()}
    assert sum(sizes.values()) == quality.dedup_count and quality.noise_ratio == round(sizes.get(-1, 0) / quality.dedup_count, 4)
    assert seen[-1] == {k: "completed" for k in ("crawl", "context", "media", "clean", "dedup", "cluster", "quality", "sample", "insight")}
    assert result.steps["crawl"]["output_summary"] == "raw_comments=16" and result.steps["dedup"]["duration_ms"] >= 1
    report = sinks.markdown(result)
    for line in ("# demo", "- 运动：篮球", "- 原始评论：16", "## 新闻背景", sinks.NO_IMAGES, "## 解读风险", "- 关键词：", "## 证据支撑的策略卡", sinks.CLOSING[1]):
        assert line in report, line
    charts = pipeline.visualizations(result)
    assert len(charts) == 11 and sum(r["n"] for r in charts["sentiment_distribution"].collect()) == quality.dedup_count
    for task in ("a", "b", "a"):
        sinks.persist(result, str(tmp_path), task)
    stored = spark.read.parquet(f"{tmp_path}/comments").groupBy("task_id").count().collect()
    assert {r.task_id: r["count"] for r in stored} == {"a": quality.clean_count, "b": quality.clean_count}
    sinks.single_csv(synthetic.demo(spark, count=3), f"file://{tmp_path}/demo.csv")
    assert open(f"{tmp_path}/demo.csv", "rb").read().startswith(b"\xef\xbb\xbfid,platform")
    assert [r.id for r in files.comments_from_file(spark, f"{tmp_path}/demo.csv").orderBy("seq").collect()] == ["nba_game-0001", "nba_game-0002", "nba_game-0003"]


def test_streaming_trend_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = trend.trend(stream).writeStream.outputMode("complete").format("memory").queryName("trend").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, trend.trend(rows).collect()))
    assert sorted(map(tuple, spark.sql("select * from trend").collect())) == want and len(want) > 10


def test_only_passing_faults_are_tried_again(spark):
    images = spark.createDataFrame([(1, 0, f"http://i/{k}.png", "selected") for k in ("too-many", "down", "lost", "refused", "broken", "good")], "rank int, pos int, url string, status string")
    calls = []

    class Refused(Exception):
        def __init__(self, code):
            super().__init__(f"status {code}")
            self.response = type("R", (), {"status_code": code})()

    def service(source):
        (url,) = source["image_urls"]
        kind = url.split("/")[-1].removesuffix(".png")
        calls.append(kind)
        if kind == "good":
            return {"summary": "s", "entities": ["红队", " ", "蓝队"], "data_points": "5"}
        if kind == "down" and calls.count("down") == 2:
            return {}
        raise {"too-many": Refused(429), "down": Refused(503), "refused": Refused(403), "lost": ConnectionError("lost"), "broken": ValueError("x" * 400)}[kind]

    got = {a["url"].split("/")[-1].removesuffix(".png"): a for a in media.analysed(images, service)}
    assert {k: calls.count(k) for k in got} == {"too-many": 2, "down": 2, "lost": 2, "refused": 1, "broken": 1, "good": 1}
    assert {k: a["status"] for k, a in got.items()} == {"too-many": "error", "down": "completed", "lost": "error", "refused": "error", "broken": "error", "good": "completed"}
    assert got["good"]["entities"] == ["红队", "蓝队"] and got["good"]["image_count"] == 1 and len(got["broken"]["error"]) == 300
    rows = {r.url: r for r in media.with_answers(images, list(got.values())).collect()}
    assert rows["http://i/good.png"].entities == ["红队", "蓝队"] and rows["http://i/refused.png"].error == "status 403"


def test_a_run_counts_as_a_whole(spark, tmp_path):
    """A run that fails at its seventh table leaves the former one; pointers name what counts."""
    folder = f"file://{tmp_path}/runs"

    def run(n, fail=None):
        frames = {name: spark.range(n).withColumn("name", F.lit(name)) for name in sinks.TABLES}
        if fail:
            frames[fail] = frames[fail].withColumn("id", F.raise_error(F.lit("killed")))
        return type("Run", (), frames)()

    with pytest.raises(ValueError):
        sinks.committed(spark, folder, "raw")
    first = sinks.commit(run(3), folder, "a/1")
    sinks.commit(run(5), folder, "b")
    with pytest.raises(Exception, match="killed"):
        sinks.commit(run(9, sinks.TABLES[6]), folder, "a/1")
    assert sinks.versions(folder)["a/1"] == first
    for name in sinks.TABLES:
        assert {(r.task_id, r["count"]) for r in sinks.committed(spark, folder, name).groupBy("task_id").count().collect()} == {("a/1", 3), ("b", 5)}
    again = sinks.commit(run(4), folder, "a/1")
    assert sinks.versions(folder)["a/1"] == again != first
    assert sinks.committed(spark, folder, "cards").where("task_id = 'a/1'").count() == 4
    assert sinks.without_others(folder, "a/1") == 2 and sinks.committed(spark, folder, "cards").count() == 9
