"""Stored threads as a data source: lazily, by share, by filter, as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from remarq.sources import paged, router, threads
from remarq.storage import fresh_folder

PER_PAGE = 3


def page(thread, number, total, hidden=()):
    posts = [{"pid": f"{thread}-{i}", "authorId": "a", "content": f"post {i} of {thread}" if i % 5 else "<p>&nbsp;</p>", "isDelete": i in hidden} for i in range((number - 1) * PER_PAGE, min(total, number * PER_PAGE))]
    detail = {"thread": {"tid": str(thread), "title": f"t{thread}"}, "replies": {"total": total, "size": PER_PAGE, "list": posts}}
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"detail": detail}}})}</script></html>'


def url(thread):
    return f"https://{threads.HOSTS[0]}/{thread}.html"


def stored_pages(spark, sizes, **more):
    rows = [(str(t), n, url(t), page(t, n, total)) for t, total in sizes.items() for n in range(1, -(-total // PER_PAGE) + 3)]  # two pages beyond the last that each states
    return paged.write_pages(spark.createDataFrame(rows, paged.SCHEMA).repartition(5), **more)


def read(df):
    return sorted((r.thread_id, r.page) for r in df.collect())


def test_pages_are_read_to_the_share_and_the_stated_total(spark):
    manifest = stored_pages(spark, {1: 10, 2: 2, 3: 30})
    assert read(paged.stored_threads(spark, manifest)) == [("1", n) for n in range(1, 5)] + [("2", 1)] + [("3", n) for n in range(1, 11)]
    # post 0, 5, ... have no text: four posts of a thread lie on its first two pages
    assert read(paged.stored_threads(spark, manifest, share=4)) == [("1", 1), ("1", 2), ("2", 1), ("3", 1), ("3", 2)]
    for share in (1, 4, 9):
        every = threads.capped(threads.parse_pages(paged.stored_threads(spark, manifest), order=F.struct("thread_id", "page")), 1000, 1000 // share)
        some = threads.capped(threads.parse_pages(paged.stored_threads(spark, manifest, share=-(-1000 // (1000 // share))), order=F.struct("thread_id", "page")), 1000, 1000 // share)
        assert {r.id for r in some.collect()} == {r.id for r in every.collect()}


def test_filters_reach_the_reader(spark):
    manifest = stored_pages(spark, {1: 10, 2: 2, 3: 30}, bundles=1)
    found = paged.stored_threads(spark, manifest).where("thread_id in ('3', '2') and page <= 2 and url is not null")
    assert read(found) == [("2", 1), ("3", 1), ("3", 2)]
    wanted = paged._Wanted()
    assert [wanted.take(f) for f in (paged.EqualTo(("thread_id",), "3"), paged.LessThan(("page",), 3), paged.EqualTo(("url",), "x"))] == [True, True, False]
    part = paged._Bundle(paged._manifest(manifest)[0], wanted.threads, wanted.last)
    assert [x[:2] for x in paged.read_bundle(part)] == [("3", 1), ("3", 2)]


def test_a_run_reads_its_threads_by_share(spark):
    manifest = stored_pages(spark, {7: 40, 8: 5, 9: 12})
    plan = router.plans("hupu_public", ["p"], 12, {"manifest": manifest, "urls": [url(9), url(7), url(9)]})
    rows = router.collect(spark, plan).orderBy("seq").collect()
    assert [r.id for r in rows] == [f"9-{i}" for i in range(12) if i % 5][:6] + [f"7-{i}" for i in range(12) if i % 5][:6]


def test_a_stream_resumes_where_it_stopped(spark, tmp_path):
    folder = fresh_folder(spark, "stream")
    manifest = stored_pages(spark, {1: 4}, folder=folder, bundles=2)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def step():
        q = paged.streamed_threads(spark, manifest).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return read(spark.read.parquet(out))

    assert step() == [("1", 1), ("1", 2)]
    stored_pages(spark, {2: 7}, folder=folder, bundles=2)
    assert step() == [("1", 1), ("1", 2), ("2", 1), ("2", 2), ("2", 3)]
    assert step() == [("1", 1), ("1", 2), ("2", 1), ("2", 2), ("2", 3)]


@pytest.mark.parametrize("html", ["", "<html>", '<script id="__NEXT_DATA__">{"props": 3}</script>', '<script id="__NEXT_DATA__">[</script>'])
def test_pages_without_posts(html):
    assert paged.visible_posts(html) == (set(), None)
