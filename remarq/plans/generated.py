"""Queries with the packaged lists and the sources, over rows generated from the driver's tables by arithmetic, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicon import SENTIMENT, TAXONOMIES
from ..operators import aggregates, cards, clusters, comments, dedup, media, tokens
from ..sources import articles, files, order, paged, synthetic, threads, variant
from ..storage import fresh_folder, spread, stored
from . import insight, pipeline
from .chain import Chain, listed, quoted
from .queries import _table, card_rows, leaders_sql, query, summary_rows, with_low_tokens

LINES = synthetic.SENTENCES["basketball"] + synthetic.SENTENCES["football"]


def _terms(domain: str) -> list[str]:
    labels = TAXONOMIES[domain].labels
    return list(dict.fromkeys([t for t, _ in SENTIMENT.terms] + [t for kind in labels.values() for terms in kind.values() for t in terms]))


def _pick(items: list[str], place: str) -> str:
    """Spark SQL: the item at a place, counted round."""
    return f"element_at(array({', '.join(map(quoted, items))}), cast(pmod({place}, {len(items)}) + 1 as int))"


def _pick_sql(items: list[str], place: str) -> str:
    return f"({listed(items)})[CAST(({place}) % {len(items)} + 1 AS INTEGER)]"


def _content(pick, terms: list[str], div: str) -> str:
    a, b, c = pick(LINES, "doc_id * 7"), pick(terms, f"doc_id * 13 + (doc_id {div} 5)"), pick(terms, "doc_id * 29 + 3")
    return f"CASE doc_id % 4 WHEN 0 THEN concat({a}, {b}) WHEN 1 THEN concat({b}, '，', {c}) WHEN 2 THEN {a} ELSE concat({b}, {c}, {a}) END"


def comments_of(spark, sf_dir: str, domain: str) -> DataFrame:
    d = spread(_table(spark, sf_dir, "documents").select("doc_id"))
    return d.selectExpr("doc_id AS seq", "cast(doc_id as string) AS id", "concat('p', doc_id % 3) AS platform", f"{_content(_pick, _terms(domain), 'div')} AS content", "doc_id * 37 % 900 AS like_count", "'' AS source_url")


def _chain(domain: str) -> Chain:
    rows = f"SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS id, 'p' || (doc_id % 3) AS platform, {_content(_pick_sql, _terms(domain), '//')} AS content, doc_id * 37 % 900 AS like_count, '' AS source_url FROM documents"
    return Chain(rows, TAXONOMIES[domain], SENTIMENT)


BASKETBALL, FOOTBALL = _chain("basketball"), _chain("football")


def marked(spark, sf_dir: str, domain: str) -> DataFrame:
    return dedup.exact(stored(pipeline.analysed(comments.clean(comments_of(spark, sf_dir, domain)), domain), "analysed"))


def clustered(spark, sf_dir: str, domain: str) -> DataFrame:
    return stored(with_low_tokens(pipeline.with_clusters(marked(spark, sf_dir, domain))), "clustered")


# --- the packaged lists ------------------------------------------------------------------------


@query(BASKETBALL.labelled + " SELECT seq, round(score, 2) AS score, label, round(least(0.95, 0.55 + abs(score) * 0.4), 4) AS confidence FROM l")
def packaged_sentiment(spark, sf_dir):
    s = F.col("sentiment")
    rows = comments.sentiment(comments.clean(comments_of(spark, sf_dir, "basketball")))
    return rows.select("seq", F.round(s["score"], 2).alias("score"), s["label"].alias("label"), F.round(s["confidence"], 4).alias("confidence"))


_LABELS = " SELECT seq, pain, pain_sure, good, good_sure, stance, stance_sure FROM l"


def _labels(spark, sf_dir, domain):
    rows = comments.scored(comments.clean(comments_of(spark, sf_dir, domain)), domain=domain)
    names = {"pain": "painpoint", "good": "positive_attribution"}
    return rows.select("seq", *(F.col(f"{c}.{f}").alias(a) for n, c in names.items() for f, a in (("category", n), ("confidence", f"{n}_sure"))), F.col("stance.label").alias("stance"), F.col("stance.confidence").alias("stance_sure"))


@query(BASKETBALL.labelled + _LABELS)
def basketball_labels(spark, sf_dir):
    return _labels(spark, sf_dir, "basketball")


@query(FOOTBALL.labelled + _LABELS)
def football_labels(spark, sf_dir):
    return _labels(spark, sf_dir, "football")


_TOKENS = " SELECT seq, array_to_string(list_sort(keys), ',') AS keys, is_noise_row FROM n"


def _tokens(spark, sf_dir, domain):
    rows = with_low_tokens(pipeline.analysed(comments.clean(comments_of(spark, sf_dir, domain)), domain))
    return rows.select("seq", F.array_join(F.array_sort("tokens"), ",").alias("keys"), "is_noise_row")


@query(BASKETBALL.tokenized + _TOKENS)
def basketball_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir, "basketball")


@query(FOOTBALL.tokenized + _TOKENS)
def football_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir, "football")


@query(BASKETBALL.written)
def basketball_tokens_as_written(spark, sf_dir):
    rows = comments.clean(comments_of(spark, sf_dir, "basketball"))
    return rows.select("seq", F.array_join(tokens.tokens(F.col("cleaned_content"), TAXONOMIES["basketball"]), ",").alias("tokens"))


@query(BASKETBALL.summary)
def basketball_clusters(spark, sf_dir):
    return summary_rows(clusters.summary(clustered(spark, sf_dir, "basketball"), TAXONOMIES["basketball"]))


@query(FOOTBALL.summary)
def football_clusters(spark, sf_dir):
    return summary_rows(clusters.summary(clustered(spark, sf_dir, "football"), TAXONOMIES["football"]))


def _low_names(found: DataFrame) -> DataFrame:
    return stored(found.withColumn("cluster_name", F.lower("cluster_name")), "names")


def _cards(spark, sf_dir, domain):
    done = clustered(spark, sf_dir, domain)
    return cards.cards(done, _low_names(clusters.summary(done, TAXONOMIES[domain])))


@query(BASKETBALL.cards(True))
def basketball_cards(spark, sf_dir):
    return card_rows(_cards(spark, sf_dir, "basketball"))


@query(FOOTBALL.cards(True))
def football_cards(spark, sf_dir):
    return card_rows(_cards(spark, sf_dir, "football"))


@query(f"SELECT card_rank, title, hypothesis, {quoted(cards.DESIGN['control'])} AS control, {quoted(cards.DESIGN['variant'])} AS variant, {quoted(cards.DESIGN['primary_metric'])} AS primary_metric, {quoted('|'.join(cards.GUARDRAILS))} AS guardrails FROM ({BASKETBALL.cards(True)})")
def card_drafts(spark, sf_dir):
    found = cards.drafts(_cards(spark, sf_dir, "basketball"))
    return found.select("card_rank", "title", "hypothesis", "control", "variant", "primary_metric", F.array_join("guardrail_metrics", "|").alias("guardrails"))


@query(f"SELECT card_rank, title, ids, CAST(sample_size AS BIGINT) AS sample_size, affected_ratio, CAST(row_number() OVER (ORDER BY affected_ratio DESC, card_rank) AS INTEGER) AS place FROM ({BASKETBALL.cards(True)})")
def card_json(spark, sf_dir):
    """The cards in the order of their list, read back from their JSON."""
    found = cards.listed(_cards(spark, sf_dir, "basketball")).withColumn("place", F.row_number().over(aggregates.Window.orderBy(F.desc("affected_ratio"), "card_rank")))
    j = F.from_json("json", "card_rank int, title string, evidence_comment_ids array<string>, sample_size long, affected_ratio double, place int")
    return cards.exported(found).select(j.alias("j")).select("j.card_rank", "j.title", F.array_join("j.evidence_comment_ids", ",").alias("ids"), "j.sample_size", "j.affected_ratio", "j.place")


_CLOUDS = " UNION ALL ".join(f"SELECT '{c}' AS cloud, * FROM ({BASKETBALL.cloud(w)})" for c, w in (("all", "true"), ("positive", "(score > 0.1 OR label LIKE '%positive')"), ("negative", "(score < -0.1 OR label LIKE '%negative')")))


@query(_CLOUDS)
def word_clouds(spark, sf_dir):
    rows = stored(marked(spark, sf_dir, "basketball"), "deduped")
    return tokens.word_clouds(rows, TAXONOMIES["basketball"]).select("cloud", F.lower("word").alias("key"), "df", "weight")


@query(f"SELECT key, greatest(weight, 1.0) AS weight FROM ({BASKETBALL.cloud()}) WHERE length(key) BETWEEN 2 AND 12 ORDER BY weight DESC, key LIMIT 50")
def shown_words(spark, sf_dir):
    cloud = tokens.word_cloud(stored(marked(spark, sf_dir, "basketball"), "deduped"), TAXONOMIES["basketball"])
    return tokens.shown_words(cloud.withColumn("word", F.lower("word"))).select(F.col("word").alias("key"), "weight")


@query(
    BASKETBALL.labelled
    + f" SELECT {', '.join(f'replace({quoted(t)}, chr(37) || chr(100), CAST(count(*) FILTER ({w}) AS VARCHAR)) AS caption_{c}' for (c, t), w in zip(tokens.CAPTIONS.items(), ('true', 'score > 0.1', 'score < -0.1'), strict=True))} FROM l WHERE NOT is_duplicate"
)
def cloud_captions(spark, sf_dir):
    return tokens.captions(marked(spark, sf_dir, "basketball")).select("caption_all", "caption_positive", "caption_negative")


@query(BASKETBALL.clustered + " SELECT seq, cluster_key FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(like_count * 0.08 + abs(score) + least(1.0, length(cleaned_content) / 80.0::DOUBLE), 6) DESC, seq) AS rank FROM o) WHERE rank <= 3 ORDER BY seq LIMIT 36")
def drilldown_default(spark, sf_dir):
    done = clustered(spark, sf_dir, "basketball")
    chosen = clusters.representatives(done).select("seq", F.lit("representative").alias("representative_reason"))
    return aggregates.drill_down(done.join(F.broadcast(chosen), "seq", "left")).select("seq", "cluster_key")


@query(BASKETBALL.clustered + " SELECT count(*) AS dedup_count, round(avg(CASE WHEN cluster_id = -1 THEN 1.0 ELSE 0.0 END), 4) AS noise_ratio FROM o")
def run_quality(spark, sf_dir):
    """A run's quality report, whose noise share is the clusters'."""
    done = clustered(spark, sf_dir, "basketball")
    return aggregates.with_noise_ratio(aggregates.quality_report(_table(spark, sf_dir, "documents"), done), clusters.noise_ratio(done)).select("dedup_count", "noise_ratio")


@query(BASKETBALL.deduped + " SELECT count(*) AS raw_count, count(*) AS clean_count, count(*) FILTER (NOT is_duplicate) AS dedup_count, 0.0::DOUBLE AS noise_ratio FROM e")
def fallback_quality(spark, sf_dir):
    return aggregates.fallback_quality(marked(spark, sf_dir, "basketball")).select("raw_count", "clean_count", "dedup_count", "noise_ratio")


# --- reads -------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_custkey % 2 = 0) AS basketball, count(*) FILTER (o_custkey % 2 = 1) AS football FROM orders")
def dashboard(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return aggregates.dashboard(o.select(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued").alias("status"), F.when(F.col("o_custkey") % 2 == 0, "basketball").otherwise("football").alias("domain")))


@query("SELECT 'task7:' || doc_id AS id, CAST(doc_id AS VARCHAR) AS original_id, printf('%.1f%%', (doc_id % 1000) / 1000.0::DOUBLE * 100) AS share FROM documents")
def remapped_ids(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), text.percent(F.col("doc_id") % 1000 / 1000.0).alias("share"))
    return aggregates.remapped(d, "task7").select("id", "original_id", "share")


@query("SELECT bool_and(len(embedding) > 0) AS have_vectors, CASE WHEN bool_and(len(embedding) > 0) AND count(*) >= 12 THEN 'kmeans' ELSE 'rules' END AS method FROM embeddings")
def cluster_method(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    good = clusters.have_vectors(e)
    return spark.createDataFrame([(good, clusters.method_for(e.count(), good))], "have_vectors boolean, method string")


# --- sources -----------------------------------------------------------------------------------


_CLOCK = f"TIMESTAMP '{synthetic.DEMO_CLOCK:%Y-%m-%d %H:%M:%S}'"


def _times(minutes: str) -> str:
    return f"strftime({_CLOCK} - to_minutes(CAST({minutes} AS INTEGER)), '%Y-%m-%dT%H:%M:%S+00:00')"


@query(
    f"""SELECT i - 1 AS seq, 'mock-hupu-0-' || i AS id, 't' AS topic, {_pick_sql(synthetic.SENTENCES["football"], "i - 1")} AS content, substr(sha1('hupu-' || i), 1, 16) AS author_hash, CAST(8 + 7 * i AS INTEGER) AS like_count, CAST(i % 5 AS INTEGER) AS reply_count, {_times("11 * i")} AS publish_time,
  'https://example.com/hupu/mock-hupu-0-' || i AS source_url FROM range(1, 17) t(i)"""
)
def generated_comments(spark, sf_dir):
    found = synthetic.comments(spark, "football", 16, topic="t", now=synthetic.DEMO_CLOCK)
    return found.select("seq", "id", "topic", "content", "author_hash", "like_count", "reply_count", "publish_time", "source_url")


def _demo_sql(name: str, rows: str = "range(320) t(i)") -> str:
    told = synthetic.SCENARIOS[name]
    line = "i * 11 + i // 5"
    sentence = f"CASE (i * 5 + i // 13) % 3 WHEN 0 THEN {_pick_sql(told['positive'], line)} WHEN 1 THEN {_pick_sql(told['neutral'], line)} ELSE {_pick_sql(told['negative'], line)} END"
    content = f"replace({sentence}, '{{subject}}', {_pick_sql(told['subjects'], 'i * 7 + i // 9')}) || ' ' || {_pick_sql(synthetic.TAILS, 'i * 3 + i // 17')}"
    return f"SELECT printf('{name}-%04d', i + 1) AS id, {content} AS content, substr(sha1('{name}:hupu:' || i), 1, 16) AS author_hash, CAST((i * 37 + i // 7 * 11) % 900 AS INTEGER) AS like_count, CAST((i * 13 + i // 19) % 80 AS INTEGER) AS reply_count, {_times('7 * i')} AS publish_time FROM {rows}"


@query(" UNION ALL ".join(map(_demo_sql, synthetic.SCENARIOS)))
def demo_comments(spark, sf_dir):
    parts = [synthetic.demo(spark, name).select("id", "content", "author_hash", "like_count", "reply_count", "publish_time") for name in synthetic.SCENARIOS]
    return parts[0].unionByName(parts[1])


@query(_demo_sql("nba_game", "(SELECT o_orderkey % 50000 AS i FROM orders)"))
def demo_for_orders(spark, sf_dir):
    """A demonstration comment for every order, by its number."""
    numbers = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50000).alias("seq"))
    return synthetic.demo_for(numbers, "nba_game").select("id", "content", "author_hash", "like_count", "reply_count", "publish_time")


@query(
    f"""SELECT c_custkey, 'mock-hupu-0-' || i AS id, {_pick_sql(synthetic.SENTENCES["football"], "i - 1")} || CASE WHEN i > {len(synthetic.SENTENCES["football"])} THEN ' 第' || i || '条' ELSE '' END AS content, substr(sha1('hupu-' || i), 1, 16) AS author_hash, CAST(8 + 7 * i AS INTEGER) AS like_count, CAST(i % 5 AS INTEGER) AS reply_count, {_times("11 * i")} AS publish_time
FROM (SELECT c_custkey, c_custkey % 40 + 1 AS i FROM customer)"""
)
def generated_for_customers(spark, sf_dir):
    """A generated comment for every customer; beyond the sentences they carry their numbers."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40 + 1).alias("number"))
    made = synthetic.comments_for(c.select("number").distinct(), "football", topic="t", now=synthetic.DEMO_CLOCK)
    met = c.join(F.broadcast(made), F.col("number") == F.col("seq") + 1)  # forty rows
    return met.select("c_custkey", "id", "content", "author_hash", "like_count", "reply_count", "publish_time")


_DEMO_ROWS = " UNION ALL ".join(f"SELECT CAST(right(id, 4) AS BIGINT) - 1 AS seq, '{n}' AS task, content FROM ({_demo_sql(n)})" for n in synthetic.SCENARIOS)


@query(f"SELECT task_id AS scenario, count(*) AS n_raw, count(*) FILTER (NOT is_duplicate) AS n_dedup FROM ({leaders_sql(_DEMO_ROWS)}) GROUP BY task_id")
def demo_dedup(spark, sf_dir):
    """How many demonstration comments stay at a similarity of 0.9: 145 and 134 of 320."""
    parts = [dedup.near(comments.clean(synthetic.demo(spark, name)).withColumn("task_id", F.lit(name)), 0.9).groupBy(F.lit(name).alias("scenario")).agg(F.count("*").alias("n_raw"), F.count_if(~F.col("is_duplicate")).alias("n_dedup")) for name in synthetic.SCENARIOS]
    return parts[0].unionByName(parts[1])


_UPLOAD = """SELECT coalesce(CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_nationkey AS VARCHAR) END, 'upload-' || substr(sha1(n_name), 1, 16)) AS id, n_name AS content, 'p' AS platform, 'anonymous' AS author_hash, CAST(n_regionkey AS INTEGER) AS like_count, 0 AS reply_count, 'http://x/' || n_regionkey AS source_url, '' AS publish_time FROM nation"""


def _upload(spark, sf_dir) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return n.select(F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey").cast("string")).alias("comment_id"), F.col("n_name").alias("comment_text"), F.col("n_regionkey").alias("likes"), F.concat(F.lit("http://x/"), "n_regionkey").alias("url"))


def _from_file(spark, path: str) -> DataFrame:
    found = files.comments_from_file(spark, path, platform="p")
    return found.select("id", "content", "platform", "author_hash", "like_count", "reply_count", "source_url", "publish_time")


@query(_UPLOAD)
def csv_upload(spark, sf_dir):
    path = fresh_folder(spark, "upload") + ".csv"
    _upload(spark, sf_dir).write.option("header", True).csv(path)
    return _from_file(spark, path)


@query(_UPLOAD)
def jsonl_upload(spark, sf_dir):
    path = fresh_folder(spark, "upload") + ".jsonl"
    _upload(spark, sf_dir).write.json(path)
    return _from_file(spark, path)


@query(_UPLOAD)
def json_upload(spark, sf_dir):
    """An object with a list of a few rows, as uploads have it."""
    path = fresh_folder(spark, "upload") + ".json"
    rows = _upload(spark, sf_dir)
    rows.agg(F.to_json(F.struct(F.lit(25).alias("total"), F.collect_list(F.struct(*rows.columns)).alias("items")))).write.text(path)
    return _from_file(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS content, coalesce(nullif(c_name, ''), 'anonymous') AS author_hash, CAST(trunc(c_acctbal) AS INTEGER) AS like_count, c_name AS parent_id FROM customer")
def mapped_upload(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    mapping, status = files.with_mapping(files.auto_mapping(rows.columns), {"id": "c_custkey", "content": "c_mktsegment", "author_hash": "c_name", "like_count": "c_acctbal", "parent_id": "c_name", "odd": "c_name"}, rows.columns)
    if status != "ready":
        raise ValueError("the mapping should be complete")
    return files.normalize_rows(rows, mapping=mapping).select("id", "content", "author_hash", "like_count", "parent_id")


_FIRST = "FROM conversations WHERE turn > 0 AND (conv_id + turn) % 7 > 0 AND trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) <> ''"


@query(
    f"""SELECT conv_id || '-' || turn AS id, 'conversation ' || conv_id AS topic, substr(sha1(CAST(conv_id % 9 AS VARCHAR)), 1, 16) AS author_hash, CAST(conv_id * 3 + turn AS INTEGER) AS like_count, CAST(turn AS INTEGER) AS reply_count,
  strftime(make_timestamp((conv_id * 1000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS publish_time, 'https://bbs.hupu.com/' || conv_id || '.html' AS source_url, CAST(conv_id AS VARCHAR) AS thread_id, 'board ' || conv_id % 3 AS board,
  'https://img/' || conv_id || '.png' AS images, CAST(ceil(conv_id % 50 / 20.0) AS INTEGER) AS total_pages {_FIRST}"""
)
def thread_pages(spark, sf_dir):
    """Forum pages made of the conversations, parsed again: replies, then highlights that repeat them; some are hidden."""
    post = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("pid"),
        (F.col("conv_id") % 9).cast("string").alias("authorId"),
        F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("content"),
        (F.col("conv_id") * 3 + F.col("turn")).alias("allLightCount"),
        F.col("turn").alias("replyNum"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("createdAt"),
        ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("isDelete"),
    )
    turns = _table(spark, sf_dir, "conversations").where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(post)).alias("posts"))
    detail = F.struct(
        F.array(F.struct(F.lit(threads.SITE).alias("title")), F.struct(F.concat(F.lit("board "), F.col("conv_id") % 3).alias("title")), F.struct(F.lit("thread").alias("title"))).alias("breadCrumb"),
        F.struct(F.col("conv_id").alias("tid"), F.concat(F.lit("conversation "), "conv_id").alias("title"), F.concat(F.lit('<p>see <img src="https://img/'), "conv_id", F.lit('.png"></p>')).alias("content")).alias("thread"),
        F.struct((F.col("conv_id") % 50).alias("total"), F.lit(20).alias("size"), F.col("posts").alias("list")).alias("replies"),
        F.slice("posts", 1, 2).alias("lights"),
    )
    body = F.to_json(F.struct(F.struct(F.struct(detail.alias("detail")).alias("pageProps")).alias("props")))
    pages = turns.select(F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></html>")).alias("html"), F.concat(F.lit("https://bbs.hupu.com/"), "conv_id", F.lit(".html")).alias("url"))
    found = threads.parse_pages(stored(pages, "pages"))
    return found.select("id", "topic", "author_hash", "like_count", "reply_count", "publish_time", "source_url", "thread_id", "board", F.array_join("thread_image_urls", ",").alias("images"), "total_pages")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, CAST(event_id AS VARCHAR) AS id, event_type AS content FROM events")
def rows_in_order(spark, sf_dir):
    """Rows of many CSV files, numbered in the order of the files and of their lines."""
    folder = fresh_folder(spark, "events") + "/events.csv"
    _table(spark, sf_dir, "events").orderBy("event_id").select("event_id", F.col("event_type").alias("comment_text")).write.option("header", True).csv(folder)
    return order.numbered(files.read_rows(spark, folder, places=True)).select("seq", F.col("event_id").alias("id"), F.col("comment_text").alias("content"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, CAST(event_id AS VARCHAR) AS id FROM events ORDER BY event_id LIMIT 5000")
def first_rows_of_files(spark, sf_dir):
    """A run's share of an upload: the first 5,000 rows, the limit of a run."""
    folder = fresh_folder(spark, "events") + "/events.jsonl"
    _table(spark, sf_dir, "events").orderBy("event_id").select(F.col("event_id").alias("comment_id"), F.col("event_type").alias("comment_text")).write.json(folder)
    return files.comments_from_file(spark, folder, mapping={"id": "comment_id", "content": "comment_text"}).select("seq", "id")


@query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(count(DISTINCT i // 3) AS BIGINT) AS n_pages, least(4, count(*)) AS n_posts FROM t WHERE i // 3 * 3 < 4 GROUP BY conv_id"""
)
def paged_threads(spark, sf_dir):
    """Conversations as stored threads of three posts a page, read as far as a share of four posts asks: no thread's third page is read."""
    post = F.struct(F.concat_ws("-", "conv_id", "turn").alias("pid"), F.lit("post").alias("content"))
    placed = _table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    sizes = F.count("*").over(Window.partitionBy("conv_id"))
    pages = placed.withColumn("total", sizes).groupBy("conv_id", F.expr("cast(i div 3 + 1 as int)").alias("page")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(post)).alias("list"))
    detail = F.struct(F.struct(F.col("conv_id").cast("string").alias("tid")).alias("thread"), F.struct("total", F.lit(3).alias("size"), "list").alias("replies"))
    html = F.concat(F.lit('<script id="__NEXT_DATA__">'), F.to_json(F.struct(F.struct(F.struct(detail.alias("detail")).alias("pageProps")).alias("props"))), F.lit("</script>"))
    manifest = paged.write_pages(pages.select(F.col("conv_id").cast("string").alias("thread_id"), "page", F.lit("").alias("url"), html.alias("html")))
    read = stored(paged.stored_threads(spark, manifest, share=4), "pages-read")
    posts = threads.parse_pages(read, order=F.struct("thread_id", "page")).groupBy("thread_id").agg(F.least(F.lit(4), F.count("*")).cast("long").alias("n_posts"))
    return read.groupBy("thread_id").agg(F.count("*").alias("n_pages")).join(posts, "thread_id")


_URLS = "CASE page_id % 4 WHEN 0 THEN concat('https://bbs.hupu.com/', page_id, '.html') WHEN 1 THEN concat('https://m.hupu.com/bbs/', page_id, '-2.html') WHEN 2 THEN concat('http://BBS.hupu.com/', page_id, '?x=1') ELSE url END"


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN CAST(page_id AS VARCHAR) END AS thread_id FROM pages")
def thread_ids(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", threads.thread_id(F.expr(_URLS)).alias("thread_id"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://a/' || page_id || '.png,https://b/' || page_id || '.jpg' WHEN 1 THEN 'http://c/x.png' ELSE '' END AS images FROM pages")
def html_images(spark, sf_dir):
    tags = F.expr("""CASE page_id % 3 WHEN 0 THEN concat('<p><img src="//a/', page_id, '.png"><IMG alt="" data-src=\\'https://b/', page_id, '.jpg\\'><img src="/c.png"></p>') WHEN 1 THEN '<img src="http://c/x.png"><img data-src="http://d" src="http://c/x.png">' ELSE 'none' END""")
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(text.html_images(tags), ",").alias("images"))


@query("SELECT conv_id, turn, regexp_matches(text, 'the[^。；，,]{0,16}(in|on)|and[^。；，,]{0,16}(of|wh)') AS wrong FROM conversations")
def outcome_contradictions(spark, sf_dir):
    """Clauses in which "the" loses or "and" wins, by other verbs than the packaged ones."""
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", insight.contradicts(F.col("text"), F.lit("the"), F.lit("and"), ("in", "on"), ("of", "wh")).alias("wrong"))


_K = "CAST(json_extract(props, '$.k') AS VARCHAR)"
_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""SELECT event_id, {", ".join(f"CASE WHEN event_type = '{t}' THEN {_K} END AS {t}" for t in _TYPES)}, CAST(event_id AS VARCHAR) AS id, '{{"k":' || {_K} || '}}' AS props FROM events""")
def ragged_rows(spark, sf_dir):
    """Events as JSON whose fields differ by type: one table of all fields."""
    e = _table(spark, sf_dir, "events")
    lines = e.select("event_id", F.format_string('{"id": %d, "%s": %s, "props": %s}', "event_id", "event_type", F.get_json_object("props", "$.k"), "props").alias("line"))
    return variant.table(variant.objects(lines, "line").drop("line"))


@query(f"""SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN 'ARRAY' ELSE 'OBJECT' END AS kind, CASE event_id % 5 WHEN 3 THEN '' WHEN 4 THEN {_K} || '|' || event_type ELSE 'k：' || {_K} END AS texts FROM events""")
def tolerant_replies(spark, sf_dir):
    """Events' properties as a service might send them: fenced, with words around them, plain, broken, as a list."""
    reply = """CASE event_id % 5 WHEN 0 THEN concat('```json\n', props, '\n```') WHEN 1 THEN concat('Here: ', props, ' - done') WHEN 2 THEN props WHEN 3 THEN concat('{', event_type)
      ELSE concat('```\n[', get_json_object(props, '$.k'), ', null, "", "', event_type, '"]\n```') END"""
    v = variant.tolerant(F.expr(reply))
    read = _table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return read.select("event_id", variant.kind(F.col("v")).alias("kind"), F.array_join(variant.texts(F.col("v")), "|").alias("texts"))


# --- media -------------------------------------------------------------------------------------


_HOSTS = ["https://www.nba.com/x", "https://fifa.com", "http://evilnba.com/", "https://u:p@stats.uefa.com:80/a", "https://example.com/nba.com", ""]
_WORDS = [*media.AUTHORITY_TERMS, *media.INFORMATION_TERMS, "红队", "别的"]
_SCORED = f"""SELECT page_id AS seq, {_pick_sql(_WORDS, "page_id * 3")} || {_pick_sql(_WORDS, "page_id // 2")} AS title, CASE WHEN page_id % 3 = 0 THEN {_pick_sql(_WORDS, "page_id * 5 + 1")} ELSE '' END AS summary, {_pick_sql(_HOSTS, "page_id")} AS source_url, CASE WHEN page_id % 2 = 0 THEN 'news' ELSE 'thread' END AS source_kind FROM pages"""


def _hits(terms) -> str:
    return f"list_sort(list_filter({listed(terms)}, lambda t: contains(title || ' ' || summary, t)))"


_RATED = f"""WITH p AS ({_SCORED}), q AS (SELECT *, {_hits(media.AUTHORITY_TERMS)} AS au, {_hits(media.INFORMATION_TERMS)} AS info, {_hits(media.REFERENCE_TERMS)} AS re, contains(title || ' ' || summary, '红队') AS ours, source_url IN ({", ".join(quoted(_HOSTS[i]) for i in (0, 1, 3))}) AS official FROM p),
s AS (SELECT *, CAST(CASE WHEN official THEN 4 ELSE 0 END + CASE WHEN len(au) > 0 THEN 3 ELSE 0 END + least(4, len(info)) + CASE WHEN ours THEN 1 ELSE 0 END AS INTEGER) AS information_score,
  CASE WHEN official THEN 'official' WHEN len(re) > 0 THEN 'official_reference' WHEN source_kind = 'news' OR contains(title || ' ' || summary, '流言板') THEN 'editorial' ELSE 'community_data' END AS authority_level,
  array_to_string(list_filter([CASE WHEN official THEN '{media.OFFICIAL_REASON}' END, CASE WHEN len(au) > 0 THEN '{media.AUTHORITY_REASON}' || array_to_string(au[1:3], '、') END, CASE WHEN len(info) > 0 THEN '{media.INFORMATION_REASON}' || array_to_string(info[1:4], '、') END, CASE WHEN ours THEN '{media.MATCH_REASON}' END], lambda x: x IS NOT NULL), '|') AS reasons FROM q)"""


def _sources(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.selectExpr("page_id AS seq", f"concat({_pick(_WORDS, 'page_id * 3')}, {_pick(_WORDS, 'page_id div 2')}) AS title", f"CASE WHEN page_id % 3 = 0 THEN {_pick(_WORDS, 'page_id * 5 + 1')} ELSE '' END AS summary", f"{_pick(_HOSTS, 'page_id')} AS source_url", "CASE WHEN page_id % 2 = 0 THEN 'news' ELSE 'thread' END AS source_kind")


@query(_RATED + " SELECT seq AS page_id, information_score, authority_level, reasons FROM s")
def source_info_score(spark, sf_dir):
    found = media.source_score(_sources(spark, sf_dir), ("红队",))
    return found.select(F.col("seq").alias("page_id"), "information_score", "authority_level", F.array_join("selection_reasons", "|").alias("reasons"))


_IMAGES = ["http://i/a.png", "http://i/bb.jpg", "http://i/news-editor/c.jpg", "http://i/d.GIF", "ftp://i/e.png", "http://i/longer-name.jpg", "http://i/x.png?news-editor"]
_LEVEL = "CASE authority_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in media.AUTHORITY_RANK.items()) + " END"


@query(
    _RATED
    + f""", r AS (SELECT *, row_number() OVER (ORDER BY {_LEVEL} DESC, information_score DESC, source_kind = 'news', seq) AS rank, [{_pick_sql(_IMAGES, "seq")}, 'http://i/' || (seq % 40) || '.jpg', {_pick_sql(_IMAGES, "seq // 3")}] AS urls FROM s WHERE information_score >= 2),
g AS (SELECT *, list_filter(urls, lambda u: regexp_matches(u, '^https?://') AND NOT contains(lower(u), '.gif')) AS good FROM r),
h AS (SELECT rank, url, i, CASE WHEN contains(lower(url), '.png') THEN 3 ELSE 0 END + CASE WHEN contains(lower(url), 'news-editor') THEN 2 ELSE 0 END AS hint FROM (SELECT rank, unnest(good) AS url, generate_subscripts(good, 1) AS i FROM g)),
d AS (SELECT rank, url, hint, min(i) AS i FROM h GROUP BY ALL),
o AS (SELECT *, max(hint) OVER (PARTITION BY rank) AS best, row_number() OVER (PARTITION BY rank ORDER BY hint DESC, length(url) DESC, i) AS pos FROM d),
k AS (SELECT * FROM o WHERE CASE WHEN best > 0 THEN hint > 0 AND pos <= 4 ELSE pos = 1 END),
f AS (SELECT url, rank, pos, row_number() OVER (PARTITION BY url ORDER BY rank, pos) AS n FROM k)
SELECT url, CAST(rank AS INTEGER) AS rank, CASE WHEN row_number() OVER (ORDER BY rank, pos) <= 6 THEN 'selected' ELSE 'skipped_limit' END AS status FROM f WHERE n = 1"""
)
def image_budget(spark, sf_dir):
    images = F.expr(f"array({_pick(_IMAGES, 'seq')}, concat('http://i/', seq % 40, '.jpg'), {_pick(_IMAGES, 'seq div 3')})")
    ranked = media.ranked_sources(media.source_score(_sources(spark, sf_dir), ("红队",)).withColumn("image_urls", images))
    return media.budgeted_images(ranked, 6).select("url", "rank", "status")


@query(
    _RATED
    + f""", z AS (SELECT *, seq // 30 AS run FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {_LEVEL} DESC, information_score DESC, source_kind = 'news', seq) AS rank, [{_pick_sql(_IMAGES, "seq")}, 'http://i/' || (seq % 40) || '.jpg', {_pick_sql(_IMAGES, "seq // 3")}] AS urls FROM z WHERE information_score >= 2),
g AS (SELECT *, list_filter(urls, lambda u: regexp_matches(u, '^https?://') AND NOT contains(lower(u), '.gif')) AS good FROM r),
h AS (SELECT run, rank, url, i, CASE WHEN contains(lower(url), '.png') THEN 3 ELSE 0 END + CASE WHEN contains(lower(url), 'news-editor') THEN 2 ELSE 0 END AS hint FROM (SELECT run, rank, unnest(good) AS url, generate_subscripts(good, 1) AS i FROM g)),
d AS (SELECT run, rank, url, hint, min(i) AS i FROM h GROUP BY ALL),
o AS (SELECT *, max(hint) OVER (PARTITION BY run, rank) AS best, row_number() OVER (PARTITION BY run, rank ORDER BY hint DESC, length(url) DESC, i) AS pos FROM d),
k AS (SELECT * FROM o WHERE CASE WHEN best > 0 THEN hint > 0 AND pos <= 4 ELSE pos = 1 END),
f AS (SELECT run, url, rank, pos, row_number() OVER (PARTITION BY run, url ORDER BY rank, pos) AS n FROM k)
SELECT run, url, CAST(rank AS INTEGER) AS rank, CASE WHEN row_number() OVER (PARTITION BY run ORDER BY rank, pos) <= 6 THEN 'selected' ELSE 'skipped_limit' END AS status FROM f WHERE n = 1"""
)
def image_budget_by_run(spark, sf_dir):
    """Many runs side by side, thirty sources each: no window without a key."""
    images = F.expr(f"array({_pick(_IMAGES, 'seq')}, concat('http://i/', seq % 40, '.jpg'), {_pick(_IMAGES, 'seq div 3')})")
    sources = media.source_score(_sources(spark, sf_dir), ("红队",)).withColumns({"image_urls": images, "run": F.expr("seq div 30")})
    return media.budgeted_images(media.ranked_sources(sources, task="run"), 6, task="run").select("run", "url", "rank", "status")


_OCR = ["PTS 30 REB 11", "Q4 02:13 LAL 99 BOS 98", "第4节 11:02 98 比 97", "hello there world", "final report", "short", "", "裁判报告全文", "12 and 13.5 points", "only one 7 here"]
_LEVELS = ["high", "medium", "low", "unrelated"]
_TOLD = [True, False, False, False, True, False, False, True, True, False]


@query(
    f"""WITH a AS (SELECT doc_id AS seq, CAST(doc_id % 10 AS INTEGER) AS k, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'completed' END AS status, {_pick_sql(_LEVELS, "doc_id // 10")} AS relevance, {_pick_sql(_LEVELS[:3], "doc_id // 40")} AS value FROM documents),
b AS (SELECT *, ({_TOLD}::BOOLEAN[])[k + 1] AS told FROM a), c AS (SELECT *, status = 'completed' AND relevance IN ('high', 'medium') AND value IN ('high', 'medium') AND told AS included FROM b)
SELECT seq, told, included AS included_in_summary, CASE WHEN status = 'completed' AND NOT included THEN CASE WHEN value = 'low' THEN '{media.LOW_VALUE}' WHEN NOT told THEN '{media.NO_SIGNAL}' ELSE '{media.NO_RELEVANCE}' END ELSE '' END AS exclusion_reason FROM c"""
)
def image_evidence(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").selectExpr("doc_id AS seq", f"{_pick(_OCR, 'doc_id')} AS ocr_text", "CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'completed' END AS status", f"{_pick(_LEVELS, 'doc_id div 10')} AS relevance", f"{_pick(_LEVELS[:3], 'doc_id div 40')} AS information_value")
    return media.included(d).select("seq", media.ocr_informative(F.col("ocr_text")).alias("told"), "included_in_summary", "exclusion_reason")


@query("SELECT page_id AS seq, url AS source_url, 'https://img/' || page_id || '.png' AS images FROM pages WHERE page_id % 5 > 0")
def news_images(spark, sf_dir):
    """Articles with an image each; every fifth stands under a private address and is an error."""
    p = spread(_table(spark, sf_dir, "pages"))
    given = p.select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://10.0.0.1/"), "page_id")).otherwise(F.col("url")).alias("url"), F.concat(F.lit('<meta property="og:image" content="https://img/'), "page_id", F.lit('.png">'), "html").alias("html"))
    items = articles.articles(given).withColumns({"seq": F.regexp_extract(F.coalesce(F.try_element_at("image_urls", F.lit(1)), F.lit("")), r"(\d+)\.png", 1).try_cast("long"), "source_url": F.col("url")})
    return media.news_candidates(items).select("seq", "source_url", F.array_join("image_urls", ",").alias("images"))


@query("SELECT conv_id AS seq, CASE WHEN conv_id % 2 = 0 THEN 'title ' || conv_id ELSE 'topic' END AS title, 'http://i/' || conv_id || '.png' AS images FROM (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY conv_id) WHERE (conv_id + first) % 3 > 0")
def thread_images(spark, sf_dir):
    """Of each thread the first comment, where that has images; its topic stands in for a missing title."""
    c = _table(spark, sf_dir, "conversations")
    rows = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.when(F.col("conv_id") % 4 < 2, F.concat(F.lit("t"), "conv_id")).otherwise("").alias("thread_id"),
        F.concat(F.lit("http://x/"), "conv_id").alias("source_url"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("title "), "conv_id")).otherwise("").alias("thread_title"),
        F.lit("topic").alias("topic"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, F.array(F.concat(F.lit("http://i/"), "conv_id", F.lit(".png")))).alias("thread_image_urls"),
    )
    return media.thread_candidates(rows).select(F.floor(F.col("seq") / 1000).alias("seq"), "title", F.array_join("image_urls", ",").alias("images"))


# --- lists -------------------------------------------------------------------------------------


def _known_sql(domain: str) -> str:
    tax = TAXONOMIES[domain]
    labels = [*tax.names("positive"), *tax.names("negative")]
    terms = [t for kind in ("positive", "negative") for ts in tax.labels[kind].values() for t in ts]
    parts = " UNION ".join(f"SELECT unnest(string_split(x, {quoted(sep)})) AS term FROM (SELECT unnest({listed(labels)}) AS x)" for sep in "与和及、/ ")
    return f"SELECT '{domain}' AS domain, term FROM (SELECT term FROM ({parts}) WHERE length(term) > 1 UNION SELECT unnest({listed(labels)}) UNION SELECT unnest({listed(terms)}) UNION SELECT unnest({listed(tax.general)}))"


@query(" UNION ALL ".join(_known_sql(d) for d in ("basketball", "football")))
def known_terms(spark, sf_dir):
    return spark.createDataFrame([(d, t) for d in ("basketball", "football") for t in TAXONOMIES[d].known_terms], "domain string, term string")
