import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from remarq.functions import lexicon, match, text
from remarq.operators import aggregates, clusters, comments, dedup, tokens


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    given = ["great👍 @someone hi <b>x</b>", "  a　　b ", "回复 nice", "展开 12 条回复 ok", "a#b$c", None, "❤️"]
    assert column(spark, given, text.normalize) == ["great 好评 hi x", "a b", "nice", "ok", "a b c", "", "喜欢"]


def test_quality_and_language(spark):
    given = ["666", "VX 123456", "a", "好玩", "abcd", "x" * 16, "y" * 400]
    assert column(spark, given, text.quality_score) == pytest.approx([0.0, 0.1, 0.0, 0.575, 0.45, 0.75, 1.0])
    assert column(spark, ["ab中", "中a", "éé", "abc"], text.language) == ["en", "zh", "zh", "en"]


def test_scalars(spark):
    assert column(spark, ["6.9", "-6.9", "x", None, "1e3"], text.safe_int) == [6, -6, 0, 0, 1000]
    assert column(spark, ["0", None, "x", "1700000000", "1700000000500"], text.epoch_iso) == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:00+00:00", "", "2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20.500000+00:00"]
    html = '<p>a &amp; <i>b</i></p><img src="//h/x.png"><img data-src="http://h/y.jpg"><img src="/no.png">'
    assert column(spark, [html, "plain  text"], text.html_text) == ["a & b", "plain text"]
    assert column(spark, [html], text.html_images) == [["https://h/x.png", "http://h/y.jpg"]]
    assert column(spark, [["Home", "A", "B"], ["Home", "A"], None], lambda c: text.board(c, "Home"), "array<string>") == ["A", "A", ""]
    assert column(spark, [0.1234], text.percent, "double") == ["12.3%"]


def test_seconds_beyond_the_guess_for_milliseconds(spark):
    def iso(c):
        return text.epoch_iso(c, millis=False)

    assert column(spark, ["1700000000", "10000001202", "47513992081", "285083992081", "x"], iso) == ["2023-11-14T22:13:20+00:00", "2286-11-20T18:06:42+00:00", "3475-08-29T11:08:01+00:00", "11003-12-15T05:48:01+00:00", ""]


def python_embedding(t):
    words = re.findall(r"\w+", t.lower()) or [t.lower()]
    counts = [0.0] * 64
    for w in words:
        counts[int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % 64] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    return [c / norm for c in counts]


def test_embedding_and_cosine(spark):
    given = ["the cat sat on the mat", "", "!!!", "été Été"]
    for got, t in zip(column(spark, given, text.embedding), given, strict=True):
        assert got == pytest.approx(python_embedding(t), abs=1e-6)
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(text.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(math.sqrt(0.5))


def test_sentiment_and_labels(spark):
    df = spark.createDataFrame([(1, "广告太烦了"), (2, "很喜欢 great"), (3, "nothing")], "seq long, cleaned_content string")
    got = {r.seq: r for r in comments.labels(comments.sentiment(df)).collect()}
    assert got[1].sentiment.score == pytest.approx(-0.53) and got[1].sentiment.label == "negative"
    assert got[2].sentiment.label == "strong_positive" and got[3].sentiment.label == "neutral"
    assert got[1].painpoint.category == "裁判判罚争议" and got[1].painpoint.confidence == 0.55 and got[1].positive_attribution is None
    assert got[3].painpoint is None and got[3].stance.label == "无关"


def test_longest_and_first_term(spark):
    tax = lexicon.taxonomy("nba")
    body = "防守漏洞太大，篮板丢，主队裁判"
    assert column(spark, [body], lambda c: match.longest_label(c, tax, "negative"))[0].label == "防守漏洞"
    assert column(spark, [body], lambda c: match.first_label(c, tax))[0].label == "支持主队"
    assert lexicon.label_parts("失误与球权") == {"失误与球权", "失误", "球权"}


def test_tokens(spark):
    tax = lexicon.taxonomy("football")
    (got,) = column(spark, ["VAR 点球 and variety var http://x.y/z 门将门将 12 ab"], lambda c: tokens.tokens(c, tax))
    assert got[:3] == ["VAR", "var", "点球"][:1] + got[1:3] and len({t.lower() for t in got}) == len(got)
    assert {"点球", "门将", "variety"} <= set(got) and "and" not in got and "12" not in got


def test_last_wins_at_first_place(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3), (3, None, 4), (4, "", 5)], "seq long, id string, v int").repartition(3)
    assert sorted(map(tuple, comments.last_of_each(df).select("seq", "id", "v").collect())) == [(0, "a", 3), (1, "b", 2)]


def greedy(rows, theta):
    """The plain rule: same hash as a leader, else the first leader that is close enough."""
    leaders, by_hash, out = [], {}, {}
    for seq, body in rows:
        h = re.sub(r"\W+", "", body.lower())
        v = python_embedding(body)
        if h in by_hash:
            out[seq] = by_hash[h]
            continue
        found = next((s for s, u in leaders if sum(a * b for a, b in zip(u, v, strict=True)) >= theta), None)
        if found is None:
            by_hash[h] = seq
            leaders.append((seq, v))
        out[seq] = found
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_near_duplicates_follow_the_order(spark, partitions):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(300)]
    df = spark.createDataFrame([(i, t, "t") for i, t in rows], "seq long, cleaned_content string, task_id string").repartition(partitions)
    got = {r.seq: r.leader_seq for r in dedup.near(df, 0.86).collect()}
    assert got == greedy(rows, 0.86)


def test_exact_flags(spark):
    df = spark.createDataFrame([(3, "A b!"), (1, "a, B"), (2, "c")], "seq long, cleaned_content string")
    got = {r.seq: (r.is_duplicate, r.duplicate_group_id) for r in dedup.exact(df).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, hashlib.sha1(b"ab").hexdigest()[:12])}


def test_similar_pairs(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want = {(i, j) for i, a in vectors for j, b in vectors if i < j and cos(a, b) >= 0.7}
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, 0.7, block=16).collect()} == want


def test_quality_report(spark):
    raw = spark.range(5)
    cleaned = spark.createDataFrame([("zh", False), ("zh", False), ("en", True), ("zh", False)], "language string, is_duplicate boolean")
    r = aggregates.quality_report(raw, cleaned).first()
    assert (r.raw_count, r.clean_count, r.dedup_count, r.duplicate_ratio, r.noise_ratio, r.sample_confidence_level) == (5, 4, 3, 0.25, 0.2, "low")
    assert r.language_distribution == {"zh": 3, "en": 1} and r.warning
    empty = aggregates.quality_report(raw.limit(0), cleaned.limit(0)).first()
    assert (empty.duplicate_ratio, empty.noise_ratio) == (0.0, 0.0)


def test_cluster_numbers(spark):
    keys = ["b"] * 3 + ["a"] * 3 + ["c"] + [clusters.NOISE_KEY] * 9
    df = spark.createDataFrame([(k,) for k in keys], "cluster_key string")
    assert {r.cluster_key: r.cluster_id for r in clusters.numbered(df).collect()} == {"a": 0, "b": 1, "c": 2, clusters.NOISE_KEY: -1}
    assert [clusters.k_for(n) for n in (1, 12, 30, 100)] == [2, 3, 5, 6]
    assert [clusters.method_for(n) for n in (11, 12)] == ["rules", "kmeans"]
