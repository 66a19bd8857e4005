"""Terms by an automaton against looking for each; k-means' own rules."""

import random
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from remarq.functions import match
from remarq.functions.lexicon import Lexicon
from remarq.operators import clusters, tokens


def test_all_terms_are_found_however_they_lie(spark):
    rng = random.Random(6)
    terms = match.vocabulary({"".join(rng.choice("abÄ防守") for _ in range(rng.randint(1, 5))) for _ in range(120)} | {"too", "too many", "many"})
    texts = ["".join(rng.choice("abÄ防守 ") for _ in range(rng.randrange(60))) for _ in range(80)] + ["too many", "TOO", "", None, "ab" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: list(r.p) for r in df.select("i", match.occurring(F.lower("t"), terms).alias("p")).collect()}
    assert got == {i: [k for k, term in enumerate(terms) if term in (t or "").lower()] for i, t in enumerate(texts)}


def test_sums_and_orders_of_terms(spark):
    df = spark.createDataFrame([(0, "A防守漏洞 b"), (1, "none"), (2, None)], "i int, t string")
    lexicon = Lexicon((("防守", 5), ("漏洞", -7), ("A", 1), ("a", 2), ("z", 100)))
    hits = match.Hits.of(F.col("t"), ["防守", "漏洞", "防守漏洞", "a", "z"])
    row = df.select("i", match.sentiment_hundredths(F.col("t"), lexicon).alias("s"), hits.first(["z", "漏洞", "防守"]).alias("f"), hits.forms(["Z", "漏洞", "A", "a", "防守漏洞"]).alias("w"))
    assert {r.i: (r.s, r.f, list(r.w)) for r in row.collect()} == {0: (1, 1, ["漏洞", "A", "a", "防守漏洞"]), 1: (0, None, []), 2: (0, None, [])}
    assert df.select(match.sentiment_hundredths(F.col("t"), Lexicon(())).alias("s")).distinct().collect()[0].s == 0


def test_k_means_keeps_its_rules(spark):
    assert [clusters.k_for(n) for n in (1, 4, 9, 24, 36, 400)] == [2, 2, 3, 4, 6, 6]
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.01 * rng.normal(size=(20, 3)) for c in np.eye(3)])
    rows = [(i, v.tolist(), i % 10 == 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "seq long, embedding array<double>, is_noise_row boolean").repartition(3)
    runs = [{r.seq: r.cluster_label for r in clusters.kmeans_clusters(df, k=3).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 60
    assert all((runs[0][i] == -1) == noisy for i, _, noisy in rows)
    groups = [{runs[0][i] for i in range(g * 20, g * 20 + 20)} - {-1} for g in range(3)]
    assert [len(g) for g in groups] == [1, 1, 1] and len(set.union(*groups)) == 3
    few = clusters.kmeans_clusters(df.limit(3), k=3)
    assert {r.cluster_label for r in few.collect()} == {None}


def test_tokens_of_forms_and_odd_texts(spark):
    """Terms first and in their order, the first form of a key stays, words hold a term that the text holds; nulls and empty texts have none; more texts than a slice."""
    tax = SimpleNamespace(known_terms=("Big Win", "VAR", "var", "点球", "门将"), stop_words=("the",))
    given = ["the\u00a0big\u3000win, Var 点球! x1 ab abc ABC #Topic# me@some http://a.b/c 门将们 普通词", None, "", "12 ab - the"] * 200
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string").coalesce(1)
    got = [r.k for r in df.select("i", tokens.tokens(F.col("t"), tax).alias("k")).orderBy("i").collect()]
    assert got == [["Big Win", "VAR", "点球", "门将", "big", "win", "abc", "Topic", "门将们"], [], [], []] * 200
