import random

from pyspark.sql import functions as F

from remarq.functions import cleaning, text
from remarq.functions.lexicon import taxonomy
from remarq.operators import comments, tokens

PARTS = ["a", "B", "Vx", "加微", " ", "  ", "\t", "\n", "\xa0", "\x1c", "\x85", "-", ",", "，", "é", "ß", "İ", "ΑΣ", "中", "作者", " 回复 ", "展开 12 条回复", "<b>", "<", ">", "@x.y", "#", "👍", "❤️", "😀", "1", "²", "½", "_", "'", "“", "https://a.b/c", "顶", "真香", "́", "\U0001df00", "ꟃ", "the", "moron"]


def made(n, most, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_one_pass_equals_the_rules_as_expressions(spark):
    given = [None, "", *PARTS, *made(1500, 12), *("x " * k for k in range(30, 42)), "word " * 50]
    df = spark.createDataFrame(list(enumerate(given)), "i long, content string").repartition(3)
    c = text.normalize(text.collapsed(F.coalesce("content", F.lit(""))))
    body = F.col("c")
    plain = df.select("i", "content", c.alias("c")).select("i", "content", "c", text.quality_score(body).alias("q"), text.language(body).alias("l"), text.content_hash(body).alias("h")).where("c != '' AND q > 0.2")
    want = {r.i: (r.c, r.q, r.l, r.h) for r in plain.collect()}
    got = {r.i: tuple(r)[1:] for r in comments.clean(df).select("i", "cleaned_content", "quality_score", "language", "content_hash").collect()}
    assert got == want
    slow = sum(cleaning.normal(t or "") is None for t in given)
    assert 0 < slow < len(given) // 3  # both ways were taken


def test_ordinary_texts_need_no_second_pass():
    assert cleaning.normal("Schön, “très” bien —\tniño  ok 👍") == "Schön, très bien niño ok 好评"
    assert cleaning.normal("ΑΣ") is None and cleaning.normal("\U0001df00") is None


def test_tokens_of_numbered_and_accented_words():
    tax = taxonomy("latin")
    own = tokens._finder(tuple(tax.known_terms), tuple(tax.stop_words))
    assert own.of("2nd Words-apart words café_x a_b 12 ab schöne MORON") == ["moron", "Words", "apart", "caf", "a_b", "sch"]
