"""Ragged rows and replies with something around them."""

from pyspark.sql import functions as F

from remarq.plans import insight
from remarq.sources import variant

TEXTS = ['{"a": 1, "b": ["x", 2, null, ""], "c.d": {"e": "f", "g": ""}}', '```json\n{"a": "t"}\n```', 'Here you are: {"z": true, "b": "one"} - done.', "```\n[1, 2]\n```", "no", "{broken", None, "", '"text"', '{"b": {"k": "v", "n": null}}']


def test_texts_around_json(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)
    got = {r.i: r.k for r in df.select("i", variant.kind(variant.tolerant(F.col("t"))).alias("k")).collect()}
    assert got == {0: "OBJECT", 1: "OBJECT", 2: "OBJECT", 3: "ARRAY", 4: None, 5: None, 6: None, 7: None, 8: "STRING", 9: "OBJECT"}


def test_ragged_rows_are_one_table(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)
    found = variant.table(variant.objects(df, "t").drop("t"))
    assert found.columns == ["i", "a", "b", "c.d", "z"]
    assert {r["i"]: (r["a"], r["b"], r["c.d"], r["z"]) for r in found.collect()} == {0: ("1", '["x",2,null,""]', '{"e":"f","g":""}', None), 1: ("t", None, None, None), 2: (None, "one", None, "true"), 9: (None, '{"k":"v","n":null}', None, None)}
    assert variant.names(variant.objects(df.limit(0), "t")) == []


def test_texts_of_fields_are_those_of_a_report(spark):
    df = variant.objects(spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string"), "t")
    got = {r.i: r.b for r in df.select("i", variant.texts(variant.field(F.col("row"), "b", "variant")).alias("b")).collect()}
    assert got == {0: ["x", "2"], 1: [], 2: ["one"], 9: ["k：v"]}
    assert got[0] == insight.flat_list(["x", 2, None, ""]) and got[9] == insight.flat_list({"k": "v", "n": None})
