import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from remarq.llm import license_scan, mixing, toxicity


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    insults = ["worthless", "pathetic", "disgusting", "scoundrel", "wretched"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(insults)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + [(900, None, "en", 0.5), (901, "", "en", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i, r in found.items() if r.held_out and i in truth]
    assert 40 < len(held) < 130
    right = sum(found[i].predicted == truth[i] for i in held) / len(held)
    assert right > 0.9
    assert found[900].score == found[901].score < 0.5
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {i for i, r in found.items() if not r.predicted}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, labels).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs.limit(0), one).count() == 0


def test_license_spans(spark):
    apache = license_scan.TEMPLATES["Apache-2.0"]
    rows = [
        (1, f"Some text. {apache}.\nMore. {apache}!", "x"),
        (2, "permission is hereby granted to any person, free of charge, obtaining a copy of this software and associated documentation files to deal in the software at all", "x"),
        (3, None, "x"),
        (4, "", "x"),
        (5, "licensed under nothing in particular", "x"),
        (1, apache.upper(), "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    found = sorted((r.doc_id, r.span_start, r.license, r.matched_text, r.coverage) for r in license_scan.scan_documents(docs).collect())
    assert [(i, n, t) for i, _, n, t, _ in found] == [(1, "Apache-2.0", apache.upper()), (1, "Apache-2.0", apache), (1, "Apache-2.0", apache), (2, "MIT-grant", rows[1][1][: -len(" at all")])]
    assert found[0][1] == 0 and found[-1][4] > 0.7
    assert license_scan.scan_documents(docs, {}).count() == 0
    assert license_scan.scan_documents(docs.limit(0)).count() == 0


def test_license_scan_finds_what_brute_force_does():
    rng = random.Random(1)
    index = license_scan.Index(license_scan.TEMPLATES)
    vocabulary = "licensed under the a version of software any use free copy".split()
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        name = rng.choice(index.names)
        at = rng.randint(0, len(words))
        text = " ".join([*words[:at], license_scan.TEMPLATES[name], *words[at:]])
        assert any(m.template == name and m.coverage == 1.0 for m in license_scan.scan(text, index))


def test_licenses_by_their_own_names():
    index = license_scan.Index(license_scan.TEMPLATES)
    for text, name in [
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0-short"),
        ("Released under the BSD License", "BSD"),
        ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        *((t, n) for n, t in license_scan.TEMPLATES.items()),
    ]:
        assert [m.template for m in license_scan.scan(f"Some words. {text} and more", index)] == [name], name
    assert license_scan.scan("Released under the Foo License", index) == []
    assert license_scan.scan("Licensed under CC BY-XX 4.0", index) == []


def brute_rake(cells, aims, dimensions, rounds=200):
    total = sum(t for *_, t in cells)
    w = [t / total for *_, t in cells]
    for _ in range(rounds):
        for d in range(dimensions):
            sums = {}
            for c, x in zip(cells, w, strict=True):
                sums[c[d]] = sums.get(c[d], 0) + x
            w = [x * aims[d][c[d]] / sums[c[d]] if sums[c[d]] else 0.0 for c, x in zip(cells, w, strict=True)]
    return w


@pytest.mark.parametrize("few", [True, False])
def test_raked_sums_meet_their_targets(spark, few):
    rng = random.Random(8)
    cells = [(s, g, t, rng.randint(1, 500)) for s in ("a", "b", "c", mixing.NONE) for g in ("en", "de", "xx") for t in ("note", "table")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = mixing.Targets(source=0.5, lang={"en": 0.5, "de": 0.3}, topic=1.0)
    found, off = mixing.rake(df, targets, few)
    raked = {(r.source, r.lang, r.topic): r.w for r in found.collect()}
    assert off < 1e-6
    total = sum(c[3] for c in cells)
    aims = []
    for d, target in enumerate((targets.source, targets.lang, targets.topic)):
        natural = {}
        for c in cells:
            natural[c[d]] = natural.get(c[d], 0) + c[3] / total
        raw = {v: target.get(v, x) if isinstance(target, dict) else x**target for v, x in natural.items()}
        aims.append({v: x / sum(raw.values()) for v, x in raw.items()})
    for c, w in zip(cells, brute_rake(cells, aims, 3), strict=True):
        assert raked[c[:3]] == pytest.approx(w, abs=1e-8)


def test_mixing_keeps_all_rows_and_handles_odd_ones(spark):
    rows = [(i, "word " * (i % 30), ("en", "de", None)[i % 3], ("s0", "s1", "s2", None)[i % 4 if i % 2 else 0]) for i in range(300)] + [(None, None, None, None), (5, "twice", "en", "s0"), (5, "twice", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("clash")).withColumn("w", F.lit(1))
    got = mixing.report(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    expected = sum(r.tokens * r.probability for r in got)
    assert expected == pytest.approx(0.5 * sum(r.tokens for r in got), rel=0.01)
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.report(docs.limit(0)).count() == 0
    assert {r.probability for r in mixing.report(docs.where("doc_id is null")).collect()} == {0.0}


def test_the_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    """Each stage on all its predecessor kept, held against plain rules for what it may and may not drop."""
    rng = random.Random(6)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in corpus(120)]
    passage = " ".join(f"bench{rng.randrange(99)}" for _ in range(30))
    rows += [(200, rows[1][1], "en", "s0", 0), (201, f"before {passage} after", "de", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in corpus(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r.doc_id for r in docs.collect()})
    assert 200 in seen[1] and 1 in seen[2] and 200 not in seen[2]
    assert seen[2] - seen[3] == {201}
    assert seen[3] >= seen[4] == seen[5]
    clean = {i for i, _, y in corpus(120) if not y}
    assert len(clean & seen[3]) > 0.95 * len(clean)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))
