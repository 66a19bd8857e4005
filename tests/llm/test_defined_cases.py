"""Repeated keys, clashing names, nulls, very long texts, and plain versions of what SQL cannot express."""

import hashlib
import math
import random
import warnings
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_duplicates import brute_components, brute_copies, brute_fingerprint, brute_hits
from test_media_and_pages import LONG, want_records
from test_scoring import brute_rake, corpus

import corpus_pipeline
from remarq.llm import decontaminate, license_scan, main_text, mixing, near_copies, simhash, toxicity, warc_zip
from remarq.llm.pieces import load

CLASHES = "probability, sampled, mix_source, component_id, row_key, row_digest, digest, own_words, label, fp, id, t".split(", ")


def with_clashes(df):
    for name in CLASHES:
        df = df.selectExpr("*", f"'kept' AS {name}")
    return df


@pytest.mark.parametrize("way", ["bits", "shingles"])
def test_copies_go_by_row(spark, way):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, "alone here now"), (None, "alone here now"), (4, None), (5, " "), (6, "x y"), (6, "x y"), (3, b.upper()), (7, a + " more"), (7, "something else entirely")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    if way == "bits":
        points = [(k, brute_fingerprint(t)) for k, (_, t) in enumerate(rows)]
        label = brute_components(points)
        found = simhash.one_of_each(df)
    else:
        label = brute_copies([(k, t) for k, (_, t) in enumerate(rows)])
        found = near_copies.one_of_each(df)
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(label[k], []).append((i, t))
    got = [(r.doc_id, r.text) for r in found.collect()]
    assert len(got) == len(groups)
    for own in groups.values():
        least = min((i for i, _ in own if i is not None), default=None)
        assert sum(g in own and g[0] == least for g in got) == 1, own
    assert found.columns == df.columns and {r.component_id for r in found.collect()} == {"kept"}


def test_pages_of_one_key_and_several_bodies(spark):
    rows = [(7, "u", "A"), (7, "u", "B"), (7, "u", "C"), (9, "u", "A"), (10, "u", "B"), (None, "u", "A"), (None, "u", "Z"), (7, "u", "C")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    assert sorted((tuple(r)[:5] for r in warc_zip.round_trip(df).collect()), key=str) == want_records(rows)


def test_mixing_with_clashing_names_and_given_columns(spark):
    rows = [(i, "one\ntwo\tthree four", "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    targets = mixing.Targets(source=1.0, lang={"en": 0.5, "de": 0.5}, topic=1.0)
    got = mixing.report(df, targets)
    assert {r.tokens for r in got.collect()} == {4} and got.columns == ["doc_id", "source", "lang", "topic", "tokens", "probability", "sampled"]
    kept = mixing.sample(df, targets)
    assert kept.columns == df.columns and {(r.probability, r.sampled, r.mix_source) for r in kept.collect()} == {("kept",) * 3}
    assert 0 < kept.count() < 60
    mixed = mixing.mix(df, targets, topic=df["label"], tokens=df["doc_id"])
    assert {(r.mix_topic, r.mix_tokens == r.doc_id) for r in mixed.collect()} == {("kept", True)}
    with pytest.raises(ValueError):
        mixing.rake(cells_of(spark), mixing.Targets(source={"a": 0.9, "b": 0.1}, lang={"x": 0.1, "y": 0.9}, topic=1.0, strict=True), True)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        _, off = mixing.rake(cells_of(spark), mixing.Targets(source={"a": 0.9, "b": 0.1}, lang={"x": 0.1, "y": 0.9}, topic=1.0), False)
    assert off > 0.1 and any("targets" in str(w.message) for w in said)


def cells_of(spark):
    return spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, tokens long")


def test_a_large_benchmark(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, " ".join(f"b{rng.randrange(20000)}" for _ in range(20))) for i in range(5500)]
    docs = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice((5, 40))))) for i in range(60)]
    docs += [(100 + i, f"{docs[i][1]} {items[i][1].upper()} end") for i in range(20)] + [(200, docs[3][1]), (201, items[7][1]), (202, items[7][1]), (203, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    bench = decontaminate.Benchmark(b)
    assert not bench.small and bench.lengths == [10] and bench.windows.count() > 50_000 and bench.broadcast
    split = d.select(decontaminate._digest(d["text"]).alias("digest"), decontaminate.word_hashes(decontaminate.words(d["text"])).alias("h"))
    rows = decontaminate.window_rows(split, bench.lengths)
    assert rows.columns == ["digest", "start", "length", "hash"]
    assert rows.count() == sum(max(0, len((t or "").split()) - 9) for _, t in docs)
    want = brute_hits(docs, items)
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_LIMIT", 0)
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == want
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == sorted(r[0] for r in want if not r[-1])


def test_smoothing_and_threshold_by_hand():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        x = rng.random(n) * 100
        reach = max(1, int(3 * main_text.SIGMA))
        want = []
        for i in range(n):
            near = [(j, math.exp(-0.5 * ((i - j) / main_text.SIGMA) ** 2)) for j in range(n) if abs(i - j) <= reach]
            want.append(sum(w * x[j] for j, w in near) / sum(w for _, w in near))
        assert main_text.smoothed(x) == pytest.approx(want)
    values = np.array([1.0, 1.2, 0.9, 5.0, 5.5, 6.0])
    cut = main_text.threshold(values)
    assert cut == pytest.approx((np.mean([1.0, 1.2, 0.9]) + np.mean([5.0, 5.5, 6.0])) / 2)
    assert main_text.threshold(np.array([2.0, 2.0])) == 2.0


PLAIN = "<body><div class=q1><div class=q2><ul>{menu}</ul></div><div class=q3>Buy it now.</div><div class=q4><h1>Head</h1>{paras}<ul>{menu}</ul></div><div class=q5>Made by us.</div></div>"


def test_the_clusters_decide(monkeypatch):
    page = PLAIN.format(menu="".join(f"<li><a href=x>Item {i}</a></li>" for i in range(8)), paras="".join(f"<p>{i} {LONG}</p>" for i in range(5)))
    want = " ".join(["Head", *(f"{i} {LONG}" for i in range(5))])
    assert main_text.main_text(page) == want
    monkeypatch.setattr(main_text, "threshold", lambda logs: -1.0)
    assert main_text.main_text(page) != want


def shuffled(n):
    rows = corpus(n)
    random.Random(1).shuffle(rows)
    return rows


def test_window_decisions_by_hand(spark):
    rows = shuffled(200)
    model = toxicity.fit([(t, y) for _, t, y in rows])
    import zstandard

    def size(content, window):
        parameters = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters).compress(window))

    scorer = model.scorer()
    for _, text, _ in rows[:6]:
        data = f" {text.lower()} ".encode()
        own = [data[i : i + 80] for i in range(0, max(1, len(data) - 16), 64)]
        gains = [size(model.ordinary, w) - size(model.toxic + model.ordinary, w) for w in own]
        z = model.weights[0]
        for k, least in enumerate(model.gains):
            hits = sum(g >= least for g in gains)
            z += sum(a * b for a, b in zip(model.weights[1 + 3 * k :], (math.log1p(hits), math.log1p(100 * hits / len(own)), float(hits > 0)), strict=False))
        assert model.toxic and scorer(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_what_toxicity_learns_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST", 50)
    docs = spark.createDataFrame([(1, "first text"), (1, "second text"), (2, "x" * 60), (3, None), (6, "same"), (8, "same")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1), (6, 0), (8, 1)], "doc_id long, toxic int")
    once = toxicity.training_rows(docs, labels)
    assert all(toxicity.training_rows(docs.repartition(k), labels) == once for k in (1, 2))
    held = {i for i in range(9) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {t for t, _ in once} <= {"first text", "second text", "same"} and sum(t.endswith(" text") for t, _ in once) == (1 not in held)
    a, b = [("a b c " * 9, 1), ("d e f " * 9, 0)], [("a b c " * 9, 0)]
    assert toxicity.fit(a + b).weights == toxicity.fit(a).weights


def smith_waterman(doc, template):
    """Equal words of the best local alignment, over the whole matrix."""
    best = (0, 0)
    score = [[(0, 0)] * (len(doc) + 1) for _ in range(len(template) + 1)]
    for i, w in enumerate(template, 1):
        for j, v in enumerate(doc, 1):
            same = v == w
            ways = [(score[i - 1][j - 1][0] + (license_scan.MATCH if same else license_scan.MISMATCH), score[i - 1][j - 1][1] + same), (score[i - 1][j][0] + license_scan.GAP, score[i - 1][j][1]), (score[i][j - 1][0] + license_scan.GAP, score[i][j - 1][1])]
            score[i][j] = max(w for w in [*ways, (0, 0)])
            if score[i][j][0] <= 0:
                score[i][j] = (0, 0)
            best = max(best, score[i][j])
    return best


def test_banded_alignment_equals_the_whole_matrix():
    rng = random.Random(5)
    index = license_scan.Index(license_scan.TEMPLATES)
    for _ in range(60):
        t = rng.randrange(len(index.names))
        template = index.tokens[t]
        words = [w for w in template if rng.random() > 0.1]
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), "extra")
        at = rng.randrange(20)
        doc = [f"x{i}" for i in range(at)] + words + [f"y{i}" for i in range(9)]
        _, _, n = license_scan.align(doc, template, at)
        assert n == smith_waterman(doc, template)[1]
        found = license_scan.scan(" ".join(doc), index)
        if n / len(template) >= 0.9 and len(template) >= license_scan.SHORT:
            assert any(m.template == index.names[t] for m in found)


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    passage, notice = " ".join(f"b{i}" for i in range(12)), license_scan.TEMPLATES["GPL-3.0-header"]
    words[140_000:140_000] = passage.split()
    text = " ".join(words) + " " + notice
    docs = spark.createDataFrame([(1, text), (2, text + " tail"), (3, "short")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert (got[1].n_hit, got[2].n_hit, got[3].n_hit) == (12, 12, 0)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [1, 3]
    assert {(r.doc_id, r.license) for r in license_scan.scan_documents(docs).collect()} == {(1, "GPL-3.0-header"), (2, "GPL-3.0-header")}
    assert {r.doc_id: r.tokens for r in mixing.report(docs).collect()}[1] == len(text.split())
    assert toxicity.score(docs, toxicity.fit([(t, y) for _, t, y in shuffled(60)])).count() == 3
    assert main_text.main_text(f"<article><p>{text}</p></article>") == text


# --- the pipeline by plain rules -----------------------------------------------------------------


def plain_topic(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").split()]
    digits = [hashlib.md5(w.encode()).hexdigest()[0] for w in words if len(w) >= 5]
    return "t" + str(sum(1 << p for p in range(3) if 2 * sum(int(d, 16) >> p & 1 for d in digits) > len(digits)))


def plain_mix(rows, targets):
    cell_of = [(s or mixing.NONE, g or mixing.NONE, plain_topic(t)) for _, t, g, s, _ in rows]
    tokens = [len((t or "").split()) for _, t, *_ in rows]
    cells = sorted(set(cell_of))
    own = [sum(n for c, n in zip(cell_of, tokens, strict=True) if c == cell) for cell in cells]
    total = sum(own)
    aims = []
    for d, target in enumerate((targets.source, targets.lang, targets.topic)):
        natural = {}
        for c, n in zip(cells, own, strict=True):
            natural[c[d]] = natural.get(c[d], 0) + n / total
        raw = {v: target.get(v, x) if isinstance(target, dict) else x**target for v, x in natural.items()}
        aims.append({v: x / sum(raw.values()) for v, x in raw.items()})
    w = brute_rake([(*c, n) for c, n in zip(cells, own, strict=True)], aims, 3)
    ratio = [x / n if n else 0.0 for x, n in zip(w, own, strict=True)]
    scale = targets.budget * total
    for _ in range(50):
        rest = sum(x for x, r in zip(w, ratio, strict=True) if r * scale < 1)
        if rest:
            scale = max(scale, (targets.budget * total - sum(n for n, r in zip(own, ratio, strict=True) if r * scale >= 1)) / rest)
    chance = {c: min(1.0, r * scale) for c, r in zip(cells, ratio, strict=True)}
    key = lambda i: "" if i is None else str(i)
    return [r for r, c in zip(rows, cell_of, strict=True) if int(hashlib.md5(key(r[0]).encode()).hexdigest()[:8], 16) / 2**32 < chance[c]]


def test_the_pipeline_equals_plain_rules(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, t, ("en", "de", "fr", None)[i % 4], f"s{i % 3}", len(t)) for i, t, _ in corpus(120)]
    passage = " ".join(f"bench{rng.randrange(99)}" for _ in range(30))
    rows += [(200, rows[1][1], "en", "s0", 0), (201, f"before {passage} after", "de", "s1", 0), (None, rows[2][1] + " tail", None, None, None), (300, None, None, "s2", None), (301, "", "en", None, 0)]
    rows += [(2, "another text under a number that is taken", "en", "s0", 1), (400, "twice the very same row", "fr", "s1", 5), (400, "twice the very same row", "fr", "s1", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    with_clashes(spark.createDataFrame(rows, schema)).write.parquet(f"{tmp_path}/documents.parquet")
    known = [(i, 1, y) for i, _, y in corpus(120)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(0, passage), (1, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    label = {i: y for i, _, y in known if i is not None and y is not None}
    text_of = {i: t for i, t, *_ in sorted(rows[:120], key=lambda r: r[0])}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sample = toxicity.training_rows(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {(t, y) for t, y in sample if t in text_of.values()} <= {(text_of[i], y) for i, y in label.items()}
    scorer = toxicity.fit(sample).scorer()
    stages = [[r for r in rows if scorer(r[1]) < 0.5]]
    group = brute_copies([(k, r[1]) for k, r in enumerate(stages[-1])])
    order = spark.createDataFrame([(k, r[1]) for k, r in enumerate(stages[-1])], "k long, text string").selectExpr("k", "xxhash64(text) AS d")
    digest = {r.k: r.d for r in order.collect()}
    first = {}
    for k, r in enumerate(stages[-1]):
        place = (r[0] is None, r[0] or 0, digest[k], k)
        first[group[k]] = min(place, first.get(group[k], place))
    stages.append([stages[-1][p[3]] for p in first.values()])
    hit = {str(r[0]) for r in brute_hits([(k, r[1]) for k, r in enumerate(stages[-1])], items) if r[-1]}
    stages.append([r for k, r in enumerate(stages[-1]) if str(k) not in hit])
    stages.append(plain_mix(stages[-1], corpus_pipeline.MIX))

    now = docs.select(*corpus_pipeline.COLUMNS)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert now.columns == list(corpus_pipeline.COLUMNS), name
        assert sorted(map(tuple, now.collect()), key=str) == sorted(stages[i], key=str), name
    library = load(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in stages[3]:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [corpus_pipeline.END_ID]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(want, key=str)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    given = [r.doc_id for r in found if r.doc_id is not None]
    assert given == sorted(given)


def test_the_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_templates_of_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("own", "the quick brown fox jumps over the lazy dog by night"), (None, "x"), ("none", None)], "name string, text string")
    templates = license_scan.templates_of(table)
    assert list(templates) == ["own"]
    docs = spark.createDataFrame([(1, "So the quick brown fox jumps over the lazy dog by night.")], "doc_id long, text string")
    assert [(r.license, r.coverage) for r in license_scan.scan_documents(docs, templates).collect()] == [("own", 1.0)]
    monkeypatch.setattr(license_scan, "MOST_TEMPLATE_WORDS", 5)
    with pytest.raises(ValueError):
        license_scan.templates_of(table)
