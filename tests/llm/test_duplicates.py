import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from remarq.llm import decontaminate, near_copies, simhash
from remarq.llm.components import components


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b, c in enumerate(counts) if 2 * c > len(shingles))


def brute_components(points):
    """point -> smallest key linked, for (key, fingerprint) pairs."""
    parent = {k: k for k, _ in points}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, f in points:
        for j, g in points:
            if (f ^ g).bit_count() <= 3:
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: find(k) for k, _ in points}


def test_masks_cover_every_triple():
    rng = random.Random(0)
    for level in range(simhash.LEVELS):
        masks = simhash.masks(level)
        for _ in range(3000):
            difference = sum(1 << i for i in rng.sample(range(64), 3))
            assert any(difference & m == 0 for m in masks)


def test_three_levels_bound_a_bucket():
    fixed = [a | b | c for a in simhash.masks(0) for b in simhash.masks(1) for c in simhash.masks(2)]
    assert max(64 - m.bit_count() for m in fixed) <= 18


def test_links_equal_brute_force_whatever_the_bucket(spark):
    rng = random.Random(5)
    points = []
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            points.append(center)
            center ^= sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
    points = sorted(set(points))
    df = spark.createDataFrame([(int(np.int64(np.uint64(p))),) for p in points], "fp long")
    want = brute_components([(p, p) for p in points])
    groups = {}
    for p, c in want.items():
        groups.setdefault(c, set()).add(int(np.int64(np.uint64(p))))
    for bucket in (2, 4096):
        found = {}
        for r in components(simhash.links(df, bucket=bucket)).collect():
            found.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def documents():
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 5, 60, 200)))]
        rows.append((3 * i + 2, " ".join(words)))
        for c in range(rng.choice((0, 0, 3))):
            near = list(words)
            if near and c:
                near[rng.randrange(len(near))] = "Other"
            rows.append((1000 + 10 * i + c, "\t".join(near).upper() if c == 2 else "  ".join(near)))
    return [*rows, (5000, None), (5001, ""), (5001, ""), (5002, "É é É " * 20)]


def test_near_duplicates_equal_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "c", "f") for i, t in rows], "doc_id long, text string, component_id string, fp string").repartition(6)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(prints)
    assert got == sorted((i, f"{f:016x}", want[i]) for i, f in prints)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    assert kept == sorted(set(want.values()))


def brute_copies(rows):
    """doc_id -> smallest doc_id linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    sets = []
    for i, t in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append((i, {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}))
    label = {i: i for i, _ in sets}
    for k, a in sets:
        for j, b in sets:
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(label[j], label[k]), min(label[j], label[k])
                label = {x: new if y == old else y for x, y in label.items()}
    return label


def edited(rng, words, share):
    return ["edit%d" % rng.randrange(9999) if rng.random() < share else w for w in words]


def test_near_copies_down_to_four_fifths_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(12):
        base = ["w%d" % rng.randrange(900) for _ in range(rng.choice((3, 8, 100, 300)))]
        rows += [(100 * i + c, " ".join(edited(rng, base, rng.choice((0, 0.01, 0.02, 0.04))))) for c in range(8)]
    large = ["v%d" % rng.randrange(900) for _ in range(80)]
    rows += [(2000 + c, " ".join(edited(rng, large, 0.015))) for c in range(60)]
    rows += [(5000, None), (5001, " "), (5002, "A b"), (5003, "a  B"), (5004, "a b c")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    want = brute_copies(rows)
    points = dict(brute_components([(i, brute_fingerprint(t)) for i, t in rows]))
    assert any(points[i] == i != want[i] for i in want)  # copies that lie beyond three bits
    for few in (10, 0):  # all pairs at once, and rounds first
        monkeypatch.setattr(near_copies, "FEW_PAIRS", few)
        assert dict(map(tuple, near_copies.groups(df).collect())) == want
    assert sorted(r.doc_id for r in near_copies.one_of_each(df).collect()) == sorted(set(want.values()))
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_the_pipeline_drops_copies_beyond_three_bits(spark):
    words = ["w%d" % i for i in range(300)]
    near = ["x" if i % 50 == 20 else w for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(near)]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 3
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.without_copies(spark, df, "").collect()] == [0]


def test_simhash_names_the_first_candidates(spark):
    """A text for each of its fingerprint's others, and links between fingerprints: a multiple of the texts, however many are copies."""
    rows = [(i, 7) for i in range(40)] + [(100 + i, 6) for i in range(5)] + [(200, -1)]
    got = {tuple(r) for r in near_copies._by_simhash(spark.createDataFrame(rows, "id long, fp long")).collect()}
    assert got == {(0, i) for i in range(1, 40)} | {(100, i) for i in range(101, 105)} | {(0, 100)}


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(None, 3), (7, 7)], "a long, b long")
    assert {r.label for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, size=10):
    def words(t):
        return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for j in range(len(w) - n + 1):
            if n:
                windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(g) for g in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    own |= windows[tuple(w[j : j + n])]
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contaminated():
    rng = random.Random(4)
    vocabulary = ["a", "B", "c1", "Ünder", "été", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 4, 10, 13, 30))))) for i in range(12)] + [(77, None), (2, "a b c"), (3, "A, b. C!")]
    docs = []
    for i in range(40):
        words = ["w%d" % rng.randrange(50) for _ in range(rng.choice((0, 3, 40)))]
        if rng.random() < 0.5:
            words[rng.randrange(len(words) + 1) : 0] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, "-".join(words)))
    return [*docs, (5, docs[5][1]), (90, None), (91, ""), (None, items[3][1])], items


def test_contamination_equals_brute_force_on_both_ways(spark, monkeypatch):
    docs, items = contaminated()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, length int")
    want = brute_hits(docs, items)
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == want
    clean = sorted(str(r.doc_id) for r in decontaminate.clean(d, b).collect())
    assert clean == sorted(str(r[0]) for r in want if not r[-1])
    monkeypatch.setattr(decontaminate, "SET_LIMIT", 3)
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == want
    assert sorted(str(r.doc_id) for r in decontaminate.clean(d, b).collect()) == clean
    monkeypatch.undo()
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontaminate.report(d, b.limit(0)).collect()} == {0}
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)


def test_signatures_never_differ_in_more_bits_than_the_sets():
    rng = random.Random(3)
    for _ in range(300):
        whole = np.unique(np.array([rng.getrandbits(63) for _ in range(rng.choice((3, 50, 3000)))], np.int64))
        a, b = (whole[np.array([rng.random() < share for _ in whole])] for share in (0.9, rng.random()))
        x, y = (np.frombuffer(near_copies.signature(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("own_words", [5, 12])
def test_pages_of_one_notice_are_no_candidates(spark, own_words):
    """A notice of 30 words and words of each page's own: similarities of 0.72 and less, and two thousand pages that share a shingle."""
    notice = " ".join(f"n{i}" for i in range(30))
    texts = spark.createDataFrame([(near_copies.node(t), t) for t in (notice + "".join(f" p{i}x{j}" for j in range(own_words)) for i in range(2000))], "id long, t string").repartition(4)
    marks = near_copies._shared(near_copies._marks(texts, *near_copies._common(texts))).withColumn("label", F.col("id"))
    assert near_copies._pairs(marks, None).count() <= 20 * 2000
    assert near_copies.links(texts).count() == 0
    tables = {t.name for t in spark.catalog.listTables()}
    assert near_copies.groups(texts.withColumnsRenamed({"id": "doc_id", "t": "text"})).where("doc_id != component_id").count() == 0
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_a_shared_passage_alone_makes_no_candidates(spark, monkeypatch):
    """A passage of which the sample of common shingles knows nothing, in 300 texts of twice its length: a similarity of 0.29."""
    passage = " ".join(f"n{i}" for i in range(20))
    texts = spark.createDataFrame([(near_copies.node(t), t) for t in (passage + "".join(f" p{i}x{j}" for j in range(20)) for i in range(300))], "id long, t string").repartition(4)
    monkeypatch.setattr(near_copies, "_common", lambda texts: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    made, pairs = [], near_copies._pairs

    def counted(*given):
        out = pairs(*given)
        made.append(out.where("b is not null").count())
        return out

    monkeypatch.setattr(near_copies, "_pairs", counted)
    assert near_copies.links(texts).count() == 0
    assert sum(made) <= 300


def test_rows_of_a_bucket_meet_as_in_plain_pairs():
    rng = np.random.default_rng(4)
    for seed in range(30):
        k = 120
        rows = np.column_stack([rng.integers(0, 4, k), rng.permutation(k), rng.integers(20, 34, k), rng.integers(0, 5, k), rng.integers(0, 2 + seed % 7, k), rng.integers(0, 64, (k, 2)) * -(1 << 58)]).astype(np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        i, j = np.triu_indices(k, 1)
        good = (rows[i, 0] == rows[j, 0]) & near_copies._possible(rows[i], rows[j])
        want = {tuple(p) for p in zip(i[good].tolist(), j[good].tolist(), strict=True)}
        for a, b in want:
            apart = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(rows[a, 5:], rows[b, 5:], strict=True))
            assert 9 * apart <= rows[a, 2] + rows[b, 2] and rows[a, 4] != rows[b, 4]
        found, more = near_copies._met(rows, None)
        got = [tuple(sorted(p)) for a, b in found for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(got) == sorted(want) and not len(more)
        found, more = near_copies._met(rows, 2)
        some = [tuple(sorted(p)) for a, b in found for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(some) == len(set(some)) <= 2 * k and set(some) <= want
        assert {int(rows[a, 0]) for a, _ in want - set(some)} <= set(more.tolist())
