"""Operators 11 to 13 against plain versions, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from remarq.llm import hard_negatives, quality_rules, turn_repair

# --- 11: quality rules -------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def some_texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "ga#mma", "de|lta", "é", "zwölf", "x"]
    out = [None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 40, "l1\nl1\n\nl1\r\nl1", "   word"]
    for _ in range(120):
        body = [rng.choice(words) + str(rng.randrange(6)) for _ in range(rng.randrange(90))]
        if rng.random() < 0.5 and len(body) > 12:
            body += body[2:12]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in body))
    return out


def test_base_counts_equal_plain_ones(spark):
    texts = some_texts() + ["word%d " * 3 % (1, 2, 3) * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_rules.counts(docs).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def plain_list(rows, s):
    """The same covering by trying every threshold on the rows themselves."""
    rules, left = [], rows

    def holds(rule, r):
        return all((r[c.statistic] > c.limit) == c.above for c in rule)

    while len(rules) < s.rules:
        grow, rule = [r for r in left if r["fold"]], ()
        while len(rule) < s.conditions:
            here = [r for r in grow if holds(rule, r)]
            bad = sum(r["bad"] for r in here)
            best, most = None, 1e-9
            for name in quality_rules.NAMES if bad else ():
                values = sorted({r[name] for r in here})
                for v, after in zip(values, values[1:]):
                    for above in (False, True):
                        p = sum(r["bad"] for r in here if (r[name] > v) == above)
                        n = sum(not r["bad"] for r in here if (r[name] > v) == above)
                        if p >= s.support and (gain := p * (math.log2(p / (p + n)) - math.log2(bad / len(here)))) > most + 1e-9:
                            best, most, pure = quality_rules.Condition(name, above, (v + after - 1) // 2 if after > v + 1 else v), gain, n == 0
            if best is None:
                break
            rule = (*rule, best)
            if pure:
                break
        if not rule:
            break

        def worth(k):
            p = sum(r["bad"] for r in left if not r["fold"] and holds(rule[:k], r))
            n = sum(not r["bad"] for r in left if not r["fold"] and holds(rule[:k], r))
            return (p - n) / max(1, p + n), -k, p, n

        _, k, p, n = max(map(worth, range(1, len(rule) + 1)))
        if p < s.confirmed or p < s.precision * (p + n):
            break
        rules.append(rule[:-k])
        left = [r for r in left if not holds(rule[:-k], r)]
    return rules


def test_the_list_is_what_plain_covering_learns(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(900):
        r = {n: rng.randrange(12) for n in quality_rules.NAMES}
        r["bad"] = (r["words"] > 8 and r["words_a_line"] <= 4) or r["symbols_a_thousand_letters"] > 9
        if rng.random() < 0.01:
            r["bad"] = not r["bad"]
        rows.append({**r, "fold": rng.randrange(3)})
    kinds = ", ".join(f"{n} int" for n in quality_rules.NAMES) + ", bad boolean, fold int"
    df = spark.createDataFrame([tuple(r[n] for n in (*quality_rules.NAMES, "bad", "fold")) for r in rows], kinds).repartition(3)
    for s in (quality_rules.Learning(precision=0.8), quality_rules.Learning(precision=0.8, conditions=1), quality_rules.Learning(rules=1, precision=0.8)):
        rules = quality_rules.learn(df, s)
        assert rules == plain_list(rows, s)
    assert len(quality_rules.learn(df, quality_rules.Learning(precision=0.8))) >= 2
    # the ordered CASE says the same as the conditions
    rules = quality_rules.learn(df, quality_rules.Learning(precision=0.8))
    by_sql = df.select(F.expr(quality_rules.shown(rules)).alias("k"), quality_rules.verdict(rules).alias("v")).where("k != (v = 0)")
    assert by_sql.count() == 0


def test_rules_hold_on_labels_that_were_not_seen(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found, rules = quality_rules.judged(spark.read.parquet(f"{d}/documents.parquet"), seen)
    assert rules
    rows = found.join(held, "doc_id").select("kept", "quality", "base_failed").collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in bad) >= 0.95 * len(bad)
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


def test_rules_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "w " * 30, 1), (2, "a b c d e f " * 5 + "g", 0)], "doc_id long, text string, n_words int")
    nothing = spark.createDataFrame([], "doc_id long, quality int, w string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in quality_rules.report(docs, nothing).collect())
    assert got == [(0, 30, True, False), (1, 0, True, False), (1, 0, True, False), (2, 31, True, False)]
    assert quality_rules.report(docs.limit(0), nothing).collect() == []
    told = spark.createDataFrame([(None, 0), (2, None), (7, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    assert quality_rules.report(docs, told).count() == 4


# --- 12: hard negatives ------------------------------------------------------------------------


def plain_negatives(rows, w=hard_negatives.Wanted()):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, own), own)
    out = set()
    for a, (label, q) in best.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, of) for i, (of, p) in best.items() if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][: w.positives]:
            fit = [x for x in scored if x[2] != label and w.least * -s <= 100 * -x[0] <= w.most * -s]
            out |= {(a, i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit[: w.negatives])}
    return out


def vectors(n, groups, seed, spread_=0.02):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, 16))
    at = rng.integers(groups, size=n)
    points = np.round(centers[at] + spread_ * rng.normal(size=(n, 16)), 3)
    return [(int(i), int(rng.integers(4)), points[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("n, groups, chunk", [(700, 700, 512), (700, 5, 4), (300, 300, 1), (40, 3, 8)])
def test_negatives_equal_plain_ones(spark, n, groups, chunk):
    rows = vectors(n, groups, n + groups)
    rows += [rows[0], rows[50 % n], (50, 0, rows[3][2]), (n + 1, None, rows[1][2]), (n + 2, 1, None), (n + 3, 1, [None] * 16), (n + 4, 1, [float("nan")] * 16), (n + 5, 2, [float("inf")] + [0.0] * 15), (None, 1, rows[2][2])]
    rows += [(n + 6, 1, []), (n + 7, 2, [1.0, 2.0]), (n + 8, 3, rows[4][2]), (n + 9, 3, rows[4][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    exact = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()]
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * 256).cast("double")))
    got = hard_negatives.mine(hard_negatives.rows_of(df, "vec_id", own, whole), F.col("id") % 50 == 0, chunk=chunk)
    assert {tuple(r) for r in got.collect()} == plain_negatives(exact)
    if chunk == 512:
        assert {tuple(r) for r in hard_negatives.report(df).collect()} == plain_negatives(exact)


def test_bounds_spare_most_scores_of_dense_groups():
    rng = np.random.default_rng(1)
    centers = 100 * rng.normal(size=(6, 16))
    anchors = np.repeat(centers, 10, axis=0) + rng.normal(size=(60, 16))
    rows = np.repeat(centers, 500, axis=0) + rng.normal(size=(3000, 16))
    chunk = hard_negatives.Chunk(anchors)
    for v, at, s in chunk.scan(rows, lambda v, low, high: (high >= 0.5 * (limit := anchors[v] @ anchors[v])) & (low <= 0.95 * limit)):
        true = rows @ anchors[v]
        limit = anchors[v] @ anchors[v]
        wanted = set(np.flatnonzero((true >= 0.5 * limit) & (true <= 0.95 * limit)))
        assert wanted <= set(at)
        assert np.allclose(s, true[at])
    assert chunk.scored < 0.5 * (chunk.scored + chunk.bounded)


def test_a_spanning_tree_is_the_shortest():
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(40, 3)), 2)
    order, parent, length = hard_negatives.spanning_tree(points)
    far = np.linalg.norm(points[:, None] - points[None], axis=2)
    of, total = list(range(40)), 0.0  # Kruskal
    for d, i, j in sorted((far[i, j], i, j) for i in range(40) for j in range(i)):
        if of[i] != of[j]:
            total += d
            of = [of[i] if x == of[j] else x for x in of]
    assert abs(length.sum() - total) < 1e-9
    assert all(parent[v] < 0 or order.index(parent[v]) < order.index(v) for v in range(40))


def test_negatives_of_nothing(spark):
    assert hard_negatives.report(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).collect() == []
    one = spark.createDataFrame([(50, 1, [1.0]), (51, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.report(one).collect() == []


# --- 13: conversations -------------------------------------------------------------------------


def plain_turns(rows):
    """Damage by its definition."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """Forward over all rows and states, with the whole letters and lines so far."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "f" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    ask = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}

    def with_insertions(states):
        for _ in range(3):
            for q, (cost, said, lines) in list(states.items()):
                t, name = ask[q]
                states[t] = min(states.get(t, (math.inf,)), (cost + 2, said + "I", (*lines, f"{name}:")))
        return states

    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(turns, faults):
        after = {}
        for q, (cost, said, lines) in with_insertions(states).items():
            options = [(q, cost + 3, "D", lines)]
            if fault in "ft":
                more = cost + (fault == "t")
                if (q, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    options.append((role[:1], more, "K", (*lines, f"{role}:{text}")))
                options.append((ask[q][0], more + 2, "R", (*lines, f"{ask[q][1]}:{text}")))
            for t, c, letter, out in options:
                after[t] = min(after.get(t, (math.inf,)), (c, said + letter, out))
        states = after
    final = with_insertions(states)
    cost, said, lines = min(final[q] for q in ("", "a") if q in final)
    known = {t for t, _, _ in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, said, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def odd_turns(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = ["Hi.", "Hi", "", " ", "What?", None, "a\n", "b. ", " ", "x" * 50]
    return [(rng.choice([None, 1, 2, 3]) if i % 3 else 7, rng.choice([None, *range(60)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"No. {rng.randrange(500)}" + rng.choice([".", "", "!"])) for i in range(n)]


@pytest.mark.parametrize("block", [1, 4, 64])
def test_repair_equals_plain_one(spark, block, monkeypatch):
    monkeypatch.setattr(turn_repair, "LEAST_BLOCK", block)
    monkeypatch.setattr(turn_repair.math, "isqrt", lambda n: 1)
    rows = odd_turns(900, block) + [(8, None, None, None), (9, 3, "user", "A."), (9, 3, "user", "A."), (10, 5, "user", "word " * 200_000 + "end.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.report(df).collect()}
    assert got == {c: plain_repair(t) for c, t in plain_turns(rows).items()}


def test_repaired_turns_are_what_the_digest_is_of(spark):
    rows = odd_turns(300, 5)
    df = turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns, told = turn_repair.repaired(df), turn_repair.figures(df)
    lines = defaultdict(list)
    for r in turns.orderBy("conv_id", "step").collect():
        lines[r["conv_id"]].append((r["role"], r["text"]))
    for r in told.collect():
        own = lines[r["conv_id"]]
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in own))
    letters = defaultdict(str)
    for r in turn_repair.edits(df).orderBy("conv_id", "step").collect():
        letters[r["conv_id"]] += r["edit"]
    assert letters == {r["conv_id"]: r["audit"] for r in told.collect() if r["audit"]}


def test_repair_of_dropped_and_missing_rows(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "a.", 5)], "conv_id long, turn long, role string, text string, cost int")
    assert [tuple(r) for r in turn_repair.report(df).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert turn_repair.report(df.limit(0)).collect() == []
    assert turn_repair.figures(turn_repair.plain(df)).collect()[0]["audit"] == "KI"
