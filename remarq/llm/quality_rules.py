"""Operator 11: quality rules as a learned decision list, with DataFrame functions only.

Statistics of every text are whole numbers from 0 to 1000. Sequential covering learns rules for documents to leave out from those that
have a label: a rule grows by the threshold that gains most information, until it covers labelled-bad documents alone or gains nothing more; it is pruned
from its end by a fold that it did not grow on; what it covers leaves both folds, and the next one grows. Each rule is a conjunction of thresholds
that a person can read, and the list becomes one ordered ``CASE WHEN``.

Growing needs only histograms: for every statistic and value how many labelled documents of either kind remain, at most 1001 rows a statistic
whatever the number of documents. They are counted where the documents are, so no sample is drawn; statistics and labels are the only rows that move.

A document that fails the base (fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED`` of 100 words in windows of eight words that the text has twice) goes
whatever the list says, and is not learned from.

Defined cases: a null text has no words and fails the base; labels that are null, or of documents that are missing, teach nothing; several labels of a document
count each; repeated rows stay repeated; without bad labels, or without any rule that its fold confirms, the list is empty and keeps all; ties between thresholds go to
the earlier statistic, the smaller value and "at most"; a very long text is an array of words in the task that reads it; empty tables give empty results; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let, once
from ..storage import stored
from .columns import column

LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
#: What words stand between, as a pattern of Java.
SPACES = r"[ \t\n\x0B\f\r]+"
#: Signs that are counted, as classes of a pattern.
SIGNS = {"n_symbols": "#*$%&|<>", "n_upper": "A-Z", "n_digits": "0-9", "n_marks": "!?", "n_stops": ".,;:"}
#: The largest value of a statistic.
TOP = 1000


@dataclass(frozen=True)
class Learning:
    """Settings of the learner."""

    #: Rules of a list, and conditions of a rule, at most.
    rules: int = 12
    conditions: int = 4
    #: Bad documents of the growing fold that a condition must leave covered, and of the pruning fold.
    support: int = 3
    confirmed: int = 2
    #: Least share of bad documents among those that a rule covers in the pruning fold.
    precision: float = 0.95
    #: One of so many documents prunes; the others grow.
    folds: int = 3


@dataclass(frozen=True)
class Condition:
    statistic: str
    #: Above the limit, or else at most.
    above: bool
    limit: int

    def holds(self) -> Column:
        return F.col(self.statistic) > self.limit if self.above else F.col(self.statistic) <= self.limit

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.limit}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    found = F.lit(True)
    for c in rule:
        found = found & c.holds()
    return found


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, counted from 1; 0 where none does."""
    found = None
    for i, rule in enumerate(rules, 1):
        found = F.when(covers(rule), i) if found is None else found.when(covers(rule), i)
    return F.lit(0) if found is None else found.otherwise(0)


def shown(rules: list[Rule]) -> str:
    """The list as SQL: an ordered CASE that says whether a document is kept."""
    return "CASE " + " ".join(f"WHEN {' AND '.join(map(str, r))} THEN false" for r in rules) + " ELSE true END" if rules else "true"


def _windows(w: Column) -> Column:
    """The hashes of the windows of words by their starts: of words, of pairs, of pairs of these. (A slice for every window would copy the
    whole array each time.)"""

    def joined(hashes: Column, far: int) -> Column:
        return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + far))))

    found, width = F.transform(w, lambda x: F.xxhash64(x)), 1
    while width < WINDOW:
        found, width = joined(found, width), 2 * width
    return let(found, lambda h: F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - (WINDOW - 1))))


def _repeated_starts(w: Column, g: Column) -> Column:
    """Starts of windows that the text has twice or more, in order.

    Windows are compared by hash first; only texts with equal hashes sort theirs, and neighbours in that order count if their words are equal."""
    placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("s"))))

    def same(x: Column, y: Column) -> Column:
        words = (F.get(w, x["s"] + i) == F.get(w, y["s"] + i) for i in range(WINDOW))
        return F.coalesce(reduce(Column.__and__, words, x["g"] == y["g"]), F.lit(False))

    def twice(o: Column) -> Column:
        again = F.filter(o, lambda x, i: same(x, F.get(o, i + 1)) | same(x, F.get(o, i - 1)))
        return F.sort_array(F.transform(again, lambda x: x["s"]))

    return F.when(F.size(F.array_distinct(g)) < F.size(g), let(placed, twice)).otherwise(F.array().cast("array<int>"))


def _inside(starts: Column) -> Column:
    """How many words the windows with these starts hold."""
    steps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _share(part: Column, whole: Column) -> Column:
    """Thousandths, rounded down, between 0 and TOP."""
    return F.least(F.lit(TOP), F.coalesce(F.floor(F.try_divide(part * TOP, whole)), F.lit(0))).cast("int")


def statistics() -> dict[str, Column]:
    """By name; every one from 0 to TOP."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "symbols_a_thousand_letters": _share(F.col("n_symbols"), chars),
        "capitals_a_thousand_letters": _share(F.col("n_upper"), chars),
        "marks_a_thousand_letters": _share(F.col("n_marks"), chars),
        "digits_a_thousand_letters": _share(F.col("n_digits"), chars),
        "again_a_thousand_words": _share(F.col("n_again"), n),
        "repeated_a_thousand_words": _share(F.col("n_repeat_words"), n),
        "repeated_a_thousand_lines": _share(F.col("n_dup_lines"), lines),
        "stops_a_thousand_words": _share(F.col("n_stops"), n),
        "letters_a_hundred_words": F.least(F.lit(TOP), F.coalesce(F.floor(F.try_divide(chars * 100, n)), F.lit(0))).cast("int"),
        "words_a_line": F.least(F.lit(TOP), F.coalesce(F.floor(F.try_divide(n, lines)), F.lit(0))).cast("int"),
        "words": F.least(F.lit(TOP), n).cast("int"),
    }


#: In order of preference.
NAMES = tuple(
    """symbols_a_thousand_letters capitals_a_thousand_letters marks_a_thousand_letters digits_a_thousand_letters again_a_thousand_words
    repeated_a_thousand_words repeated_a_thousand_lines stops_a_thousand_words letters_a_hundred_words words_a_line words""".split()
)


def counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed and the statistics; texts are read once."""
    plain = docs.select(column(key).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    words = F.array_remove(F.split("t", SPACES, -1), "")
    signs = {n: F.char_length(F.regexp_replace("t", f"[^{kept}]+", "")).cast("long") for n, kept in SIGNS.items()}
    split = once(plain, w=words, l=lines, **signs).drop("t")
    counted = once(
        split,
        g=_windows(F.col("w")),
        word_chars=F.char_length(F.array_join("w", "")).cast("long"),
        n_words=F.size("w").cast("long"),
        n_lines=F.size("l").cast("long"),
        n_dup_lines=(F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        n_again=F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))),
    ).drop("l")
    full = once(counted, n_repeat_words=let(_repeated_starts(F.col("w"), F.col("g")), _inside)).drop("w", "g")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *(c.alias(n) for n, c in statistics().items()))


def _histograms(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
    """For every statistic and value the numbers of bad and of other rows; at most TOP + 1 values a statistic reach the driver."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(n).alias("v")) for i, n in enumerate(NAMES)))).alias("x")
    found = rows.select("bad", values).groupBy("x.i", "x.v").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    out: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in found:
        out[NAMES[r["i"]]][r["v"]] = (r["p"], r["n"])
    return out


def best_condition(histograms: dict[str, dict[int, tuple[int, int]]], support: int) -> tuple[Condition | None, float]:
    """The threshold with the largest gain of information over all rows, and the share of bad rows that it leaves."""
    best, gain, share = None, 1e-9, 0.0
    for name in NAMES:
        values = sorted(histograms.get(name, {}))
        p_all = sum(p for p, _ in histograms.get(name, {}).values())
        n_all = sum(n for _, n in histograms.get(name, {}).values())
        if not p_all:
            continue
        before = math.log2(p_all / (p_all + n_all))
        p_low = n_low = 0
        for v, after in zip(values, values[1:], strict=False):
            p, n = histograms[name][v]
            p_low, n_low = p_low + p, n_low + n
            for above, bad, good in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if bad >= support and (found := bad * (math.log2(bad / (bad + good)) - before)) > gain + 1e-9:
                    best, gain, share = Condition(name, above, (v + after - 1) // 2 if after > v + 1 else v), found, bad / (bad + good)
    return best, share


def learn(rows: DataFrame, settings: Learning | None = None) -> list[Rule]:
    """The decision list for ``rows``: the statistics, ``bad`` (boolean) and ``fold`` (0 prunes). Every step is one aggregation of rows where they are."""
    s = settings or Learning()
    rules: list[Rule] = []
    while len(rules) < s.rules:
        left = rows.where(verdict(rules) == 0)
        grow, rule = left.where("fold > 0"), ()
        while len(rule) < s.conditions:
            added, share = best_condition(_histograms(grow.where(covers(rule))), s.support)
            if added is None:
                break
            rule = (*rule, added)
            if share == 1.0:
                break
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        of_head = [f(F.col("bad") & covers(h) if bad else ~F.col("bad") & covers(h)) for h in heads for f, bad in ((F.count_if, True), (F.count_if, False))]
        found = left.where("fold = 0").agg(*(c.alias(f"c{i}") for i, c in enumerate(of_head))).first()
        scored = [((found[2 * k] - found[2 * k + 1]) / max(1, found[2 * k] + found[2 * k + 1]), found[2 * k], found[2 * k + 1]) for k in range(len(heads))]
        k = max(range(len(heads)), key=lambda i: (scored[i][0], -i))
        _, bad, good = scored[k]
        if bad < s.confirmed or bad < s.precision * (bad + good):
            break
        rules.append(heads[k])
    return rules


def examples(counted: DataFrame, labels: DataFrame, settings: Learning | None = None, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Labelled rows to learn from: the statistics, ``bad`` and ``fold``. The fold hangs on the id alone."""
    folds = (settings or Learning()).folds
    told = labels.select(column(key).alias("doc_id"), column(label).alias("label")).where("label is not null and doc_id is not null")
    met = counted.where("not base_failed").join(told, "doc_id")
    return met.select(*NAMES, (F.col("label") == 0).alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold"))


def judged(docs: DataFrame, labels: DataFrame, settings: Learning | None = None, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, list[Rule]]:
    """What :func:`counts` gives, with ``rule`` (the rule that leaves the document out, or 0) and ``kept``; and the list."""
    counted = stored(counts(docs, text, key), "quality-counts")
    rules = learn(stored(examples(counted, labels, settings, key), "quality-examples"), settings)
    return counted.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def report(docs: DataFrame, labels: DataFrame, settings: Learning | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule."""
    found, _ = judged(docs, labels, settings, text, key)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
