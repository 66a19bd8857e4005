"""Operator 4: mixing sources to target weights, with DataFrame functions only.

Token weights are raked to marginal targets by iterative proportional fitting: documents are summed into cells of
source, language and topic; each step scales the cells so that one dimension's sums meet their target, and
rounds over all dimensions go on until the sums hold. A cell's raked tokens over its own are its
documents' sampling probability, scaled to a token budget and never above 1. A document stays if a hash of
its key lies below its probability, so a sample is the same on every run and every cluster.

Only cells take part in the rounds; documents are read once to count and once to sample. While a count finds
the cells few, a round is three window sums over them in one task, and they meet the documents by broadcast. Beyond
that, sums per value are pre-aggregated before their shuffle and joined, so a source with a third of all
cells makes no large task, and the cells meet the documents by a join.

Tokens and topic are Columns that a caller may give. By default a token is what stands between white space, and a topic is a hashed-term
cluster: every word of five letters and more votes, by its hash, for one side of each of three planes, so texts that share most
of their longer words get the same of eight clusters.

Targets that no weights can meet (a value whose cells have no tokens, sums that contradict each other) end the raking after ``ROUNDS``; the
distance that is left is given back, and a warning names it when it exceeds ``MOST_OFF``, or an error if the targets are strict.

Defined cases: null values of a dimension are a value of their own; null and empty texts have no tokens and
go with their cell's probability; a cell without tokens has probability 0; values that a
target does not name keep their natural share, and all shares are scaled to sum to one; null keys
are hashed like an empty one; repeated rows, and different keys with equal hashes, share their fate; a very long text is one row of
words in the task that reads it; empty tables give empty results; other columns stay as they are, whatever their names
(``mix`` alone puts its own in the place of columns with the same names).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .columns import column, columns, free

NONE = "(none)"
#: Rounds at most, and the largest distance of any sum from its target at which they end.
ROUNDS = 30
TOLERANCE = 1e-10
#: Distance of a sum from its target, as a share of all tokens, beyond which the targets count as not met.
MOST_OFF = 1e-4
#: What words stand between, as a pattern of Java and of RE2; the least letters of a word that votes on the topic; its planes.
SPACES = r"[ \t\n\x0B\f\r]+"
VOTING, PLANES = 5, 3
#: Rounds that make one plan while the cells are few.
ROUNDS_AT_ONCE = 6
#: Cells that fit one task and are sent to every task; about 100 bytes each.
BROADCAST_CELLS = 50_000


@dataclass(frozen=True)
class Targets:
    """For each dimension either shares of its values, or a power: shares in proportion to the natural ones to that power."""

    source: float | dict[str, float] = 0.5
    lang: float | dict[str, float] = field(default_factory=lambda: {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2})
    topic: float | dict[str, float] = 0.7
    #: The sample's expected tokens as a share of all.
    budget: float = 0.5
    #: Whether targets that cannot be met are an error.
    strict: bool = False


DIMENSIONS = ("source", "lang", "topic")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def token_count(text: Column) -> Column:
    """Words between white space: what raking weighs documents by."""
    return F.size(_words(text)).cast("long")


def _side(digits: str) -> list[str]:
    """For every plane the hexadecimal digits that vote for its far side."""
    return ["".join(d for d in digits if int(d, 16) >> p & 1) for p in range(PLANES)]


def hashed_topic(text: Column) -> Column:
    """The cluster of a text's longer words, "t0" to "t7"."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    voting = F.filter(_words(lowered), lambda w: F.length(w) >= VOTING)
    votes = F.array_join(F.transform(voting, lambda w: F.substring(F.md5(w.cast("binary")), 1, 1)), "")
    far = [F.length(votes) - F.length(F.translate(votes, digits, "")) for digits in _side("0123456789abcdef")]
    return F.concat(F.lit("t"), sum((F.when(2 * n > F.length(votes), 1 << p).otherwise(0) for p, n in enumerate(far)), F.lit(0)).cast("string"))


def _value(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NONE))


def _shares(cells: DataFrame, dimension: str, target: float | dict[str, float]) -> DataFrame:
    """value and its target share."""
    natural = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("w").alias("natural"))
    if isinstance(target, dict):
        named = reduce(lambda c, kv: c.when(F.col("value") == kv[0], F.lit(float(kv[1]))), target.items(), F.when(F.lit(False), F.lit(0.0)))
        raw = natural.select("value", F.coalesce(named, F.col("natural")).alias("raw"))
    else:
        raw = natural.select("value", F.pow("natural", F.lit(float(target))).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.join(total, F.lit(True)).select("value", F.expr("coalesce(try_divide(raw, total), 0D)").alias("target"))


def _by_windows(now: DataFrame, aims: dict[str, DataFrame]) -> DataFrame:
    """Some rounds over few cells: window sums in one task, no shuffle between them."""
    for d in DIMENSIONS:
        now = now.join(F.broadcast(aims[d].select(F.col("value").alias(d), F.col("target").alias(f"aim_{d}"))), d)
    now = now.coalesce(1)
    for _ in range(ROUNDS_AT_ONCE):
        for d in DIMENSIONS:
            scale = F.coalesce(F.try_divide(F.col(f"aim_{d}"), F.sum("w").over(Window.partitionBy(d))), F.lit(0.0))
            now = now.withColumn("w", F.col("w") * scale)
    return now.select(*DIMENSIONS, "tokens", "w")


def _by_joins(now: DataFrame, aims: dict[str, DataFrame]) -> DataFrame:
    """One round over any number of cells: sums pre-aggregated before their shuffle, then joined."""
    for d in DIMENSIONS:
        sums = now.groupBy(F.col(d).alias("value")).agg(F.sum("w").alias("sum"))
        scale = sums.join(aims[d], "value").select("value", F.expr("coalesce(try_divide(target, sum), 0D)").alias("scale"))
        now = now.join(scale, F.col(d) == F.col("value")).select(*DIMENSIONS, "tokens", (F.col("w") * F.col("scale")).alias("w"))
    return now


def rake(cells: DataFrame, targets: Targets, few: bool) -> tuple[DataFrame, float]:
    """Cells (source, lang, topic, tokens) with their raked share ``w`` of all tokens, and the largest distance of a sum from its target."""
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("w", F.lit(0.0)), 0.0
    now = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    aims = {d: stored(_shares(now, d, getattr(targets, d)), "targets") for d in DIMENSIONS}
    left = 0.0
    for _ in range(0, ROUNDS, ROUNDS_AT_ONCE if few else 1):
        now = stored(_by_windows(now, aims) if few else _by_joins(now, aims), "raked")
        off = [now.groupBy(F.col(d).alias("value")).agg(F.sum("w").alias("sum")).join(aims[d], "value").select(F.abs(F.col("sum") - F.col("target")).alias("off")) for d in DIMENSIONS]
        left = reduce(DataFrame.union, off).agg(F.max("off")).first()[0]
        if left <= TOLERANCE:
            break
    if left > MOST_OFF:
        said = f"raking ends {left:.2g} of all tokens from its targets: they cannot all be met"
        if targets.strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return now, left


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """Cells with ``probability``: in proportion to raked over own tokens, such that the expected tokens are the
    budget's share of all, and cells that would exceed 1 are taken whole."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    ratio = F.expr("coalesce(try_divide(w, cast(tokens as double)), 0D)")
    scale, before = float(budget * total), None
    for _ in range(ROUNDS):
        whole = ratio * F.lit(scale) >= 1.0
        full, rest, n = raked.agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("w"))), F.count(F.when(whole, 1))).first()
        if n == before or not rest:
            break
        before, scale = n, max(scale, (budget * total - (full or 0)) / rest)
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale)))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the key's MD5."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: What ``mix`` adds.
ADDED = ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "probability", "sampled")


def _mixed(docs: DataFrame, targets: Targets | None, text: str, key: str, source: str, lang: str, topic: Column | None, tokens: Column | None) -> tuple[DataFrame, list[str]]:
    """All rows and columns of ``docs`` and those of ADDED, under the names given back, which clash with none."""
    targets = targets or Targets()
    names = free(docs, *ADDED)
    of_source, of_lang, of_topic, n_tokens, probability, sampled = names
    counted = F.coalesce(tokens.cast("long"), F.lit(0)) if tokens is not None else token_count(column(text))
    marked = docs.withColumns({of_source: _value(column(source)), of_lang: _value(column(lang)), of_topic: _value(hashed_topic(column(text)) if topic is None else topic), n_tokens: counted})
    pairs = dict(zip(names[:3], DIMENSIONS, strict=True))
    cells = stored(marked.groupBy(*(F.col(k).alias(d) for k, d in pairs.items())).agg(F.sum(n_tokens).alias("tokens")), "cells")
    few = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    raked, _ = rake(cells, targets, few)
    chances = probabilities(raked, targets.budget).select(*(F.col(d).alias(k) for k, d in pairs.items()), F.col("probability").alias(probability))
    if few:
        chances = F.broadcast(chances)
    met = marked.join(chances, names[:3], "left").withColumn(probability, F.coalesce(probability, F.lit(0.0)))
    return met.withColumn(sampled, uniform(column(key)) < F.col(probability)), names


def mix(docs: DataFrame, targets: Targets | None = None, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """All rows and columns of ``docs``, and ``mix_source, mix_lang, mix_topic, mix_tokens, probability, sampled``."""
    mixed, names = _mixed(docs, targets, text, key, source, lang, topic, tokens)
    own = [column(c) for c in docs.columns if c.lower() not in ADDED]
    return mixed.select(*own, *(F.col(n).alias(a) for n, a in zip(names, ADDED, strict=True)))


def sample(docs: DataFrame, targets: Targets | None = None, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """The sampled rows of ``docs``, its columns alone."""
    mixed, names = _mixed(docs, targets, text, key, source, lang, topic, tokens)
    return mixed.where(F.col(names[-1])).select(*columns(docs))


def report(docs: DataFrame, targets: Targets | None = None, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Per document: doc_id, source, lang, topic, tokens, probability (six places), sampled."""
    mixed, names = _mixed(docs, targets, text, key, source, lang, topic, tokens)
    own = [F.round(F.col(n), 6) if a == "probability" else F.col(n) for n, a in zip(names, ADDED, strict=True)]
    return mixed.select(column(key).alias("doc_id"), *(c.alias(a.removeprefix("mix_")) for c, a in zip(own, ADDED, strict=True)))


def report_sql(targets: Targets | None = None, rounds: int = 12, scalings: int = 8) -> str:
    """The same rows in DuckDB SQL; a number of rounds that is enough for the sums to hold."""
    targets = targets or Targets()
    split = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    votes = f"array_to_string(list_transform(list_filter({split.format(lowered)}, lambda x: length(x) >= {VOTING}), lambda x: md5(x)[1]), '')"
    far = " + ".join(f"CASE WHEN 2 * (length(votes) - length(translate(votes, '{digits}', ''))) > length(votes) THEN {1 << p} ELSE 0 END" for p, digits in enumerate(_side("0123456789abcdef")))
    parts = [
        f"""d AS MATERIALIZED (SELECT doc_id, source, lang, 't' || CAST({far} AS VARCHAR) AS topic, tokens
  FROM (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {votes} AS votes, len({split.format("coalesce(text, '')")}) AS tokens FROM documents))""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM d) AS w FROM d GROUP BY source, lang, topic)",
    ]
    for d in DIMENSIONS:
        target = getattr(targets, d)
        natural = "sum(w)"
        if isinstance(target, dict):
            cases = " ".join(f"WHEN {d} = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in target.items())
            raw = f"CASE {cases} ELSE {natural} END"
        else:
            raw = f"pow({natural}, {target})"
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, raw / sum(raw) OVER () AS target FROM (SELECT {d}, {raw} AS raw FROM c GROUP BY {d}))")
    last = "c"
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"r{i}_{d}"
            parts.append(f"{name} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, x.tokens, x.w * t.target / sum(x.w) OVER (PARTITION BY x.{d}) AS w FROM {last} x JOIN t_{d} t ON x.{d} = t.{d})")
            last = name
    b = targets.budget
    parts.append(f"s0 AS MATERIALIZED (SELECT {b} * sum(tokens) AS scale FROM c)")
    for i in range(scalings):
        parts.append(
            f"s{i + 1} AS MATERIALIZED (SELECT greatest(max(scale), ({b} * sum(tokens) - coalesce(sum(CASE WHEN w / tokens * scale >= 1 THEN tokens END), 0)) / sum(CASE WHEN w / tokens * scale < 1 THEN w END)) AS scale FROM {last}, s{i} WHERE tokens > 0)"
        )
    parts.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, w / tokens * scale) ELSE 0.0 END AS probability FROM {last}, s{scalings})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.tokens AS BIGINT) AS tokens, round(p.probability, 6) AS probability,"
        " CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < p.probability AS sampled"
        " FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"
    )
