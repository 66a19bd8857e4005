"""Exact and near duplicates of comments: flagged, never removed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.bind import once
from ..storage import stored
from . import similar

#: The near-dup threshold of each entry point.
THRESHOLD = 0.92
#: Rows that are compared with the leaders at once.
BLOCK = 256
#: Comments of a task that are settled in one group: the limit of a run's configuration.
MOST_ROWS = 5000


def exact(df: DataFrame, body: str = "cleaned_content") -> DataFrame:
    """``content_hash``, ``is_duplicate`` and ``duplicate_group_id`` by hash alone, over the whole table.

    The first row of every hash comes from an aggregation that combines before its shuffle; a text that a third of all rows share costs one
    row per task there, and the join that hands it back is one that adaptive execution splits. It reads ``df`` twice: give it a stored table.
    """
    hashed = df if "content_hash" in df.columns else df.withColumn("content_hash", text.content_hash(F.col(body)))
    first = hashed.groupBy("content_hash").agg(F.min("seq").alias("__first"))
    met = hashed.join(first, "content_hash")
    return met.withColumns({"is_duplicate": F.col("seq") != F.col("__first"), "duplicate_group_id": F.when(F.col("seq") != F.col("__first"), text.group_id(F.col("content_hash")))}).drop("__first")


def _greedy(ids: np.ndarray, hashes: np.ndarray, vectors: np.ndarray, theta: float) -> np.ndarray:
    """For rows in order, the place of the leader that claims each, or -1 for leaders: a leader with its hash, else the
    earliest leader whose cosine reaches ``theta``."""
    n = len(ids)
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms == 0, 1.0, norms)[:, None]
    of = np.full(n, -1, np.int64)
    by_hash: dict[str, int] = {}
    leaders: list[int] = []
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        before = np.array(leaders, np.int64)
        near = unit[start:stop] @ unit[before].T >= theta - 1e-12 if len(before) else np.zeros((stop - start, 0), bool)
        inner = unit[start:stop] @ unit[start:stop].T >= theta - 1e-12
        fresh: list[int] = []
        for i in range(start, stop):
            if (found := by_hash.get(hashes[i])) is None:
                row = near[i - start]
                if row.any():
                    found = int(before[row.argmax()])
                else:
                    found = next((j for j in fresh if inner[i - start, j - start]), None)
            if found is None:
                by_hash[hashes[i]] = i
                fresh.append(i)
                leaders.append(i)
            else:
                of[i] = found
    return of


def near(df: DataFrame, theta: float = THRESHOLD, task: str = "task_id", body: str = "cleaned_content", most: int = MOST_ROWS) -> DataFrame:
    """Hash and cosine duplicates inside every task, in order of ``seq``: is_duplicate, leader_seq, and duplicate_group_id, the leader's.

    Whom a leader claims depends on all rows before. A task of ``most`` rows or fewer is one group, and tasks are spread over the cluster. Larger ones, up to one
    task for a whole table, are settled by rounds over the rows that are undecided, see :func:`leaders`. Cleaned texts are hashed and embedded once.
    """
    return settled(df.withColumns({"content_hash": text.content_hash(F.col(body)), "embedding": text.embedding(F.col(body))}), theta, task, most)


def settled(df: DataFrame, theta: float = THRESHOLD, task: str = "task_id", most: int = MOST_ROWS) -> DataFrame:
    """:func:`near` of rows that have ``content_hash`` and ``embedding`` already. All columns are written to the shared folder: leave out texts that nobody reads afterwards."""
    ready = stored(once(df, **{_TASK: F.coalesce(F.col(task).cast("string"), F.lit(""))}), "embedded")
    keyed = ready.select(F.col(_TASK).alias("task"), "seq", "content_hash", "embedding")
    large = keyed.groupBy("task").count().where(F.col("count") > most).select("task")
    if large.isEmpty():
        claims = _in_groups(keyed, theta)
    else:
        large = stored(large, "large-tasks")
        claims = _in_groups(keyed.join(large, "task", "left_anti"), theta).unionByName(leaders(keyed.join(large, "task", "left_semi"), theta, most))
    claims = claims.select(F.col("task").alias(_TASK), "seq", "leader_seq", "leader_hash")
    met = ready.join(claims, [_TASK, "seq"]).drop(_TASK)
    found = met.withColumns({"is_duplicate": F.col("leader_seq").isNotNull(), "duplicate_group_id": text.group_id(F.coalesce("leader_hash", "content_hash"))})
    return found.drop("leader_hash")


_TASK = "__task"


def _in_groups(keyed: DataFrame, theta: float) -> DataFrame:
    """task, seq, leader_seq, leader_hash: every task by the plain rule, in one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("seq", kind="stable")
        vectors = np.array(rows["embedding"].tolist(), float).reshape(len(rows), -1)
        seq, hashes = rows["seq"].to_numpy(), rows["content_hash"].to_numpy()
        of = _greedy(seq, hashes, vectors, theta)
        leader = pd.array([seq[i] if i >= 0 else None for i in of], dtype="Int64")
        return pd.DataFrame({"task": rows["task"].to_numpy(), "seq": seq, "leader_seq": leader, "leader_hash": [hashes[i] if i >= 0 else None for i in of]})

    return keyed.groupBy("task").applyInPandas(run, "task string, seq long, leader_seq long, leader_hash string")


def leaders(keyed: DataFrame, theta: float, prefix: int = MOST_ROWS, block: int = similar.BLOCK) -> DataFrame:
    """The same for tasks of any size: task, seq, leader_seq, leader_hash of rows ``task, seq, content_hash, embedding``.

    Rows of equal hash and vector are one node, at the place of the first. The first ``prefix`` nodes of a task are settled in one group, since nothing that follows
    matters to them, and whatever their leaders are close to is decided; in a task of many copies that leaves little. The rest is settled by rounds of exact searches. A row then belongs to the leader
    with its hash, if that comes before it, else to the earliest leader that is close to it.
    """
    width = keyed.agg(F.max(F.size("embedding"))).first()[0] or 1
    unit = similar.units(keyed.select(F.col("task").alias("g"), F.col("seq"), F.col("content_hash").alias("hash"), F.col("embedding").alias("v")), width).withColumn("d", F.md5("v"))
    rows = stored(unit.select("g", "hash", "d", "seq"), "rows")
    nodes = stored(unit.groupBy("g", "hash", "d").agg(F.min("seq").alias("k"), F.min_by("v", "seq").alias("v")), "nodes")  # vectors lie here alone; what is told of nodes has none
    first = nodes.select("g", "k").withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("k"))).where(F.col("place") <= prefix)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("k", kind="stable")
        of = _greedy(own["k"].to_numpy(), own["hash"].to_numpy(), np.frombuffer(b"".join(own["v"]), float).reshape(len(own), width), theta)
        return pd.DataFrame({"k": own["k"].to_numpy(), "leads": of < 0})

    early = stored(nodes.join(first.select("k"), "k", "left_semi").select("g", "k", "hash", "v").groupBy("g").applyInPandas(run, "k long, leads boolean"), "first-nodes")
    into = similar.cells(nodes, width, theta)
    marked = nodes.join(early, "k", "left")
    claimed = similar.met(marked.select("k", "g", F.coalesce("leads", F.lit(False)).alias("serves"), F.col("leads").isNull().alias("asks"), "v"), into, theta, block)
    hashes = nodes.select("k", "g", "hash").join(early.where("leads"), "k", "left_semi").select("g", "hash").distinct()
    open_ = nodes.join(early, "k", "left_anti").join(claimed, "k", "left_anti").join(hashes, ["g", "hash"], "left_anti")
    later = similar.led(open_, into, theta, block)
    led = stored(early.where("leads").select("k").union(later), "all-leaders", instead_of=later)
    asks = nodes.select("k", "g", "v").join(led.withColumn("leads", F.lit(True)), "k", "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    near_ = similar.met(asks.select("k", "g", F.col("leads").alias("serves"), (~F.col("leads")).alias("asks"), "v"), into, theta, block).withColumnRenamed("least", "near")
    leading = nodes.select("k", "g", "hash").join(led, "k", "left_semi")
    by_hash = leading.select("g", "hash", F.col("k").alias("of_hash"))
    node = nodes.select("g", "hash", "d", "k").join(near_, "k", "left").drop("k")
    met = rows.join(node, ["g", "hash", "d"]).join(by_hash, ["g", "hash"], "left")
    leader = F.when(F.col("of_hash") < F.col("seq"), F.col("of_hash")).when(F.col("of_hash").eqNullSafe(F.col("seq")), F.lit(None)).otherwise(F.col("near"))
    told = met.select(F.col("g").alias("task"), "seq", leader.alias("leader_seq"))
    names = leading.select(F.col("g").alias("task"), F.col("k").alias("leader_seq"), F.col("hash").alias("leader_hash"))
    return told.join(names, ["task", "leader_seq"], "left").select("task", "seq", "leader_seq", "leader_hash")


def _distinct_vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """Every key's class (the smallest key with its vector), and the classes as rows to be placed."""
    plain = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and v is not null")
    width = plain.agg(F.max(F.size("v"))).first()[0] or 1
    own = stored(similar.units(plain, width).withColumn("d", F.md5("v")), "unit-vectors")
    classes = stored(own.groupBy("d").agg(F.min("k").alias("k"), F.min_by("v", "k").alias("v"), F.count("*").alias("n")), "vector-classes")
    return own.select("k", "d").join(classes.select("d", F.col("k").alias("class"), "n"), "d").select("k", "class", "n"), classes, width


def class_pairs(classes: DataFrame, width: int, theta: float, block: int = similar.BLOCK) -> DataFrame:
    """a, b, cosine of different vectors that are close enough, each by its class."""
    ready = classes.select("k", F.lit("").alias("g"), F.lit(True).alias("serves"), F.lit(True).alias("asks"), "v")
    return similar.pairs(similar.placed(ready, similar.cells(classes, width, theta), theta), width, theta, block)


def similar_pairs(df: DataFrame, theta: float, key: str = "vec_id", vector: str = "embedding", block: int = similar.BLOCK) -> DataFrame:
    """All pairs (a < b) of vectors whose cosine reaches ``theta``: different vectors meet in :mod:`similar`'s cells and tiles, then classes of equal ones are written out.

    Rows without a key or a vector take no part. What comes out grows with the square of a class; :func:`similar_links` does not write classes out.
    """
    of, classes, width = _distinct_vectors(df, key, vector)
    found = class_pairs(classes, width, theta, block)
    one, other = (of.select(F.col("class").alias(c), F.col("k").alias(f"k_{c}")) for c in ("a", "b"))
    across = found.join(one, "a").join(other, "b").select("k_a", "k_b", "cosine")
    same = of.where("n > 1")
    zero = classes.where(F.expr("v != cast(repeat(char(0), octet_length(v)) as binary)")).select(F.col("k").alias("class"))
    inside = same.join(zero, "class", "left_semi")
    twice = inside.select("class", F.col("k").alias("k_a")).join(inside.select("class", F.col("k").alias("k_b")), "class").where("k_a < k_b").select("k_a", "k_b", F.lit(1.0).alias("cosine"))
    every = across.unionByName(twice) if theta <= 1 + similar.SLACK else across
    return every.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"), "cosine").distinct()


def similar_links(df: DataFrame, theta: float, key: str = "vec_id", vector: str = "embedding", block: int = similar.BLOCK) -> DataFrame:
    """A row per key: its class (the smallest key with the same vector) and ``n_links``, how many other keys are close enough to it."""
    of, classes, width = _distinct_vectors(df, key, vector)
    found = class_pairs(classes, width, theta, block)
    both = found.select(F.col("a").alias("k"), F.col("b").alias("other")).union(found.select("b", "a"))
    sizes = classes.select(F.col("k").alias("other"), "n")
    linked = both.join(sizes, "other").groupBy(F.col("k").alias("class")).agg(F.sum("n").alias("near"))
    return of.join(linked, "class", "left").select(F.col("k").alias(key), F.col("class").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"))


def earlier_near(df: DataFrame, theta: float, group: str, body: str = "cleaned_content") -> DataFrame:
    """For every row whether an earlier row of its group has a cosine of ``theta`` or more; a window over the group's earlier vectors."""
    ready = df.withColumn("embedding", text.embedding(F.col(body)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values("seq", kind="stable")
        unit = np.array(rows["embedding"].tolist(), float).reshape(len(rows), -1)
        norms = np.linalg.norm(unit, axis=1)
        unit /= np.where(norms == 0, 1.0, norms)[:, None]
        found = np.zeros(len(rows), bool)
        for start in range(0, len(rows), BLOCK):
            own = unit[start : start + BLOCK]
            for other in range(0, start + BLOCK, BLOCK):
                close = own @ unit[other : other + BLOCK].T >= theta
                places = np.arange(other, min(len(rows), other + BLOCK))[None, :] < np.arange(start, start + len(own))[:, None]
                found[start : start + len(own)] |= (close & places).any(axis=1)
        return pd.DataFrame({"seq": rows["seq"].to_numpy(), "near_earlier": found})

    return ready.select(F.col(group).alias("g"), "seq", "embedding").groupBy("g").applyInPandas(run, "seq long, near_earlier boolean")


def group_sizes(df: DataFrame) -> DataFrame:
    """Hashes that several rows share: size, first seq."""
    return df.groupBy("content_hash").agg(F.count("*").alias("n_rows"), F.min("seq").alias("first_seq")).where("n_rows > 1")

