"""Exact cosine search, and greedy leaders of whole tables, against plain rules."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from test_text_and_rows import greedy

from remarq import storage
from remarq.operators import dedup, similar


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def some(n, groups, noise, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, 24))
    x = centers[rng.integers(groups, size=n)] + noise * rng.normal(size=(n, 24))
    x[5] = x[9] = x[3]
    x[12] = x[11] = 0.0
    return x


@pytest.mark.parametrize("n, groups, noise, theta", [(500, 500, 0.0, 0.3), (1200, 30, 0.1, 0.9), (300, 3, 0.02, 0.97)])
def test_pairs_and_links_are_all_there_are(spark, n, groups, noise, theta):
    x = some(n, groups, noise)
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    close = unit @ unit.T >= theta - 1e-12
    np.fill_diagonal(close, False)
    df = frame(spark, x)
    got = {(r.a, r.b): r.cosine for r in dedup.similar_pairs(df, theta, block=128).collect()}
    assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(close))), strict=True))
    assert all(abs(c - unit[a] @ unit[b]) < 1e-9 for (a, b), c in got.items())
    links = {r.vec_id: (r.class_id, r.n_links) for r in dedup.similar_links(df.where("vec_id not in (11, 12)"), theta, block=128).collect()}
    assert {k: n for k, (_, n) in links.items()} == {k: int(close[k].sum()) for k in links}
    assert links[9][0] == links[5][0] == 3


def test_grouped_vectors_meet_few_others(spark):
    """Pairs in tiles at two sizes of the same density of groups: they grow as the rows, not as their square."""
    held = []
    for n in (1000, 4000):
        _, classes, width = dedup._distinct_vectors(frame(spark, some(n, n // 40, 0.05)), "vec_id", "embedding")
        ready = classes.select("k", F.lit("").alias("g"), F.lit(True).alias("serves"), F.lit(True).alias("asks"), "v")
        met, every = similar.work(similar.placed(ready, similar.cells(classes, width), 0.95))
        assert met < 0.1 * every
        held.append(met)
    assert held[1] < 8 * held[0]


@pytest.mark.parametrize("theta, prefix, copies", [(0.86, 20, 1), (0.81, 40, 3), (0.93, 1, 1)])
def test_leaders_of_a_whole_table_follow_the_plain_rule(spark, theta, prefix, copies):
    rng = random.Random(prefix)
    words = ["w%d" % i for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + ("!" if i % 5 == 0 else "") for i in range(260)]
    texts += [t.replace(" ", "") for t in texts[:30]] + texts[40:60] * copies  # equal hashes of other vectors, and copies
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "a") for i, t in rows] + [(1000 + i, t, "b") for i, t in rows[:15]], "seq long, cleaned_content string, task_id string").repartition(5)
    found = dedup.near(df, theta, most=prefix).collect()
    assert {r.seq: r.leader_seq for r in found if r.task_id == "a"} == greedy(rows, theta)
    assert {r.seq: r.leader_seq for r in found if r.task_id == "b"} == greedy([(1000 + i, t) for i, t in rows[:15]], theta)
    own = {r.seq: r for r in found}
    assert all(r.duplicate_group_id == own[r.seq if r.leader_seq is None else r.leader_seq].content_hash[:12] for r in found)


def test_chains_take_as_many_rounds_as_they_are_long(spark):
    """Each vector is close to its neighbours alone: every other one leads."""
    angle = np.arange(14) * 0.4
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    keyed = spark.createDataFrame([("t", i, f"h{i}", v.tolist()) for i, v in enumerate(x)], "task string, seq long, content_hash string, embedding array<double>")
    got = {r.seq: r.leader_seq for r in dedup.leaders(keyed, float(np.cos(0.5)), prefix=1).collect()}
    assert got == {i: None if i % 2 == 0 else i - 1 for i in range(14)}


def test_nothing_is_near_nothing(spark):
    empty = spark.createDataFrame([], "seq long, cleaned_content string, task_id string")
    assert dedup.near(empty, 0.9).collect() == []
    assert dedup.similar_pairs(spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<double>"), 0.5).collect() == []


@pytest.mark.parametrize("groups, noise, theta, few", [(1500, 0.0, 0.3, True), (40, 0.05, 0.95, False)])
def test_cells_that_spare_nothing_are_not_made(spark, groups, noise, theta, few):
    """Random directions would be copied to every cell; groups keep their cells."""
    df = frame(spark, some(1500, groups, noise, seed=3))
    _, classes, width = dedup._distinct_vectors(df, "vec_id", "embedding")
    ready = classes.select("k", F.lit("").alias("g"), F.lit(True).alias("serves"), F.lit(True).alias("asks"), "v")
    own = similar.placed(ready, into := similar.cells(classes, width, theta), theta)
    assert own.count() < 3 * classes.count()
    assert (len(into.points) == 1) == few


def test_placed_rows_leave_in_bounded_batches():
    """However many cells a row goes to."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    part = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([""] * 1500), *[pa.array([True] * 1500)] * 2, pa.array([v.tobytes() for v in x], pa.binary())], names=["k", "g", "serves", "asks", "v"])

    class Rows:  # what placed() asks of a table
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter([part])))

    out = similar.placed(Rows(), similar.Cells(x[:60], np.full(60, 2.0)), 0.3)
    assert max(p.num_rows for p in out) <= similar.PLACED
    assert sum(p.num_rows for p in out) > 10 * 1500
    assert pa.Table.from_batches(out).filter(pa.compute.field("role") == similar.HOME).num_rows == 1500


def shuffled_rows(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_are_not_copied_once_a_block(spark):
    """Random directions lie in one cell of 20 blocks, of which all pairs meet: rows are shuffled once, not once a tile."""
    rng = np.random.default_rng(4)
    rows = similar.units(frame(spark, rng.normal(size=(1000, 24))).select(F.col("vec_id").alias("k"), F.lit("").alias("g"), F.lit(True).alias("serves"), F.lit(True).alias("asks"), F.col("embedding").alias("v")), 24)
    rows = storage.stored(rows, "rows")
    into = similar.cells(rows, 24, 0.9)
    assert len(into.points) == 1
    before = shuffled_rows(spark)
    assert similar.earliest(similar.placed(rows, into, 0.9), 24, 0.9, block=50).collect() == []
    assert shuffled_rows(spark) - before < 3 * 1000


def test_rounds_leave_nothing_but_leaders_behind(spark):
    def folders():
        files, path = storage.open_fs(storage.shared_root(spark) + f"/remarq/{spark.sparkContext.applicationId}")
        return [f.base_name for f in files.get_file_info(storage.pafs.FileSelector(path, allow_not_found=True))]

    angle = np.arange(10) * 0.4
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    nodes = spark.createDataFrame([(i, "t", f"h{i}", v.tobytes()) for i, v in enumerate(x)], "k long, g string, hash string, v binary")
    before = set(folders())
    led = similar.led(nodes, similar.Cells(x[:1], np.full(1, 2.0)), float(np.cos(0.5)))
    left = {f.rsplit("-", 1)[0] for f in set(folders()) - before}
    assert sorted(r.k for r in led.collect()) == [0, 2, 4, 6, 8]
    assert left <= {"undecided", "leaders"}
