"""Numbers of rows hang on files alone, not on how they are split."""

import pytest

from remarq.sources import files, order


@pytest.fixture
def table(tmp_path):
    folder = tmp_path / "x.csv"
    folder.mkdir()
    rows = [(f"f{f}-{i}", "text " * (i % 7)) for f in range(3) for i in range((300, 40, 900)[f])]
    for f in range(3):
        (folder / f"part-{f}.csv").write_text("comment_id,comment_text\n" + "".join(f'{a},"{b}""q"""\n' for a, b in rows if a.startswith(f"f{f}-")))
    return str(folder), [a for a, _ in rows]


@pytest.mark.parametrize("size", ["512", "4k", "128m"])
def test_the_same_numbers_for_all_splits(spark, table, size):
    path, ids = table
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        raw = files.read_rows(spark, path, places=True)
        assert raw.rdd.getNumPartitions() > (20 if size == "512" else 0)
        assert [r.comment_id for r in order.numbered(raw).orderBy("seq").collect()] == ids
        some = files.comments_from_file(spark, path, 333).orderBy("seq").collect()
        assert [r.id for r in some] == ids[:333] and [r.seq for r in some] == list(range(333))
        plan = order.numbered(raw, first=5)._jdf.queryExecution().toString()
        assert "GlobalLimit" not in plan and "SinglePartition" not in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_line_breaks_in_fields_are_kept(spark, tmp_path):
    path = tmp_path / "y.csv"
    path.write_text('id,content\n1,"a\nb"\n2,"c ""d"""\n')
    assert files.holds_line_breaks(spark, str(path))
    assert [(r.seq, r.id, r.content) for r in files.comments_from_file(spark, str(path)).orderBy("seq").collect()] == [(0, "1", "a\nb"), (1, "2", 'c "d"')]
    path = tmp_path / "z.csv"
    path.write_text('id,content\n1,"a ""b"" c"\n2\n\n3,d,e\n')
    assert not files.holds_line_breaks(spark, str(path))
    assert [(r.id, r.content) for r in files.comments_from_file(spark, str(path)).orderBy("seq").collect()] == [("1", 'a "b" c'), ("2", ""), ("3", "d")]


def test_json_lists_and_lines(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"comments": [{"id": 1, "text": "x"}, {"id": 2}, {"text": "z", "other": [1]}]}')
    assert [(r.seq, r.content) for r in files.comments_from_file(spark, str(path), 2).orderBy("seq").collect()] == [(0, "x"), (1, "")]
    path = tmp_path / "b.jsonl"
    path.write_text('{"id": 1, "text": "x"}\n\n{"id": 2, "extra": {"a": 1}, "text": "y"}\n')
    assert [(r.seq, r.id, r.content) for r in files.comments_from_file(spark, str(path)).orderBy("seq").collect()] == [(0, "1", "x"), (1, "2", "y")]
