"""Sinks: files appear when they are asked for, all or none; archives are whole; tasks that fail and come again leave one of each."""

import os
import subprocess
import sys
import textwrap
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspark.sources import sinks

ROWS = [("index.md", "# All\n"), ("a/b.md", "é🙂"), ("a/c/d.md", None), ("a/e.md", ""), ("x" * 120 + ".md", "y" * 100_000), ("größe/ä.md", "1")]


def tree(folder):
    return {os.path.relpath(os.path.join(at, name), folder): open(os.path.join(at, name), encoding="utf-8").read() for at, _, names in os.walk(folder) for name in names}


def test_files_are_written_when_called(spark, tmp_path):
    files = spark.createDataFrame(ROWS, "path string, content string").repartition(3)
    out = tmp_path / "out"
    sizes = sinks.write_files(files, str(out))
    want = {p: c or "" for p, c in ROWS}
    assert tree(out) == want and os.listdir(tmp_path) == ["out"]
    assert {r.path: r.bytes for r in sizes.collect()} == {p: len(c.encode()) for p, c in want.items()}
    sinks.write_files(spark.createDataFrame([("index.md", "new"), ("z.md", "z")], "path string, content string"), "file://" + str(out))
    assert tree(out) == want | {"index.md": "new", "z.md": "z"}
    sinks.write_files(files.where("false"), str(tmp_path / "none"))
    assert tree(tmp_path / "none") == {}


@pytest.mark.parametrize("path", ["../x", "/etc/x", "a/../../x", "a//b", "./a", "", "a/b/.."])
def test_paths_that_leave_the_folder(spark, tmp_path, path):
    df = spark.createDataFrame([("good.md", "g"), (path, "b")], "path string, content string").repartition(2)
    with pytest.raises(Exception, match="leaves"):
        sinks.write_files(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="leaves"):
        sinks.write_zip(df, str(tmp_path / "out.zip"))
    assert os.listdir(tmp_path) == []


def test_paths_that_stand_twice_and_other_file_systems(spark, tmp_path):
    for rows in ([("a", "1"), ("a", "2")], [(None, "1")]):
        for write in (sinks.write_files, sinks.write_zip):
            with pytest.raises(ValueError, match="once or is null"):
                write(spark.createDataFrame(rows, "path string, content string"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="mounted"):
        sinks.write_files(spark.createDataFrame(ROWS, "path string, content string"), "s3://bucket/out")
    assert os.listdir(tmp_path) == []


def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path):
    out = tmp_path / "out"
    sinks.write_files(spark.createDataFrame([("p0.md", "old")], "path string, content string"), str(out))
    bad = spark.range(40).repartition(8).select(F.concat(F.lit("p"), "id", F.lit(".md")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("new").alias("content"))
    for write, to in ((sinks.write_files, out), (sinks.write_zip, tmp_path / "a.zip")):
        with pytest.raises(Exception, match="lost"):
            write(bad, str(to))
    assert tree(out) == {"p0.md": "old"} and os.listdir(tmp_path) == ["out"]


def test_only_attempts_that_count_are_committed(tmp_path):
    writer = sinks.FolderWriter(str(tmp_path / "out"))
    first, again, other = writer.write(iter([("a.md", "cut off")])), writer.write(iter([("a.md", "whole"), ("b.md", "b")])), writer.write(iter([]))
    assert first.attempt != again.attempt
    writer.commit([again, other, None])
    assert tree(tmp_path / "out") == {"a.md": "whole", "b.md": "b"} and os.listdir(tmp_path) == ["out"]
    lost = sinks.FolderWriter(str(tmp_path / "out"))
    lost.write(iter([("c.md", "c")]))
    with pytest.raises(sinks.NotShared):
        lost.commit([sinks.Written("elsewhere", 1, 1)])
    assert tree(tmp_path / "out") == {"a.md": "whole", "b.md": "b"} and os.listdir(tmp_path) == ["out"]


def test_tasks_that_come_again(tmp_path):
    """A session of its own, whose tasks may fail twice: each fails once after it has written."""
    script = f"""
        import sys; sys.path.insert(0, {os.getcwd()!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from loomspark.sources import sinks
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/scratch").getOrCreate()
        def flaky(batches):
            for batch in batches:
                yield batch
            if TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("lost")
        df = spark.range(60).repartition(3).selectExpr("concat('d', id % 7, '/', id, '.md') path", "cast(id as string) content").mapInArrow(flaky, "path string, content string")
        sinks._refuse_twice = lambda files: None  # one job only
        sinks.write_files(df, "{tmp_path}/out")
        print(sinks.write_zip(df, "{tmp_path}/out.zip"))
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    want = {f"d{i % 7}/{i}.md": str(i) for i in range(60)}
    assert tree(tmp_path / "out") == want
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == want and len(z.namelist()) == 60
    assert sorted(x for x in os.listdir(tmp_path) if x != "scratch") == ["out", "out.zip"]


def test_archives(spark, tmp_path):
    at = str(tmp_path / "b.zip")
    assert sinks.write_zip(spark.createDataFrame(ROWS, "path string, content string").repartition(3), at) == len(ROWS)
    with zipfile.ZipFile(at) as z:
        assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == {p: c or "" for p, c in ROWS}
        assert z.namelist() == sorted(z.namelist(), key=str.encode)
    assert sinks.write_zip(spark.createDataFrame([], "path string, content string"), at) == 0
    with zipfile.ZipFile(at) as z:
        assert z.namelist() == []
    many = spark.range(70_000).selectExpr("concat('n/', id) path", "repeat('z', id % 9) content")  # more than a plain directory counts
    assert sinks.write_zip(many, at) == 70_000
    with zipfile.ZipFile(at) as z:
        assert len(z.namelist()) == 70_000 and z.read("n/69998") == b"z" * (69998 % 9)
    assert os.listdir(tmp_path) == ["b.zip"]


def test_members_beyond_four_gigabytes_are_told_in_wide_fields():
    """A directory row with large places, read by the standard library's own reader."""
    import io

    big = sinks._MOST + 5
    row = sinks._entry(b"a", 7, 3, big, big + 11)
    archive = io.BytesIO(row + sinks._end(1, len(row), 0))
    with zipfile.ZipFile(archive) as z:
        info = z.infolist()[0]
    assert (info.filename, info.CRC, info.compress_size, info.file_size, info.header_offset) == ("a", 7, 3, big, big + 11)
    assert sinks._end(70_000, 10, 20).startswith(b"PK\6\6") and sinks._end(2, 10, 20).startswith(b"PK\5\6")
