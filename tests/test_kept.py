"""Kept trails, and facts exactly once."""

import os

import pytest

from roadpulse.operators import operations
from roadpulse.sinks import exactly_once, kept_trail

STEPS = "log_id bigint, step bigint, name string, is_insert boolean"


def steps(spark, rows):
    return spark.createDataFrame(rows, STEPS)


def trails(df):
    return sorted(map(tuple, df.select("log_id", "process_log", "process_status", "n_steps").collect()))


def test_increments_equal_one_fold(spark, tmp_path):
    rows = [(i % 40, i // 40, f"s{i // 40}", i < 35) for i in range(240)]
    path = str(tmp_path / "kept")
    for part in (rows[::3], rows[1::3], [], rows[1::3], rows[2::3]):
        kept_trail.merge_steps(steps(spark, part), path, parts=8)
    assert trails(kept_trail.kept_trails(spark, path)) == trails(operations.process_trail(steps(spark, rows)))
    want = sorted(map(tuple, operations.process_log_orphans(steps(spark, rows)).collect()))
    assert sorted(map(tuple, kept_trail.kept_orphans(spark, path).select("log_id", "n_updates").collect())) == want
    assert len(want) == 5


def test_partitions_without_new_steps_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "kept")
    files = lambda: {(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    kept_trail.merge_steps(steps(spark, [(i, 0, "a", True) for i in range(200)]), path, parts=8)
    before = files()
    kept_trail.merge_steps(steps(spark, [(7, 1, "b", False)]), path, parts=8)
    gone, made = before - files(), files() - before
    assert len({d for d, _ in gone}) == len({d for d, _ in made}) == 1
    assert kept_trail.kept_trails(spark, path).count() == 200


def facts(spark, low, high):
    return spark.range(low, high).selectExpr("id", "cast(id * 2 as string) as text")


FACTS = "id bigint, text string"


def read(spark, path, under=None):
    return sorted(r.id for r in exactly_once.read_committed(spark, f"{path}/commits", FACTS, under).collect())


def test_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    write = exactly_once.committed_batches(f"{path}/commits", [(f"{path}/a", exactly_once.save_parquet)])
    assert read(spark, path) == []
    commit = exactly_once._commit
    monkeypatch.setattr(exactly_once, "_commit", lambda *_: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError):
        write(facts(spark, 0, 10), 0)
    monkeypatch.setattr(exactly_once, "_commit", commit)
    assert read(spark, path) == [] and len(os.listdir(f"{path}/a")) == 1
    for batch_id in (0, 0, 1):
        write(facts(spark, batch_id * 10, batch_id * 10 + 10), batch_id)
    assert read(spark, path) == list(range(20)) and len(os.listdir(f"{path}/a")) == 3


def test_a_batch_that_moves_to_the_second_place(spark, tmp_path):
    path = str(tmp_path)

    def breaks_off(batch, folder):
        exactly_once.save_parquet(batch, folder)
        raise OSError("down")

    places = [(f"{path}/a", breaks_off), (f"{path}/b", exactly_once.save_parquet)]
    exactly_once.committed_batches(f"{path}/commits", places)(facts(spark, 0, 5), 0)
    assert read(spark, path) == read(spark, path, f"{path}/b") == list(range(5)) and read(spark, path, f"{path}/a") == []
    with pytest.raises(OSError):
        exactly_once.committed_batches(f"{path}/commits", places[:1])(facts(spark, 5, 9), 1)
    assert read(spark, path) == list(range(5))


def test_the_first_commit_of_a_batch_stands(spark, tmp_path):
    commits = str(tmp_path / "commits")
    for folder in ("x", "y"):
        exactly_once._commit(spark, commits, 3, folder)
    assert exactly_once.committed_folders(spark, commits) == ["x"]
    assert [f for f in os.listdir(commits) if not f.endswith(".crc")] == ["batch-3.json"]
