"""Commits: killed writers, concurrent ones, and many of them."""

from __future__ import annotations

import threading

import pytest

from stockcast.sources import snapshots

SCHEMAS = {"run": "id string, n long", "score": "id string, v double"}


def add(spark, name):
    """Replaces the runs by themselves and one more, and adds its scores."""

    def change(held):
        one = spark.createDataFrame([(name, 1)], SCHEMAS["run"])
        return {"run": held["run"].unionByName(one)}, {"score": spark.createDataFrame([(name, 0.5), (name, 1.5)], SCHEMAS["score"])}, name

    return change


def names(spark, root):
    number, _, held = snapshots.read(spark, root, SCHEMAS)
    return number, sorted(r["id"] for r in held["run"].collect()), sorted(r["id"] for r in held["score"].collect())


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert names(spark, root) == (0, [], [])
    assert snapshots.commit(spark, root, SCHEMAS, add(spark, "a")) == "a"

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        snapshots.commit(spark, root, SCHEMAS, add(spark, "b"), after_write=die)
    assert names(spark, root) == (1, ["a"], ["a", "a"])
    (tmp_path / "registry" / "commit" / ".left").write_text("half a commi")
    snapshots.commit(spark, root, SCHEMAS, add(spark, "c"))
    assert names(spark, root) == (2, ["a", "c"], ["a", "a", "c", "c"])
    assert snapshots.commit(spark, root, SCHEMAS, lambda held: ({}, {}, "nothing")) == "nothing" and names(spark, root)[0] == 2


def test_the_second_of_two_writers_starts_again(spark, tmp_path):
    root, turns = str(tmp_path / "registry"), []

    def other():
        if not turns:
            turns.append(1)
            snapshots.commit(spark, root, SCHEMAS, add(spark, "first"))

    snapshots.commit(spark, root, SCHEMAS, add(spark, "second"), after_write=other)
    assert names(spark, root) == (2, ["first", "second"], ["first", "first", "second", "second"])
    assert len(list((tmp_path / "registry" / "data").iterdir())) == 4  # what the lost try wrote is gone


def test_concurrent_writers_all_stay(spark, tmp_path):
    root = str(tmp_path / "registry")
    threads = [threading.Thread(target=snapshots.commit, args=(spark, root, SCHEMAS, add(spark, f"t{k}"))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert names(spark, root) == (4, [f"t{k}" for k in range(4)], sorted([f"t{k}" for k in range(4)] * 2))


def test_a_number_is_claimed_once_and_tries_end(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "registry")
    assert snapshots._claim(spark, root, 1, {}) and not snapshots._claim(spark, root, 1, {"run": []})
    monkeypatch.setattr(snapshots, "TRIES", 2)
    monkeypatch.setattr(snapshots, "_claim", lambda *a: False)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, SCHEMAS, add(spark, "a"))


def test_many_folders_are_written_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 2)
    root = str(tmp_path / "registry")
    for k in range(4):
        snapshots.commit(spark, root, SCHEMAS, add(spark, f"t{k}"))
    assert len(snapshots.read(spark, root, SCHEMAS)[1]["score"]) == 2 and len(names(spark, root)[2]) == 8
