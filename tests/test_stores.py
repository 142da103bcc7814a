"""Stores with versions and loops that go on after they died, against plain dictionaries."""

import random

import pytest

from tessera.operators import keyed, levels
from tessera.sources import files

SCHEMA = "id long, name string, n int"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_and_deletes(spark, tmp_path):
    store, want, dice = keyed.Store(spark, str(tmp_path / "s"), "id", SCHEMA, buckets=8), {}, random.Random(1)
    assert store.read().count() == 0 and store.versions() == []
    snapshots = {}
    for k in range(4):
        rows = [(dice.choice([*range(40), None]), f"v{k}", j) for j in range(30)]
        assert store.upsert(rows_of(spark, rows), ["n"]) == len(store.versions())
        for i, name, n in rows:
            want[i] = (i, name, n)
        gone = [(dice.choice([*range(40), None]), None, None) for _ in range(5)]
        store.delete(rows_of(spark, gone))
        for i, *_ in gone:
            want.pop(i, None)
        assert held(store.read()) == sorted(want.values(), key=str)
        snapshots[store.versions()[-1]] = sorted(want.values(), key=str)
    for version, rows in snapshots.items():
        assert held(store.read(version)) == rows
    some = [i for i in want][:3] + [None, 999]
    assert held(store.get(some)) == sorted((v for i, v in want.items() if i in some), key=str)
    store.upsert(rows_of(spark, []))
    assert held(store.read()) == sorted(want.values(), key=str)
    store.vacuum(keep=2)
    assert len(store.versions()) == 2 and held(store.read()) == sorted(want.values(), key=str)
    store.clear()
    assert store.read().count() == 0 and held(store.read(store.versions()[-2])) == sorted(want.values(), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = keyed.Store(spark, str(tmp_path / "s"), "id", SCHEMA, buckets=32)
    store.upsert(rows_of(spark, [(i, "x" * 50, i) for i in range(4000)]))
    whole = files.size(spark, str(tmp_path / "s/data/version=1"))
    store.upsert(rows_of(spark, [(7, "changed", 0)]))
    assert len(files.names(spark, str(tmp_path / "s/data/version=2"))) <= 2  # the bucket, the marker
    assert files.size(spark, str(tmp_path / "s/data/version=2")) < whole / 10
    assert store.get([7]).first()["name"] == "changed" and store.read().count() == 4000


def test_a_commit_that_dies_counts_for_nothing(spark, tmp_path):
    store = keyed.Store(spark, str(tmp_path / "s"), "id", SCHEMA, buckets=4)
    store.upsert(rows_of(spark, [(1, "a", 1), (2, "b", 2)]))
    before = held(store.read())
    broken = rows_of(spark, [(1, "z", 0)]).selectExpr("id", "if(n = 0, raise_error('dead'), name) as name", "n")
    with pytest.raises(Exception, match="dead"):
        store.upsert(broken)
    assert held(store.read()) == before
    with pytest.raises(ValueError, match="doesn't touch"):
        store.rewrite(rows_of(spark, [(1, "", 0)]), lambda old: rows_of(spark, [(k, "", 0) for k in range(50)]))
    assert held(store.read()) == before
    store.upsert(rows_of(spark, [(2, "c", 3)]))
    store.vacuum(keep=1)
    assert held(store.read()) == [(1, "a", 1), (2, "c", 3)]


def brute_components(edges):
    label = {n: n for n, _ in edges}
    while True:
        hub = {}
        for n, h in edges:
            hub[h] = min(hub.get(h, label[n]), label[n])
        new = {n: min([label[n]] + [hub[h] for m, h in edges if m == n]) for n in label}
        if new == label:
            return label
        label = new


def test_a_loop_goes_on_where_it_died(spark, tmp_path, monkeypatch):
    chain = [(n, f"h{k}") for k in range(12) for n in (k, k + 1)] + [(100, "x"), (101, "x")] + [(n, "hot") for n in range(200, 400)] + [(500, "alone")]
    random.Random(2).shuffle(chain)
    edges = spark.createDataFrame(chain, "node long, hub string")
    whole = {r[0]: r[1] for r in levels.components(edges, levels.Levels(spark, str(tmp_path / "whole"))).collect()}
    assert whole == brute_components(chain)

    commit, made = levels.Levels._commit, []

    def dying(self, level, rows):
        if level == 5 and 5 not in made:
            made.append(5)
            rows.write.parquet(f"{self.folder}/level=5/_temporary_rest")
            raise RuntimeError("killed")
        made.append(level)
        return commit(self, level, rows)

    monkeypatch.setattr(levels.Levels, "_commit", dying)
    loop = levels.Levels(spark, str(tmp_path / "killed"))
    with pytest.raises(RuntimeError):
        levels.components(edges, loop)
    assert loop.committed()[-1] == 4
    assert {r[0]: r[1] for r in levels.components(edges, levels.Levels(spark, str(tmp_path / "killed"))).collect()} == whole
    assert made[:7] == [0, 1, 2, 3, 4, 5, 5] and len(set(made)) == len(made) - 1
    assert len(loop.committed()) == 2
    loop.clear()
    assert loop.committed() == []
