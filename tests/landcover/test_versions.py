"""Versions that are switched in one step."""

import pytest
from pyspark.sql import functions as F

from landweave.sources import versions


def table(spark, pairs):
    return spark.createDataFrame(list(pairs), "id long, v string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def folders(root):
    return {f"{p.parent.name}/{p.name}" for p in (root / "data").glob("*/*") if p.is_dir()}


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    first = [(i, "a") for i in range(40)] + [(None, "n")]
    assert versions.replace(table(spark, first), root, ["id"], 8) == 1
    before = versions.manifest(spark, root)
    new = [(3, "b"), (100, "b"), (None, "m")]
    assert versions.upsert(table(spark, new), root) == 2
    after = versions.manifest(spark, root)
    touched = {r[0] for r in table(spark, new).select(F.pmod(F.xxhash64("id"), F.lit(8)).cast("string")).distinct().collect()}
    assert {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)} == touched and len(touched) < 8
    want = {k: v for k, v in first} | dict(new)
    assert rows(versions.read(spark, root)) == sorted(want.items(), key=str)
    # The first version is still whole.
    assert rows(versions.read(spark, root, 1)) == sorted(first, key=str)


def test_a_reader_sees_one_whole_version(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace(table(spark, [(1, "a"), (2, "a")]), root, ["id"], 2)
    reader = versions.read(spark, root)
    versions.replace(table(spark, [(3, "b")]), root, ["id"], 2)
    assert rows(reader) == [(1, "a"), (2, "a")] and rows(versions.read(spark, root)) == [(3, "b")]


def test_a_write_that_ends_early_leaves_no_version(spark, tmp_path, monkeypatch):
    root = tmp_path / "t"
    versions.replace(table(spark, [(1, "a")]), str(root), ["id"], 2)

    @F.udf("string")
    def fails(v):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        versions.replace(table(spark, [(2, "b")]).withColumn("v", fails("v")), str(root), ["id"], 2)
    # And between the data and the manifest.
    commit = versions._commit
    monkeypatch.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        versions.upsert(table(spark, [(2, "b")]), str(root))
    monkeypatch.setattr(versions, "_commit", commit)
    assert rows(versions.read(spark, str(root))) == [(1, "a")] and versions.numbers(spark, str(root)) == [1]
    versions.drop_old(spark, str(root), hours=0.0)
    assert folders(root) == set(versions.manifest(spark, str(root))["folders"][b].removeprefix("data/") for b in versions.manifest(spark, str(root))["folders"])


def test_two_writers_of_one_number(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace(table(spark, [(1, "a")]), root, ["id"], 2)
    entry = versions.manifest(spark, root)
    with pytest.raises(versions.Conflict):
        versions._commit(spark, root, entry)
    assert not [p for p in (tmp_path / "t" / "manifests").iterdir() if p.name.startswith("_")]


def test_old_versions_go(spark, tmp_path):
    root = tmp_path / "t"
    versions.replace(table(spark, [(i, "a") for i in range(9)]), str(root), ["id"], 4)
    for v in "bcd":
        versions.upsert(table(spark, [(3, v)]), str(root))
    versions.drop_old(spark, str(root), keep=2)
    assert versions.numbers(spark, str(root)) == [3, 4]
    named = {f.removeprefix("data/") for n in (3, 4) for f in versions.manifest(spark, str(root), n)["folders"].values()}
    assert folders(root) == named
    assert dict(rows(versions.read(spark, str(root), 3)))[3] == "c" and dict(rows(versions.read(spark, str(root))))[3] == "d"
    with pytest.raises(ValueError):
        versions.read(spark, str(root), 1)
    with pytest.raises(ValueError):
        versions.read(spark, str(tmp_path / "none"))


def test_empty_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace(table(spark, []), root, ["id"], 4)
    assert versions.read(spark, root).count() == 0
    versions.upsert(table(spark, [(1, "a"), (1, "b")]), root)
    versions.upsert(table(spark, []), root)
    assert rows(versions.read(spark, root)) == [(1, "a"), (1, "b")]
