"""Bucketed tables against upserts of whole tables, and what a change leaves untouched."""

import pathlib
import random

import pytest

from kontor.session import fresh_path
from kontor.sources import snapshots, tables

SCHEMA = "id long, company_name string, city string, status string, created_at string, updated_at string"
KEYS = ["company_name", "city"]


def files(folder):
    return {p for p in pathlib.Path(folder.removeprefix("file:")).rglob("data/**/*.parquet")}


def test_changes_in_a_row_equal_whole_upserts(spark):
    rng = random.Random(4)
    rows = [(k, f"Firma {k}", None if k % 7 == 0 else f"Ort {k % 3}", "alt", "a", "b") for k in range(300)]
    whole = spark.createDataFrame(rows, SCHEMA)
    folder = fresh_path(spark, "snapshot")
    snapshots.create(whole, folder, KEYS, buckets=16)
    for turn in range(3):
        picked = rng.sample(rows, 4)
        changes = spark.createDataFrame([(r[1], r[2] or ("" if turn % 2 else None), f"neu {turn}") for r in picked] + [(f"Neu {turn}", "X", "y"), (f"Neu {turn}", "X", "z")],
                                        "company_name string, city string, status string")
        before = files(folder)
        touched = snapshots.upsert(spark, folder, changes, KEYS, ["status"], f"t{turn}")
        assert touched <= 5
        assert before <= files(folder), "files of older versions stay as they are"
        whole = tables.upsert(whole, changes, KEYS, ["status"], f"t{turn}")
        got = sorted(map(tuple, snapshots.read(spark, folder).collect()), key=str)
        assert got == sorted(map(tuple, whole.select(*[f.name for f in snapshots.read(spark, folder).schema]).collect()), key=str)
    versions = {r.version for r in snapshots.manifest(spark, folder).collect()}
    assert 0 in versions and 3 in versions
    assert sum(r.rows for r in snapshots.manifest(spark, folder).collect()) == 303


def test_repeated_and_failed_versions(spark):
    folder = fresh_path(spark, "snapshot")
    snapshots.create(spark.createDataFrame([], SCHEMA), folder, KEYS, buckets=4)
    assert snapshots.read(spark, folder).collect() == []
    one = spark.createDataFrame([("A", "B", "s")], "company_name string, city string, status string")
    with pytest.raises(ZeroDivisionError):
        snapshots.change(spark, folder, one, KEYS, lambda *_: 1 / 0, version=1)
    # rows written by an attempt that never published its manifest are not seen, and make room for the next attempt
    spark.createDataFrame([(9, "half", "done", "x", "", "", 3)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"{folder}/data/version=1")
    assert snapshots.read(spark, folder).collect() == []
    assert snapshots.upsert(spark, folder, one, KEYS, ["status"], "t", version=1) == 1
    assert snapshots.upsert(spark, folder, one.withColumn("status", one.city), KEYS, ["status"], "t", version=1) == 0
    assert [(r.id, r.company_name, r.status) for r in snapshots.read(spark, folder).collect()] == [(1, "A", "s")]
