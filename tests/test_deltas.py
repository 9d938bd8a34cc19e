import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from manualdex.operators import status as S
from manualdex.sources import deltas

SCHEMA = "id long, filename string, filepath string, extension string, extraction_status string, content string"
STATUSES = [None, "", "ok", "error", "pending", "ocr_pending", "unsupported"]


def frame(spark, rows):
    return spark.createDataFrame([(i, *v) for i, v in rows.items()], SCHEMA)


def row(rng, i):
    ext = rng.choice([".pdf", ".txt", ".jpg"])
    return f"f{i}{ext}", f"/lib/{i}", ext, rng.choice(STATUSES), rng.choice([None, "", f"text {rng.random()}"])


def plain(df):
    return {r.id: tuple(r)[1:] for r in df.select("id", "filename", "filepath", "extension", "extraction_status", "content").collect()}


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def check(spark, root, want, version=None):
    got = deltas.read(spark, root, version)
    assert plain(got) == want and got.count() == len(want)
    files, tally = frame(spark, want), deltas.tally(spark, root, version)
    assert same(deltas.status_counts(tally), S.counts(files))
    assert same(deltas.database_summary(tally), S.summary(files))
    assert same(deltas.ocr_pending_count(tally), S.ocr_pending_count(files))
    assert same(deltas.analysis_counters(tally), S.analysis_counters(files))


def test_versions_equal_full_rewrites(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path)
    state = {i: row(rng, i) for i in range(60)}
    deltas.create(frame(spark, state), root)
    history = {1: dict(state)}
    for step in range(4):
        changed = {i: row(rng, i) for i in rng.sample(range(80), rng.randint(0, 9))}
        removed = rng.sample(range(90), rng.randint(0, 6))
        entry = deltas.commit(
            spark, root, frame(spark, changed), spark.createDataFrame([(i,) for i in removed], "id long"),
            most_removed=14 if step > 1 else 1000,
        )
        for i in removed:
            state.pop(i, None)
        state |= changed
        history[entry.version] = dict(state)
        check(spark, root, state)
    assert deltas.at_version(spark, root).base > 1
    for version, want in list(history.items())[:3]:
        check(spark, root, want, version)
    deltas.compact(spark, root)
    check(spark, root, state)


def test_bytes_written_follow_the_changes(spark, tmp_path):
    root = str(tmp_path)
    files = spark.range(3000).select(
        "id", F.format_string("f%s.txt", "id").alias("filename"), F.format_string("/lib/%s", "id").alias("filepath"),
        F.lit(".txt").alias("extension"), F.lit("ok").alias("extraction_status"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha1((F.col("id") * 100 + i).cast("string"))), " ").alias("content"),
    )
    deltas.create(files, root)
    deltas.commit(spark, root, files.filter("id = 7").withColumn("content", F.lit("new")), spark.range(9, 10).toDF("id"))
    size = lambda name: sum(p.stat().st_size for p in Path(root, name).rglob("*.parquet"))
    assert size("changes") + size("removed") < size("version=00000001") / 100
    got = deltas.read(spark, root)
    assert got.count() == 2999 and got.filter("id = 7").first().content == "new"
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_two_writers_and_missing_versions(spark, tmp_path):
    root, rng = str(tmp_path), random.Random(5)
    none = spark.createDataFrame([], "id long")
    deltas.create(frame(spark, {}), root)
    deltas.commit(spark, root, frame(spark, {1: row(rng, 1)}), none)
    with pytest.raises(deltas.VersionTaken):
        deltas._log(spark, root, deltas.Version(2, 1, 0))
    with pytest.raises(ValueError):
        deltas.read(spark, root, 9)
    assert deltas.read(spark, root, 1).count() == 0 and deltas.read(spark, root).count() == 1
