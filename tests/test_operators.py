"""Top-k, numbering, salted joins, duplicates, sync and streaming."""

import os
import random

from pyspark.sql import functions as F

from manualdex.operators import duplicates, sync
from manualdex.operators.numbering import number_rows
from manualdex.operators.skew import join_groups
from manualdex.operators.topk import top_k
from manualdex.session import cut_lineage, run_scope
from manualdex.sources import catalog as C
from manualdex.sources import derived as D
from manualdex.streaming import jobs as J


def test_top_k_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v int, id long").repartition(8)
    got = {
        (r["k"], r["rank"]): r["id"]
        for r in top_k(df, [F.col("v").desc(), F.col("id")], 4, by=["k"]).collect()
    }
    want = {}
    for key in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:4]
        want.update({(key, i + 1): r[2] for i, r in enumerate(best)})
    assert got == want


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    got = sorted((r["n"], r["g"], r["v"]) for r in number_rows(df, [F.col("g"), F.col("v")], "n", 5).collect())
    assert [n for n, _, _ in got] == list(range(6, 1006))
    assert [(g, v) for _, g, v in got] == sorted((g, v) for _, g, v in got)


def test_join_groups_equals_plain_join(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 2500).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m")).filter("n > 1")
    got = join_groups(rows, groups, groups, ["k"], "n", "id")
    want = rows.join(groups, "k")
    assert got.exceptAll(want.select(got.columns)).count() == 0
    assert got.count() == want.count()


def test_third_of_all_files_is_one_copy(spark):
    files = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, " Readme.TXT").otherwise(F.concat(F.lit("f"), F.col("id") % 900)).alias("filename"),
        F.concat(F.lit("/lib/"), "id").alias("filepath"),
        F.lit(0).alias("is_cloud"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("content"),
    )
    members = duplicates.members(files).collect()
    assert len(members) == 1000
    assert [r["id"] for r in members if r["is_first"]] == [0]


def test_sync_twice_changes_nothing(spark, sf):
    catalog, listing = D.catalog(spark, sf), D.scan(spark, sf)
    state = sync.sync(catalog, listing, "/lib")
    root = "/tmp/none"
    stored = C.spread(state.select(*sync.STATE)).withColumn("content", F.lit(None).cast("string"))
    again = sync.sync(stored, listing, "/lib")
    assert {r[0] for r in again.select("sync_action").distinct().collect()} == {
        "unchanged", "error_locked",
    }
    assert again.select(*sync.STATE).exceptAll(state.select(*sync.STATE)).count() == 0
    assert sync.missing(stored, listing, root).count() == 0


def test_rows_outside_the_root_stay(spark, sf):
    catalog = D.catalog(spark, sf)
    empty = D.scan(spark, sf).limit(0)
    kept = sync.sync(catalog, empty, "/lib/en")
    assert kept.filter(F.col("filepath").startswith("/lib/en/")).count() == 0
    assert kept.count() == catalog.filter(~F.col("filepath").startswith("/lib/en/")).count()


def test_repair_is_idempotent_and_flagged(spark, sf):
    once = sync.repair(D.old_files(spark, sf), image_queue_done=False)
    twice = sync.repair(once, image_queue_done=True)
    assert once.exceptAll(twice).count() == 0
    meta = spark.createDataFrame([("other", "1")], "key string, value string")
    flags = sync.repair_flags(meta)
    assert C.has_meta(flags, "image_ocr_queue_v13")
    assert sync.repair_flags(flags).count() == flags.count() == 2


def test_stream_in_parts_equals_batch(spark, sf, tmp_path):
    catalog, listing = D.catalog(spark, sf), D.scan(spark, sf)
    listing.repartition(5).write.parquet(str(tmp_path / "listing"))
    parts = (
        spark.readStream.schema(listing.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "listing"))
    )
    got = J.stream_sync(parts, catalog, "/lib", str(tmp_path / "work"))
    want = sync.sync(catalog, listing, "/lib")
    columns = want.columns
    assert got.select(columns).exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_repeated_pages_are_ignored(spark, sf):
    from manualdex.operators import ocr

    files, pages = D.catalog(spark, sf), D.ocr_pages(spark, sf)
    once = ocr.merge(files, pages)
    assert ocr.merge(files, pages.union(pages)).exceptAll(once).count() == 0


def test_long_documents_merge_in_page_order(spark):
    from manualdex.operators import ocr

    files = spark.createDataFrame(
        [(1, "a.tif", ".tif", "ocr_pending", None, "start", 2, 700, None)],
        "id long, filename string, extension string, extraction_status string, "
        "extraction_error string, content string, ocr_page int, ocr_total_pages int, ocr_updated double",
    )
    pages = spark.range(1, 701).select(
        F.lit(1).cast("long").alias("file_id"), F.col("id").cast("int").alias("page"),
        F.lit(700).alias("total_pages"), F.concat(F.lit("p"), "id").alias("text"),
    )
    row = ocr.finish(ocr.merge(files, pages, 5.0), 7.0).first()
    assert row["content"] == "start\n" + "\n".join(f"p{i}" for i in range(3, 701))
    assert (row["extraction_status"], row["ocr_page"], row["ocr_updated"]) == ("ok", 700, 7.0)


def test_rows_below_unread_folders_stay(spark, sf):
    catalog, empty = D.catalog(spark, sf), D.scan(spark, sf).limit(0)
    failed = spark.createDataFrame([("/lib/en/",), ("/lib/d",), ("/elsewhere",)], "path string")
    unread = F.col("filepath").startswith("/lib/en/")
    assert sync.missing(catalog, empty, "/lib", failed).count() == catalog.filter(~unread).count()
    kept = sync.sync(catalog, empty, "/lib", failed)
    assert kept.count() == kept.filter(unread).count() == catalog.filter(unread).count()
    everything = spark.createDataFrame([("/",)], "path string")
    assert sync.missing(catalog, empty, "/lib", everything).count() == 0


def test_stream_without_files(spark, sf, tmp_path):
    catalog, listing = D.catalog(spark, sf), D.scan(spark, sf)
    (tmp_path / "listing").mkdir()
    source = spark.readStream.schema(listing.schema).parquet(str(tmp_path / "listing"))
    kept = J.stream_sync(source, catalog, "/lib", str(tmp_path / "a"))
    assert kept.filter("sync_action = 'kept'").count() == catalog.count()
    dropped = J.stream_sync(source, catalog, "/lib", str(tmp_path / "b"), empty_deletes=True)
    assert dropped.count() == 0
    counts = J.stream_status_counts(
        spark.readStream.schema("extraction_status string").parquet(str(tmp_path / "listing")), str(tmp_path / "c")
    )
    assert counts.count() == 0


def test_micro_batches_do_not_shuffle_the_catalog(spark, sf):
    rows = cut_lineage(D.scan(spark, sf).limit(20).select("filepath", *sync.LISTED))
    plan = sync.classify(D.catalog(spark, sf), rows, "/lib", listed_only=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_published_version_is_the_newest(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.txt", "/a.txt", "some words")], "id long, filename string, filepath string, content string")
    for version in (1, 2):
        C.publish(files.withColumn("content", F.lit(f"text of {version}")), str(tmp_path), version)
    assert C.current_version(spark, str(tmp_path)) == 2
    row = C.read_current(spark, str(tmp_path)).first()
    assert row["content"] == "text of 2" and {"2", "text", "txt", "*"} <= set(row["keys"])


def test_run_scope_removes_what_it_wrote(spark):
    with run_scope(spark) as folder:
        assert cut_lineage(spark.range(5)).count() == 5
        inside = cut_lineage(spark.range(3)).inputFiles()
        assert all(folder in f for f in inside)
    assert not os.path.exists(folder.removeprefix("file:"))
