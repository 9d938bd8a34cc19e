import random

from manualdex.operators import ocr, pages

FILES = "id long, filename string, extension string, content string, extraction_status string, extraction_error string, ocr_page int, ocr_total_pages int, ocr_updated double"


def books(spark, rng):
    files, rows = [], []
    for i in range(30):
        saved = rng.choice([0, 0, 2])
        before = "kept text" * rng.randint(0, 4) if saved else None
        status = rng.choice(["ocr_pending", "ocr_processing", "ok"])
        files.append((i, f"b{i}.tif", ".tif", before, status, None, saved, 9, None))
        n = rng.choice([0, 3, 9, 600 if i == 4 else 5])
        delivered = [(i, p, n, rng.choice(["", None, "é" * rng.randint(1, 70), f"page {p} 𝄞"])) for p in range(1, n + 1)]
        rows += delivered + rng.sample(delivered, min(2, n))
    rows.append((99, 1, 1, "no such file"))
    rng.shuffle(rows)
    return spark.createDataFrame(files, FILES), spark.createDataFrame(rows, "file_id long, page int, total_pages int, text string")


def test_spans_cut_the_pages_out_of_the_merged_text(spark):
    files, delivered = books(spark, random.Random(3))
    merged = {r.id: r.content for r in ocr.merge(files, delivered, 0.0).collect()}
    texts = {(r.file_id, r.page): r.p.text for r in ocr.fresh_pages(files, delivered).collect()}
    spans = pages.page_spans(files, delivered).collect()
    assert {(r.file_id, r.page) for r in spans} == {k for k, t in texts.items() if t}
    assert all(merged[r.file_id][r.start : r.end] == texts[r.file_id, r.page] for r in spans)


def test_chunks_name_all_pages_they_touch(spark):
    files, delivered = books(spark, random.Random(8))
    merged, spans = ocr.merge(files, delivered, 0.0), pages.page_spans(files, delivered)
    of_file = {}
    for r in spans.collect():
        of_file.setdefault(r.file_id, []).append((r.page, r.start, r.end))
    rows = pages.chunks_with_pages(merged, spans, 64).collect()
    assert rows
    for r in rows:
        a, b = r.chunk_index * 64, r.chunk_index * 64 + 64
        touched = [p for p, start, end in of_file.get(r.file_id, []) if start < b and end > a]
        assert (r.page_number, r.last_page) == ((min(touched), max(touched)) if touched else (None, None))


def test_page_of_a_place(spark):
    spans = spark.createDataFrame([(1, 1, 1, 40), (1, 2, 41, 300), (1, 9, 301, 310)], "file_id long, page int, start long, end long")
    places = spark.createDataFrame([(1, p, "x") for p in (None, 0, 1, 39, 40, 41, 299, 305, 310)] + [(2, 5, "x")], "file_id long, place int, page_label string")
    got = {(r.file_id, r.place): r.page for r in pages.page_at(places, spans, 100).collect()}
    assert got == {(1, None): None, (1, 0): None, (1, 1): 1, (1, 39): 1, (1, 40): None, (1, 41): 2, (1, 299): 2, (1, 305): 9, (1, 310): None, (2, 5): None}
