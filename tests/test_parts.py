"""Correction, geometry, orientation, recognition records, images, stitching and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slips.operators import correct, geometry, images, ocr, orientation, pages, stitching
from slips.plans import batch, receipts
from slips.sources import readers, writers
from slips.streaming import ingest

CORRECTED = {
    "P1220.00": "₱1220.00", "P 45.00": "₱45.00", "P1,220.00": "₱1,220.00", "PDR MLK": "PDR MLK", "PHP 100.00": "PHP 100.00", "PCS 5": "PCS 5", "INTERNATI0NAL": "INTERNATIONAL",
    "2O5": "205", "2068103059163Bitty": "2068103059163 Bitty", "MIN 2501": "MTN 2501", "TOTAL AMOUNT": "TOTAL AMOUNT", "480036140523": "480036140523", "NID05+PDR": "NID05+PDR",
    "SMCITY PAMPANGA": "SMCITY PAMPANGA", "SANFERNANDO": "SANFERNANDO", "1O0A": "100A", "2 x 45.00": "2 × 45.00", "12_34": "12-34", "ID#7": "ID# : 7", "BOOKSTORE": "BOOK STORE",
    "McDonald's": "Mc Donald's", "NO:0919": "NO:0919", "": "", "1l2": "112", "A1B": "AIB",
}
ENHANCED = {
    "TELNO044815-1340": "TEL NO : (044) 815-1340", "LESSBPDISC5%x1220.00": "LESS : BP DISC5% x 1220.00", "**1items **": "** 1 item(s) **", "VAT-12%": "VAT 12%", "PWD ID#000 0031": "PWD ID# : 000 0031",
    "4800 3614-0523": "4800 3614-0523", "PWDID#000 0031 402013135": "PWD ID# : 000 0031 402013135", "Phil logix Systems, Inc.": "Phillogix Systems, Inc.", "Sa lamat Po": "Salamat Po",
    "NID05+PDR MLK2kg": "NIDO5+PDR MLK2kg", "Accred No.:8042": "Acct'd No.:8042", "MOBILE7VIBER NO:0919080-6386": "MOBILE/VIBER NO : 0919 080-6386",
}


@pytest.mark.parametrize(("table", "repair"), [(CORRECTED, correct.correct_line), (ENHANCED, correct.enhance_line)])
def test_rules(spark, table, repair):
    rows = spark.createDataFrame([(k,) for k in table], "x string").select("x", repair(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == table


BOX = "text string, confidence double, bbox array<array<double>>"


def boxed(spark, rows, key=1):
    lines = [(t, c, [[float(a), float(b)], [float(x), float(b)], [float(x), float(y)], [float(a), float(y)]]) for t, c, a, b, x, y in rows]
    return spark.createDataFrame([(key, lines)], f"doc_id long, lines array<struct<{BOX.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>")


def test_geometry(spark):
    rows = [("WALMART", 0.99, 100, 50, 300, 80), ("SUPERCENTER", 0.98, 320, 50, 500, 80), ("ITEM 1", 0.95, 100, 200, 250, 220), ("$5.99", 0.96, 500, 200, 600, 220), ("TOTAL", 0.97, 100, 400, 200, 420), ("$5.99", 0.95, 500, 400, 600, 420)]
    r = geometry.format_receipts(boxed(spark, rows)).first()
    assert r.formatted_text == "WALMART SUPERCENTER\nITEM 1  $5.99\nTOTAL  $5.99"
    assert [(x.columns, x.confidence, x.y_position) for x in r["rows"]] == [(1, 0.985, 50.0), (2, 0.955, 200.0), (2, 0.96, 400.0)]
    assert [(s.type, s.start_row, s.end_row) for s in r.sections] == [("header", 1, 3)]
    assert (r.structure.total_rows, r.structure.rows_with_prices, r.structure.average_items_per_row) == (3, 2, 2.0)


def test_row_anchor_is_the_first_line(spark):
    rows = [("a", 0.9, 0, 0, 10, 20), ("b", 0.9, 20, 12, 30, 32), ("c", 0.9, 40, 24, 50, 44)]
    assert [r.text for r in boxed(spark, rows).select(geometry.rows(F.col("lines")).alias("r")).first().r] == ["a b", "c"]


def test_empty_page(spark):
    r = geometry.format_receipts(boxed(spark, [])).first()
    assert r.formatted_text == "" and r["rows"] == [] and r.sections == []


def test_orientation(spark):
    lines = ["THANK YOU FOR", "a", "b", "c", "d", "JOLLIBEE"]
    rows = spark.createDataFrame([(lines,), (lines[::-1],), (["x"],)], "lines array<string>")
    assert [r[0] for r in rows.select(orientation.text_orientation(F.col("lines"))).collect()] == [180, 0, 0]


def test_recognise_isolates_failures(spark):
    def backend(content):
        if content == b"bad":
            raise ValueError("no picture")
        return [([[0, 0], [9, 0], [9, 9], [0, 9]], content.decode(), 0.9126)] if content else []

    images_ = spark.createDataFrame([(1, bytearray(b"P45.00")), (2, bytearray(b"bad")), (3, bytearray(b""))], "doc_id long, content binary")
    done = ocr.assemble(ocr.recognise(images_, backend).withColumn("processing_time_ms", F.lit(5).cast("long")))
    got = {r.doc_id: r for r in done.collect()}
    assert (got[1].status, got[1].text, got[1].average_confidence) == ("success", "₱45.00", 0.913)
    assert (got[2].status, got[2].error) == ("error", "no picture") and got[3].status == "no_text_found"
    s = batch.batch_summary(done).first()
    assert (s.total_images, s.successful, s.failed, s.total_processing_time_ms) == (3, 1, 2, 5)


def test_merge_passes_a_single_part_through(spark):
    part = "doc_id long, part_no int, status string, lines array<struct<text:string,confidence:double>>, processing_time_ms long"
    rows = [(1, 1, "error", None, 7), (2, 2, "success", [("b", 0.5)], 3), (2, 1, "success", [("a", 1.0)], 2), (2, 3, "error", [("c", 1.0)], 9)]
    got = {r.doc_id: r for r in ocr.merge_results(spark.createDataFrame(rows, part)).collect()}
    assert got[1].status == "error" and got[1].merged_from is None
    assert ([x.text for x in got[2].lines], got[2].average_confidence, got[2].processing_time_ms, got[2].merged_from) == (["a", "b"], 0.75, 5, 3)


def test_image_kernels():
    grey = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    p = images.measure(grey)
    assert (p.width, p.height, p.brightness) == (64, 64, 31.5) and p.shadow > 200
    assert images.rotate(np.array([[1, 2], [3, 4]]), 90).tolist() == [[3, 1], [4, 2]]
    assert images.gamma_correct(np.array([0, 128, 255], np.uint8), 0.45).tolist() == [0, int((128 / 255) ** (1 / 0.45) * 255), 255]
    points = np.array([[10, 0], [0, 0], [0, 5], [10, 5]])
    assert pages.ordered(points).tolist() == [[0, 0], [10, 0], [10, 5], [0, 5]] and pages.sides(pages.ordered(points).astype(float)) == (10, 10, 5, 5)
    fixed, done = images.repair(np.full((700, 700, 3), 30, np.uint8))
    assert "gamma_strong" in done.applied and fixed.shape[0] > 700
    paper = np.zeros((200, 200), np.uint8)
    paper[60:140:4, 60:140] = 255
    box = images.detect_document(paper)
    assert box and box["x1"] <= 0.3 and box["x2"] >= 0.7


def test_stitching(spark):
    r = np.random.default_rng(3)
    long = r.integers(0, 255, (300, 40, 3), dtype=np.uint8)
    rows = [(1, 2, 180, 40, bytearray(long[120:].tobytes())), (1, 1, 150, 40, bytearray(long[:150].tobytes())), (2, 1, 10, 40, bytearray(long[:10].tobytes()))]
    got = {x.doc_id: x for x in stitching.stitch(spark.createDataFrame(rows, "doc_id long, part_no int, height int, width int, data binary"), "concat").collect()}
    assert (got[1].height, got[1].overlap_removed) == (300, 30) and bytes(got[1].data) == long.tobytes()
    assert got[2].error == "1 parts"
    blended = stitching.blend(np.zeros((4, 2, 3), np.uint8), np.full((4, 2, 3), 200, np.uint8), 2)
    assert blended.shape == (6, 2, 3) and blended[2, 0, 0] == 0 and blended[3, 0, 0] == 200


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.jpg").write_bytes(b"\xff\xd8\xff123")
    (tmp_path / "in" / "a.txt").write_text("no")
    found = readers.image_files(spark, str(tmp_path / "in")).collect()
    assert [r.filename for r in found] == ["b.jpg"]
    docs = spark.createDataFrame([(1, ["JOLLIBEE", "TEA  5.00"])], "doc_id long, lines array<string>")
    read = receipts.extract(docs)
    writers.write_receipts(read, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().receipt_type == "fast_food"
    assert '"store_name":"JOLLIBEE"' in writers.as_json(read).first().json


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["JOLLIBEE", "TEA  5.00"]), (2, ["x"])], "doc_id long, lines array<string>")
    docs.write.parquet(str(tmp_path / "in"))
    ingest.start(ingest.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, receipts.extract(docs).select(*got.columns).collect()))
