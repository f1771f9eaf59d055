"""Cheap tests that stand before costly patterns let through all that the patterns would change or find."""

import itertools

from pyspark.sql import functions as F

from slips.functions import patterns as P
from slips.functions.text import either, let, rx
from slips.operators import classify, correct, geometry, ocr, orientation
from slips.session import GROWTH, spread

ODD = [
    None, "", " ", "GRAND TOTAL 5.00", "P5.00", "P 1,220.50", "xP 5.00", "¥5.00", "2 x 3", "2 X 3", "12_3", "2O5", "3l4", "٣O٤", "A0B", "É1É", "ABCdef", "abCd", "SANFernando", "BOOKSTORE",
    "HEALTHCARE", "1234Ab", "MIN : 5", "ADMIN", "ID#7", "Sa lamat", "tele phone", "TELE PHONE", "inter national", "INTER\nNATIONAL", "plain text", "LONELY 12.50",
]


def test_lines_that_need_no_correction_are_told_apart(spark):
    lines = ODD + [f"{a}{b}" for a, b in itertools.product(ODD[3:], ODD[3:])]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    plain = correct.rewrite(correct.confusions(correct.rewrite(F.col("x"), P.CORRECT_SYMBOLS)), P.CORRECT_WORDS)
    got = df.select("x", correct.correct_line(F.col("x")).alias("got"), plain.alias("want"), correct.may_need(F.col("x")).alias("may")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and sum(r["want"] != r["x"] for r in got if r["x"]) > 100
    assert {r["x"]: r["may"] for r in got if r["x"] in ("plain text", "LONELY 12.50")} == {"plain text": False, "LONELY 12.50": False}


def test_chains_are_found_in_any_spelling(spark):
    texts = [None, "", "mercury \n drug", "Mercury", "ſhopwiſe", "burger King", "mını", "jollibee", "jollİbee", "JOLLıBEE", "kfc", "KFCS", "Kfc", "mcdonalds", "MCDONALD'S", "s&r\tmembership", "rustan's", "straße", "the landmark", "İPUREGOLD"]
    df = spark.createDataFrame([([x, "end"],) for x in texts], "l array<string>")
    block = lambda b: F.coalesce(*[F.when(b.rlike(rx(either(chains))), name) for name, (chains, _) in classify.SIGNATURES.items()])
    got = df.select(classify.by_chain(F.col("l")).alias("got"), let(F.array_join("l", "\n"), block).alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and sum(r["want"] is not None for r in got) >= 12
    assert classify.needed(r"A\s+LONG\s?NAME?S") == "LONG" and classify.needed("MCDONALD'?S") == "MCDONALD" and classify.needed("AB|CD") is None and classify.needed("abc") is None


def depth(column) -> int:
    return str(column).count("reverse(")


def test_shared_values_are_bound_once():
    """An expression that a helper takes is written into its result once, so it is evaluated once a row."""
    lines = F.reverse("lines")
    assert depth(orientation.text_orientation(lines)) <= 8  # its size and both of its ends, not once a keyword
    assert depth(ocr.better_pass(lines, F.col("other"))) == 1 and depth(ocr.mean_height(lines)) == 1 and depth(ocr.wants_retry(lines)) == 1


def test_rows_of_one_and_of_several_items(spark):
    box = lambda x, y, w=40: [[x, y], [x + w, y], [x + w, y + 20.0], [x, y + 20.0]]
    lines = [("b", 0.5, box(300.0, 3.0)), ("a", None, box(0.0, 0.0)), (None, 0.7, box(0.0, 60.0)), ("$5.00", 0.9, box(0.0, 100.0)), ("c", 0.25, box(0.0, 130.0)), ("d", 0.5, box(45.0, 133.0))]
    df = spark.createDataFrame([(1, lines), (2, []), (3, None)], f"k int, lines array<{ocr.LINE}>")
    got = {r["k"]: r for r in df.select("k", geometry.rows(F.col("lines")).alias("r"), geometry.merged(geometry.rows(F.col("lines"))).alias("m")).collect()}
    assert [tuple(x)[:6] for x in got[1]["r"]] == [
        (1, "a  b", 2, 2, 0.25, 0.0), (2, "", 1, 1, 0.7, 60.0), (3, "$5.00", 1, 1, 0.9, 100.0), (4, "c d", 2, 1, 0.375, 130.0)
    ]
    assert [(x["text"], x["merged"]) for x in got[1]["m"]][2:] == [("$5.00 c d", True)] and got[2]["r"] == [] and got[3]["r"] is None


def test_partitions_grow_with_what_is_read(spark, tmp_path):
    for k in range(3):
        spark.range(10, numPartitions=1).write.mode("append").parquet(str(tmp_path / "t"))
    source = spark.read.option("maxPartitionBytes", "1").parquet(str(tmp_path / "t"))
    few = spread(spark, source, "id").rdd.getNumPartitions()
    assert spread(spark, source.repartition(40), "id", source.repartition(40)).rdd.getNumPartitions() == 40 * GROWTH > few


def test_a_lone_part_passes_whatever_its_status(spark):
    line = [("a", 0.5, None)]
    parts = [(1, 1, "success", line, 3), (2, 1, "error", line, 4), (3, 1, None, line, 5), (4, 1, "success", None, 6), (5, 1, "error", line, 7), (5, 2, "success", line, 8)]
    df = spark.createDataFrame(parts, f"doc_id int, part_no int, status string, lines array<{ocr.LINE}>, processing_time_ms long")
    got = {r["doc_id"]: (r["status"], r["lines_detected"], r["processing_time_ms"], r["merged_from"]) for r in ocr.merge_results(df).collect()}
    assert got == {1: ("success", 1, 3, None), 2: ("error", 1, 4, None), 3: (None, 1, 5, None), 4: ("success", 0, 6, None), 5: ("success", 1, 8, 2)}
