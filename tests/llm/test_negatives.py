"""Hard negatives against all pairs."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from slips.llm import negatives


def brute(rows, most=5, least=3):
    """rows: (id, label, vector); anchors are ids divisible by 50."""
    fit = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, y, v) in enumerate(fit):
        if a % 50:
            continue
        score = [(-sum(x * z for x, z in zip(v, w, strict=False)), i, z == y) for n, (i, z, w) in enumerate(fit) if n != k]
        for p, i, _ in sorted(s for s in score if s[2])[:most]:
            fits = sorted(s for s in score if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(a, i, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fits[:least])]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def told(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def vectors(seed, n, d, spread, labels):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, spread) for _ in range(d)] for _ in range(4)]
    out = []
    for k in range(n):
        c = rng.choice(centre)
        out.append((k, rng.randrange(labels), [round(x + rng.gauss(0, spread / 3), 3) for x in c]))
    return out


@pytest.mark.parametrize(("rows", "anchors", "sparse"), [(4096, 1024, 1 / 32), (64, 3, 0.9), (17, 4, 0.0)])
@pytest.mark.parametrize(("spread", "labels", "d"), [(0.1, 3, 16), (0.002, 2, 8), (5000.0, 300, 5), (5e5, 3, 3)])
def test_mining_matches_all_pairs(spark, rows, anchors, sparse, spread, labels, d, monkeypatch):
    for name, value in (("ROWS", rows), ("ANCHORS", anchors), ("SPARSE", sparse)):
        monkeypatch.setattr(negatives, name, value)
    data = vectors(d, 500, d, spread, labels)
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").repartition(3)
    assert told(negatives.mine(df, F.col("vec_id") % 50 == 0)) == brute(data)


def test_rows_that_take_no_part_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    data = vectors(1, 120, 4, 0.1, 2) + [(50, 1, None), (150, None, [0.1] * 4), (None, 1, [0.1] * 4), (200, 1, [0.1, None, 0.2, 0.3]), (250, 0, [nan, 0.1, 0.1, 0.1]), (300, 0, [0.1, inf, 0.1, 0.1]), (350, 1, []), (400, 1, [0.2, 0.1]), (450, 0, [0.0] * 4)]
    data += [(500, 1, [0.3] * 4)] * 2 + [(501 + k, k % 2, [0.2] * 4) for k in range(12)] + [(0, 0, data[0][2])]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").withColumns({"uid": F.lit("u"), "q": F.lit(1), "anchor": F.lit("x"), "score": F.lit(0), "i": F.lit(3)})
    got = told(negatives.mine(df, F.col("vec_id") % 50 == 0))
    assert got == brute(data) and any(r[0] == 500 for r in got) and any(r[0] == 450 for r in got)
    for part in ("1 = 0", "vec_id % 50 <> 0", "label = 1"):
        assert told(negatives.mine(df.where(part), F.col("vec_id") % 50 == 0)) == [], part


def test_hot_label_and_one_vector_repeated(spark):
    data = vectors(3, 100, 6, 0.1, 3) + [(1000 + k, 2, [0.1] * 6) for k in range(900)] + [(2000 + k, k % 2, [0.09] * 6) for k in range(100)]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")
    held = [(i, y, [r.embedding[k] for k in range(6)]) for (i, y, _), r in zip(data, df.collect(), strict=True)]
    assert told(negatives.mine(df, F.col("vec_id") % 50 == 0)) == brute(held)


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    cursor = db.execute(negatives.ORACLE["op12_hard_negatives"])
    assert [d[0] for d in cursor.description] == COLUMNS
    assert told(negatives.op12_hard_negatives(spark, folder)) == sorted(cursor.fetchall())
