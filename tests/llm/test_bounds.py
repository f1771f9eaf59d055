"""Bounds that must not depend on how many bands, rows of an id or bytes of a text there are."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slips.llm import common, decontam, exact_dedup, near, quality


def jaccard(a, b):
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.mark.parametrize("similar", [0.35, 0.8])
def test_crowded_buckets_of_many_bands(spark, similar):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(110)]
    texts = [" ".join([*base, f"x{k}", f"y{k}"]) for k in range(40)]
    texts += [" ".join([*base[: 60 + k], *(f"z{k}{n}" for n in range(50 - k))]) for k in range(10)]
    bands, _ = near.banding(similar)
    assert bands > 64 or similar == 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.classes(df, similar=similar).collect()}
    links = [[j for j, u in enumerate(texts) if j != i and jaccard(t, u) >= similar] for i, t in enumerate(texts)]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[i], *(label[j] for j in links[i])) if links[i] else label[i] for i in range(len(texts))]
    assert got == {i: (label[i], len(links[i])) for i in range(len(texts))}
    assert len(links[0]) >= 39


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "LONGEST", 5000)
    rows = [(7, "the same again")] * 3000 + [(100 + k, f"text {k}") for k in range(2000)] + [(10, "long " * 2000), (11, "fine " * 200)]
    labels = [(i, 1) for i in {i for i, _ in rows} - {10, 11}] + [(10, 0), (11, 0)] + [(10**6 + k, k % 2) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    got, counts = quality.training_rows(docs, marked, "doc_id", "text", "quality", 300)
    assert counts == {1: 5000, 0: 2}
    ones, zeros = [b for b, y in got if y == 1], [b for b, y in got if y == 0]
    assert len(ones) == 300 and len(zeros) == 1  # the long text is no part of it
    same = sum(b.rstrip(b"\0") == b"the same again" for b in ones)
    assert 120 < same < 240  # three in five
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 40 * quality.CHUNK)
    got, _ = quality.training_rows(docs, marked, "doc_id", "text", "quality", 300)
    assert sum(y for _, y in got) == 40 and all(len(np.frombuffer(b, np.uint8)) % quality.CHUNK == 0 for b, _ in got)


def test_decontamination_bounds(spark, monkeypatch):
    """A window that many items share is named by all of them, in blocks; a row that repeats past the arrays' bound stays as often."""
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 7)
    items = spark.createDataFrame([(i, "one shared line of text") for i in range(40)] + [(99, "no such words")], "item_id long, text string")
    texts = [(1, "x one shared line of text"), (None, "One shared line, of text?"), (2, "another shared text"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs = docs.unionByName(spark.range(2500).selectExpr("5L AS doc_id", "'one shared line of text' AS text"))
    got = decontam.decontaminate(docs, items).groupBy("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").count().collect()
    ids = hashlib.sha256(",".join(sorted(map(str, range(40)))).encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in got} == {
        (1, 6, 5, 40, ids, True, 1), (None, 5, 5, 40, ids, True, 1), (5, 5, 5, 40, ids, True, 2500), (2, 3, 0, 0, none, False, 1), (3, 0, 0, 0, none, False, 1),
    }


@pytest.mark.parametrize("bits", [7, 24])
def test_lists_beyond_broadcast_reach_texts_as_a_bitmap(spark, monkeypatch, bits):
    """No listed row is missed, however full the bitmap is, and results are those of the broadcast list."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts += texts[:40] + [texts[3]] * 300 + [f"{t} more" for t in texts[50:90]] + ["", None, "é" * 70, "é" * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want_exact = exact_dedup.refine(docs, digest_all=True).collect()
    want_near = near.classes(docs).collect() if bits == 7 else None
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    for module in (common, exact_dedup, near):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 5)
    listed = docs.where("doc_id % 7 = 0 or text is null").select("text")
    seen = common.maybe_in(docs, listed, text=F.col("text")).where("doc_id % 7 = 0 or text is null").groupBy("__maybe").count().collect()
    assert [r["__maybe"] for r in seen] == [True]
    assert sorted(exact_dedup.refine(docs, digest_all=True).collect()) == sorted(want_exact)
    unhashed = exact_dedup.refine(docs).where("text_sha256 is null and group_size > 1")
    assert unhashed.count() == 0
    if want_near:
        assert sorted(near.classes(docs).collect()) == sorted(want_near)
