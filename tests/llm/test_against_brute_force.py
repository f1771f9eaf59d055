"""Operators without SQL, and the pipeline, against slow versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slips.llm import language, near, quality, sharding
from slips.llm.common import stash

from .test_operators import ENCODER, brute_classes, contamination, library

DATA = "/root/testdata/sf0.001"


# --- Language identification --------------------------------------------------------------------------


def slow_grams(text):
    """Letter n-grams of a text's words, each word between two blanks."""
    text, words, word = (text or "").lower(), [], ""
    for c in [*text, " "]:
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    found = Counter()
    for w in words:
        found.update(w)
        for n in (2, 3):
            s = f" {w} "
            found.update(s[k : k + n] for k in range(len(s) - n + 1))
    return found


def slow_rank(found):
    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | ord(c)
        return out

    return sorted(found, key=lambda g: (-found[g], code(g)))[: language.PROFILE]


def test_language_matches_a_slow_version_on_documents(spark):
    rows = [r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    fold = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5
    profiles = {}
    for r in rows:
        if fold(r) != 0 and r["lang"] is not None and r["text"] is not None:
            profiles.setdefault(r["lang"], Counter()).update(slow_grams(r["text"]))
    profiles = {lang: {g: k for k, g in enumerate(slow_rank(c))} for lang, c in profiles.items()}
    got = {r.doc_id: r for r in language.op7_language_id(spark, DATA).collect()}
    assert len(got) == len(rows)
    right = Counter()
    for r in rows:
        top = slow_rank(slow_grams(r["text"]))
        apart = {lang: sum(abs(p[g] - k) if g in p else language.PROFILE for k, g in enumerate(top)) for lang, p in profiles.items()}
        want = min(sorted(apart), key=apart.get) if top else "und"
        mine = got[r["doc_id"]]
        assert (mine.lang_pred, mine.held_out) == (want, fold(r) == 0)
        assert mine.score == pytest.approx(1 - apart[want] / (language.PROFILE * len(top)) if top else 0.0)
        if mine.held_out and r["lang"] is not None and top:
            right[mine.lang_pred == r["lang"]] += 1
    assert right[True] >= 0.95 * right.total()


# --- Quality classifier -------------------------------------------------------------------------------


def slow_quality(net, text):
    """The network's score, place by place."""
    body, starts = (text or "").encode(), [0]
    while starts[-1] + quality.CHUNK < len(body):
        starts.append(starts[-1] + quality.HOP)
    pooled = []
    for a in starts:
        chunk = np.frombuffer(body[a : a + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
        places = [net.embed[chunk[k : k + quality.WIDTH]].reshape(-1) @ net.filters for k in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
        pooled.append(np.maximum(np.max(places, axis=0) + net.offset, 0))
    hidden = np.maximum(np.mean(pooled, axis=0) @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + math.exp(-float(hidden @ net.out + net.out_bias[0])))


GOOD = "the old ship sailed out of the quiet harbour at dawn while the gulls cried over grey water"
JUNK = "buy now!!! $$$ click >>> free $$$ win win win >>> http://x"


def small_tables(folder):
    """Documents with junk, exact and near copies, benchmark passages, nulls and empty texts; most are labelled."""
    r = np.random.default_rng(3)
    vocab = GOOD.split() + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    prose = lambda n: " ".join(r.choice(vocab, n)) + "."
    items = [(k, prose(30)) for k in range(4)] + [(9, "few words only"), (10, None), (11, "")]
    texts = [prose(int(n)) for n in r.integers(20, 90, 60)]
    texts += [" ".join(r.permutation(JUNK.split() * 4)) for _ in range(40)]
    texts += [texts[k] for k in (0, 0, 0, 1, 2, 60)]
    near_copy = texts[5].split()
    texts += [" ".join([*near_copy, "extra"]), " ".join(["more", *near_copy])]
    texts += [items[0][1] + " " + prose(40), prose(400) + " " + " ".join(items[1][1].split()[:13]), prose(30) + " few words only", prose(2000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, "a"), (0, texts[0])]
    labels = [(k, int("$$$" not in (t or ""))) for k, t in enumerate(texts) if k % 7] + [(None, 1), (3, None)]
    return rows, items, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, items, labels = small_tables(folder)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items, labels


def test_quality_matches_a_slow_version(spark, tables):
    folder, rows, _, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    train = docs.where(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    net = quality.fit(train, spark.read.parquet(f"{folder}/labels.parquet"))
    got = quality.op9_quality(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    known, right = dict(labels), Counter()
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0]), strict=True):
        want = slow_quality(net, t)
        assert r.score == pytest.approx(want, abs=1e-4) and r.predicted == int(r.score >= 0.5) and r.held_out == held(i)
        if r.held_out and known.get(i) is not None:
            right[r.predicted == known[i]] += 1
    assert right[True] >= 0.95 * right.total() > 0


# --- Pipeline -----------------------------------------------------------------------------------------


def slow_stage(name, rows, items, net):
    """The rows (id, text) that a stage keeps of its input."""
    if name == "quality classifier":
        return [(i, t) for i, t in rows if slow_quality(net, t) >= 0.5]
    if name == "exact dedup":
        best = {}
        for i, t in rows:
            best[t or ""] = max(i, best.get(t or "", i))
        return list({(i, t or ""): (i, t) for i, t in rows if best[t or ""] == i}.values())
    if name == "n-gram Jaccard join":
        stay = {c for c, _ in brute_classes(rows).values()}
        return [(i, t) for i, t in rows if i in stay]
    return [(i, t) for i, t in rows if not contamination(t, items)[4]]


def test_pipeline_matches_slow_stages(spark, tables):
    folder, rows, items, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    train = docs.where(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    net = quality.fit(train, spark.read.parquet(f"{folder}/labels.parquet"))
    columns, now, sizes = docs.columns, rows, [len(rows)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, folder), "test")
        now = slow_stage(name, now, items, net)
        key = lambda r: (r[0], r[1] or "")
        assert docs.columns == columns and sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(now, key=key), name
        sizes.append(len(now))
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))  # every stage decides something
    whole = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {i: library(t) for i, t in now}


def test_pipeline_of_an_empty_table(spark, tables, tmp_path):
    folder, _, _, _ = tables
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("1 = 0").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoder_survives_many_texts():
    for t in ("", "a", GOOD * 50, JUNK):
        assert ENCODER.encode([t.encode()])[0].tolist() == ENCODER.library.encode(t, add_special_tokens=False).ids


# --- Jaccard join and shards on documents -------------------------------------------------------------


def test_near_finds_every_link_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    want = brute_classes(rows)
    got = near.op10_ngram_jaccard_join(spark, DATA).collect()
    texts = dict(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: want[texts[i] or ""] for i in texts}
    assert any(n for _, n in want.values())


def test_shards_of_documents_are_near_equal(spark):
    got = sharding.op3_sharding(spark, "/root/testdata/sf0.01").collect()
    load, rows = Counter(), Counter()
    for r in got:
        load[r.shard] += r.size
        rows[r.shard, r.slot] += 1
    mean = sum(load.values()) / 16
    assert max(load.values()) <= 1.001 * mean and min(load.values()) >= 0.999 * mean
    assert set(rows.values()) == {1} and all((s, k) in rows for s, n in Counter(s for s, _ in rows).items() for k in range(n))
