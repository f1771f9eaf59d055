"""SimHash fingerprints and components against all pairs."""

import random
import re
import string

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slips.llm import common, simhash

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LINE = "the old ship sailed out of the harbour at dawn while gulls cried over the grey water and nobody looked up"


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(prints, radius=3):
    """Least member of each print's component."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[find(b)] = find(a)
    return {p: find(p) for p in prints}


@given(st.text(alphabet="aA bÉß\t\n\x0b\x1c.ĳ　", max_size=60))
def test_fingerprint_matches_a_slow_version(text):
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def test_fingerprint_of_a_very_long_text(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(5000))
    whole = slow_print(text)
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 64)
    assert simhash.fingerprint(text.encode()) == whole


@given(st.integers(0, 2**64 - 1), st.integers(1, 5).flatmap(lambda r: st.tuples(st.just(r), st.sets(st.integers(0, 63), max_size=r))))
def test_pairs_within_the_radius_meet_in_some_table(x, case):
    radius, places = case
    y = x ^ sum(1 << k for k in places)
    found = simhash.masks(radius)
    assert len(found) == 2 ** (radius + 1) - 1 and any(x & m == y & m for m in found)


@pytest.mark.parametrize(("block", "most"), [(1024, 500_000), (8, 500_000), (8, 3)])
def test_components_match_all_pairs(spark, block, most, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    for module in (simhash, common):
        monkeypatch.setattr(module, "BROADCAST_ROWS", most)
    rng = random.Random(2)
    prints = {0, 7, 1 << 63} | {rng.getrandbits(64) for _ in range(50)}
    for p in rng.sample(sorted(prints), 5):  # chains and one crowded ball
        for _ in range(8):
            p ^= sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 5)))
            prints.add(p)
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << k for k in rng.sample(range(12), rng.randrange(0, 7))) for _ in range(300)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    edges = [(r.u % 2**64, r.v % 2**64) for r in simhash.forests(df).collect()]
    assert all(a in prints and b in prints for a, b in edges)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: find(p) for p in prints} == {p: min(q for q, r in slow.items() if r == s) for slow in [slow_components(prints)] for p, s in slow.items()}
    # Far fewer edges than pairs of the ball.
    assert len(edges) < 60 * len(prints)


ROWS = [(1, LINE), (2, LINE), (3, LINE.upper()), (4, ""), (5, None), (None, LINE), (None, None), (6, "one two"), (6, "one two"), (7, " \t\n"), (8, "ONE\x0bTWO"), (9, "x"), (None, "only without an id")]
ROWS += [(10 + k, " ".join(LINE.split() * 40) + f" end{k}") for k in range(5)]


def test_classes_of_edge_cases(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    df = df.withColumns({"fp": F.lit("x"), "key": F.lit(1), "h": F.lit(2), "root": F.lit(3), "id": F.lit(4), "least": F.lit(5)})
    got = simhash.classes(df).collect()
    slow = slow_components({slow_print(t) for _, t in ROWS})
    want = []
    for i, t in ROWS:
        same = [j for j, u in ROWS if slow[slow_print(u)] == slow[slow_print(t)] and j is not None]
        want.append((i, f"{slow_print(t):016x}", min(same, default=None)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    assert {r.component_id for r in got if r.doc_id is not None and 10 <= r.doc_id <= 14} == {10}
    assert simhash.classes(df.where("1 = 0")).count() == 0
    kept = sorted(repr((r.doc_id, r.text)) for r in simhash.thin(df).collect())
    assert kept == sorted(map(repr, [(1, LINE), (4, ""), (6, "one two"), (9, "x"), (10, ROWS[13][1]), (None, "only without an id")]))


def test_query_matches_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    slow = slow_components({slow_print(t) for t in texts.values()})
    of = {i: slow[slow_print(t)] for i, t in texts.items()}
    least = {}
    for i, c in of.items():
        least[c] = min(i, least.get(c, i))
    got = simhash.op13_simhash(spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{slow_print(t):016x}", least[of[i]]) for i, t in texts.items()}
    assert len(set(of.values())) < len(texts)


def test_rows_of_one_run_are_compared_by_squares_too():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 64, 60, np.uint64)
    i, j = simhash.close_pairs(prints, np.array([0, 5]), np.array([5, 55]), 1)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a < 5) == (b < 5) and (int(prints[a]) ^ int(prints[b])).bit_count() <= 1}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
