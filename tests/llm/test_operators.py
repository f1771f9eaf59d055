"""Each operator on one table of edge cases and against a brute-force version."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slips.llm import bpe, common, decontam, exact_dedup, language, licenses, lm, near, pii, quality, sharding
from slips.llm.common import crc_mod, stash, without
from slips.llm.elias_fano import EliasFano, Level

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


PROSE = "the old ship sailed out of the harbour at dawn while gulls cried over the grey water and nobody on the quay looked up to see it go"
LONG = " ".join(f"word{i % 997} {'x' * (i % 13)}" for i in range(20_000))
ROWS = [
    (1, PROSE), (2, PROSE), (3, PROSE.replace("dawn", "noon")), (4, ""), (5, None), (None, PROSE), (None, None), (6, "one two"), (6, "one two"), (7, LONG), (8, "émile@exämple.com ünïcode ẞ"),
    (9, "Mail a@b.co_d@e.fr or call +1 (212) 555-0100, card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.25."), (10, "Under the MIT license. Apache License, Version 2.0; CC BY-NC 4.0. Under the MIT License"),
    (11, "   \t\n"), (12, "<|endoftext|> it's 3 o'clock now é éẛ̣"), (13, "the " * 40), (14, PROSE.upper()), (15, "a"),
]
EXTRA = {"h": "x", "t": "y", "id": 3, "key": "k", "n": 1, "size": 2, "word": "w", "lang": "en", "source": "s", "n_chars": 4}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


# --- Exact dedup --------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [500_000, 2])
def test_exact_dedup(docs, empty, most, monkeypatch):
    for module in (exact_dedup, common):
        monkeypatch.setattr(module, "BROADCAST_ROWS", most)
    got = exact_dedup.refine(docs, digest_all=True).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        keep = max((i for i in groups[text] if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(groups[text]), r.doc_id == keep)
    assert exact_dedup.refine(empty).count() == 0
    kept = Counter(r.doc_id for r in exact_dedup.unique(docs).collect())
    assert kept == {2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1, 15: 1}


def test_without_matches_nulls(docs):
    dropped = docs.where("doc_id is null").select("doc_id")
    assert without(docs, dropped, doc_id=F.col("doc_id")).where("doc_id is null").count() == 0


# --- Sharding -----------------------------------------------------------------------------------------


def test_sharding(spark, docs, empty):
    assert sharding.shard(empty).count() == 0
    got = sharding.shard(docs).collect()
    assert len(got) == len(ROWS)
    many = [(i, hashlib.sha256(str(i // 2).encode()).hexdigest() * (1 + i // 2 % 5)) for i in range(6000)] + [(i, "hot") for i in range(6000, 9000)]
    for rows in (ROWS, many):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = sharding.shard(df).collect()
        assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = Counter()
    placed = {}
    for r in out:
        weight[r.shard] += r.size
        placed.setdefault(r.text_crc32, set()).add(r.shard)
    mean = sum(weight.values()) / 16
    assert len(weight) == 16 and max(weight.values()) < 1.03 * mean and min(weight.values()) > 0.97 * mean
    assert all(len(s) == 1 for crc, s in placed.items() if crc != zlib.crc32(b"hot"))


def test_range_of(spark):
    bounds = [-5, 0, 7, 7000]
    df = spark.createDataFrame([(x,) for x in (-9, -5, -1, 0, 7, 6999, 7000, 9999)], "x long")
    assert [r[0] for r in df.select(sharding.range_of(F.col("x"), bounds)).collect()] == [0, 1, 1, 2, 3, 3, 4, 4]


# --- Personal data ------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_pii_base(spark, empty):
    odd = [(100, "a@b.c" * 900), (101, "1.2.3.4.5.6.7.8 0000300.1.1.1 +12345 +1234567890123456"), (102, "x" * 200_000), (103, "é 4111-1111 1111 1111 ü +49 (30) 123-45678"), (104, ".".join("ab" * 5000)), (105, "a@" + ".x" * 20_000)]
    df = spark.createDataFrame(ROWS + odd, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    found, model = pii.find(df)
    got = by_id(found)
    for i, t in ROWS + odd:
        if i is not None:
            assert [f"{pii.KINDS[s.kind]}:{s.first}:{s.end}" for s in got[i].found if s.base] == base_spans(t), i
    assert set(model.reliability) == set(pii.LABELERS)
    assert pii.find(empty)[0].count() == 0


def test_pii_method_adds_spans(spark):
    rows = [(i, f"Contact mail user{i}@site{i}.com or phone +1 212 555 {1000 + i}") for i in range(60)]
    rows += [(100, "write to jane.doe (at) example.com please"), (101, "phone call (212) 555-0100 now"), (102, "no personal data here at all")]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))[0])
    assert [(s.kind, s.base) for s in got[100].found] == [(0, False)] and [(s.kind, s.base) for s in got[101].found] == [(3, False)]
    assert got[102].found == []


def test_pii_precision_and_recall_on_planted_spans(spark):
    """Beyond the base: secrets, masked addresses, phones without a country and names are found; look-alikes are not."""
    r = np.random.default_rng(11)
    hexes = lambda n: "".join(r.choice([*"0123456789abcdef"], n))
    mixed = lambda n: "".join(r.choice([*"abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"], n - 2)) + "7q"
    planted, clean = [], []
    for k in range(40):
        planted += [
            (f'the ship sailed token = "{(x := hexes(40))}" at dawn', x), (f"export API_KEY={(x := 'AKIA' + mixed(16).upper())} now", x), (f"password: {(x := mixed(12))} was set", x),
            (f"reach us by mail at {(x := f'ann{k} (at) site{k}.org')} soon", x), (f"phone call (212) 555-{1000 + k} today", f"(212) 555-{1000 + k}"), (f"signed by {(x := pii.FIRST_NAMES[k] + ' Walker')} of this town", x),
        ]
        clean += [f"sha256: {hexes(64)} of the file", f"commit {hexes(40)} fixes it", "the key: remember everything about it", f"order 4{k}7 of the old ship", "The The Of Of gulls cried", f"version 1.{k}.3 build 20{k}", "a token of thanks and a secret garden"]
    base = [f"mail bob{k}@site{k}.com or host 10.0.{k}.7, phone +1 212 555 {1000 + k}" for k in range(60)]
    texts = [t for t, _ in planted] + clean + base
    got = by_id(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0])
    hit = [any(t[x.first : x.end] == want and not x.base for x in got[i].found) for i, (t, want) in enumerate(planted)]
    false = [t for i, t in enumerate(clean, len(planted)) if got[i].found]
    more = sum(not x.base for i in range(len(texts)) for x in got[i].found)
    assert sum(hit) >= 0.9 * len(planted), [planted[k][0] for k in range(6) if not hit[k]]
    assert sum(hit) >= 0.9 * more and len(false) <= 0.1 * len(clean), false[:10]


def test_pii_many_spans_in_one_text(spark):
    text = " ".join(f"a{k}@b.com (212) 555-{1000 + k} +1 212 555 {1000 + k}" for k in range(3000))
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first().found
    assert [f"{pii.KINDS[s.kind]}:{s.first}:{s.end}" for s in got if s.base] == base_spans(text)
    spans = sorted((s.first, s.end) for s in got)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_em_finds_the_unreliable_labeler():
    counts = {"0222222": 80, "0222202": 20, "0000022": 70, "0000000": 30}
    belief, right = pii.reliabilities(counts)
    assert belief["0222222"] > 0.9 > 0.1 > belief["0000022"]
    assert right["format"] > right["boundary"]


# --- Licenses -----------------------------------------------------------------------------------------


def test_licenses(docs, empty):
    got = by_id(licenses.scan(docs))
    for i, t in ROWS:
        if i is None:
            continue
        w = words(t)
        at = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert licenses.scan(empty).count() == 0


def test_license_rules():
    assert len(licenses.rules()) > 200
    label = lambda t: licenses.detect(t.encode())["labels"]
    assert label("Licensed under the GNU Lesser General Public License, version 3.") == "lgpl-3"
    assert label("This work is licensed under the GNU General Public License, version 3.") == "gpl-3"
    assert label("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert label("released under the Mozilla Public License 2.0 or the Boost Software License") == "boost,mpl-2"
    assert label("she was permitted to submit a summit") == "" and label("the apache helicopter") == ""


def _sample(r, parsed):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            kinds = [chr(x[1] if str(x[0]) == "LITERAL" else r.integers(x[1][0], x[1][1] + 1)) for x in arg]
            out += str(r.choice(kinds))
        elif kind == "BRANCH":
            out += _sample(r, arg[1][r.integers(len(arg[1]))])
        elif kind == "SUBPATTERN":
            out += _sample(r, arg[3])
        elif kind == "MAX_REPEAT":
            out += "".join(_sample(r, arg[2]) for _ in range(r.integers(arg[0], arg[1] + 1)))
        else:
            assert kind == "ASSERT_NOT"
    return out


def test_license_gates_drop_nothing():
    label = lambda t: licenses.detect(t.encode())["labels"]
    assert label("Licensed under GPLv3") == label("released under GPL-3") == "gpl-3" and label("Licensed under the AGPLv3.") == "agpl-3"
    assert label("released under the MIT") == "mit" and label("governed by the ISC") == "isc" and label("provided under the Boost Software") == "boost"
    assert label("distributed under the terms of the BSD 3-Clause") == "bsd-3-clause" and label("licensed under FreeBSD") == "bsd-2-clause" and label("PSF License") == "python"
    r = np.random.default_rng(4)
    for rule in licenses.rules():
        for _ in range(6):
            text = _sample(r, re._parser.parse(rule.pattern.pattern.decode()))
            assert rule.pattern.search(text.encode()), text
            got = licenses.detect(f"so {text} it".encode())
            assert got["labels"] and got == licenses.detect(f"so {text} it".encode(), gated=False)


def test_license_bodies():
    label = lambda t: licenses.detect(t.encode())["labels"]
    assert label("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")") == "mit"
    assert label("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. x") == "bsd-2-clause"
    assert label("Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0") == "apache-2"
    assert label("SPDX-License-Identifier: GPL-2.0-or-later") == "gpl-2-or-later" and label("Licensed under CC BY-NC-SA 4.0") == "cc-by-nc,cc-by-nc-sa"
    assert label("This is free and unencumbered software released into the public domain.") == "unlicense"
    assert label("https://creativecommons.org/licenses/by-sa/4.0/") == "cc-by-sa"


# --- BPE ----------------------------------------------------------------------------------------------


def library(text):
    t = ENCODER.library
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


ENCODER = bpe.Encoder(bpe.default_tokenizer())


@pytest.mark.parametrize("deal", [True, False])
def test_bpe(docs, empty, deal):
    got = by_id(bpe.encode(docs, deal=deal, keep_ids=True))
    for i, t in ROWS:
        if i is not None:
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == library(t)
            assert len(got[i].ids) == got[i].n_tokens
    assert bpe.encode(empty, deal=deal).count() == 0


def test_bpe_random_texts():
    r = np.random.default_rng(5)
    alphabet = [*"abcDEF .,'\n\t09", "é", "é", "́", "ẞ", "İ", "Σ", " ", " ", "\x1c", "日本", "🙂", "<|endoftext|>", "  ", "don't", "\r\n", "<|start"]
    texts = ["".join(r.choice(alphabet, size=int(n))) for n in r.integers(0, 3000, 60)] + ["x" * 30_000, "日" * 9_000, "ab " * 9_000]
    for t, ids in zip(texts, ENCODER.encode([t.encode() for t in texts]), strict=True):
        own = ids.tolist()
        assert (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(ENCODER.decode(own).encode()).hexdigest()) == library(t)


def test_bpe_reuses_and_repairs():
    r = np.random.default_rng(8)
    passage = " ".join("".join(r.choice([*"abcdefgh"], int(n))) for n in r.integers(2, 9, 5000))
    e = bpe.Encoder(bpe.default_tokenizer())
    e.encode([f"intro {i} {passage} end {i}".encode() for i in range(20)])
    assert e.encoded < e.reused / 3
    text = f"intro 3 {passage} end 3"
    for wrong in (1, 3, 10_000):  # chunks whose outer words were encoded wrongly must be noticed, and windows widened past them
        e.windows = bpe.Cache(e.windows.most)
        _, inner = e.plan([body.decode() for body in np.split(np.frombuffer(text.encode(), np.uint8), bpe.cuts(np.frombuffer(text.encode(), np.uint8))[:-1]) for body in [body.tobytes()]])
        for _, _, chunk in inner[1 : 1 + wrong]:
            chunk.before = np.array([1], np.int32)
        before = e.widened
        got = e.encode([text.encode()])[0]
        assert e.widened > before and got.tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_bpe_words_are_encoded_in_runs():
    """New words go to the library some hundred at a time, and come out as they do alone, odd ones included."""
    r = np.random.default_rng(10)
    e = bpe.Encoder(bpe.default_tokenizer())
    odd = ["É", "İ", "ẞ", "é", "e\u0301", "\u0301", "a\xa0b", "\x0b", "a\x1cb", "<|endoftext|>", "</w>", "日本", "🙂", "ΣΑΣ", "ǆ", "it's", "x" * 400]
    for share in (0.0, 0.001, 0.3):
        words = {"".join(r.choice([*"abcdefghé0.'"], int(n))) for n in r.integers(1, 12, 3000)}
        words |= {w + str(k) for k in range(int(1000 * share)) for w in odd} | (set(odd) if share else set())
        calls, whole = [], e.whole
        e.whole = lambda texts: calls.append(len(texts)) or whole(texts)  # noqa: B023
        e.learn_words(words)
        e.whole = whole
        assert all(np.frombuffer(e.words[w], np.int32).tolist() == e.library.encode(w, add_special_tokens=False).ids for w in words)
        assert share or sum(calls) <= len(words) / bpe.RUN + 1


def test_bpe_cache_is_bounded_by_bytes():
    r = np.random.default_rng(9)
    e = bpe.Encoder(bpe.default_tokenizer(), kept=200_000)
    for k in range(30):
        text = " ".join("".join(r.choice([*"abcdefgh"], int(n))) for n in r.integers(2, 9, 800)) + f" {k}"
        assert e.encode([text.encode()])[0].tolist() == e.library.encode(text, add_special_tokens=False).ids
        assert max(x.used for x in (e.words, e.chunks, e.windows)) < 400_000  # half of what is kept, and one text


# --- Decontamination ----------------------------------------------------------------------------------


def contamination(text, items):
    w = words(text)
    hit, names = set(), set()
    for name, t in items:
        iw = words(t)
        n = min(13, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[k : k + n]:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("per_block", [200_000, 3])
def test_decontamination(spark, docs, empty, per_block, monkeypatch):
    monkeypatch.setattr(decontam, "WINDOWS_PER_BLOCK", per_block)
    items = [(1, PROSE), (2, "one two"), (3, ""), (4, None), (5, "the the the the"), (6, PROSE), (10, " ".join(PROSE.split()[3:18]).upper() + "!"), (None, "émile"), (11, "a")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = by_id(decontam.decontaminate(docs, table))
    for i, t in ROWS:
        if i is not None:
            want = contamination(t, [x for x in items if x[0] is not None])
            r = got[i]
            if i != 8:  # an item without an id has windows but no name
                assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, i
    assert decontam.decontaminate(empty, table).count() == 0
    clean = decontam.decontaminate(docs, table.where("1 = 0"))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(ROWS)


# --- Language -----------------------------------------------------------------------------------------


def test_language(spark, docs, empty):
    en, de = "the ship and the harbour with this water", "der hund und die katze nicht mit dem schiff"
    train = spark.createDataFrame([(en, "en"), (de, "de"), (None, "en"), (en, None), ("", "de")], "text string, lang string")
    by_lang = language.fit(train)
    assert set(by_lang) == {"en", "de"}
    got = by_id(language.predict(docs, by_lang, ["doc_id"]))
    assert got[1].lang_pred == "en" and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 11))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(empty, by_lang, ["doc_id"]).count() == 0
    assert language.predict(docs, {}, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("gather", [1_000_000, 200])
def test_language_learns_from_every_row(spark, gather, monkeypatch):
    """However many rows there are, a rare language keeps its own and copies of one text weigh what they are."""
    monkeypatch.setattr(language, "GATHER", gather)
    often = spark.range(60_000 if gather > 200 else 300).select(F.concat(F.lit("the ship "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([("kissa", "fi"), ("hund", "de"), ("hund", "de"), ("katze", "de")], "text string, lang string")
    by_lang = language.fit(often.unionByName(rare))
    assert set(by_lang) == {"de", "en", "fi"}
    for lang, texts in (("fi", ["kissa"]), ("de", ["hund", "hund", "katze"]), ("en", ["the ship"])):
        counts = Counter()
        for t in texts:
            counts.update(dict(zip(*(x.tolist() for x in language.grams(t)), strict=True)))
        assert by_lang[lang] == sorted(counts, key=lambda g: (-counts[g], g))[: language.PROFILE]


def test_language_grams():
    codes, counts = language.grams("ab, b")
    text = lambda c: "".join(chr(x) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x)
    assert dict(zip(map(text, codes.tolist()), counts.tolist(), strict=True)) == {"a": 1, "b": 2, " a": 1, "ab": 1, "b ": 2, " b": 1, " ab": 1, "ab ": 1, " b ": 1}


# --- Language model -----------------------------------------------------------------------------------


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 5), (10, 10), (1000, 100), (1000, 100_000), (3000, 10**9), (3, 2**40), (0, 1)):
        v = np.sort(r.integers(0, top, n)).astype(np.int64)
        e, _ = EliasFano.load(memoryview(EliasFano.build(v).dump()), 0)
        if n:
            assert (e.get(np.arange(n)) == v).all()
            x = r.integers(0, top + top // 5 + 2, 2000)
            assert (e.find(x) == np.searchsorted(v, x)).all()
    key = np.unique(r.integers(0, 500, 4000) * 5000 + r.integers(0, 4000, 4000))
    level, _ = Level.load(memoryview(Level.build(500, key // 5000, key % 5000, r.random(len(key))).dump()))
    c, w = r.integers(-1, 500, 9000), r.integers(0, 4000, 9000)
    at, found = level.find(c, w)
    assert (found == (np.isin(c * 5000 + w, key) & (c >= 0))).all() and (at[found] == np.searchsorted(key, (c * 5000 + w)[found])).all()


def brute_lm(train):
    """Absolutely discounted trigrams over bigrams with a Dirichlet prior, in plain dictionaries."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    toks = [split(t) for t in train]
    c, ends = Counter(w for ws in toks for w in ws), len(toks)
    total, distinct = sum(c.values()) + ends, len(c) + bool(ends)
    one = lambda w: (ends if w == "<e>" else c[w]) + 0.5
    two, three = {}, {}
    for ws in toks:
        s = ["<s>", "<s>", *ws, "<e>"]
        for a, b, w in zip(s, s[1:], s[2:], strict=False):
            two.setdefault(b, Counter())[w] += 1
            three.setdefault((a, b), Counter())[w] += 1

    def p(a, b, w):
        after = two.get(b, Counter())
        lower = (after[w] + lm.PRIOR * one(w) / (total + 0.5 * (len(c) + 2))) / (after.total() + lm.PRIOR)
        if (a, b) not in three:
            return lower
        own = three[a, b]
        return max(own[w] - lm.DISCOUNT, 0) / own.total() + lm.DISCOUNT * len(own) / own.total() * lower

    def score(text):
        ws = split(text)
        s = ["<s>", "<s>", *ws, "<e>"]
        out = sum(math.log10(p(a, b, w)) for a, b, w in zip(s, s[1:], s[2:], strict=False))
        base = sum(math.log10((n + 0.5) / (total + 0.5 * (distinct + 1))) for n in [*(c[w] for w in ws), ends])
        return len(ws) + 1, sum(c[w] > 0 for w in ws) + bool(ends), total, base, out

    return score


@pytest.mark.parametrize("block", [4_000_000, 4_000])
def test_lm(spark, empty, block, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", block)
    rows = [(i, f"the {a} ship sailed to the {b} port with {a} {b} cargo of tin{i % 7}") for i, (a, b) in enumerate([("old", "far"), ("new", "near"), ("old", "near")] * 20)] + [r for r in ROWS if r[0] is not None]
    rows = [(1000 + k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1)
    score = brute_lm([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    for r in lm.score(df).collect():
        n, known, total, base, out = score(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(out, abs=0.014 * n)  # half a step of one-byte probabilities
    assert lm.score(df.where("1 = 0")).count() == 0
    assert lm.score(df.where("held_out").select("doc_id", "text", "held_out")).where("n_known > 0").count() == 0


def test_lm_knows_every_training_word(spark, monkeypatch):
    """Rare words and n-grams that occur once have statistics of their own, whatever chunk and block they are in."""
    monkeypatch.setattr(lm, "BLOCK", 3_000)
    monkeypatch.setattr(lm, "CHUNK", 2_000)
    rows = [(i, " ".join(f"w{(i * 40 + k) % 5600}" for k in range(45))) for i in range(150)]
    rows += [(1000 + i, rows[i][1] if i % 2 else " ".join(reversed(rows[i][1].split()))) for i in range(20)] + [(2000, "the " * 900), (2001, "never seen"), (2002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held_out", F.col("doc_id") >= 1000)
    brute = brute_lm([t for i, t in rows if i < 1000])
    got = {r.doc_id: r for r in lm.score(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, known, total, base, out = brute(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(out, abs=0.014 * n)
    assert all(got[1000 + i].score / got[1000 + i].n_tokens > got[1000 + i - 1].score / got[1000 + i - 1].n_tokens + 1 for i in range(1, 20, 2))


# --- Quality ------------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    r = np.random.default_rng(2)
    vocab = ["".join(r.choice(list("abcdefghij"), int(n))) for n in r.integers(2, 8, 300)]
    good = [(i, " ".join(r.choice(vocab, 60)).capitalize() + ".") for i in range(150)]
    bad = [(i, " ".join(w + "$$$" for w in r.choice(vocab, 60))) for i in range(150, 300)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    fold = crc_mod(F.col("doc_id"), 3) != 1
    net = quality.fit(rows.where(fold), labels)
    held = quality.score(rows.where(~fold), net, ["doc_id"]).collect()
    assert sum((r.doc_id < 150) == (r.predicted == 1) for r in held) / len(held) > 0.95
    got = quality.score(docs, net, ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score(empty, net, ["doc_id"]).count() == 0
    kept = quality.accepted(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    one = quality.fit(rows, labels.where("quality = 1"))
    assert quality.score(docs, one, ["doc_id"]).where("predicted = 0").count() == 0
    assert quality.fit(empty, labels).probability(np.zeros((1, quality.FILTERS)))[0] == pytest.approx(0.5, abs=0.01)


def test_quality_learns_from_whole_texts_and_own_labels(spark):
    texts = [(i, "plain words go on and on " * 200 if i % 2 else "plain words go on and on " * 90 + "zq#" * 70 + "plain words go on and on " * 110) for i in range(40)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    fold = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    others = spark.createDataFrame([(i, 1) for i in range(100, 600)], "doc_id long, quality int")
    got, counts = quality.training_rows(rows, fold.unionByName(others), "doc_id", "text", "quality", quality.SAMPLE)
    whole = [(quality.chunks(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tobytes(), i % 2) for i, t in texts]
    assert sorted(got) == sorted(whole) and counts == {0: 20, 1: 20}
    net, same = quality.fit(rows, fold.unionByName(others)), quality.fit(rows, fold)
    assert all((a == b).all() for a, b in zip(net.parts(), same.parts(), strict=True))
    assert all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in quality.score(rows, net, ["doc_id"]).collect())


def test_quality_gradient_in_parts(monkeypatch):
    r = np.random.default_rng(3)
    rows, sizes, y = r.integers(0, 256, (12, quality.CHUNK)).astype(np.uint8), np.array([5, 1, 6]), np.array([0, 1, 1], np.float32)
    whole = quality.Network.fresh().gradient(rows, sizes, y)
    monkeypatch.setattr(quality, "UNROLLED", 5)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, quality.Network.fresh().gradient(rows, sizes, y), strict=True))


def test_quality_chunks_cover_every_byte():
    body = np.arange(1, 2001, dtype=np.uint64).astype(np.uint8)
    at = np.array([0, 0, 1, 255, 256, 257, 1000, 2000])
    rows, owner = quality.chunks(body, at)
    for k in range(len(at) - 1):
        text, own = body[at[k] : at[k + 1]], rows[owner == k]
        for n, c in enumerate(own):
            part = text[n * quality.HOP : n * quality.HOP + quality.CHUNK]
            assert (c[: len(part)] == part).all() and not c[len(part) :].any()
        assert (len(own) - 1) * quality.HOP + quality.CHUNK >= len(text)


# --- Near duplicates ----------------------------------------------------------------------------------


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows, similar=0.8):
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets = [shingle_set(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= similar:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, t in rows:
        if i is not None:
            k = root(texts.index(t or ""))
            least[k] = min(i, least.get(k, i))
    return {t: (least.get(root(k)), links[k]) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("small", "block"), [(16, 512), (2, 7)])
def test_near(spark, empty, small, block, monkeypatch):
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "BLOCK", block)
    r = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(400)]
    base = list(r.choice(vocab, 120))
    rows = list(ROWS)
    for k in range(40):  # one large group of near copies with more and more edits
        copy = list(base)
        for at in r.integers(0, 120, k // 6):
            copy[at] = f"edit{k}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(200 + k, " ".join(r.choice(vocab, 80))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    want, counts = brute_classes(rows), Counter(t or "" for _, t in rows)
    got = by_id(near.classes(df))
    for i, t in rows:
        if i is not None:
            assert (got[i].class_id, got[i].n_links, got[i].n_copies) == (*want[t or ""], counts[t or ""] - 1), i
    kept = near.thin(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {c for c, _ in want.values()}
    assert near.classes(empty).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = near.banding()
    assert 1 - (1 - near.SIMILAR**rows) ** bands >= near.RECALL and bands * rows <= near.MOST_HASHES


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(50, 40), (40, 60)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 31)} | {40: 40, 50: 40, 60: 40}
    assert near.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stash_round_trip(docs):
    assert stash(docs, "test").count() == len(ROWS)
