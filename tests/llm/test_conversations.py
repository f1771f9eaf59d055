"""Repair of conversations against a slow version that tries every edit."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slips.llm import conversations

BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def slow_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append("blank" if BLANK.match(text) else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """Cost and audit, by trying every edit at every place."""
    faults = slow_faults(rows)

    @cache
    def best(t, state, inserted=0):
        """state: what has been put out, shortened to its last role: '', s, u or a."""
        found = [(0, "")] if t == len(rows) and state in ("", "a") else []
        due = "a" if state == "u" else "u"
        step = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1]))
        if inserted < 3:  # more in a row come round to the same state
            step(2, "I", best(t, due, inserted + 1))
        if t < len(rows):
            step(3, "D", best(t + 1, state))
            if faults[t] not in ("blank", "duplicate"):
                more = faults[t] == "truncated"
                first = rows[t][0][:1]
                if first == due or (first == "s" and state == ""):
                    step(more, "K", best(t + 1, first))
                step(2 + more, "R", best(t + 1, due))
        return min(found, default=(10**9, ""))

    return best(0, "")


def slow_report(rows):
    """rows: (turn, role, text) after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    md5 = lambda r, x: hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[1], r[2])))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    cost, audit = slow_repair(pairs)
    lines, queue, state = [], list(pairs), ""
    for letter in audit:
        role, text = ("", "") if letter == "I" else queue.pop(0)
        if letter != "D":
            state = role[0] if letter == "K" else "a" if state == "u" else "u"
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    faults = Counter(slow_faults(pairs))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def told(df, key="conv_id"):
    return {r[key]: tuple(r[c] for c in [*conversations.NAMES, "repaired_sha256"]) for r in df.collect()}


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2"]
TEXTS = ["Yes.", "No", "  ", "", None, "Why?\n", "Ends here!\t ", "a.b", "Zoë …"]


@pytest.mark.parametrize("block", [7, 1 << 17])
def test_edits_are_the_cheapest_and_least(spark, block, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(300)]:
        for t in range(rng.randrange(0 if conv else 1, 13)):
            row = (conv, rng.choice([t, t, t, None, t + 3]), rng.choice(ROLES), rng.choice(TEXTS))
            rows += [row] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumns({"conv": F.lit(1), "kind": F.lit(2), "digest": F.lit("x"), "audit": F.lit("K"), "seq": F.lit(9)})
    want = {}
    for c, *row in rows:
        want.setdefault(c, []).append(row)
    reports = {c: slow_report(r) for c, r in want.items()}
    assert told(conversations.report(df)) == reports
    turns = {}
    for r in sorted(conversations.repaired(df).collect(), key=lambda r: r.seq):
        turns.setdefault(r.conv_id, []).append(r)
    for c, report in reports.items():
        got = turns.get(c, [])
        assert [r.seq for r in got] == list(range(len(got))) and "".join(r.edit for r in got) == report[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got).encode()).hexdigest() == report[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got))


def test_a_long_conversation(spark):
    n = 5000
    rows = [(1, t, ["user", "assistant"][t % 2 if t % 50 else 0], f"turn {t}.") for t in range(n)] + [(i, 0, "user", "Hello?") for i in range(2, 50)]
    got = told(conversations.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got[1][:6] == (0, 0, 0, 0, 0, 0) and got[1][6] == "K" * n
    assert {got[i][6] for i in range(2, 50)} == {"KI"}


def test_conversations_without_rows_and_empty_tables(spark):
    schema = "conv_id string, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert conversations.report(none).count() == conversations.repaired(none).count() == 0
    named = spark.createDataFrame([("x",), (None,), ("x",)], "conv_id string")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert told(conversations.report(none, named)) == {"x": empty, None: empty}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def test_query_matches_a_slow_version(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{folder}/conversations.parquet").to_pylist()]
    want = {c: [] for c, *_ in rows}
    for c, *row in damage(rows):
        want[c].append(row)
    assert told(conversations.op11_conversation_repair(spark, folder)) == {c: slow_report(r) for c, r in want.items()}


def test_damage_reads_nulls_as_a_space(spark):
    rows = [(None, None, None, None), (1, None, None, "Hm."), (None, 3, "user", None)] + [(i, t, None, "So. What?!") for i in range(40) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: tuple((x is not None, x or "") for x in map(str, r))
    assert sorted(map(tuple, conversations.damaged(df).collect()), key=key) == sorted(damage(rows), key=key)
