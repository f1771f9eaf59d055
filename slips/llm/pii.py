"""Personal data and secrets by weak supervision.

Regex patterns propose candidate spans. Labelers (format, checksum, gazetteer, context, boundary and
shape) vote for, against or abstain. Expectation-maximisation over the distinct vote patterns estimates
each labeler's reliability without labels, and its posteriors train the final span classifier, a
logistic regression over the votes and features of the span itself: its length, its share of digits and the
variety of its characters. Spans of the base patterns that pass their checks are always kept; the classifier
adds others that overlap none of them: masked addresses, phones without a country, cards in their context,
long addresses of hosts, names of persons, and secrets such as keys and tokens.

Null texts count as empty; every row gives one row, whatever its id; further columns are ignored. An
empty table or one without candidates trains nothing and adds nothing. Offsets are code points, end
exclusive. All row work is column expressions; the driver sees the counts of vote and feature patterns only,
at most kinds x 3^(labelers + features) of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, stash

KINDS = ("email", "ip", "card", "phone", "person", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("format", "checksum", "gazetteer", "context", "boundary", "shape")
FEATURES = ("length", "digits", "variety")

# Linear forms of the base patterns: a match can only begin where its run of characters begins or
# where the match before ended, and repeats are possessive because what follows cannot be in them.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Gazetteer of first names that are frequent in the languages of the corpus.
FIRST_NAMES = """
Adam Albert Alexander Alice Ana Andrea Andreas Andrew Anna Anne Anthony Antoine Antonio Barbara Bernd Brian Camille Carlos Carmen Catherine
Charles Charlotte Christian Christine Christopher Claire Claudia Daniel David Deborah Diego Donald Edward Elena Elizabeth Emily Emma Eric
Felix Fernando Francisco Frank Franz George Hans Heinrich Helen Henri Isabelle Jack Jacques James Jason Javier Jean Jeffrey Jennifer
Jessica Joanna Johann John Jonathan Jorge Joseph Juan Julia Julie Karen Karl Katharina Kenneth Kevin Klaus Laura Laurent Lars Linda Lisa Louis
Lucas Luis Manuel Margaret Maria Marie Mark Martin Mary Matthew Michael Michel Miguel Monika Nancy Nicolas Olivia Pablo Patricia Patrick Paul
Pedro Peter Philippe Pierre Rachel Ralf Richard Robert Ryan Sabine Samuel Sandra Sarah Sofia Sophie Stefan Stephen Steven Susan Teresa Thomas
Timothy Ursula Uwe Victor Walter William Wolfgang
""".split()  # fmt: skip


def any_of(words: list[str]) -> str:
    """An alternation by first letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in heads.items())


# Looser forms that only the classifier can accept.
MASKED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
LONG_IP = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
TITLED = rf"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señora?)\.? [A-Z][a-z]{{1,30}}(?: [A-Z][a-z]{{1,30}})?|(?:{any_of(FIRST_NAMES)}) [A-Z][a-z]{{2,30}})"
# A value with a digit after the name of a secret, or a long run of letters and digits.
KEY_NAME = r"(?:api[_-]?key|access[_-]?key|private[_-]?key|key|token|secret|passwd|password|passwort|contraseña|pwd|bearer|credential)"
KEYED = rf"(?<![A-Za-z])(?i:{KEY_NAME})[\"']? ?[:= ] ?[\"']?"
SECRET = rf"{KEYED}(?=[A-Za-z+/_.~!#$%^&*-]*+[0-9])[A-Za-z0-9+/_.~!#$%^&*-]{{8,}}+=*+|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{{20,}}+=*+"
# Kind, pattern, and what stands before the span in a match.
PATTERNS = ((0, EMAIL, None), (1, IP, None), (2, CARD, None), (3, PHONE, None), (0, MASKED_EMAIL, None), (3, LOCAL_PHONE, None), (1, LONG_IP, None), (4, TITLED, None), (5, SECRET, f"^{KEYED}"))

BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
DOMAIN_ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|ch|at|it|nl|us|ca|mx|ar"
CONTEXT = (
    r"(?i)(?:e-?mail|mail|contact|write|courriel|correo)",
    r"(?i)(?:\bip\b|addr|host|server|login|from)",
    r"(?i)(?:card|credit|visa|master|amex|account|karte|carte|tarjeta)",
    r"(?i)(?:phone|tel|call|mobile|fax|cell|anruf|ruf)",
    r"(?i)(?:name|dear|sincerely|signed|by|from|von|madame|contact|author)",
    rf"(?i)(?<![A-Za-z]){KEY_NAME}[\"']? ?[:= ] ?[\"']?$",
)
#: Starts of issued keys.
KEY_STARTS = r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|[sp]k[_-](?:live|test)?|AIza|eyJ|SG\.)"
#: Digits of a checksum, which a secret may look like too.
HEX_DIGEST = "^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"
#: What is named before a run of letters and digits that is no secret.
DIGEST_OF = r"(?i)(?:sha-?[0-9]*|md5|commit|digest|checksum|hash|revision|etag|uuid)[\"']? ?[:= ] ?[\"']?$"
AGAINST = r"(?i)(?:version|release|isbn|sha|md5|hash|token|key|order|invoice|build)[^\n]{0,6}$"
#: Code points of text before a candidate that context labelers see.
CONTEXT_WIDTH = 24


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, m, pre, post>>, offsets in code points."""
    block = 256

    def measured(v):
        return let(F.struct(v["found"].alias("found"), v["gaps"].alias("gaps"), F.transform(v["gaps"], lambda g: F.char_length(g)).alias("gap")), stepped)

    def stepped(v):
        step = F.transform(v["found"], lambda m, i: F.get(v["gap"], i) + F.char_length(m))
        return let(F.struct(v["found"].alias("found"), v["gaps"].alias("gaps"), v["gap"].alias("gap"), step.alias("step")), summed)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def summed(v):
        # Running sums in blocks, so that a text with very many matches costs no square.
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(v["step"]) / block).cast("int")), lambda b: total(F.slice(v["step"], 1, b * block)))
        return let(
            sums,
            lambda before: F.transform(
                v["found"],
                lambda m, i: F.struct(
                    (
                        F.get(before, F.floor(i / block).cast("int"))
                        + total(F.slice(v["step"], F.floor(i / block).cast("int") * block + 1, i % block))
                        + F.get(v["gap"], i)
                    ).alias("start"),
                    m.alias("m"),
                    F.right(F.get(v["gaps"], i), F.lit(CONTEXT_WIDTH)).alias("pre"),
                    F.left(F.get(v["gaps"], i + 1), F.lit(1)).alias("post"),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:int,m:string,pre:string,post:string>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(
            let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), measured)
        ),
    )


def luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 0 against, 1 abstains."""
    out = F.when(F.coalesce(yes, F.lit(False)), "2")
    return (out if no is None else out.when(F.coalesce(no, F.lit(False)), "0")).otherwise("1")


def bucket(value: Column, second: float, third: float) -> Column:
    return F.when(value >= third, "2").when(value >= second, "1").otherwise("0")


def judged(kind: int, strict: bool, s: Column, d: Column) -> Column:
    """A candidate with its votes and features; ``s`` is the match, ``d`` its digits."""
    m, n = s["m"], F.length(d)
    yes, never = F.lit(True), F.lit(False)
    valid, checksum, gazetteer, shape = {
        0: (yes, None, m.rlike(rf"(?i)\.(?:{DOMAIN_ENDINGS})$"), F.length(m).between(6, 64)),
        1: (m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), None, ~m.rlike(r"^0*(?:0|127|255)\."), n >= 7),
        2: (n.between(12, 19) & F.when(n.between(12, 19), luhn(d)), n.between(12, 19) & F.when(n.between(12, 19), luhn(d)), d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), n.isin(13, 14, 15, 16)),
        3: (n.between(9, 15), None, F.when(m.startswith("+"), m.rlike(r"^\+(?:1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])")), n.between(10, 13)),
        4: (m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor)"), None, m.rlike(rf"(?:^| )(?:{any_of(FIRST_NAMES)}) "), m.rlike("^[A-Za-zñ.]+ [A-Z][a-z]{2,14}(?: [A-Z][a-z]{2,14})?$")),
        5: (F.when(m.rlike(KEY_STARTS), yes), m.rlike(HEX_DIGEST), F.when(m.rlike(KEY_STARTS), yes), (n >= 1) & m.rlike("[A-Za-z]") & (F.length(m) >= 12)),
    }[kind]
    base = valid if strict else never
    pre = s["pre"]
    against = pre.rlike(DIGEST_OF if kind == 5 else AGAINST)
    variety = F.size(F.array_distinct(F.split(F.lower(F.left(m, F.lit(256))), "")))
    votes = (
        vote(valid if kind == 5 else base, never if kind >= 4 else ~valid),
        F.lit("1") if checksum is None else vote(never, checksum) if kind == 5 else vote(checksum, ~checksum),
        vote(gazetteer, ~gazetteer),
        vote(pre.rlike(CONTEXT[kind]), against),
        vote(never, F.right(pre, F.lit(1)).rlike(r"[A-Za-z0-9_]") | s["post"].rlike(r"[A-Za-z0-9_]")),
        vote(shape, ~shape),
        bucket(F.length(m), 12, 24), bucket(n / F.greatest(F.length(m), F.lit(1)), 0.2, 0.8), bucket(variety, 7, 13),
    )
    return F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("first"), (s["start"] + F.char_length(m)).alias("end"),
        F.coalesce(base, never).alias("base"), F.concat(F.lit(str(kind)), *votes).alias("code"),
    )


def voter(kind: int, strict: bool, before: str | None):
    """The judge of a match, less what stands before its span."""

    def trimmed(s: Column) -> Column:
        return let(F.regexp_extract(s["m"], before, 0), lambda p: F.struct(
            (s["start"] + F.char_length(p)).alias("start"), F.substr(s["m"], F.char_length(p) + 1).alias("m"),
            F.right(F.concat(s["pre"], p), F.lit(CONTEXT_WIDTH)).alias("pre"), s["post"].alias("post")))

    digits = lambda s: let(F.regexp_replace(s["m"], "[^0-9]", ""), lambda d: judged(kind, strict, s, d))
    return digits if before is None else lambda s: let(trimmed(s), digits)


def above(spans: Column, end: Column) -> Column:
    """How many of the spans, in order, begin before ``end``, by binary search."""
    steps = F.when(F.size(spans) > 0, F.transform(F.sequence(F.floor(F.log2(F.size(spans))).cast("int"), F.lit(0)), lambda i: F.pow(F.lit(2), i).cast("int")))
    return F.aggregate(F.coalesce(steps, F.array().cast("array<int>")), F.lit(0), lambda low, s: low + F.when(F.coalesce(F.get(spans, low + s - 1)["first"] < end, F.lit(False)), s).otherwise(0))


def candidates(text: Column) -> Column:
    """Base spans, and other candidates that overlap none of them."""
    found = []
    for k, (kind, pattern, before) in enumerate(PATTERNS):
        strict, raw = k < len(BASE_KINDS), matches(text, pattern)
        if kind == 2:  # runs that cannot be card numbers
            raw = F.filter(raw, lambda s: F.length(s["m"]) >= 12)
        one = F.transform(raw, voter(kind, strict, before))
        if kind == 2:
            one = F.filter(one, lambda c: c["base"] | c["code"].rlike("^2..[12]2"))
        found.append(one.alias(f"k{k}"))

    def apart(v: Column) -> Column:
        every = [v[f"k{k}"] for k in range(len(PATTERNS))]
        # Spans of one kind do not overlap, so they stand in order of their ends too.
        return let(F.struct(*(F.filter(every[k], lambda x: x["base"]).alias(f"b{k}") for k in range(len(BASE_KINDS)))), lambda b: F.concat(*(
            F.filter(one, lambda x: x["base"] | ~reduce(lambda p, q: p | q, (clash(b[f"b{k}"], x) for k in range(len(BASE_KINDS))))) for one in every)))

    def clash(base: Column, x: Column) -> Column:
        last = F.get(base, above(base, x["end"]) - 1)
        return (F.size(base) > 0) & F.coalesce(last["end"] > x["first"], F.lit(False))

    return let(F.struct(*found), apart)


@dataclass
class Model:
    """Reliability of each labeler, by name, and the classifier's weights: a vote's, a feature's, and a bias for each kind."""

    reliability: dict[str, float]
    weights: list[list[float]]
    bias: list[float]

    def score(self, code: Column) -> Column:
        z = F.element_at(F.lit(self.bias), F.substring(code, 1, 1).cast("int") + 1)
        for j in range(len(LABELERS) + len(FEATURES)):
            z = z + F.element_at(F.lit(self.weights[j]), F.substring(code, j + 2, 1).cast("int") + 1)
        return 1 / (1 + F.exp(-z))


#: What labelers are taken for before any vote is seen: how often right, and the share of the votes that this counts for.
PRIOR_RIGHT, PRIOR_SHARE = 0.8, 0.2


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, float]]:
    """EM over vote patterns: posterior of each pattern, reliability of each labeler. Who abstains says nothing."""
    belief = {c: min(0.95, max(0.05, 0.5 + 0.15 * sum(int(v) - 1 for v in c[1:]))) for c in counts}
    right = {}
    for _ in range(rounds):
        prior = {}
        for kind in {c[0] for c in counts}:
            own = [c for c in counts if c[0] == kind]
            prior[kind] = (1 + sum(counts[c] * belief[c] for c in own)) / (2 + sum(counts[c] for c in own))
        says = []  # of each labeler: the chance of a vote for, given no span and given a span
        for j, name in enumerate(LABELERS):
            votes = {c: n for c, n in counts.items() if c[1 + j] != "1"}
            weight = 1 + PRIOR_SHARE * sum(votes.values())
            sides = []
            for span in (0, 1):
                share = {c: n * (belief[c] if span else 1 - belief[c]) for c, n in votes.items()}
                start = weight * (PRIOR_RIGHT if span else 1 - PRIOR_RIGHT)
                sides.append((start + sum(x for c, x in share.items() if c[1 + j] == "2")) / (weight + sum(share.values())))
            says.append(sides)
            agree = sum(n * (belief[c] if c[1 + j] == "2" else 1 - belief[c]) for c, n in votes.items())
            right[name] = (weight * PRIOR_RIGHT + agree) / (weight + sum(votes.values()))
        for c in counts:
            odds = math.log(prior[c[0]] / (1 - prior[c[0]]))
            for v, (no, yes) in zip(c[1:], says, strict=True):
                odds += 0 if v == "1" else math.log(yes / no) if v == "2" else math.log((1 - yes) / (1 - no))
            belief[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief, right


def train(counts: dict[str, int], rounds: int = 400, rate: float = 0.5, shrink: float = 1e-3) -> Model:
    """Logistic regression on the posteriors of the votes; ``counts`` is of votes followed by features."""
    known = len(LABELERS) + 1
    weights, bias = [[0.0] * 3 for _ in LABELERS + FEATURES], [0.0] * len(KINDS)
    if not counts:
        return Model({name: 0.5 for name in LABELERS}, weights, [-5.0] * len(KINDS))
    votes: dict[str, int] = {}
    for c, n in counts.items():
        votes[c[:known]] = votes.get(c[:known], 0) + n
    belief, right = reliabilities(votes)
    scale = {c: math.log1p(n) for c, n in counts.items()}
    whole = sum(scale.values())
    for _ in range(rounds):
        grad, slope = [[0.0] * 3 for _ in weights], [0.0] * len(KINDS)
        for c, n in scale.items():
            z = bias[int(c[0])] + sum(weights[j][int(v)] for j, v in enumerate(c[1:]))
            miss = n / whole * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - belief[c[:known]])
            slope[int(c[0])] += miss
            for j, v in enumerate(c[1:]):
                grad[j][int(v)] += miss
        bias = [b - rate * g for b, g in zip(bias, slope, strict=True)]
        weights = [[w - rate * (g + shrink * w) for w, g in zip(ws, gs, strict=True)] for ws, gs in zip(weights, grad, strict=True)]
    return Model(right, weights, bias)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> tuple[DataFrame, Model]:
    """Rows of id and ``found``, array<struct<kind, first, end, base, p>> in order; and the fitted model."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = stash(docs.select(F.col(id_col).alias("id"), candidates(text).alias("c")), "pii")
    counted = seen.select(F.explode("c.code").alias("code")).groupBy("code").count().collect()
    model = train({r["code"]: r["count"] for r in counted})

    def kept(v):
        scored = F.transform(v["c"], lambda x: x.withField("p", F.when(x["base"], 1.0).otherwise(model.score(x["code"]))))
        free = F.filter(scored, lambda x: x["base"] | (x["p"] >= threshold))
        order = F.transform(free, lambda x: F.struct(x["first"], x["kind"], x["end"], x["base"], x["p"]))
        return F.array_sort(order)

    return seen.select(F.col("id").alias(id_col), let(F.struct("c"), kept).alias("found")), model


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["first"].cast("string"), x["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = find(read_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    more = F.size(F.filter("found", lambda x: ~x["base"])).cast("long").alias("n_more")
    every = F.size("found").cast("long").alias("n_spans")
    return found.select(
        "doc_id", *counts, F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"), more, every
    )


QUERIES = {"op1_pii": op1_pii}
ORACLE: dict = {}
