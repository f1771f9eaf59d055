"""Repair of recognised lines: ordered corrections and the optional enhancer, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slips.functions import patterns as P
from slips.functions.text import let, rx


def rewrite(line: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """Apply (pattern, replacement, ignore case) rules in order."""
    return reduce(lambda c, r: F.regexp_replace(c, rx(r[0], r[2]), r[1]), rules, line)


#: A misread character and the one after it, and a noncharacter that marks the former.
MISREAD, MARK = r"(?<=\d)([Ol])(\d)|(?<=\p{Lu})([01])(\p{Lu})", "\ufdd0"
REPAIRED = {"O": "0", "l": "1", "0": "O", "1": "I"}


def confusions(line: Column) -> Column:
    """O, l between digits and 0, 1 between capitals, left to right: what stands before is already repaired.

    After a repair the next character is a digit or capital that stays as it is, so a match takes it along.
    """
    marked = F.regexp_replace(line, MISREAD, f"{MARK}$1$2$3$4")
    return F.when(line.rlike(MISREAD), reduce(lambda c, r: F.replace(c, F.lit(MARK + r[0]), F.lit(r[1])), REPAIRED.items(), marked)).otherwise(line)


def may_need(line: Column) -> Column:
    """Whether a correction could fit a line: cheap tests, at least one of which holds wherever one does. Words that are
    corrected without regard to case are told by parts whose letters have no other forms than two."""
    has, small = line.contains, F.lower(line).contains
    amount, times = has("P") & has("."), (has("x") | has("X")) & line.rlike(rx(r"\d\s+[xX]\s+\d", False))
    tests = [line.rlike("[A-Z][a-z]|[a-z][A-Z]"), amount, *map(has, ("_", "¥", "MIN", "ID#", "CARE", "SUPPORT", "SERVICE", "CENTER", "STORE")), times, small("phone"), small("onal"), line.rlike(MISREAD)]
    return reduce(lambda a, b: a | b, tests)


def correct_line(line: Column) -> Column:
    """All corrections of one line; null and empty lines stay as they are."""
    return F.when(may_need(line), rewrite(confusions(rewrite(line, P.CORRECT_SYMBOLS)), P.CORRECT_WORDS)).otherwise(line)


def enhance_line(line: Column) -> Column:
    return rewrite(line, P.ENHANCE)


def correct_lines(lines: Column) -> Column:
    return F.transform(lines, correct_line)


def enhance_lines(lines: Column) -> Column:
    return F.transform(lines, enhance_line)


def _with_original(lines: Column, repair, flag: str) -> Column:
    """Line structs with repaired text; the flag and the original are set where something changed."""

    def one(x):
        return let(
            repair(x["text"]),
            lambda new: x.withField("text", new)
            .withField(flag, F.when(new != x["text"], True))
            .withField("original_text", F.when(new != x["text"], x["text"])),
        )

    return F.transform(lines, one)


def correct_ocr_lines(lines: Column) -> Column:
    return _with_original(lines, correct_line, "pattern_corrected")


def enhance_ocr_lines(lines: Column) -> Column:
    return _with_original(lines, enhance_line, "enhanced")


def change_type(old: Column, new: Column) -> Column:
    n_words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return (
        F.when(n_words(new) > n_words(old), "spacing_added")
        .when(new.contains("₱") & ~old.contains("₱"), "peso_sign_restored")
        .when(new.contains("0") & old.contains("O"), "character_swap_O_0")
        .when(new.contains("O") & old.contains("0"), "character_swap_0_O")
        .when(old.contains("MIN") & new.contains("MTN"), "systematic_error_MIN_MTN")
        .otherwise("other")
    )


def correction_report(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """Per document: total_lines, lines_corrected, correction_rate and the corrections in line order."""
    pairs = F.transform(F.col(lines), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("original"), correct_line(x).alias("corrected")))
    seen = docs.select("doc_id", F.explode(F.array(F.struct(pairs.alias("p")))).alias("v")).select("doc_id", F.col("v.p").alias("p"))
    changed = F.filter("p", lambda x: x["original"] != x["corrected"])
    full = F.transform(changed, lambda x: x.withField("change_type", change_type(x["original"], x["corrected"])))
    n, total = F.size(changed), F.size("p")
    return seen.select(
        "doc_id",
        total.alias("total_lines"),
        n.alias("lines_corrected"),
        F.when(total > 0, n / total).otherwise(0.0).alias("correction_rate"),
        full.alias("corrections"),
    )


def enhancement_report(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """Per document: whether and where the enhancer changes a line (0 or 1 each)."""
    marks = F.transform(F.col(lines), lambda x: (enhance_line(x) != x).cast("int"))
    seen = docs.select("doc_id", F.explode(F.array(F.struct(marks.alias("m")))).alias("v")).select("doc_id", F.col("v.m").alias("changes"))
    return seen.select("doc_id", F.array_contains("changes", 1).alias("enhanced"), F.size("changes").alias("total_lines"), "changes")
