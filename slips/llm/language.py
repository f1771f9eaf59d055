"""Language identification by rank-order profiles.

The most frequent letter n-grams (n = 1 to 3, words padded by blanks) of a text, in order of frequency,
are compared with each language's profile: the distance is the sum over the text's n-grams of how far
each is out of its place, or the most there can be if the profile lacks it. Profiles are fitted on all
labelled rows, whose n-grams are counted in each task; scoring reads every whole text.

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing was learned.
Equal counts are ranked by n-gram, equal distances by language name. A null id counts as the empty text in
the fold rule. Rows with a null lang are scored but never learned from; repeated rows count as often as
they occur; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, read_table

#: N-grams of a profile and longest n-gram.
PROFILE, LONGEST = 400, 3
#: N-grams of texts that a task holds before it sums them up.
GATHER = 1_000_000
BLANK = 32


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (code points packed 21 bits each) and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = np.where(is_letter, codes, BLANK).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    s = np.concatenate(([BLANK], folded[keep], [BLANK]))
    inner = s != BLANK
    found, code = [s[inner]], s
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << 21) | s[n - 1 :]
        # No blank but at the ends: all middle places are letters, and one end at least.
        good = inner[: len(code)] | inner[n - 1 :] if n == 2 else np.logical_and.reduce([inner[k : k + len(code)] for k in range(1, n - 1)])
        found.append(code[good])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in order."""
    if len(codes) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.lexsort((codes, -counts))][:most]


class Profiles:
    """Language profiles: sorted n-grams with their ranks."""

    def __init__(self, by_lang: dict[str, list[int]]):
        self.names = sorted(by_lang)
        self.sorted, self.rank = [], []
        for name in self.names:
            codes = np.array(by_lang[name], np.int64)
            order = np.argsort(codes)
            self.sorted.append(codes[order])
            self.rank.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        top = ranked(codes, counts)
        place = np.arange(len(top))
        best, least = "und", None
        for name, known, rank in zip(self.names, self.sorted, self.rank, strict=True):
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            apart = np.where(known[at] == top, np.abs(rank[at] - place), PROFILE).sum()
            if least is None or apart < least:
                best, least = name, int(apart)
        return best, 1.0 - least / (PROFILE * len(top))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Profiles of the languages in ``labelled``, from all its rows.

    N-grams are counted in each partition and summed by a shuffle; only the profiles reach the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(found: list) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in ((lang, summed(found)) for lang, found in parts.items()):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

        parts: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                found = grams(text.as_py())
                parts.setdefault(lang.as_py(), []).append(found)
                size += len(found[0])
                if size > GATHER:
                    parts = {lang: [summed(found)] for lang, found in parts.items()}
                    size = sum(len(codes) for [(codes, _)] in parts.values())
                    if size > GATHER // 2:
                        yield from out()
                        parts, size = {}, 0
        yield from out()

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    by_lang: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        by_lang.setdefault(r["lang"], []).append(r["gram"])
    return by_lang


def predict(docs: DataFrame, by_lang: dict[str, list[int]], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with lang_pred and score."""
    narrow = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(by_lang)
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(len(keep)).to_pylist()]
            more = [pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=schema.names)

    return narrow.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    by_lang = fit(docs.where(~F.col("held_out")))
    return predict(docs, by_lang, ["doc_id", "held_out"])


QUERIES = {"op7_language_id": op7_language_id}
ORACLE: dict = {}
