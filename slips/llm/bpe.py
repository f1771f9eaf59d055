"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the text's bytes cuts it into chunks, so a passage that many documents share falls
into the same chunks wherever it stands. Documents that share content are dealt to the same partition,
where each distinct chunk is encoded once, word by word, and the joins are repaired: the words on both sides of
a join are encoded again in one window, which must agree with the chunks' own tokens at its outer words.
A window that does not agree takes in the chunks at its sides and is encoded again, until it agrees or is the
whole text. Tokens equal those of the library's encoding of the whole text.

A worker keeps its encoder and what it last used of words, chunks and windows, by bytes, from one task to the next;
what has been forgotten is encoded again.

Null counts as the empty text, which has no tokens. Every input row gives one row, whatever its id;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table
from .texts import mix, slices, text_buffer

#: Bytes that the rolling hash sees, mean and least bytes between cuts, and the most.
SPAN, MEAN, LEAST, MOST = 16, 1024, 256, 8192
#: Bytes kept of words, chunks and windows in all.
KEPT = 128 << 20
#: Words at each end of a chunk that its join encodes again: the outer one must agree.
EDGE = 2

#: Words that are encoded at once, parted by blanks.
RUN = 256
#: Words that must come out of a run as they do alone, before a tokenizer's words are encoded in runs.
PROBE = "A b's It'll WORD word2 12,500.75 e-mail@host.org (x) \"quoted.\" a_b ... '' 's #1 <tag> http://a.b/c?d=e&f $5 100% ~ ^".split()

#: A blank, tab or line end parts words.
_WORD = re.compile(r"[^ \t\n\r]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(body: np.ndarray) -> list[int]:
    """Ends of the chunks of one text: where the hash of the last ``SPAN`` bytes says so.

    The hash doubles its window step by step, a cut never splits a UTF-8 character, and places closer
    than ``LEAST`` to the cut before are passed over.
    """
    n = len(body)
    if n <= LEAST:
        return [n]
    h, width, base = body.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < SPAN:
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    places = np.flatnonzero(mix(h) % np.uint64(MEAN) == 0) + SPAN
    places = places[places < n]
    places = places[(body[places] & 0xC0) != 0x80]
    found, last = [], 0
    for p in [*places.tolist(), n]:
        while p - last > MOST:
            q = last + MOST
            while q > last + 1 and body[q] & 0xC0 == 0x80:
                q -= 1
            found.append(q)
            last = q
        if p - last >= LEAST or p == n:
            if p > last:
                found.append(p)
            last = p
    return found


@dataclass(slots=True)
class Chunk:
    """Places of a chunk's inner stretch, between its first and last words, its tokens, and those of the words at its sides.

    ``ids`` is None for a chunk of too few words to have an inner stretch.
    """

    start: int = 0
    end: int = 0
    ids: np.ndarray | None = None
    before: np.ndarray | None = None
    after: np.ndarray | None = None


class Cache(dict):
    """Values by text, in two generations of half of ``most`` bytes each: what the younger has not used again goes with the older."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.used, self.older = most, 0, {}

    def put(self, text: str, value, nbytes: int) -> None:
        self[text] = value
        self.used += nbytes + 250

    def missing(self, texts: set[str], nbytes) -> list[str]:
        """Those of the texts that are not known; known ones move to the younger generation."""
        new = []
        for t in texts:
            if t not in self:
                if t in self.older:
                    self.put(t, self.older[t], nbytes(t, self.older[t]))
                else:
                    new.append(t)
        return new

    def room(self) -> None:
        if self.used > self.most // 2:
            self.older = dict(self)
            self.clear()
            self.used = 0


def steady(word: str) -> bool:
    """Whether neither small letters nor composed characters change how many bytes a word has."""
    return word.isascii() or (word == word.lower() and unicodedata.is_normalized("NFC", word))


def word_bytes(word: str, ids: bytes | np.ndarray) -> int:
    return len(word) + (len(ids) if isinstance(ids, bytes) else ids.nbytes)


def chunk_bytes(text: str, chunk: Chunk) -> int:
    return len(text) + 600 + (0 if chunk.ids is None else chunk.ids.nbytes)


def window_bytes(text: str, ids: np.ndarray) -> int:
    return len(text) + 100 + ids.nbytes


class Encoder:
    """Encodes texts as the library does, reusing chunks and windows seen before."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.names, self.digits = [""] * (1 + max(vocabulary.values(), default=0)), [str(i) for i in range(1 + max(vocabulary.values(), default=0))]
        for token, i in vocabulary.items():
            self.names[i] = token
        self.words, self.chunks, self.windows = Cache(kept // 2), Cache(kept // 4), Cache(kept // 4)
        self.encoded = self.reused = self.widened = 0
        end = getattr(self.library.model, "end_of_word_suffix", None) or ""
        self.lengths = np.array([len(t.removesuffix(end)) for t in self.names])
        found = self.runs([PROBE])[0]
        self.in_runs = found == [ids.tobytes() for ids in self.whole(PROBE)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, np.int32) for e in found]

    def decode(self, ids: list[int]) -> str:
        """The library's decoding; without a decoder of its own it joins tokens by blanks."""
        if self.library.decoder is None:
            return " ".join(map(self.names.__getitem__, ids))
        return self.library.decode(ids, skip_special_tokens=False)

    def runs(self, runs: list[list[str]]) -> list[list[bytes] | None]:
        """Tokens of the words of each run, encoded as one text; None where its tokens do not end where the words end.

        For words that keep their bytes when normalised (``steady``) and tokens that have as many characters as the bytes they stand for, besides the mark of a word's end; with others the ends do not agree.
        """
        found = []
        for run, ids in zip(runs, self.whole([" ".join(run) for run in runs]), strict=True):
            long, wanted = self.lengths[ids], np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in run])
            ends = np.cumsum(long)
            at = np.searchsorted(ends, wanted)
            if not len(ids) or long.min() < 1 or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
                found.append(None)
                continue
            places, raw = ((at + 1) * ids.itemsize).tolist(), ids.tobytes()
            found.append([raw[a:b] for a, b in zip([0, *places], places, strict=False)])
        return found

    def learn_words(self, words: set[str]) -> None:
        new = self.words.missing(words, word_bytes)
        joined, alone = [], new
        if self.in_runs:
            alone = []
            for w in new:
                (joined if steady(w) else alone).append(w)
        runs = [joined[k : k + RUN] for k in range(0, len(joined), RUN)]
        put = self.words.put
        for run, coded in zip(runs, self.runs(runs), strict=True):
            if coded is None:
                alone += run
            else:
                for w, ids in zip(run, coded, strict=True):
                    put(w, ids, len(w) + len(ids))
        for w, ids in zip(alone, self.whole(alone), strict=True):
            put(w, ids.tobytes(), word_bytes(w, ids))

    def learn_chunks(self, texts: set[str]) -> None:
        """Encode new chunks, word by word between the joins."""
        new = self.chunks.missing(texts, chunk_bytes)
        self.encoded += len(new)
        split = [_WORD.findall(t) for t in new]
        self.learn_words({w for ws in split for w in ws})
        words, coded = self.words, lambda own: np.frombuffer(b"".join(own), np.int32)
        for t, ws in zip(new, split, strict=True):
            c = Chunk()
            if len(ws) > 2 * EDGE + 1:
                start, end = 0, len(t)
                for w in ws[:EDGE]:
                    start = t.index(w, start) + len(w)
                for w in ws[: -EDGE - 1 : -1]:
                    end = t.rindex(w, 0, end)
                c = Chunk(start, end, coded([words[w] for w in ws[EDGE:-EDGE]]), coded([words[ws[EDGE - 1]]]), coded([words[ws[-EDGE]]]))
            self.chunks.put(t, c, chunk_bytes(t, c))

    def encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        """Tokens of whole texts."""
        for known in (self.words, self.chunks, self.windows):
            known.room()
        split = []
        for body in bodies:
            last, own = 0, []
            for end in cuts(np.frombuffer(body, np.uint8)):
                own.append(body[last:end].decode())
                last = end
            split.append(own)
        self.reused += sum(map(len, split))
        self.learn_chunks({t for own in split for t in own})
        plans = [self.plan(own) for own in split]
        new = self.windows.missing({w for text, inner in plans for w in gaps(text, inner)}, window_bytes)
        for w, ids in zip(new, self.whole(new), strict=True):
            self.windows.put(w, ids, window_bytes(w, ids))
        return [self.assemble(text, inner) for text, inner in plans]

    def plan(self, own: list[str]) -> tuple[str, list[tuple[int, int, Chunk]]]:
        """A text and its inner stretches: from, to and chunk."""
        at, inner = 0, []
        for t in own:
            c = self.chunks[t]
            if c.ids is not None:
                inner.append((at + c.start, at + c.end, c))
            at += len(t)
        return "".join(own), inner

    def assemble(self, text: str, inner: list[tuple[int, int, Chunk]]) -> np.ndarray:
        """Tokens of windows and inner stretches in turn; a window spans a join, the start or the end."""
        windows = [self.windows[w] for w in gaps(text, inner)]
        k = 0
        while k < len(windows):
            left = inner[k - 1][2].after if k else NONE
            right = inner[k][2].before if k < len(inner) else NONE
            if agrees(windows[k], left, right):
                k += 1
                continue
            self.widened += 1
            low, high = max(0, k - 1), min(len(inner), k + 1)
            inner = inner[:low] + inner[high:]
            windows[low : high + 1] = self.whole([gaps(text, inner)[low]])
            k = low
        parts = [windows[0]]
        for (_, _, c), w in zip(inner, windows[1:], strict=True):
            parts += [c.ids, w]
        return np.concatenate(parts)


NONE = np.zeros(0, np.int32)


def gaps(text: str, inner: list[tuple[int, int, Chunk]]) -> list[str]:
    """What stands between inner stretches, before the first and after the last."""
    return [text[a:b] for a, b in zip([0, *(x[1] for x in inner)], [*(x[0] for x in inner), len(text)], strict=True)]


def agrees(window: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
    """Whether the window's outer tokens are those that the chunks have there."""
    n = len(window)
    return n >= len(left) + len(right) and np.array_equal(window[: len(left)], left) and np.array_equal(window[n - len(right) :], right)


@cache
def encoder_of(path: str) -> Encoder:
    """A worker's encoder."""
    return Encoder(path)


FIELDS = (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))


def together(docs: DataFrame, text_col: str) -> DataFrame:
    """Documents that share content side by side: dealt by their least sentence hash.

    A rebalance, so adaptive execution splits what a hot key makes too large and merges the small.
    """
    sentences = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[.\n]"), lambda s: F.length(s) >= 24)
    keyed = docs.withColumn("__key", F.array_min(F.transform(sentences, lambda s: F.xxhash64(s))))
    return keyed.hint("rebalance", F.col("__key")).drop("__key")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, deal: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    path = path or default_tokenizer()
    narrow = docs.select(F.col(id_col), F.col(text_col))
    narrow = together(narrow, text_col) if deal else narrow
    schema = T.StructType([narrow.schema[0], *(T.StructField(n, t) for n, t in FIELDS)])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            body, at = text_buffer(batch.column(1))
            for low, high in slices(at):
                coded = [c.tolist() for c in encoder.encode([body[a:b].tobytes() for a, b in zip(at[low:high], at[low + 1 : high + 1], strict=True)])]
                columns = [
                    batch.column(0).slice(low, high - low),
                    pa.array([len(ids) for ids in coded], pa.int64()),
                    pa.array([sha(" ".join(map(encoder.digits.__getitem__, ids))) for ids in coded], pa.string()),
                    pa.array([sha(encoder.decode(ids)) for ids in coded], pa.string()),
                ]
                if keep_ids:
                    columns.append(pa.array(coded, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE: dict = {}
