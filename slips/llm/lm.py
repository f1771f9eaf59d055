"""Language-model scores from an Elias-Fano n-gram trie.

The vocabulary is every word of the training texts, and every bigram and trigram of them is kept, however rare:
what the model holds grows with the corpus. A trigram's probability is absolutely discounted and interpolates with
that of the bigram, whose counts are smoothed by a Dirichlet prior, the unigrams; words that training never saw
share the mass of one unseen word.

Texts are gathered into chunks that carry their own dictionary. First each chunk sends its words to blocks of words,
which answer with each word's count and, if more than one chunk has it, its number. A trigram whose first two words
are such shared words has its context dealt to a block by hash: the chunk sends its distinct contexts, what follows
each, and how often in training. The block sums the counts of its contexts and packs them as trie levels of monotone
pointers and context-relative ids in Elias-Fano form with one-byte probabilities, and answers each chunk by successor
search. A context with a word that only one chunk has is complete in that chunk, which packs those into a trie of its own;
where only the third word is the chunk's own, the block is told how many such words follow the context and how often.
How often a bigram occurs is the total of the context that it is, so the same answers give the lower order.
Blocks and chunks are of bounded size in expectation (a text is never cut, a context never split), nothing but totals
passes through the driver, and the scores do not depend on how texts are gathered.

Words are known by 62-bit hashes: among 10^8 different words two are taken for one with probability about 1/900.

Null texts count as empty: one end token. A null id counts as the empty text in the fold rule. Repeated
rows count as often as they occur and score alike. Without training rows every word is unknown. Further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read_table, stash
from .elias_fano import LEVELS, Level, quantise
from .texts import FOLD_BLANKS, mix, slices, squeeze, text_buffer, unsqueeze, word_hashes

#: Discount of trigrams, and weight of the prior of bigrams in tokens.
DISCOUNT, PRIOR = 0.75, 400.0
#: Trigrams that a block is sent, in expectation.
BLOCK = 1_000_000
#: Tokens of a chunk; the text that reaches it is taken whole.
CHUNK = 900_000
#: Numbers of the start, the end, what follows it, and a third word that only its chunk has; shared words follow.
START, END, AFTER, OWN, FIRST = 0, 1, 2, 3, 4
#: In a chunk the words of its dictionary follow start, end and what follows it.
MARKS = 3
#: The byte that says that a trigram is not in the trie.
ABSENT = 255

CODED = "chunk long, doc_id array<{0}>, held_out array<boolean>, sizes binary, words binary, held binary, trained binary, ids binary, n long, ends long"


def coded(docs: DataFrame, kind: str) -> DataFrame:
    """Chunks of texts: rows' ids and folds, tokens of each, the dictionary (sorted word hashes, how often the chunk and its
    training texts have each), and the tokens as ranks of their words by how often the chunk has them."""
    names = [x.split()[0] for x in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        ids, folds, hashes, sizes, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            words, places = np.unique(np.concatenate(hashes), return_inverse=True)
            n, own, fold = np.concatenate(sizes), pa.concat_arrays(ids), pa.concat_arrays(folds)
            training = np.repeat(~fold.to_numpy(zero_copy_only=False).astype(bool), n)
            held, trained = np.bincount(places, minlength=len(words)), np.bincount(places, training, len(words)).astype(np.int64)
            rank = np.empty(len(words), np.int64)
            rank[by_count(held)] = np.arange(len(words))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own, fold)]
            blobs = [pa.array([squeeze(x)], pa.binary()) for x in (n, np.diff(words, prepend=0), held, trained, rank[places])]
            longs = [pa.array([x], pa.int64()) for x in (len(places) + 2 * len(n), len(n) - fold.true_count)]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | nth], pa.int64()), *lists, *blobs, *longs], names=names)

        for batch in batches:
            body, at = text_buffer(batch.column(2))
            for low, high in slices(at):
                h, n = word_hashes(body, at[low : high + 1], FOLD_BLANKS)
                ids.append(batch.column(0).slice(low, high - low))
                folds.append(batch.column(1).slice(low, high - low))
                hashes.append((h >> np.uint64(2)).astype(np.int64))
                sizes.append(n.astype(np.int64))
                size += len(h) + 2 * len(n)
                if size >= CHUNK:
                    yield out()
                    nth += 1
                    ids, folds, hashes, sizes, size = [], [], [], [], 0
        if sizes:
            yield out()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, CODED.format(kind))


def by_count(n: np.ndarray) -> np.ndarray:
    """Places of the largest counts first; frequent words so have small ranks, which take fewer bytes."""
    return np.argsort(-n, kind="stable")


#: What goes between chunks and blocks: packed columns.
PARCEL = "dest long, source long, a binary, b binary, c binary, d binary, total long, kinds long"
NAMES = [x.split()[0] for x in PARCEL.split(", ")]


def parcels(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in rows], t) for k, t in enumerate(kinds)], names=NAMES)


def word_parcels(seen: DataFrame, blocks: int) -> DataFrame:
    """Each chunk's words by block of words (a range of hashes), with how often its training texts have them."""
    width = -(-(1 << 62) // blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, trained = np.cumsum(unsqueeze(r["words"])), unsqueeze(r["trained"])
                cuts = np.searchsorted(words // width, np.arange(blocks + 1))
                some = np.flatnonzero(np.diff(cuts)).tolist()
                yield parcels([(b, r["chunk"], squeeze(np.diff(words[cuts[b] : cuts[b + 1]], prepend=0)), squeeze(trained[cuts[b] : cuts[b + 1]])) for b in some])

    return seen.select("chunk", "words", "trained").mapInArrow(run, PARCEL)


def answer_words(sent: DataFrame, blocks: int) -> DataFrame:
    """Answers to chunks: numbers of words (0: only this chunk has it) and their counts; and each block's totals (dest -1)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["source"])
        block = rows[0]["dest"]
        own = [np.cumsum(unsqueeze(r["a"])) for r in rows]
        words, back = np.unique(np.concatenate(own), return_inverse=True)
        # Sums of whole numbers: exact as long as a word occurs less than 2^53 times.
        count = np.bincount(back, np.concatenate([unsqueeze(r["b"]) for r in rows]), len(words)).astype(np.int64)
        shared = np.flatnonzero(np.bincount(back, minlength=len(words)) > 1)
        number = np.zeros(len(words), np.int64)
        number[shared[np.argsort(-count[shared], kind="stable")]] = np.arange(len(shared)) * blocks + block + FIRST
        out, low = [(-1, block, None, None, None, None, int(count.sum()), int((count > 0).sum()))], 0
        for r, x in zip(rows, own, strict=True):
            at = back[low : low + len(x)]
            low += len(x)
            out.append((r["source"], -1 - block, squeeze(number[at]), squeeze(count[at])))
        return pa.Table.from_batches([parcels(out)])

    return sent.groupBy("dest").applyInArrow(run, PARCEL)


def block_of(first: np.ndarray, second: np.ndarray, blocks: int) -> np.ndarray:
    h = mix(first.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    return (mix(h) % np.uint64(blocks)).astype(np.int64)


class Trie:
    """Trigrams under their contexts: first word, second word, then the words that follow."""

    def __init__(self, size: int, u: np.ndarray, v: np.ndarray, parent: np.ndarray, w: np.ndarray, n: np.ndarray, more: np.ndarray, kinds: np.ndarray):
        """Of distinct sorted contexts (u, v) of words below ``size``; of the distinct sorted words ``w`` that follow them in
        training, n times; and of ``kinds`` other words, that follow ``more`` times in all."""
        at = np.flatnonzero(n > 0)
        parent, w, n = parent[at], w[at], n[at]
        self.whole = np.bincount(parent, n, len(u)).astype(np.int64) + more
        self.left = quantise(np.clip(DISCOUNT * (np.bincount(parent, minlength=len(u)) + kinds) / np.maximum(self.whole, 1), 1e-7, 1))
        self.top = Level.build(size, u, v, np.ones(len(u)))
        self.words = Level.build(len(u), parent, w, np.maximum((n - DISCOUNT) / self.whole[parent], 2e-7))

    def contexts(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of contexts (below 0: not there), the level of what each leaves to the lower order, and its total."""
        none = np.zeros(len(u), np.int64)
        if not len(self.whole):
            return none - 1, none, none
        at, known = self.top.find(u, v)
        known &= self.whole[at] > 0
        return np.where(known, at, -1), np.where(known, self.left[at], 0).astype(np.int64), np.where(known, self.whole[at], 0)

    def levels(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Levels of trigrams' probabilities."""
        at, found = self.words.find(context, w)
        return np.where(found, self.words.values[at], ABSENT).astype(np.int64) if len(self.words.values) else np.full(len(w), ABSENT, np.int64)


def alone(pair: np.ndarray, word: np.ndarray, n: np.ndarray, kinds: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the answer to a chunk's entries and contexts would be if no other chunk had them; answers tell what differs."""
    whole = np.bincount(pair, n, pairs).astype(np.int64)
    left = quantise(np.clip(DISCOUNT * np.bincount(pair, kinds, pairs) / np.maximum(whole, 1), 1e-7, 1)).astype(np.int64)
    level = quantise(np.maximum((n - DISCOUNT) / np.maximum(whole[pair], 1), 2e-7)).astype(np.int64)
    return np.where((n > 0) & (word != OWN), level, ABSENT), np.where(whole > 0, left, 0), whole


class Chunk:
    """A row of ``coded``, and its trigrams: those of a text are its tokens, its end, and what follows the end."""

    def __init__(self, row: dict, answers: list[dict], blocks: int):
        answers = sorted(answers, key=lambda r: -r["source"])
        numbers, counts = ([unsqueeze(r[c]) for r in answers] for c in "ab")
        self.number = np.concatenate([[START, END, AFTER], *numbers]).astype(np.int64)
        self.count = np.concatenate([np.zeros(MARKS, np.int64), *counts])
        self.sizes, ids = unsqueeze(row["sizes"]), by_count(unsqueeze(row["held"]))[unsqueeze(row["ids"])]
        n = len(self.sizes)
        self.at = np.concatenate(([0], np.cumsum(self.sizes + 2)))  # trigrams before each text
        s = np.full(len(ids) + 4 * n, START, np.int64)
        s[np.arange(len(ids)) + np.repeat(4 * np.arange(n) + 2, self.sizes)] = ids + MARKS
        stop = self.at[1:] + 2 * np.arange(1, n + 1)
        s[stop - 2], s[stop - 1] = END, AFTER
        where = np.arange(self.at[-1]) + np.repeat(2 * np.arange(n), self.sizes + 2)
        self.v, self.w = s[where + 1], s[where + 2]
        training = np.repeat(~np.array(row["held_out"], bool), self.sizes + 2)
        # Distinct contexts and trigrams; ``back`` has each trigram's place among the distinct.
        size = len(self.number)
        pair, place = np.unique(s[where] * size + self.v, return_inverse=True)
        key, self.back = np.unique(place * size + self.w, return_inverse=True)
        self.pu, self.pv, self.context, self.kw = pair // size, pair % size, key // size, key % size
        self.n = np.bincount(self.back, training, len(key)).astype(np.int64)
        alone = self.number == 0
        alone[:MARKS] = False
        self.own_pair = alone[self.pu] | alone[self.pv]
        self.own_word = alone[self.kw]
        # Shared contexts by block, and by their words' numbers; entries by context and third word.
        shared = np.flatnonzero(~self.own_pair)
        block = block_of(self.number[self.pu[shared]], self.number[self.pv[shared]], blocks)
        order = np.lexsort((self.number[self.pv[shared]], self.number[self.pu[shared]], block))
        self.pairs = shared[order]
        self.pair_cuts = np.searchsorted(block[order], np.arange(blocks + 1))
        position = np.full(len(pair), -1, np.int64)
        position[self.pairs] = np.arange(len(self.pairs))
        self.sent = np.flatnonzero(position[self.context] >= 0)
        third = np.where(self.own_word[self.sent], OWN, self.number[self.kw[self.sent]])
        known, rank = np.unique(third, return_inverse=True)
        entry, self.to_entry = np.unique(position[self.context[self.sent]] * max(1, len(known)) + rank, return_inverse=True)
        self.entry_pair, self.entry_word = entry // max(1, len(known)), known[entry % max(1, len(known))]
        self.entry_cuts = np.searchsorted(self.entry_pair, self.pair_cuts)
        self.entry_n = np.bincount(self.to_entry, self.n[self.sent], len(self.entry_pair)).astype(np.int64)
        self.entry_kinds = np.bincount(self.to_entry, self.n[self.sent] > 0, len(self.entry_pair)).astype(np.int64)

    def parcels(self, chunk: int) -> pa.RecordBatch:
        n, kinds = self.entry_n, self.entry_kinds
        u, v = self.number[self.pu[self.pairs]], self.number[self.pv[self.pairs]]
        follow = np.bincount(self.entry_pair, minlength=len(u))
        rows = []
        for b in np.flatnonzero(np.diff(self.pair_cuts)).tolist():
            p, e = slice(self.pair_cuts[b], self.pair_cuts[b + 1]), slice(self.entry_cuts[b], self.entry_cuts[b + 1])
            own = self.entry_word[e] == OWN
            context = np.concatenate((np.diff(u[p], prepend=0), v[p], follow[p]))
            rows.append((b, chunk, squeeze(context), squeeze(self.entry_word[e]), squeeze(n[e]), squeeze(kinds[e][own])))
        return parcels(rows)

    def own_trie(self) -> tuple[Trie, np.ndarray]:
        """Trie of the contexts that only this chunk has, and their places among all contexts."""
        pairs = np.flatnonzero(self.own_pair)
        position = np.full(len(self.own_pair), -1, np.int64)
        position[pairs] = np.arange(len(pairs))
        at = np.flatnonzero(position[self.context] >= 0)
        none = np.zeros(len(pairs), np.int64)
        return Trie(len(self.number), self.pu[pairs], self.pv[pairs], position[self.context[at]], self.kw[at], self.n[at], none, none), pairs

    def looked_up(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct trigram: its probability, what its context leaves to the lower order, and the context's total."""
        level = np.full(len(self.kw), ABSENT, np.int64)
        left, whole = np.zeros(len(self.pu), np.int64), np.zeros(len(self.pu), np.int64)
        trie, pairs = self.own_trie()
        places, left[pairs], whole[pairs] = trie.contexts(self.pu[pairs], self.pv[pairs])
        position = np.full(len(self.pu), -1, np.int64)
        position[pairs] = places
        mine = np.flatnonzero(self.own_pair[self.context])
        level[mine] = trie.levels(position[self.context[mine]], self.kw[mine])
        entries, own_left, own_whole = alone(self.entry_pair, self.entry_word, self.entry_n, self.entry_kinds, len(self.pairs))
        for r in answers:
            p, e = (slice(x[r["source"]], x[r["source"] + 1]) for x in (self.pair_cuts, self.entry_cuts))
            entries[e] ^= unsqueeze(r["a"])
            own_left[p] ^= unsqueeze(r["b"])
            own_whole[p] += unsqueeze(r["c"])
        left[self.pairs], whole[self.pairs] = own_left, own_whole
        level[self.sent] = entries[self.to_entry]
        # Words that only this chunk has, after shared contexts.
        single = self.sent[self.own_word[self.sent] & (self.n[self.sent] > 0)]
        level[single] = quantise(np.maximum((self.n[single] - DISCOUNT) / whole[self.context[single]], 2e-7))
        return np.where(level == ABSENT, 0.0, LEVELS[level]), LEVELS[left[self.context]], whole[self.context]


def trigram_parcels(seen: DataFrame, of_words: DataFrame, blocks: int) -> DataFrame:
    """Each chunk's shared contexts by block, what follows them, and how often in training."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Chunk(r, right.to_pylist(), blocks).parcels(r["chunk"]) for r in left.to_pylist()], schema=parcels([]).schema)

    chunks = seen.select("chunk", "held_out", "sizes", "held", "ids")
    return chunks.groupBy("chunk").cogroup(of_words.groupBy("dest")).applyInArrow(run, PARCEL)


def answer_trigrams(sent: DataFrame) -> DataFrame:
    """Answers to chunks: levels of the trigrams, and of each context what it leaves and its total."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["source"])
        block = rows[0]["dest"]
        us, vs, follow, ws, ns, more = [], [], [], [], [], []
        for r in rows:
            u, v, f = unsqueeze(r["a"]).reshape(3, -1)
            us.append(np.cumsum(u))
            vs.append(v)
            follow.append(f)
            ws.append(unsqueeze(r["b"]))
            ns.append(unsqueeze(r["c"]))
            kinds = (ns[-1] > 0).astype(np.int64)
            kinds[ws[-1] == OWN] = unsqueeze(r["d"])
            more.append(kinds)
        pair_ends, entry_ends = np.cumsum([len(x) for x in us]), np.cumsum([len(x) for x in ws])
        u, v, w, n, kinds = (np.concatenate(x) for x in (us, vs, ws, ns, more))
        known, places = np.unique(np.concatenate((u, v, w)), return_inverse=True)
        u, v, w = np.split(places, [len(u), len(u) + len(v)])
        pair, place = np.unique(u * len(known) + v, return_inverse=True)
        context = np.repeat(place, np.concatenate(follow))
        named = np.flatnonzero(known[w] != OWN)
        key, back = np.unique(context[named] * len(known) + w[named], return_inverse=True)
        single = np.setdiff1d(np.arange(len(w)), named, assume_unique=True)
        sums = lambda x: np.bincount(context[single], x[single], len(pair)).astype(np.int64)
        trie = Trie(len(known), pair // len(known), pair % len(known), key // len(known), key % len(known), np.bincount(back, n[named], len(key)).astype(np.int64), sums(n), sums(kinds))
        at, left, whole = trie.contexts(pair // len(known), pair % len(known))
        level = np.full(len(w), ABSENT, np.int64)
        level[named] = trie.levels(at[key // len(known)], key % len(known))[back]
        out = []
        for r, p, e, f, word, n, kinds in zip(rows, pair_ends.tolist(), entry_ends.tolist(), follow, ws, ns, more, strict=True):
            own = place[p - len(f) : p]
            by_self = alone(np.repeat(np.arange(len(f)), f), word, n, kinds, len(f))
            out.append((r["source"], block, squeeze(level[e - len(word) : e] ^ by_self[0]), squeeze(left[own] ^ by_self[1]), squeeze(whole[own] - by_self[2])))
        return pa.Table.from_batches([parcels(out)])

    return sent.groupBy("dest").applyInArrow(run, PARCEL)


SCORED = "doc_id {0}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def assembled(seen: DataFrame, answers: DataFrame, blocks: int, total: int, kinds: int, ends: int, kind: str) -> DataFrame:
    """Scores of each chunk's texts from the answers to its words and trigrams."""
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, told = left.to_pylist()[0], right.to_pylist()
        c = Chunk(row, [r for r in told if r["source"] < 0], blocks)
        p3, rest, whole = c.looked_up([r for r in told if r["source"] >= 0])
        count = c.count
        count[START] = count[END] = ends
        p1 = (count + 0.5) / (total + 0.5 * (kinds + 2))  # the unseen word and the end are two more
        # A bigram's count is the total of the context that the next trigram has.
        own = np.ones(len(c.v), bool)
        own[c.at[1:] - 1] = False
        own = np.flatnonzero(own)
        v, w, pair = c.v[own], c.w[own], whole[c.back[own + 1]]
        lower = (pair + PRIOR * p1[w]) / (count[v] + PRIOR)
        at = c.back[own]
        lm = np.log10(p3[at] + rest[at] * lower)
        n = c.sizes + 1
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        sums = lambda x: np.add.reduceat(x, begin)
        base = sums(np.log10(count + 0.5)[w]) - n * np.log10(total + 0.5 * (kinds + (ends > 0) + 1))
        columns = [left["doc_id"].combine_chunks().flatten(), left["held_out"].combine_chunks().flatten(), pa.array(n), pa.array(sums((count[w] > 0).astype(np.int64)))]
        return pa.Table.from_arrays([*columns, pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(sums(lm))], names=names)

    chunks = seen.select("chunk", "doc_id", "held_out", "sizes", "held", "ids")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("dest")).applyInArrow(run, SCORED.format(kind))


def score(docs: DataFrame) -> DataFrame:
    """docs has doc_id, text and held_out; one row per input row with the token counts and both scores."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = stash(coded(docs, kind), "lm-coded")
    n, ends = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK))
    word_blocks = max(1, blocks // 2)
    found = stash(answer_words(word_parcels(seen, word_blocks), word_blocks), "lm-words")
    total, kinds = found.where("dest < 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    of_words = found.where("dest >= 0").select("dest", "source", "a", "b", "c")
    of_trigrams = answer_trigrams(trigram_parcels(seen, of_words, blocks)).select("dest", "source", "a", "b", "c")
    return assembled(seen, of_words.unionByName(of_trigrams), blocks, total + ends, kinds, ends, kind)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1))


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLE: dict = {}
