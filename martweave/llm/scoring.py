"""Language-model scores with stupid backoff, from bigram and word counts of the whole corpus.

1. Word counts: every task sums the words of its slices, Spark sums the rest by hash. Words
   with a share of at least ``2**-VOCABULARY_BITS`` of all words are frequent; there are at
   most ``2**VOCABULARY_BITS`` of them whatever the corpus, and their counts go to every task.
2. Bigram counts: the bigrams of every document, counted per document, are partitioned by
   hash in packed rows and summed where equal ones meet. A bigram of frequent words goes by
   its own hash. One with a rare word goes to the place of that word's hash, and to both
   places if both are rare: there all bigrams of the rare word meet, which gives its count,
   and no rare word has enough of them to weigh on a task. So every word has its own count,
   and the bound only says by which way it is found.
3. Each document's bigrams are turned into partial scores where they meet, and these are
   packed by document and summed.

With ``c`` for counts and ``n`` for the words of the corpus, a word ``w`` after ``v``
scores ``c(v w) / c(v)`` if the corpus has the bigram ``MIN_COUNT`` times or more, and
``BACKOFF * c(w) / n`` if it has not. A document's first word follows a mark of its own,
which counts once per document with words. Words are ASCII-lowered.

A null or empty text has no words, and null scores. Rows that repeat doc_id and text get
equal scores, and each of them counts. A null doc_id is an id. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage
from martweave.llm import packed
from martweave.llm.mixing import word_count
from martweave.llm.words import LOWER, Slice, text_slices

VOCABULARY_BITS = 20
BACKOFF = 0.4
MIN_COUNT = 2
FLUSH_WORDS = 2_000_000
FLUSH_KEYS = packed.FLUSH_KEYS // 2
MARK = np.uint64(0)
# What the number of an entry says besides how often it stands in the document: a bigram of
# frequent words, or one of a rare word that is its second or its first; the other word follows with 0.
SECOND, FIRST, ROLE = 1, 2, 30


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return found, n if counts is None else np.bincount(at, counts, len(found)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): 64-bit word hashes and their counts in the whole corpus; word 0 counts documents with words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = _summed(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for s in text_slices(batch.column(0), LOWER):
                held += [s.hashes(), np.zeros(np.count_nonzero(s.counts), np.uint64)]
                size += len(held[-2])
                if size >= FLUSH_WORDS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words in ascending hash order, then the mark before a first word, and the counts of all."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, documents: int) -> None:
        self.words, self.total = words, total
        self.mark, self.rare = len(words), len(words) + 1
        self.counts = np.concatenate((counts, [documents, 0])).astype(np.float64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words; MARK is the mark, and what is not listed is rare."""
        distinct, at = np.unique(hashes, return_inverse=True)
        found = np.full(len(distinct), self.rare, np.uint64)
        if len(self.words):
            spot = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
            found = np.where(self.words[spot] == distinct, spot, self.rare).astype(np.uint64)
        found[distinct == MARK] = self.mark
        return found[at]


def vocabulary(docs: DataFrame, bits: int = VOCABULARY_BITS) -> Vocabulary:
    counts = stage(word_counts(docs), "lm-words")
    total, documents = counts.agg(F.sum(F.when(F.col("word") != 0, F.col("n"))), F.max(F.when(F.col("word") == 0, F.col("n")))).first()
    known = counts.filter((F.col("word") != 0) & (F.col("n") * (1 << bits) >= (total or 0))).toArrow()  # at most 2**bits rows, the rest stays where it is
    words = known.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Vocabulary(words[order], known.column("n").to_numpy()[order], total or 0, documents or 0)


def _bigrams(s: Slice, known: Vocabulary, shift: np.uint64) -> tuple[np.ndarray, ...]:
    """(key, row, number, route) of the distinct bigrams of every row; two ids in one key, or a rare word and the other one."""
    words = s.hashes()
    ids = known.ids(words)
    filled = np.flatnonzero(s.counts)
    opening = s.rows[filled]
    before, first = np.empty(len(ids), np.uint64), np.empty(len(ids), np.uint64)
    before[1:], first[1:] = ids[:-1], words[:-1]
    before[opening], first[opening] = known.mark, MARK
    place = np.repeat(np.arange(len(filled), dtype=np.uint64), s.counts[filled])
    plain = (ids != known.rare) & (before != known.rare)
    # A slice has at most 2**20 bytes or one row, so row and bigram fit in one number.
    key = ((place << (2 * shift)) | (before << shift) | ids)[plain]
    found, times = np.unique(key, return_counts=True)
    width = np.uint64((1 << int(2 * shift)) - 1)
    keys, owner = [found & width], [(found >> (2 * shift)).astype(np.int64)]
    numbers, routes = [times], [keys[0]]
    rest = np.flatnonzero(~plain)
    v, w, p = first[rest], words[rest], place[rest]
    order = np.lexsort((w, v, p))
    v, w, p, rest = v[order], w[order], p[order], rest[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (p[1:] != p[:-1])
    start = np.flatnonzero(fresh)
    times = np.diff(np.concatenate((start, [len(p)])))
    v, w, p, rest = v[start], w[start], p[start].astype(np.int64), rest[start]
    for role, rare, other, at in ((SECOND, w, v, ids[rest] == known.rare), (FIRST, v, w, before[rest] == known.rare)):
        keys.append(np.column_stack((rare[at], other[at])).ravel())
        owner.append(np.repeat(p[at], 2))
        numbers.append(np.column_stack((times[at] | role << ROLE, np.zeros(np.count_nonzero(at), np.int64))).ravel())
        routes.append(np.repeat(rare[at], 2))
    keys, owner, numbers, routes = map(np.concatenate, (keys, owner, numbers, routes))
    order = np.argsort(owner, kind="stable")  # both words of an entry stay together
    return keys[order], filled[owner[order]], numbers[order], routes[order]


def _packed(parts: int, held: list) -> pa.RecordBatch:
    base = np.cumsum([0, *[len(h[4]) for h in held]])
    owner = np.concatenate([h[1] + b for h, b in zip(held, base)])
    keys, numbers, route, k, tag = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 4, 5))
    return packed.pack(parts, keys, owner, numbers, k, tag, route)


def _frequent(keys: np.ndarray, times: np.ndarray, known: Vocabulary, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(logarithm, found often enough) of every entry with two frequent words."""
    found, at = np.unique(keys, return_inverse=True)
    n = np.bincount(at, times, len(found))
    v, w = (found >> shift).astype(np.int64), (found & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    seen = n >= MIN_COUNT
    logs = np.log(np.where(seen, n / np.maximum(known.counts[v], 1), BACKOFF * known.counts[w] / known.total))
    return logs[at], seen[at]


def _rare(word: np.ndarray, other: np.ndarray, second: np.ndarray, times: np.ndarray,
          known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logarithm, found often enough, counts here) of every entry of a rare word; all entries of the word are given.

    A bigram of two rare words has two entries: the place of the first word knows what it is
    divided by if it is found often enough, that of the second what it backs off to if not.
    """
    distinct, at = np.unique(word, return_inverse=True)
    own = np.bincount(at[second], times[second], len(distinct))[at]  # every occurrence is the second word of one bigram
    order = np.lexsort((other, word, second))
    fresh = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    fresh[1:] = (other[a] != other[b]) | (word[a] != word[b]) | (second[a] != second[b])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    n = np.bincount(group, times)[group]
    ids = known.ids(other).astype(np.int64)
    frequent, count = ids != known.rare, known.counts[ids]
    seen = n >= MIN_COUNT
    divisor, backoff = np.where(second, count, own), np.where(second, own, count)
    here = np.where(seen, ~second | frequent, second | frequent)
    share = np.where(seen, n / np.maximum(divisor, 1), BACKOFF * backoff / known.total)
    return np.log(np.where(here, share, 1)), seen, second | frequent


def score(docs: DataFrame, bits: int = VOCABULARY_BITS) -> DataFrame:
    """doc_id, n_words, log_score (mean natural logarithm per word), perplexity and backed_off (share of words)."""
    if not 0 < bits <= 20:
        raise ValueError("bits")
    spark = docs.sparkSession
    own = packed.named(docs)
    sent = spark.sparkContext.broadcast(vocabulary(own, bits))
    parts, shift = packed.part_count(spark, 2), np.uint64(bits + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            k, tag = batch.column("k").to_numpy(), batch.column("tag").to_numpy()
            for s in text_slices(batch.column("text"), LOWER):
                if not len(s.starts):
                    continue
                rows = slice(s.first_row, s.first_row + s.n_rows)
                held.append((*_bigrams(s, sent.value, shift), k[rows], tag[rows]))
                size += len(held[-1][0])
                if size >= FLUSH_KEYS:
                    yield _packed(parts, held)
                    held, size = [], 0
        if size:
            yield _packed(parts, held)

    def meet(part: packed.Part) -> Iterator[pa.RecordBatch]:
        known = sent.value
        other = np.flatnonzero(part.places == 0)
        role = part.places[other - 1] >> ROLE
        plain = np.ones(len(part.keys), bool)
        plain[other] = plain[other - 1] = False
        times = part.places[plain].astype(np.float64)
        logs, seen = _frequent(part.keys[plain], times, known, shift)
        sums = [np.bincount(part.owner[plain], t, len(part.k)).astype(np.float64) for t in (logs * times, times, np.where(seen, 0, times))]
        if len(other):
            times = (part.places[other - 1] & np.uint32((1 << ROLE) - 1)).astype(np.float64)
            logs, seen, counts = _rare(part.keys[other - 1], part.keys[other], role == SECOND, times, known)
            for total, t in zip(sums, (logs * times, times * counts, np.where(seen, 0, times * counts))):
                total += np.bincount(part.owner[other], t, len(part.k))
        # Two entries per document: the score's bits with the words, and the words that backed off.
        keys = np.column_stack((sums[0].view(np.uint64), np.zeros(len(part.k), np.uint64))).ravel()
        route = np.repeat(part.k.view(np.uint64) ^ part.tag.view(np.uint64), 2)
        yield packed.pack(parts, keys, np.repeat(np.arange(len(part.k)), 2), np.column_stack(sums[1:]).ravel(), part.k, part.tag, route)

    def add(part: packed.Part) -> Iterator[pa.RecordBatch]:
        values = (part.keys[::2].view(np.float64), part.places[::2], part.places[1::2])
        sums = [np.bincount(part.owner[::2], v, len(part.k)) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array(part.k), pa.array(part.tag), *[pa.array(x) for x in sums]], names=["k", "tag", "score", "n", "backed"])

    partial = packed.exchange(own.select("k", "tag", "text").mapInArrow(send, packed.SCHEMA), parts, meet, packed.SCHEMA)
    scores = packed.exchange(partial, parts, add, "k long, tag long, score double, n double, backed double")
    mean = F.col("score") / F.col("n")
    rows = own.select("doc_id", "k", "tag", word_count(F.col("text")).alias("n_words"))
    return rows.join(scores, ["k", "tag"], "left").select(
        "doc_id", "n_words", F.round(mean, 9).alias("log_score"), F.round(F.exp(-mean), 6).alias("perplexity"),
        F.round(F.col("backed") / F.col("n"), 9).alias("backed_off"))
