"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII characters, ASCII letters lowered. A
document and a benchmark item that share a seed of ``min_match`` tokens are compared:
the longest matches between unmarked tokens are marked, longest first, without overlap,
and found by running Karp-Rabin hashes over windows of falling length. The share of an
item's tokens that are marked is its coverage; since tiles may lie in any order and
anywhere in the document, reordered passages are covered too. A document is contaminated
by an item when the coverage is at least ``threshold``.

Items shorter than ``min_match`` tokens match only as a whole. The benchmark is the
stated query set: it is read in blocks of at most ``block_tokens`` tokens. A task compares
about ``HELD_BYTES`` of documents with one block after the other and adds up what it finds,
so every row of the input gives one row, and what tasks hold is bounded whatever the
benchmark's size.

A null or empty text has no tokens and matches nothing; an empty item is never covered.
Rows that repeat an item_id are items of their own; rows that repeat a document are each
judged. An empty benchmark leaves every document clean. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martweave.llm.words import LOWER, cut, column_bytes, text_slices, windows

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_TOKENS = 2_000_000
HELD_BYTES = 64 << 20
SEARCH_LENGTH = 64

SEPARATOR = np.ones(256, bool)
SEPARATOR[128:] = False
SEPARATOR[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = False


def tile(pattern: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (place in pattern, place in text, length), longest first."""
    tiles: list[tuple[int, int, int]] = []
    free_p, free_t = np.ones(len(pattern), bool), np.ones(len(text), bool)
    length = min(SEARCH_LENGTH, len(pattern), len(text))
    while length >= min_match:
        longest = 0
        while True:
            found = _matches(pattern, text, free_p, free_t, length)
            longest = max((n for _, _, n in found), default=0)
            if longest > 2 * length:
                length = longest  # a longer match than the window: search again from its length
                continue
            break
        for p, t, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if free_p[p: p + n].all() and free_t[t: t + n].all():
                tiles.append((p, t, n))
                free_p[p: p + n] = False
                free_t[t: t + n] = False
            # What is left of a match that overlaps a tile is found again with shorter windows.
        left = _matches(pattern, text, free_p, free_t, length)
        if left:
            continue
        if length == min_match:
            break
        length = max(min_match, length // 2)
    return tiles


def _matches(pattern, text, free_p, free_t, length) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` unmarked tokens, by hashes of windows of that length."""
    hp, ht = _rolled(pattern, free_p, length), _rolled(text, free_t, length)
    if not len(hp[0]) or not len(ht[0]):
        return []
    wanted = defaultdict(list)
    for t, h in zip(*ht):
        wanted[h].append(t)
    found, ended = [], set()
    for p, h in zip(*hp):
        for t in wanted.get(h, ()):
            if (p - 1, t - 1) in ended:  # inside a match that is listed already
                ended.add((p, t))
                continue
            n = 0
            while (p + n < len(pattern) and t + n < len(text) and free_p[p + n] and free_t[t + n]
                   and pattern[p + n] == text[t + n]):
                n += 1
            if n >= length:
                found.append((int(p), int(t), n))
                ended.add((p, t))
    return found


def _rolled(tokens: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, list[int]]:
    if len(tokens) < length:
        return np.zeros(0, np.int64), []
    _, hashes, _ = windows(tokens, np.array([0, len(tokens)]), length)
    blocked = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(blocked[length:] == blocked[:-length])
    return at, hashes[at].tolist()


class _Block:
    """Some benchmark items: token sequences, and their seeds in ascending order."""

    def __init__(self, names: list, texts: list, min_match: int) -> None:
        data, bounds = column_bytes(pa.array(texts, pa.large_binary()))
        s = cut(LOWER[data[bounds[0]: bounds[-1]]], bounds - bounds[0], 0, SEPARATOR)
        h = s.hashes()
        self.names, self.min_match = names, min_match
        self.items = [h[s.rows[i]: s.rows[i + 1]] for i in range(s.n_rows)]
        sizes = {min_match: [], **{k: [] for k in range(1, min_match)}}
        for i, tokens in enumerate(self.items):
            if len(tokens):
                sizes[min(len(tokens), min_match)].append(i)
        self.seeds = {}
        for k, members in sizes.items():
            if members:
                found = [np.unique(windows(self.items[i], np.array([0, len(self.items[i])]), k)[1]) for i in members]
                seed = np.concatenate(found)
                owner = np.repeat(members, [len(f) for f in found])
                order = np.argsort(seed, kind="stable")
                self.seeds[k] = (seed[order], owner[order])

    def shared(self, tokens: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (row, item) that share a seed."""
        pairs = set()
        for k, (seed, owner) in self.seeds.items():
            _, found, begin = windows(tokens, rows, k)
            low = np.searchsorted(seed, found, "left")
            hit = np.flatnonzero(seed[np.minimum(low, len(seed) - 1)] == found)
            row = np.searchsorted(begin, hit, "right") - 1
            high = np.searchsorted(seed, found[hit], "right")
            for r, a, b in zip(row.tolist(), low[hit].tolist(), high.tolist()):
                pairs.update((r, int(i)) for i in owner[a:b])
        return iter(sorted(pairs))


def _near(tokens: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the document that occur in the item at all; every tile lies inside runs of them."""
    known = np.isin(tokens, item)
    edges = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return starts, ends


def coverage(tokens: np.ndarray, item: np.ndarray, min_match: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Marked tokens of the item, and the tiles (place in item, place in document, length)."""
    least = min(min_match, len(item))
    starts, ends = _near(tokens, item)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return 0, []
    # Runs are put together with a token between them that no item has.
    pieces, places = [], []
    for s, e in zip(starts, ends):
        pieces += [tokens[s:e], np.zeros(1, np.uint64)]
        places += [np.arange(s, e), np.full(1, -1)]
    text, place = np.concatenate(pieces), np.concatenate(places)
    tiles = [(p, int(place[t]), n) for p, t, n in tile(item, text, least)]
    return sum(n for _, _, n in tiles), tiles


def benchmark_blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of bounded size, one block in memory at a time."""
    names, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).orderBy("item_id", "text").toLocalIterator():
        if names and size + len(row["text"]) // 2 > block_tokens:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(row["item_id"])
        texts.append(bytes(row["text"]))
        size += len(row["text"]) // 2
    if names:
        yield names, texts


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
                  block_tokens: int = BLOCK_TOKENS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the kept columns, n_items (contaminating items), items, coverage (the highest), best_item, spans.

    ``items`` lists the contaminating items, ``spans`` their tiles as token places
    (item_id, in item, in document, length).
    """
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(block) for block in benchmark_blocks(benchmark, block_tokens)]
    if not sent:
        return docs.select(*keep, F.lit(0).cast("long").alias("n_items"), F.array().cast("array<bigint>").alias("items"),
                           F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("best_item"),
                           F.array().cast(SPANS).alias("spans"))
    return _against(docs, sent, min_match, threshold, keep)


SPANS = "array<struct<item_id:bigint,in_item:int,in_document:int,length:int>>"


def _against(docs, sent, min_match, threshold, keep) -> DataFrame:
    at = keep.index("text") if "text" in keep else len(keep)
    source = docs.select(*keep, *([] if "text" in keep else [F.col("text").alias("_text")]))

    def look(block: _Block, batch: pa.RecordBatch, found: list) -> None:
        for s in text_slices(batch.column(at), LOWER, SEPARATOR):
            hashes = s.hashes()
            best: dict[int, list] = defaultdict(list)
            for row, item in block.shared(hashes, s.rows):
                tokens = block.items[item]
                marked, tiles = coverage(hashes[s.rows[row]: s.rows[row + 1]], tokens, min_match)
                best[row].append((marked / len(tokens), block.names[item], tiles))
            for row, hits in best.items():
                top = max(hits, key=lambda h: h[0])
                bad = [h for h in hits if h[0] >= threshold]
                n, items, most, name, spans = found[s.first_row + row]
                found[s.first_row + row] = (
                    n + len(bad), items + [h[1] for h in bad], *(top[:2] if top[0] > most else (most, name)),
                    spans + [{"item_id": h[1], "in_item": p, "in_document": t, "length": n} for h in bad for p, t, n in h[2]])

    def judge(held: list[pa.RecordBatch], blocks: Iterator[_Block]) -> Iterator[pa.RecordBatch]:
        rows = [[(0, [], 0.0, None, [])] * batch.num_rows for batch in held]
        for block in blocks:
            for batch, found in zip(held, rows):
                look(block, batch, found)
        for batch, found in zip(held, rows):
            columns = list(zip(*found)) if found else [[]] * 5
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64(),
                     pa.list_(pa.struct([("item_id", pa.int64()), ("in_item", pa.int32()), ("in_document", pa.int32()), ("length", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                names=[*keep, "n_items", "items", "coverage", "best_item", "spans"])

    def opened() -> Iterator[_Block]:
        for one in sent:
            yield _Block(*one.value, min_match)
            if getattr(one, "_path", None):
                one.__dict__.pop("_value", None)  # read again from its file when the next documents need it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(sent) == 1:
            block = _Block(*sent[0].value, min_match)
            for batch in batches:
                yield from judge([batch], iter([block]))
            return
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from judge(held, opened())
                held, size = [], 0
        if held:
            yield from judge(held, opened())

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(
        run, f"{schema}, n_items long, items array<long>, coverage double, best_item long, spans {SPANS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_items, coverage, contaminated) for every row of ``docs``."""
    return find_overlaps(docs, benchmark, min_match, threshold, block_tokens).select(
        "doc_id", "n_items", "coverage", "best_item", (F.col("n_items") > 0).alias("contaminated"))
