"""Substring deduplication by level-wise doubling of repeated windows.

A window is a run of consecutive words. Counting all windows of the full length would
shuffle one key per word of the corpus; instead a level of half the length goes first.

* Level 1: every full window is represented by one half-length window in it, the one with
  the smallest hash (the first of equals). Equal full windows have equal representatives
  at equal distances, so a full window can only repeat if its representative does. Only
  representatives, about a sixth of all places, are brought together by hash; those found
  once in the whole corpus end here.
* Level 2: windows whose representative survived are extended to twice its length and
  brought together again. Of equal ones the earliest stays and the others are marked.

The levels end at the window length: every longer repeat is covered by its windows.

Earliest means smallest doc_id, then smallest start. Words covered by a marked window are
removed; windows are judged on the input. Keys that repeat inside a slice of text are
resolved there, so a passage shared by a third of all documents costs one key per slice.

A null or empty text, and one shorter than a window, keeps all it has. A null doc_id comes
after all others. Rows that share doc_id and text are one document and get equal results;
rows that share only the id are ordered by a hash of their text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage
from martweave.llm import packed
from martweave.llm.words import Slice, text_slices, windows

WINDOW = 20
FOUND = "k long, tag long, places binary"


def _found(k: np.ndarray, tag: np.ndarray, owner: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document with the chosen places; ``owner`` ascends."""
    if not len(owner):
        return
    docs, counts = packed.runs(owner)
    ends = np.cumsum(counts)
    raw = places.astype(np.uint32)
    for a in range(0, len(docs), 10_000):
        d, e = docs[a: a + 10_000], ends[a: a + 10_000]
        blobs = [raw[y - c: y].tobytes() for y, c in zip(e, counts[a: a + 10_000])]
        yield pa.RecordBatch.from_arrays([pa.array(k[d], pa.int64()), pa.array(tag[d], pa.int64()), pa.array(blobs, pa.binary())],
                                         names=["k", "tag", "places"])


class _Gathered:
    """Keys of several slices, combined when there are enough of them, then packed."""

    def __init__(self, parts: int, later_only: bool) -> None:
        self.parts, self.later_only, self.held, self.size = parts, later_only, [], 0

    def add(self, keys, owner, places, k, tag) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, owner, places, k, tag))
        self.size += len(keys)
        if self.size >= packed.FLUSH_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        base = np.cumsum([0, *[len(h[3]) for h in self.held]])
        keys = np.concatenate([h[0] for h in self.held])
        owner = np.concatenate([h[1] + b for h, b in zip(self.held, base)])
        places = np.concatenate([h[2] for h in self.held])
        k, tag = np.concatenate([h[3] for h in self.held]), np.concatenate([h[4] for h in self.held])
        self.held, self.size = [], 0
        first, hit = _split(keys, owner, places, k, tag, self.later_only)
        if len(first):
            yield _wide(packed.pack(self.parts, keys[first], owner[first], places[first], k, tag))
        # What is decided here already goes on as an answer, spread over the parts.
        for batch in _found(k, tag, owner[hit], places[hit]):
            part = pa.array((batch.column(1).to_numpy().view(np.uint64) % np.uint64(self.parts)).astype(np.int32))
            blank = pa.array([None] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([part, blank, blank, blank, blank, blank, *batch.columns], names=[*packed.NAMES, "dk", "dtag", "dplaces"])


def _wide(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                                      names=[*packed.NAMES, "dk", "dtag", "dplaces"])


WIDE = packed.SCHEMA + ", dk long, dtag long, dplaces binary"


def _split(keys, owner, places, k, tag, later_only) -> tuple[np.ndarray, np.ndarray]:
    """(one entry per key, the earliest; entries that are repeated, or repeat an earlier one), both ascending."""
    order = np.lexsort((places, tag[owner], k[owner], keys))
    same = np.zeros(len(order), bool)
    x, y = order[1:], order[:-1]
    same[1:] = keys[x] == keys[y]
    heads = np.flatnonzero(~same)
    head = order[np.repeat(heads, np.diff(np.append(heads, len(order))))]
    twin = (k[owner[order]] == k[owner[head]]) & (tag[owner[order]] == tag[owner[head]]) & (places[order] == places[head])
    later = same & ~twin
    hit = later.copy()
    if not later_only and len(order):
        hit |= np.repeat(np.logical_or.reduceat(later, heads), np.diff(np.append(heads, len(order))))
    return np.sort(order[~same]), np.sort(order[hit])


def _meet(docs: DataFrame, parts: int, emit, later_only: bool) -> DataFrame:
    """Places per document whose keys repeat (or repeat an earlier place), anywhere in the corpus: k, tag, blobs."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(parts, later_only)
        for batch in batches:
            k, tag = batch.column("k").to_numpy(), batch.column("tag").to_numpy()
            for s in text_slices(batch.column("text")):
                rows = slice(s.first_row, s.first_row + s.n_rows)
                extra = batch.column("blobs").slice(s.first_row, s.n_rows) if "blobs" in batch.schema.names else None
                yield from gathered.add(*emit(s, extra), k[rows], tag[rows])
        yield from gathered.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys_only() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                answer = pc.is_null(batch.column("keys"))
                told.append(batch.filter(answer).select(["dk", "dtag", "dplaces"]).rename_columns(["k", "tag", "places"]))
                yield batch.filter(pc.invert(answer))

        told: list[pa.RecordBatch] = []
        p = packed.gather(keys_only())
        yield from told
        if len(p.keys):
            _, hit = _split(p.keys, p.owner, p.places, p.k, p.tag, later_only)
            hit = hit[np.argsort(p.owner[hit], kind="stable")]
            yield from _found(p.k, p.tag, p.owner[hit], p.places[hit])

    met = docs.mapInArrow(send, WIDE).repartitionById(parts, F.col("part")).mapInArrow(meet, FOUND)
    return met.groupBy("k", "tag").agg(F.collect_list("places").alias("blobs"))


def _places(blobs: pa.Scalar) -> np.ndarray:
    values = blobs.values if blobs.is_valid else None
    if values is None or not len(values):
        return np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in values])).astype(np.int64)


def _representatives(s: Slice, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Half windows of a slice (hashes, where rows begin), and per full window its row's index and its representative."""
    half = window // 2
    _, h, begin = windows(s.hashes(), s.rows, half)
    reach = window - half
    n_full = np.maximum(np.diff(begin) - reach, 0)
    row = np.repeat(np.arange(s.n_rows), n_full)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
    if not len(row):
        return h, begin, row, start, start
    seen = np.lib.stride_tricks.sliding_window_view(h, reach + 1)
    at = begin[row] + start
    chosen = np.empty(len(at), np.int64)
    for a in range(0, len(at), 1 << 16):
        chosen[a: a + (1 << 16)] = at[a: a + (1 << 16)] + seen[at[a: a + (1 << 16)]].argmin(axis=1)
    return h, begin, row, start, chosen


def find_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k, tag, blobs): per document with any, the starts of windows that also start earlier."""
    if window < 2:
        raise ValueError("a window has two words at least")
    parts = packed.part_count(docs.sparkSession)

    def level_1(s: Slice, _):
        h, begin, row, _, chosen = _representatives(s, window)
        picked = np.unique(chosen)
        owner = np.searchsorted(begin, picked, "right") - 1
        return h[picked], owner, picked - begin[owner]

    def level_2(s: Slice, blobs):
        h, begin, row, start, chosen = _representatives(s, window)
        alive = np.zeros(len(h) + 1, bool)
        for r in range(s.n_rows):
            alive[begin[r] + _places(blobs[r])] = True
        ok = alive[chosen]
        _, full, first = windows(s.hashes(), s.rows, window)
        return full[ok], row[ok], start[ok]

    names = docs.select("k", "tag", "text")
    survivors = _meet(names, parts, level_1, False)
    return _meet(names.join(survivors, ["k", "tag"]), parts, level_2, True)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256: words left when later copies of windows are removed."""
    own = packed.named(docs)
    marked = own.join(find_repeats(own, window), ["k", "tag"], "left").select("doc_id", "text", "blobs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column("text")):
                ids = batch.column("doc_id").slice(s.first_row, s.n_rows)
                blobs = batch.column("blobs").slice(s.first_row, s.n_rows)
                cover = np.zeros(len(s.starts) + 1, np.int64)
                for r in range(s.n_rows):
                    places = _places(blobs[r])
                    if len(places):
                        np.add.at(cover, s.rows[r] + places, 1)
                        np.add.at(cover, s.rows[r] + places + window, -1)
                kept = np.cumsum(cover[:-1]) == 0
                texts = _joined(s, kept)
                totals = np.concatenate(([0], np.cumsum(~kept)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(s.counts, pa.int64()), pa.array(totals[s.rows[1:]] - totals[s.rows[:-1]], pa.int64()),
                    pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_text binary, kept_sha256 string").withColumn(
        "kept_text", F.col("kept_text").cast("string"))


def _joined(s: Slice, kept: np.ndarray) -> list[bytes]:
    """Kept words of every row, joined by one space."""
    row = np.repeat(np.arange(s.n_rows), s.counts)[kept]
    starts, ends = s.starts[kept], s.ends[kept]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    edge = np.zeros(len(s.data) + 2, np.int8)
    edge[starts] += 1
    stop = ends + ~last
    np.add.at(edge, stop, -1)
    take = np.cumsum(edge[: len(s.data)], dtype=np.int8).astype(bool)
    data = s.data.copy()
    data[ends[~last]] = 0x20
    out = data[take]
    bounds = np.concatenate(([0], np.cumsum(take, dtype=np.int64)))[s.bounds]
    return [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
