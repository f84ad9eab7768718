"""Ranked search of all documents for every benchmark item, with bags scored once.

Terms are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z in lower
case. Of a document only the terms of the items matter, so its text becomes a bag: the item
terms it holds with their counts. Documents with the same bag and the same length norm ``m``
have the same score for every item. They form a class: grouping hashes (m, bag) and compares
both, every class is scored once, and the best 20 classes of an item are opened in the order
of their scores, members by ascending doc_id. A class among the best 20 has fewer than 20
classes in front, each with at least one better document, so no document is lost; of the
members of a class no more than its 20 smallest ids can be needed.

Items are the query set. They are taken in blocks of at most ``BLOCK_BYTES`` of text (an item
counts at least ``ITEM_BYTES``; one longer item is a block of its own), so what goes to the
tasks is bounded however many items there are. Each block reads the documents once.

A null or empty text, and one without terms, belongs to no item and counts neither in N nor in
L; an item without terms has no rows. Whole texts are read, however long. Rows that repeat a
doc_id are documents of their own and may take ranks of their own; a null doc_id comes after
all others. Benchmark rows with the same item_id and text are one item, others with the same
item_id are ranked apart. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martweave.functions.scale import grouped_running_sum, stage
from martweave.llm.packed import LAST
from martweave.llm.words import LOWER, column_bytes, text_slices

TOP = 20
BLOCK_BYTES = 1 << 22
ITEM_BYTES = 1 << 12
CELLS = 1 << 18       # scores of classes by items held at once
EXPANDED = 1 << 21    # postings held at once
EXACT = 1 << 53

SEPARATOR = np.zeros(256, bool)
for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    SEPARATOR[low: high + 1] = True

BAG = np.dtype([("term", np.uint32), ("tf", np.uint32)])
BAG_SCHEMA = "k bigint, n bigint, bag binary"
COUNT_SCHEMA = "term bigint, n bigint"
BEST_SCHEMA = "item int, score bigint, first bigint, h bigint, m bigint"
WITH_TERMS, ALL_TERMS = -1, -2


@dataclass
class Block:
    """Items of one block: their terms as sorted hashes, and per term the items with its count in each."""

    item_ids: list
    terms: np.ndarray
    offsets: np.ndarray
    items: np.ndarray
    counts: np.ndarray


def block_of(rows: list) -> Block:
    column = pa.array([r["text"] for r in rows], pa.string())
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for s in text_slices(column, LOWER, SEPARATOR):
        hashes.append(s.hashes())
        owner.append(np.repeat(np.arange(s.n_rows) + s.first_row, s.counts))
    terms, at = np.unique(np.concatenate(hashes), return_inverse=True)
    pairs, counts = np.unique(np.stack([at, np.concatenate(owner)]), axis=1, return_counts=True)
    offsets = np.searchsorted(pairs[0], np.arange(len(terms) + 1))
    return Block([r["item_id"] for r in rows], terms, offsets, pairs[1], counts)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Distinct items with the number of their block."""
    one = items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    placed = grouped_running_sum(one, [], ["item_id", "text"], F.greatest(F.octet_length("text"), F.lit(ITEM_BYTES)), "upto")
    size = F.greatest(F.octet_length("text"), F.lit(ITEM_BYTES))
    return placed.select("item_id", "text", F.floor((F.col("upto") - size) / block_bytes).cast("int").alias("block"))


def bags(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """k, n and the bag of every document with at least one term; a bag lists ``terms`` by place, ascending."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column(1), LOWER, SEPARATOR):
                hashes = s.hashes()
                place = np.searchsorted(terms, hashes)
                hit = np.flatnonzero(terms[np.minimum(place, len(terms) - 1)] == hashes)
                owner = np.repeat(np.arange(s.n_rows), s.counts)[hit]
                cells, tf = np.unique(owner * np.int64(len(terms)) + place[hit], return_counts=True)
                bag = np.empty(len(cells), BAG)
                bag["term"], bag["tf"] = cells % len(terms), tf
                bounds = np.searchsorted(cells, np.arange(s.n_rows + 1) * np.int64(len(terms)))
                full = np.flatnonzero(s.counts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(s.first_row, s.n_rows).take(pa.array(full)), pa.array(s.counts[full], pa.int64()),
                    pa.array([bag[bounds[i]: bounds[i + 1]].tobytes() for i in full], pa.binary())], names=["k", "n", "bag"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), "text").mapInArrow(read, BAG_SCHEMA)


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of bags, and how many each bag has."""
    data, bounds = column_bytes(column)
    return data[bounds[0]: bounds[-1]].view(BAG), np.diff(bounds) // BAG.itemsize


def term_counts(read: DataFrame, n_terms: int) -> dict[int, int]:
    """Documents per term, and N and L; one number per term of the block comes back."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        rows = words = 0
        for batch in batches:
            entries, _ = _entries(batch.column(1))
            total += np.bincount(entries["term"], minlength=n_terms)
            rows += batch.num_rows
            words += int(np.sum(batch.column(0).to_numpy()))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), WITH_TERMS, ALL_TERMS], pa.int64()),
                                          pa.array([*total[used].tolist(), rows, words], pa.int64())], names=["term", "n"])

    return {r.term: r.n for r in read.select("n", "bag").mapInArrow(count, COUNT_SCHEMA).groupBy("term").agg(F.sum("n").alias("n")).collect()}


def weights(block: Block, counts: dict[int, int]) -> np.ndarray:
    """What one unit of saturation of a term adds to each of its items."""
    n = counts[WITH_TERMS]
    w = [math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(block.terms))]
    return np.repeat(np.array(w, np.int64), np.diff(block.offsets)) * block.counts


def best_classes(classes: DataFrame, block: Block, worth: np.ndarray) -> DataFrame:
    """The ``TOP`` best classes of every item, by score and smallest doc_id."""
    offsets, items, n_items = block.offsets, block.items, len(block.item_ids)
    exact = int(np.bincount(items, worth.astype(np.float64), n_items).max(initial=0)) * 1_000_000 < EXACT

    def scores(entries: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        tf = entries["tf"].astype(np.int64)
        gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        begin = offsets[entries["term"]]
        many = offsets[entries["term"] + 1] - begin
        out = np.zeros(len(sizes) * n_items, np.float64 if exact else np.int64)
        upto = np.cumsum(many)
        a = 0
        while a < len(entries):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + EXPANDED, "right")))
            count = many[a:b]
            at = np.arange(count.sum()) + np.repeat(begin[a:b] - (np.cumsum(count) - count), count)
            cell = np.repeat(owner[a:b], count) * n_items + items[at]
            value = worth[at] * np.repeat(gain[a:b], count)
            if exact:
                out += np.bincount(cell, value, len(out))
            else:
                np.add.at(out, cell, value)
            a = b
        return out.astype(np.int64).reshape(len(sizes), n_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)  # item, score, first, h, m
        least = np.ones(n_items, np.int64)
        step = max(1, CELLS // n_items)
        for batch in batches:
            entries, sizes = _entries(batch.column(2))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            h, m, first = (batch.column(i).to_numpy() for i in (0, 1, 3))
            for a in range(0, len(sizes), step):
                b = min(a + step, len(sizes))
                table = scores(entries[ends[a]: ends[b]], sizes[a:b], m[a:b])
                row, item = np.nonzero(table >= least)
                new = np.stack([item, table[row, item], first[a + row], h[a + row], m[a + row]])
                held = np.concatenate([held, new], axis=1)
                held = held[:, np.lexsort((held[3], held[2], -held[1], held[0]))]
                start = np.searchsorted(held[0], held[0])
                held = held[:, np.arange(held.shape[1]) - start < TOP]
                last = np.bincount(held[0], minlength=n_items) == TOP
                least[last] = held[1][np.searchsorted(held[0], np.flatnonzero(last), "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), *[pa.array(x) for x in held[1:]]], names=["item", "score", "first", "h", "m"])

    found = classes.select("h", "m", "bag", "first").mapInArrow(run, BEST_SCHEMA)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first", "h")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP).drop("place")


def search_block(docs: DataFrame, rows: list) -> DataFrame | None:
    """item_id, rank, doc_id, score for the items of one block."""
    spark = docs.sparkSession
    block = block_of(rows)
    if not len(block.terms):
        return None
    read = stage(bags(docs, block.terms), "search-bags")
    counts = term_counts(read, len(block.terms))
    if not counts.get(WITH_TERMS):
        return None
    norm = F.expr(f"75 + (25 * n * {counts[WITH_TERMS]}L) div {counts[ALL_TERMS]}L")
    classed = read.filter(F.length("bag") > 0).select("k", norm.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    classes = classed.groupBy("h", "m", "bag").agg(F.min("k").alias("first"))
    best = stage(best_classes(classes, block, weights(block, counts)), "search-classes")
    # At most TOP hashes per item of the block are broadcast; a hot class leaves a task as its TOP smallest ids.
    hashes = F.broadcast(best.select("h").distinct())
    own = Window.partitionBy("h", "m", "bag").orderBy("k")
    likely = stage(classed.join(hashes, "h", "left_semi").withColumn("place", F.row_number().over(own)).filter(
        F.col("place") <= TOP).select("h", "m", "bag", "k"), "search-members")
    # Members share hash, norm and bag with the document that stands for the class.
    wanted = best.select("h", "m", "first").distinct()
    heads = likely.withColumnRenamed("k", "first").join(wanted, ["h", "m", "first"]).distinct()
    members = likely.join(heads, ["h", "m", "bag"]).select("h", "m", "first", "k")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "k")
    ranked = best.join(members, ["h", "m", "first"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(block.item_ids)], "item int, item_id bigint")
    return ranked.join(names, "item").select("item_id", "rank", F.when(F.col("k") != LAST, F.col("k")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``TOP`` best documents of every item."""
    spark = docs.sparkSession
    placed = stage(item_blocks(items, block_bytes), "search-items")
    blocks = placed.agg(F.max("block")).first()[0]
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(-1 if blocks is None else blocks + 1):
        found = search_block(docs, placed.filter(F.col("block") == b).orderBy("item_id", "text").collect())
        out = out if found is None else out.unionByName(found)
    return out
