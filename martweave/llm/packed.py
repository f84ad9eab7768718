"""Shuffling 64-bit keys of documents in packed rows.

Tasks cut a corpus into millions of hashed windows or n-grams. Sending each as a row of
its own costs several times its eight bytes, so a task packs those that go to the same
partition into one row: keys, the documents they come from with counts, and a number per
key (a place, or a count). Rows are placed by ``part``, a function of the key alone, so
equal keys meet in one partition. A partition holds an equal share of all distinct keys
of a slice; keys that repeat inside a slice are to be combined by the caller before
packing, so that a hot key costs one entry per slice of text and not one per occurrence.

A document is named by ``(k, tag)``: its id (a null id comes after all others) and a hash
of its text, so rows that share an id are told apart unless they are copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martweave.llm.words import mix

LAST = (1 << 63) - 1
SCHEMA = "part int, keys binary, k binary, tag binary, counts binary, places binary"
NAMES = ["part", "keys", "k", "tag", "counts", "places"]
FLUSH_KEYS = 4_000_000


def named(docs: DataFrame, keep: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The kept columns, k and tag; a null text is told apart like an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"),
                       F.xxhash64(text).alias("tag"))


def part_count(spark: SparkSession, share: int = 4) -> int:
    """Packed rows are dense, so a share of the session's shuffle partitions is enough."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)


def pack(parts: int, keys: np.ndarray, owner: np.ndarray, places: np.ndarray, k: np.ndarray, tag: np.ndarray,
         route: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per part; ``owner`` is the index of each key's document in ``k`` and ``tag``, ascending.

    Keys go where ``route`` says (by default the key itself); keys of one route keep their order.
    """
    part = (mix((keys if route is None else route).copy()) >> np.uint64(40)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    keys, owner, places, part = keys[order], owner[order], places[order], part[order]
    bounds = np.searchsorted(part, np.arange(parts + 1))
    rows: list[list] = [[] for _ in NAMES]
    for p in range(parts):
        a, b = bounds[p], bounds[p + 1]
        if a == b:
            continue
        docs, counts = runs(owner[a:b])
        for out, value in zip(rows, (p, keys[a:b].tobytes(), k[docs].tobytes(), tag[docs].tobytes(),
                                     counts.astype(np.uint32).tobytes(), places[a:b].astype(np.uint32).tobytes())):
            out.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=NAMES)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts], np.diff(np.concatenate((starts, [len(values)])))


@dataclass
class Part:
    """All keys of one partition: each with its document's index and its place; documents ascend by (k, tag)."""

    keys: np.ndarray
    owner: np.ndarray
    places: np.ndarray
    k: np.ndarray
    tag: np.ndarray


def gather(batches: Iterator[pa.RecordBatch]) -> Part:
    read: list[list[np.ndarray]] = [[] for _ in range(5)]
    kinds = (np.uint64, np.int64, np.int64, np.uint32, np.uint32)
    for batch in batches:
        for column, kind, out in zip(batch.columns[1:6], kinds, read):
            out.extend(np.frombuffer(v.as_buffer(), kind) for v in column)
    keys, k, tag, counts, places = (np.concatenate(r) if r else np.zeros(0, t) for r, t in zip(read, kinds))
    del read
    order = np.lexsort((tag, k))
    k, tag = k[order], tag[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (tag[1:] != tag[:-1])
    rank = np.empty(len(k), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return Part(keys, np.repeat(rank, counts).astype(np.uint32), places, k[fresh], tag[fresh])


def exchange(packed: DataFrame, parts: int, resolve: Callable[[Part], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring equal keys together and run ``resolve`` on every partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = gather(batches)
        if len(part.keys):
            yield from resolve(part)

    return packed.repartitionById(parts, F.col("part")).mapInArrow(run, schema)
