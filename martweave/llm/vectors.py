"""Product codes of vectors by equal-average search.

A component x becomes the integer floor(4096 * x), a vector is cut into 8 equal parts, and each
part position has a codebook of at most 16 entries. The codebook starts as that part of the
vectors with the smallest ids; every round assigns all parts to their nearest entries and
replaces an entry by the componentwise floor of the mean of its parts.

Equal-average search: the entries are sorted by the sum of their components. A part begins at
the place of its own sum and takes entries outward, the nearer sum first. By Cauchy-Schwarz the
squared gap of two sums is at most the dimension times the squared distance, so the search
ends once the squared gap over the dimension is strictly greater than the best distance; an
entry at a gap that only equals it may tie and is still looked at. All of it is integer
arithmetic, so the codes are those of a full search, ties to the lower index.

A round is one scan: tasks return sums and counts per entry, and the driver sees no more than
the codebooks (8 x 16 entries).

A null vector, and one with a null, NaN or infinite component, is dropped. The vectors have the
length that most of them have (the smallest of several); one of another length, or with a
component too large for exact 64-bit distances (beyond 2^28 / part length after scaling), takes
no part in the codebooks and returns with null code and errors, and so do all when that length
is not a positive multiple of 8. Rows that repeat a vec_id are vectors of their own; among the
first 16 they are ordered by their components. A null vec_id comes after all others. Null
labels are one label. Fewer than 16 vectors make fewer entries; an empty table has no codes.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
NONE = np.iinfo(np.int64).max
MASS = "part int, entry int, place int, n bigint, total bigint"


def largest(width: int) -> int:
    """Largest scaled component for which gaps, distances and errors of parts of this length fit 64 bits."""
    return (1 << 28) // width


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, and the squared distance, for every row of ``parts``."""
    width = parts.shape[1]
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, ranked = sums[order], entries[order]
    own = parts.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best = np.full(len(parts), NONE)
    chosen = np.full(len(parts), len(entries))
    live = np.arange(len(parts))
    while len(live):
        a, b, s = left[live], right[live], own[live]
        below = np.where(a >= 0, s - sums[np.maximum(a, 0)], NONE)
        above = np.where(b < len(sums), sums[np.minimum(b, len(sums) - 1)] - s, NONE)
        down = below <= above
        gap = np.minimum(below, above)
        seen = best[live]
        more = gap != NONE
        known = more & (seen != NONE)
        more[known] = gap[known] ** 2 <= width * seen[known]
        live, down = live[more], down[more]
        at = np.where(down, left[live], right[live])
        left[live[down]] -= 1
        right[live[~down]] += 1
        distance = ((parts[live] - ranked[at]) ** 2).sum(axis=1)
        index = order[at]
        better = (distance < best[live]) | ((distance == best[live]) & (index < chosen[live]))
        best[live[better]], chosen[live[better]] = distance[better], index[better]
    return chosen, best


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """Integers of a list column as (rows, parts, width)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, PARTS, width)


def _usable(vectors: DataFrame) -> DataFrame:
    vector = F.col("embedding")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(vector.isNotNull() & ~odd).select("vec_id", "label", vector.cast("array<double>").alias("embedding"))


def _fits(length: int, limit: int) -> Column:
    inside = F.forall("embedding", lambda x: (x * SCALE >= -limit) & (x * SCALE < limit))
    return (F.size("embedding") == length) & inside


def train(vectors: DataFrame, length: int, limit: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) of the usable vectors after ``rounds`` rounds."""
    width = length // PARTS
    fitting = vectors.filter(_fits(length, limit))
    seeds = fitting.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    first = pa.array([r[0] for r in seeds], pa.list_(pa.float64()))
    books = scaled(first, width).transpose(1, 0, 2) if seeds else np.zeros((PARTS, 0, width), np.int64)
    for _ in range(rounds if seeds else 0):
        held = books

        def masses(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(held.shape, np.int64)
            count = np.zeros(held.shape[:2], np.int64)
            for batch in batches:
                rows = scaled(batch.column(0), width)
                for p in range(PARTS):
                    index, _ = nearest(rows[:, p], held[p])
                    np.add.at(total[p], index, rows[:, p])
                    count[p] += np.bincount(index, minlength=held.shape[1])
            part, entry, place = (a.ravel() for a in np.indices(held.shape))
            n = np.repeat(count.ravel(), width)
            used = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(v[used], t) for v, t in (
                (part, pa.int32()), (entry, pa.int32()), (place, pa.int32()), (n, pa.int64()), (total.ravel(), pa.int64()))],
                names=["part", "entry", "place", "n", "total"])

        sums = fitting.select("embedding").mapInArrow(masses, MASS).groupBy("part", "entry", "place").agg(
            F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = books.copy()
        for r in sums.collect():  # at most one row per component of a codebook
            books[r.part, r.entry, r.place] = int(r.total) // int(r.n)
    return books


def encode(vectors: DataFrame, length: int, limit: int, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of the usable vectors."""
    width = length // PARTS
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = scaled(batch.column(2), width)
            error = np.zeros(len(rows), np.int64)
            digits = np.zeros((len(rows), PARTS), np.uint8)
            for p in range(PARTS):
                index, distance = nearest(rows[:, p], books[p])
                digits[:, p] = index
                error += distance
            text = pa.array([d.tobytes().hex() for d in digits], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    return vectors.filter(_fits(length, limit)).mapInArrow(codes, schema)


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept vector."""
    kept = _usable(vectors)
    common = kept.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    length = common["length"] if common else 0
    if length == 0 or length % PARTS:
        none = F.lit(None).cast("bigint")
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), none.alias("error"), none.alias("label_error"),
                           F.lit(None).cast("string").alias("codebooks_sha256"))
    limit = largest(length // PARTS)
    books = train(kept, length, limit)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = encode(kept, length, limit, books)
    apart = kept.filter(~_fits(length, limit)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    rows = stage(coded.unionByName(apart), "vector-codes")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error"),
        F.lit(digest).alias("codebooks_sha256"))
