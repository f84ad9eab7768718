"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted arrays.

A document's set holds the 64-bit hashes of its distinct word n-grams (ASCII-lowered; a
shorter document is one n-gram as a whole). Two documents link when
``100 * intersection >= percent * union``. Equal sets are one node from the start.

1. Tiles. Linked sets share one of their ``prefix`` n-grams, the rarest ones in an order
   that all documents share (prefix filtering). Rarity comes from a sketch of fixed size
   that counts all n-grams of the corpus; an error in it costs time, never a link. A tile
   is an n-gram with the sets of one size band and the next: linked sets have sizes in the
   same band or in neighbouring ones. Tiles with equal members are one tile.
2. Bitmaps. Inside a tile, bit counts of ``A & ~B`` bound ``|A - B|`` from below, hence the
   overlap from above. Pairs below the threshold end here, and pairs that earlier
   candidates already connect are left out.
3. Arrays. What is left is decided by intersecting the sorted arrays.

A tile with more than ``BLOCK`` sets is split, and only its first block is compared with all
blocks. A second round settles what is left: in split tiles, and in tiles with a candidate
that failed the exact test, sets outside the tile's largest component are compared with all
sets of the tile; in tiles of more than ``SMALL`` sets with arrays at hand, so that only
links leave a task, in the others by testing all pairs that are left. So no link
between different sets is lost, while a group of any number of near copies costs one
comparison for most of its members.

A null or empty text has an empty set and links with nothing. A null doc_id takes part but
is never the smallest id of a component that has another. Rows that repeat a text, with
the same doc_id or not, are linked. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage
from martweave.llm.components import components
from martweave.llm.words import LOWER, mix, text_slices, windows

SKETCH_BITS = 18
SKETCH_PARTS = 16
FILTER_BITS = 22
BLOCK = 2048
SMALL = 64
BLOCK_GRAMS = 1 << 22
STAR = 256


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per slice: the first row, and the sorted distinct n-gram hashes of each row."""
    for s in text_slices(column, LOWER):
        h = s.hashes()
        _, grams, begin = windows(h, s.rows, n)
        out = []
        for r in range(s.n_rows):
            if begin[r + 1] > begin[r]:
                out.append(np.unique(grams[begin[r]: begin[r + 1]]))
            elif s.rows[r + 1] > s.rows[r]:
                own = h[s.rows[r]: s.rows[r + 1]]
                out.append(windows(own, np.array([0, len(own)]), len(own))[1])
            else:
                out.append(np.zeros(0, np.uint64))
        yield s.first_row, out


def set_key(grams: np.ndarray) -> int:
    """64-bit name of a set."""
    h = np.bitwise_xor.reduce(mix(grams + np.uint64(7)), keepdims=True)
    h += grams.sum(keepdims=True) + np.uint64(len(grams))
    return int(mix(h).view(np.int64)[0])


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of all n-grams of the corpus by the low bits of their hash."""
    size, piece = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_PARTS

    def rows(counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(range(SKETCH_PARTS), pa.int32()),
            pa.array([counts[i * piece: (i + 1) * piece].tobytes() for i in range(SKETCH_PARTS)], pa.binary())], names=["piece", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), n):
                if sets:
                    counts += np.bincount((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), minlength=size)
        yield rows(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(blob.as_buffer(), np.int64)
                sums[p] = sums[p] + part if p in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                             names=["piece", "counts"])

    schema = "piece int, counts binary"
    total = np.zeros(size, np.int64)
    for row in docs.select("text").mapInArrow(count, schema).repartitionById(SKETCH_PARTS, F.col("piece")).mapInArrow(add, schema).collect():
        total[row["piece"] * piece: (row["piece"] + 1) * piece] = np.frombuffer(row["counts"], np.int64)
    return total


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def bitmap(grams: np.ndarray) -> bytes:
    """One bit per n-gram by its high bits, two to four times as many bits as n-grams (64 at least)."""
    bits = max(6, (4 * len(grams)).bit_length() - 1)
    place = (grams >> np.uint64(20)) & np.uint64((1 << bits) - 1)
    marks = np.zeros(1 << bits, np.uint8)
    marks[place.astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, tag, n_shingles, key; and, once per key and task, prefix and bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = sent.value, set()
        for batch in batches:
            for first, sets in shingle_sets(batch.column(2), n):
                sizes, keys, prefixes, maps = [], [], [], []
                for grams in sets:
                    key = set_key(grams)
                    sizes.append(len(grams))
                    keys.append(key)
                    if not len(grams) or key in seen:
                        prefixes.append(None)
                        maps.append(None)
                        continue
                    seen.add(key)
                    count = sketch[(grams & np.uint64(len(sketch) - 1)).astype(np.int64)]
                    rare = np.lexsort((grams, count))[: prefix_length(len(grams), percent)]
                    prefixes.append(grams[rare].view(np.int64))
                    maps.append(bitmap(grams))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(sets)), batch.column(1).slice(first, len(sets)), pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                    names=["doc_id", "tag", "n_shingles", "key", "prefix", "bitmap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(
        run, f"doc_id {kind}, tag long, n_shingles long, key long, prefix array<long>, bitmap binary")


def band(size: Column, percent: int) -> Column:
    """Sizes whose quotient is percent / 100 or more differ by one band at most."""
    return F.floor(F.log(size) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")


def _tiles(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, tier, members, key, n): tiles of two sets or more, one of several with equal members."""
    postings = sets.filter("prefix IS NOT NULL").select(F.explode("prefix").alias("gram"), "key", F.col("n_shingles").alias("n"))
    shared = postings.groupBy("gram").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("gram")
    members = stage(postings.join(stage(shared, "jaccard-shared"), "gram").distinct(), "jaccard-members")
    level = band(F.col("n"), percent)
    tiled = members.withColumn("own", level).withColumn("tier", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    named = tiled.groupBy("gram", "tier").agg(
        F.count(F.lit(1)).alias("members"), F.min("own").alias("low"),
        F.bit_xor("key").alias("x"), F.bit_xor(F.xxhash64("key")).alias("y"))
    one = named.filter("members > 1 AND low = tier").groupBy("members", "x", "y").agg(F.min(F.struct("gram", "tier")).alias("t"))
    kept = stage(one.select("t.gram", "t.tier", "members"), "jaccard-kept")
    return stage(tiled.drop("own").join(kept, ["gram", "tier"]), "jaccard-tiles")


PAIR = "a long, b long"


def _in_cells(rows: DataFrame, payload: str, compare: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): what ``compare`` finds in every cell of rows (gram, tier, i, j, key, n, lead, label, payload)."""
    cells = ["gram", "tier", "i", "j"]

    def found(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, sizes, lead, label = (table.column(c).to_numpy() for c in ("key", "n", "lead", "label"))
        blobs = table.column(payload).combine_chunks()
        pairs: list[np.ndarray] = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                x, y = compare(keys[a:b], sizes[a:b], lead[a:b], label[a:b], blobs[a:b])
                if len(x):
                    pairs.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
        if pairs:
            both = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cell = np.stack([table.column(c).to_numpy() for c in range(4)])
            edge = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            if len(edge):
                yield from found(table.slice(0, edge[-1]), np.concatenate(([0], edge)))
            rest = table.slice(edge[-1]) if len(edge) else table
        if rest is not None and rest.num_rows:
            yield from found(rest, np.array([0, rest.num_rows]))

    return rows.select(*cells, "key", "n", "lead", "label", payload).repartition(*cells).sortWithinPartitions(*cells, "key").mapInArrow(run, PAIR)


def _folded(maps: pa.Array) -> np.ndarray:
    """Bitmaps as rows of one width: wider ones are folded, which keeps every bit's meaning."""
    raw = [np.frombuffer(m.as_buffer(), np.uint64) for m in maps]
    width = min(len(r) for r in raw)
    return np.stack([r if len(r) == width else np.bitwise_or.reduce(r.reshape(-1, width), axis=0) for r in raw])


def _possible(i: int, bits: np.ndarray, sizes: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``at`` that sizes and bit counts do not rule out as links of ``i``."""
    small, large = np.minimum(sizes[at], sizes[i]), np.maximum(sizes[at], sizes[i])
    at = at[100 * small >= percent * large]
    if not len(at):
        return at
    mine, theirs = bits[i], bits[at]
    only_mine = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
    only_theirs = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
    most = np.minimum(sizes[i] - only_mine, sizes[at] - only_theirs)
    return at[100 * most >= percent * (sizes[i] + sizes[at] - most)]


def _leads(lead: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leading set, sets of other groups to compare it with, groups); the caller may join groups as it goes."""
    group = np.unique(label, return_inverse=True)[1].copy()
    for i in np.flatnonzero(lead):
        other = group != group[i]
        other[:i] &= ~lead[:i]  # two leading sets meet once
        at = np.flatnonzero(other)
        if len(at):
            yield i, at, group


def _candidates(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs that bit counts do not rule out; in a forest, without those that earlier candidates of the cell connect."""
    def compare(keys, sizes, lead, label, blobs):
        bits, left, right = _folded(blobs), [], []
        for i, at, group in _leads(lead, label):
            at = _possible(i, bits, sizes, at, percent)
            if forest:
                groups, first = np.unique(group[at], return_index=True)
                group[np.isin(group, groups)] = group[i]
                at = at[first]
            left.append(np.full(len(at), keys[i]))
            right.append(keys[at])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2

    return _in_cells(rows, "bitmap", compare)


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links that join groups of a cell, from the arrays: fine bitmaps first, then intersections until one links."""
    def compare(keys, sizes, lead, label, blobs):
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in blobs]
        width = np.uint64((1 << int(32 * sizes.max()).bit_length()) - 1)
        bits = np.empty((len(sets), (int(width) + 1) // 64), np.uint64)
        for row, grams in zip(bits, sets):
            marks = np.zeros(int(width) + 1, np.uint8)
            marks[(grams & width).astype(np.int64)] = 1
            row[:] = np.packbits(marks).view(np.uint64)
        left, right = [], []
        for i, at, group in _leads(lead, label):
            for j in _possible(i, bits, sizes, at, percent):
                if group[j] == group[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    group[group == group[j]] = group[i]
                    left.append(keys[i])
                    right.append(keys[j])
        return np.array(left, np.int64), np.array(right, np.int64)

    return _in_cells(rows, "grams", compare)


def _arrays(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, grams): sorted arrays of the wanted keys, one row each."""
    spark = docs.sparkSession
    size = 1 << FILTER_BITS
    # A filter of fixed size keeps most other sets out of the shuffle; the join below is exact.
    marks = np.zeros(size, bool)
    marks[wanted.select(F.pmod("key", F.lit(size)).cast("int").alias("m")).distinct().toArrow().column(0).to_numpy()] = True
    sent = spark.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = np.unpackbits(sent.value).astype(bool), set()
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), n):
                keys, blobs = [], []
                for grams in sets:
                    if len(grams) and marks[(key := set_key(grams)) % size] and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        blobs.append(grams.tobytes())
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "grams"])

    return docs.select("text").mapInArrow(run, "key long, grams binary").join(wanted, "key", "left_semi").groupBy("key").agg(F.max("grams").alias("grams"))


def _verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Pairs of one ``a`` are decided together, ``STAR`` at a time."""
    wanted = stage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "jaccard-wanted")
    degree = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("d")), "jaccard-degree")
    chunked = stage(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / STAR)).cast("int").alias("chunk")), "jaccard-stars")
    roles = chunked.select("a", "chunk", F.col("b").alias("key")).union(chunked.select("a", "chunk", F.col("a").alias("key")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, None
        for batch in batches:
            a, chunk, key = (batch.column(c).to_numpy() for c in range(3))
            left, right = [], []
            for i in range(batch.num_rows):
                grams = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if (a[i], chunk[i]) != star:  # the centre comes first
                    star, centre = (a[i], chunk[i]), grams
                    continue
                both = len(np.intersect1d(centre, grams, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(grams) - both):
                    left.append(a[i])
                    right.append(key[i])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    met = roles.join(_arrays(docs, wanted, n), "key").select("a", "chunk", "key", (F.col("key") != F.col("a")).alias("outer"), "grams")
    return met.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "outer", "key").mapInArrow(run, PAIR)


def _blocks(count: Column, size: Column) -> Column:
    """Blocks of at most BLOCK sets and BLOCK_GRAMS n-grams."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(count * size / BLOCK_GRAMS)).cast("int")


def link(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) over the keys of sets that link with another."""
    tiles = _tiles(sets, percent)
    maps = stage(sets.filter("bitmap IS NOT NULL").groupBy("key").agg(F.max("bitmap").alias("bitmap"))
                 .join(tiles.select("key").distinct(), "key", "left_semi"), "jaccard-bitmaps")
    block = F.pmod(F.xxhash64("key"), F.col("g")).cast("int")
    # The first block of every tile against all its blocks: all pairs, unless the tile has more than one.
    first = tiles.withColumn("g", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", block).withColumn("lead", F.col("block") == 0)
    cells = first.withColumn("j", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array("block"))))
    rows = cells.select("gram", "tier", F.lit(0).alias("i"), "j", "key", "n", "lead", F.col("key").alias("label")).join(maps, "key")
    pairs = stage(_candidates(rows, percent, True).distinct(), "jaccard-pairs")
    links = stage(_verify(docs, pairs, n, percent), "jaccard-links")
    # Tiles to look at again: split ones, and those in which a failed candidate stood for a connection.
    failed = pairs.join(links, ["a", "b"], "left_anti")
    ends = failed.join(tiles.select("gram", "tier", F.col("key").alias("a")), "a").join(
        tiles.select("gram", "tier", F.col("key").alias("b")), ["gram", "tier", "b"]).select("gram", "tier")
    split = tiles.filter(F.col("members") > BLOCK).select("gram", "tier")
    again = stage(ends.union(split).distinct(), "jaccard-again")
    if again.isEmpty():
        return components(links)
    cells = stage(_second(tiles.join(again, ["gram", "tier"]), links), "jaccard-cells")
    # A small tile has few pairs, so those left are tested like the first ones; in a large one, sets come with their arrays.
    small, large = cells.filter(F.col("members") <= SMALL), cells.filter(F.col("members") > SMALL)
    rest = stage(_candidates(small.join(maps, "key"), percent, False).distinct().join(pairs, ["a", "b"], "left_anti"), "jaccard-rest")
    more = stage(_verify(docs, rest, n, percent), "jaccard-links")
    wanted = stage(large.select("key").distinct(), "jaccard-wanted")
    if not wanted.isEmpty():
        more = more.union(stage(_links(large.join(_arrays(docs, wanted, n), "key"), percent), "jaccard-links"))
    return components(links.union(more))


def _second(tiles: DataFrame, links: DataFrame) -> DataFrame:
    """Cells in which the sets outside a tile's largest component lead against all of the tile."""
    labels = stage(components(links), "jaccard-labels").select(F.col("node").alias("key"), F.col("component").alias("_label"))
    known = stage(tiles.join(labels, "key", "left").withColumn("label", F.coalesce("_label", "key")).drop("_label"), "jaccard-labelled")
    sizes = known.groupBy("gram", "tier", "label").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("size"))
    most = stage(sizes.groupBy("gram", "tier").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("parts"),
                                                   (F.sum("c") - F.max("c")).alias("outside"), F.max("size").alias("size")).filter("parts > 1"), "jaccard-mains")
    open_ = known.join(most, ["gram", "tier"]).withColumns({
        "lead": F.col("label") != F.col("main"), "g": _blocks(F.col("members"), F.col("size")), "h": _blocks(F.col("outside"), F.col("size"))})
    own_i, own_j = F.pmod(F.xxhash64("key"), F.col("h")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "key"), F.col("g")).cast("int")
    every_i, every_j = F.sequence(F.lit(0), F.col("h") - 1), F.sequence(F.lit(0), F.col("g") - 1)
    as_lead = open_.filter("lead").withColumn("i", own_i).withColumn("j", F.explode(every_j))
    as_other = open_.withColumn("j", own_j).withColumn("i", F.explode(every_i))
    columns = ["gram", "tier", "members", "i", "j", "key", "n", "label"]
    both = as_lead.select(*columns, F.lit(True).alias("lead")).union(as_other.select(*columns, F.lit(False).alias("lead")))
    return both.groupBy(*columns).agg(F.max("lead").alias("lead"))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, component_id (smallest doc_id reachable by links) of every row.

    ``component`` names the component also where it has no doc_id; it is null for empty sets, which link with nothing.
    """
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("percent and n")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = stage(_sets(own, n, percent), "jaccard-sets")
    linked = link(own, sets, n, percent)
    named = sets.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    joined = stage(named.join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")), "jaccard-named")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = stage(joined.join(least, "component").select("key", "component", "component_id"), "jaccard-ids")
    rows = sets.select("doc_id", "tag", "n_shingles", "key").join(ids, "key", "left")
    return rows.select("doc_id", "tag", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                       "component")
