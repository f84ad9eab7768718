"""Token counts as delta-maintained rollups.

A change names a document's place in the totals and its counts before and after: an
insert has no counts before, a delete none after, a revision both. Only the differences
are kept, summed by (source, lang, tokenizer), so totals are additive: a batch is one
small set of rows, and the current rollup is the sum over all committed batches.

Batches commit at most once. A batch is written aside and made visible by one atomic
rename to the digest of its id, so ids may be of any length; a batch id that is there already
changes nothing, whether it comes from a rerun of the job, from a lost driver or from two
writers at once. Once many batches have gathered, ``compact`` sums them into one folder with
a file that lists the digests of all their ids, so a rollup can live through any number of them.

Null source, language or tokenizer are groups of their own. A null or empty text has 0
tokens and still counts as a document. Changes whose counts are null before and after
have no effect. Repeated rows are separate changes, so they count as often as they occur.
Other columns are ignored. An empty batch commits as an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
ROW = "source string, lang string, tokenizer string, documents long, tokens long"
# Fixed value: the published pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
IDS = "_ids"  # readers of the table skip names that begin with an underscore


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("rollup", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str, out: str = "tokens") -> DataFrame:
    """``docs`` with the number of tokens of every whole text; ``vocabulary`` is a rank file present on every host.

    The text is left out, and a column that is called ``out`` already is replaced.
    """
    docs = docs.drop(out) if out in docs.columns else docs
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        place = names.index("text")
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in batch.column(place)]
            rest = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64())], names=[*[n for n in names if n != "text"], out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema + ', ' if schema else ''}{out} long")


def change(kind: Column, before: Column, after: Column) -> dict[str, Column]:
    """Signed differences of one change: documents and tokens."""
    gone = F.when(kind.isin("delete", "revise"), before)
    come = F.when(kind.isin("insert", "revise"), after)
    one = lambda c: F.when(c.isNotNull(), 1).otherwise(0)
    return {"documents": (one(come) - one(gone)).cast("long"),
            "tokens": (F.coalesce(come, F.lit(0)) - F.coalesce(gone, F.lit(0))).cast("long")}


def deltas(changes: DataFrame) -> DataFrame:
    """Summed differences per group of rows (kind, source, lang, tokenizer, before, after)."""
    return changes.select(*[F.col(k).cast("string").alias(k) for k in KEYS],
                          *[c.alias(n) for n, c in change(F.col("kind"), F.col("before"), F.col("after")).items()]
                          ).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """The rollup kept below ``path``: one folder per committed batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> dict[str, list[str]]:
        """Folder name -> digests of the batch ids in it; a compacted folder hides those that it sums."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        folders = {n: self._digests(n) for n in names if n.startswith(("batch-", "sum-"))}
        covered: set[str] = set()
        kept: dict[str, list[str]] = {}
        for name, ids in sorted(folders.items(), key=lambda x: -len(x[1])):
            if not covered.issuperset(ids):
                kept[name] = ids
                covered.update(ids)
        return kept

    @staticmethod
    def _digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def _digests(self, name: str) -> list[str]:
        kind, _, digest = name.partition("-")
        if kind == "batch":
            return [digest]
        stream = self._fs.open(self._path(f"{self.path}/{name}/{IDS}"))
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split()
        finally:
            stream.close()

    def _commit(self, rows: DataFrame, name: str, ids: list[str] | None = None) -> bool:
        aside = f"{self.path}/_writing/{name}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        rows.coalesce(1).write.parquet(aside)
        if ids is not None:
            stream = self._fs.create(self._path(f"{aside}/{IDS}"))
            try:
                stream.write(bytearray("\n".join(ids).encode()))
            finally:
                stream.close()
        target = self._path(f"{self.path}/{name}")
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            self._fs.delete(self._path(aside), True)
            return False
        stray = self._path(f"{self.path}/{name}/{aside.rpartition('/')[2]}")
        if self._fs.exists(stray):  # a writer that came between: the rename put this copy inside the committed folder
            self._fs.delete(stray, True)
            return False
        return True

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit one batch of changes; False if the batch was committed before, which then changes nothing."""
        digest = self._digest(batch_id)
        if any(digest in ids for ids in self.committed().values()):
            return False
        return self._commit(deltas(changes), f"batch-{digest}")

    def compact(self) -> None:
        """Sum all committed batches into one folder, then drop the folders that it covers."""
        folders = self.committed()
        if len(folders) < 2:
            return
        ids = sorted(i for held in folders.values() for i in held)
        if self._commit(self._sum(list(folders)), f"sum-{self._digest(' '.join(ids))}", ids):
            for name in folders:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _sum(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], ROW)
        rows = self.spark.read.schema(ROW).parquet(*[f"{self.path}/{n}" for n in names])
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def current(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches; groups without documents drop out."""
        return self._sum(list(self.committed())).filter("documents <> 0 OR tokens <> 0")
