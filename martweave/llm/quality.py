"""Quality rules with risk-controlled thresholds.

``text_metrics`` measures every whole text. A rule rejects a document whose metric is
above the rule's cutoff. Labelled documents are split by a hash of their id. One part in
``PARTS`` proposes cutoffs of growing strictness: first beyond the highest value among its
good documents, by ``MARGINS`` of the distance from the median to it, then as the high
quantiles in ``LEVELS``. The other parts, the holdout, test them: in every stratum (by
default a language) the levels are tried from the laxest on, and one is certified when
the exact (Clopper-Pearson) upper bound on the share of good documents that all rules
together reject is at most ``risk``. The first failure ends the sequence, which needs no
correction over levels (fixed-sequence testing); over strata the error rate ``error`` is
divided (Bonferroni). Of the certified levels, the one that rejects most bad documents net
of good ones in the proposal part is taken.

Strata whose holdout has too few good documents to certify anything, even if none of them
were rejected, are put together and propose and test as one. Only sizes decide this, not
metrics. So with probability ``1 - error`` no stratum that is tested by itself, and not the
others as a whole, loses more than ``risk`` of its good documents; a single one of those
put together may lose more. If they are too few even together, or a stratum has no good
label in the proposal part or the holdout, it gets no cutoffs and rejects nothing.

A null text has no words and metrics of 0. Null labels, and labels of unknown documents,
are not used; a document labelled twice counts once, as its lowest label. A null stratum
is a stratum. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage
from martweave.llm.words import span_hashes, text_slices, windows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
RISK, ERROR = 0.01, 0.05
PARTS = 4
MARGINS = (4.0, 2.0, 1.0, 0.5, 0.25)
LEVELS = (0.0, 0.0002, 0.0005, 0.001, 0.002, 0.003, 0.004, 0.005)  # share of good documents, over all rules
BROADCAST_ROWS = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"): ord("Z") + 1] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "!?{}[]=_~^\\/@;0123456789"]] = True

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_odd", "n_lines"]


def _sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(keys: np.ndarray, rows: np.ndarray, later_only: bool) -> np.ndarray:
    """Marks of keys that occur elsewhere (or earlier) in the same row."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    marks = same.copy()
    if not later_only:
        marks[:-1] |= same[1:]
    out = np.zeros(len(keys), bool)
    out[order] = marks
    return out


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    parts: list[list[np.ndarray]] = []
    for s in text_slices(column):
        rows = np.arange(s.n_rows)
        inside = np.zeros(len(s.data) + 1, np.int8)
        np.add.at(inside, s.starts, 1)
        np.add.at(inside, s.ends, -1)
        in_word = np.cumsum(inside[:-1]).astype(bool)
        points = in_word & ((s.data & 0xC0) != 0x80)
        # windows found again in the same text
        hashes = s.hashes()
        at, found, begin = windows(hashes, s.rows, REPEAT_WINDOW)
        again = at[_again(found, np.repeat(rows, np.diff(begin)), False)]
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + REPEAT_WINDOW, -1)
        repeated = np.cumsum(cover[:-1]) > 0
        # lines: cut at \n and at the ends of rows
        stops = np.flatnonzero(s.data == 0x0A)
        starts = np.concatenate((s.bounds[:-1], stops + 1))
        ends = np.concatenate((stops, s.bounds[1:]))
        starts.sort()
        ends.sort()
        line_row = np.searchsorted(s.bounds, starts, "right") - 1
        line_row = np.minimum(line_row, s.n_rows - 1)
        wordy = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
        line_hash = span_hashes(s.data, starts[wordy], ends[wordy])
        dup = _again(line_hash, line_row[wordy], True)
        parts.append([
            s.counts, _sums(points, s.bounds), _sums(_SYMBOL[s.data], s.bounds),
            np.bincount(line_row[wordy][dup], minlength=s.n_rows), _sums(repeated, s.rows),
            _sums(_UPPER[s.data], s.bounds), _sums(_ODD[s.data], s.bounds),
            np.bincount(line_row[wordy], minlength=s.n_rows)])
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(METRICS)
    return dict(zip(METRICS, columns))


def text_metrics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and, per whole text, the metrics as longs."""
    at = keep.index("text") if "text" in keep else len(keep)
    source = docs.select(*keep, *([] if "text" in keep else [F.col("text").alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _measure(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *[pa.array(found[m], pa.int64()) for m in METRICS]],
                names=[*keep, *METRICS])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{m} long" for m in METRICS])
    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_metrics() -> dict[str, Column]:
    """Named shares, the higher the worse."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper", "word_chars"),
        "odd": share("n_odd", "word_chars"), "word_length": share("word_chars", "n_words"),
    }


def upper_bound(rejected: int, tested: int, error: float) -> float:
    """Clopper-Pearson: the largest share p at which at most ``rejected`` of ``tested`` has probability ``error``."""
    if tested == 0 or rejected >= tested:
        return 1.0
    logs = [math.lgamma(tested + 1) - math.lgamma(k + 1) - math.lgamma(tested - k + 1) for k in range(rejected + 1)]
    low, high = rejected / tested, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p <= 0 or p >= 1:
            break
        terms = [c + k * math.log(p) + (tested - k) * math.log1p(-p) for k, c in enumerate(logs)]
        top = max(terms)
        tail = math.exp(top) * sum(math.exp(t - top) for t in terms)
        low, high = (p, high) if tail > error else (low, p)
    return high


def fit_thresholds(metrics: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, pooled, level, tested, rejected, bound, one cutoff per rule): one row per stratum with a certified level.

    ``level`` counts MARGINS and then LEVELS; of a pooled stratum, the figures are those of the pool.
    """
    names = rule_metrics()
    judged = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stage(metrics.filter(~base_failed()).join(judged, "doc_id").select(
        F.col(stratum).alias("stratum"), (F.col("quality") >= 1).alias("good"),
        (F.xxhash64(F.lit("holdout"), "doc_id") % PARTS != 0).alias("holdout"), *[c.alias(n) for n, c in names.items()]), "quality-labelled")
    sizes = labelled.filter("good").groupBy("stratum").agg(
        F.count_if("holdout").alias("n"), F.count_if(~F.col("holdout")).alias("proposing")).filter("n > 0 AND proposing > 0")
    sizes = stage(sizes.select(F.col("stratum").alias("_s"), "n"), "quality-sizes")
    strata = max(1, sizes.count())
    # Pooling leaves no more groups than strata, so this share of the error holds for both.
    each = error / strata
    least = math.log(each) / math.log1p(-risk)
    pooled = F.col("n") < least
    # A pool keeps no name of a stratum: null strata and the pool are told apart by ``pooled``.
    member = sizes.select("_s", pooled.alias("pooled"), F.when(~pooled, F.col("_s")).alias("group"))
    member = stage(member, "quality-members")
    small = F.broadcast(member) if strata <= BROADCAST_ROWS else member
    grouped = stage(labelled.join(small, F.col("stratum").eqNullSafe(F.col("_s"))).drop("_s", "stratum"), "quality-grouped")
    both = ["pooled", "group"]
    # Level l of LEVELS leaves an equal share of it to every rule.
    shares = [1 - level / len(names) for level in LEVELS[1:]]
    far = lambda n: [F.max(n) + m * (F.max(n) - F.percentile_approx(n, 0.5, 100_000)) for m in MARGINS]
    proposed = grouped.filter("good AND NOT holdout").groupBy(*both).agg(*[
        F.concat(F.array(*far(n), F.max(n)), F.percentile_approx(n, shares, 100_000)).alias(f"_{n}") for n in names])
    proposed = stage(proposed.withColumnsRenamed({"group": "_group", "pooled": "_pooled"}), "quality-proposed")
    steps_in = len(MARGINS) + len(LEVELS)
    same = lambda g, p: F.col("group").eqNullSafe(F.col(g)) & (F.col("pooled") == F.col(p))
    if strata <= BROADCAST_ROWS:
        proposed = F.broadcast(proposed)
    # Cutoffs fall from level to level, so a document is rejected from some level on.
    first = F.least(*[F.size(F.filter(F.col(f"_{n}"), lambda c: c >= F.col(n))) for n in names])
    placed = grouped.join(proposed, same("_group", "_pooled")).withColumn("first", first).groupBy(
        *both, "first", "good", "holdout").agg(F.count(F.lit(1)).alias("rows"))
    rows = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("rows"))), F.lit(0).cast("long"))
    sums = [rows(F.expr("good AND holdout")).alias("tested")]
    for level in range(steps_in):
        over = F.col("first") <= level
        sums += [rows(F.expr("good AND holdout") & over).alias(f"_n{level}"),
                 (rows(F.expr("NOT good AND NOT holdout") & over) - rows(F.expr("good AND NOT holdout") & over)).alias(f"_g{level}")]
    counts = placed.groupBy(*both).agg(*sums)

    @F.pandas_udf("double")
    def bound(rejected: pd.Series, tested: pd.Series) -> pd.Series:
        return pd.Series([upper_bound(int(k), int(n), each) for k, n in zip(rejected, tested)], dtype="float64")

    levels = F.array(*[F.struct(F.col(f"_n{level}").alias("rejected"), F.col(f"_g{level}").alias("gain")) for level in range(steps_in)])
    steps = counts.select(*both, "tested", F.posexplode(levels).alias("level", "l")).select(*both, "tested", "level", "l.*")
    tried = steps.withColumn("bound", bound("rejected", "tested"))
    failed = tried.groupBy(*both).agg(F.coalesce(F.min(F.when(F.col("bound") > risk, F.col("level"))), F.lit(steps_in)).alias("failed"))
    passed = tried.join(failed.withColumnsRenamed({"group": "_f", "pooled": "_p"}), same("_f", "_p")).filter("level < failed")
    best = passed.groupBy(*both).agg(F.max_by(F.struct("level", "tested", "rejected", "bound"), F.struct(F.col("gain"), -F.col("level"))).alias("_at"))
    cutoffs = best.join(proposed, same("_group", "_pooled")).select(
        *both, "_at.level", "_at.tested", "_at.rejected", "_at.bound",
        *[F.element_at(F.col(f"_{n}"), F.col("_at.level") + 1).alias(n) for n in names])
    of = member.withColumnsRenamed({"group": "_g", "pooled": "_p"})
    return stage(of.join(cutoffs, same("_g", "_p")).select(
        F.col("_s").alias("stratum"), "pooled", "level", "tested", "rejected", "bound", *names), "quality-cutoffs")


def judge(metrics: DataFrame, thresholds: DataFrame, stratum: str) -> DataFrame:
    """``metrics`` with base_failed and kept."""
    names = rule_metrics()
    wide = thresholds.select(F.col("stratum").alias("_stratum"), *names)
    if thresholds.count() <= BROADCAST_ROWS:
        wide = F.broadcast(wide)
    over = F.lit(False)
    for n, c in names.items():
        over = over | F.coalesce(c > F.col(n), F.lit(False))
    joined = metrics.join(wide, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", *names)


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep: tuple[str, ...] = ("doc_id",),
                risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Metrics and verdict of every document; the cutoffs are fitted on the labels."""
    columns = (*dict.fromkeys((*keep, "doc_id", stratum)),)
    metrics = stage(text_metrics(docs, columns), "quality-metrics")
    return judge(metrics, fit_thresholds(metrics, labels, stratum, risk, error), stratum)
