"""WARC archives: writing pages with revisits, and reading them back by boundary-chain verification.

``write_warc`` writes one record per page with Spark's text writer, so archives land in
any file system Spark knows. Pages with equal payloads of at least ``min_revisit_bytes``
share one response record, that of the largest page_id; the others become revisit records.

``read_warc`` reads archives in splits. Every place where the magic ``WARC/1.1`` stands
is a candidate record; it names its successor by the length it declares. A magic inside
a payload is a candidate too, so candidates are trusted only when they can be reached
from the start of the file:

1. inside each split, pointer jumping gives every candidate the offset at which its chain
   leaves the split;
2. between splits, pointer jumping over those few exits (in a logarithmic number of
   rounds) finds the ones that the file start reaches;
3. inside each split, the chain is marked from the reached entries.

Results for odd rows: a null html is an empty payload; a null page_id counts as smaller
than any other; rows that repeat the largest page_id of a group are all responses; a
null url is written as ``about:blank`` and control characters in urls as ``%20``. An
empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martweave.functions.scale import new_path, stage

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT_BYTES = 1000


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html with ``payload_digest``, ``payload_bytes`` and ``refers_to`` (null: a response)."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", _payload(F.col("html")).alias("html"),
    ).withColumns({
        "payload_digest": F.sha1(F.col("html").cast("binary")),
        "payload_bytes": F.octet_length("html").cast("long"),
    })
    groups = stage(
        own.filter(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 AND keeper IS NOT NULL").drop("copies"), "warc-groups")
    other = ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return own.join(groups, ["payload_digest", "payload_bytes"], "left").withColumn(
        "refers_to", F.when(F.col("keeper").isNotNull() & other, F.col("keeper"))).drop("keeper")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(">"))


def record_text(date: str) -> Column:
    """The whole record but for its closing END."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block)


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z",
               min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """One archive file per task below ``path``."""
    plan_records(pages, min_revisit_bytes).select(record_text(date).alias("value")).write.option("lineSep", END).text(path)


def _field(header: Column, name: str) -> Column:
    """Value of a header line, null where it is missing."""
    return F.nullif(F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str, keep_all: bool) -> DataFrame:
    """Every piece of text that follows a magic, up to the next one, in the splits of the scan.

    ``span`` is the distance to the next magic and ``step`` the declared distance to the
    next record. Pieces in which both agree are whole records if they are records at all:
    of them only header fields, length and digest go on, unless ``keep_all`` is set.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("raw"), "value",
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"))
    header = F.substring_index("value", END, 1)
    http = F.substring_index(F.col("body"), END, 1)
    size = F.octet_length
    whole = F.col("step").eqNullSafe(F.col("span"))
    parsed = raw.withColumn("header", header).withColumn(
        "declared", F.expr("try_cast(nullif(regexp_extract(header, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)', 1), '') AS BIGINT)")
    ).withColumns({
        "span": size("value").cast("long") + len(MAGIC),
        "step": F.when(size("header") < size("value"), size("header") + F.col("declared") + len(MAGIC) + 2 * len(END)),
        "body": F.substring(F.col("raw"), size("header") + len(END) + 1, F.greatest(
            size("raw") - size("header") - 2 * len(END), F.lit(0))).cast("string"),
    }).withColumn("http", http)
    payload = F.substring(F.col("body").cast("binary"), size("http") + len(END) + 1, F.greatest(size("body") - size("http") - len(END), F.lit(0)))
    return parsed.select(
        "file", "block", "place", "span", "step", F.when(whole, F.col("header")).alias("header"),
        F.when(whole, F.col("http")).alias("http"),
        F.when(whole, size(payload).cast("long")).alias("stored_bytes"),
        F.when(whole, F.sha1(payload)).alias("stored_digest"),
        F.when(~whole | F.lit(keep_all), F.col("raw")).alias("raw"))


def _chain(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of one split in file order, their offsets in it (and its end), successors' places, declared ends.

    A successor's place is the number of candidates where there is none inside the split.
    """
    pdf = pdf.sort_values("place", ignore_index=True)
    lead = 0
    if pdf["block"].iloc[0] == 0:  # what stands before the first magic of a file is no candidate
        lead = int(pdf["span"].iloc[0]) - len(MAGIC)
        pdf = pdf.iloc[1:].reset_index(drop=True)
    at = lead + np.concatenate(([0], np.cumsum(pdf["span"].to_numpy(np.int64))))
    step = pdf["step"].fillna(-1).to_numpy(np.int64)
    after = np.where(step > 0, at[:-1] + step, -1)
    spot = np.searchsorted(at[:-1], after)
    inside = (after >= 0) & (spot < len(pdf)) & (at[np.minimum(spot, len(pdf))] == after)
    return pdf, at, np.where(inside, spot, len(pdf)), after


def _leave(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of every candidate leaves its split, by pointer jumping."""
    pdf, at, succ, after = _chain(pdf)
    last = np.where(succ < len(pdf), succ, np.arange(len(pdf)))
    while (last[last] != last).any():
        last = last[last]
    beyond = np.where(after[last] >= at[-1], after[last] - at[-1], -1)
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "place": pdf["place"], "rel": at[:-1],
                         "beyond": beyond, "block_bytes": at[-1]})


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """Offsets of all candidates and of the reached record that each belongs to."""
    pdf, at, succ, _ = _chain(pdf)
    seen = np.append(pdf["entry"].notna().to_numpy(), False)
    for i in range(len(pdf)):  # successors lie behind, so one pass marks whole chains
        if seen[i]:
            seen[succ[i]] = True
    seen = seen[:-1]
    offset = pdf["base"].to_numpy(np.int64) + at[:-1]
    owner = np.maximum.accumulate(np.where(seen, offset, -1))
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "place": pdf["place"], "offset": offset,
                         "chosen": seen, "own": owner})


def verify_chain(found: DataFrame) -> DataFrame:
    """(file, block, place, offset, owner): candidates with the offset of the reachable record they belong to."""
    narrow = found.select("file", "block", "place", "span", "step")
    left = stage(narrow.groupBy("file", "block").applyInPandas(
        _leave, "file string, block long, place long, rel long, beyond long, block_bytes long"), "warc-leave")
    blocks = left.groupBy("file", "block").agg(F.first("block_bytes").alias("block_bytes"), F.min("rel").alias("_r"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(blocks.select("file", "block", "block_bytes", F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).alias("base")), "warc-bases")
    placed = left.join(bases.drop("block_bytes"), ["file", "block"]).select(
        "file", "block", "place", (F.col("base") + F.col("rel")).alias("at"),
        F.when(F.col("beyond") >= 0, F.col("base") + F.col("block_bytes") + F.col("beyond")).alias("exit"))
    wanted = placed.filter("exit IS NOT NULL").select("file", F.col("exit").alias("at")).union(
        bases.select("file", F.lit(0).cast("long"))).distinct()
    jumps = stage(placed.select("file", "at", "exit").join(wanted, ["file", "at"]), "warc-jumps")
    reached = stage(bases.select("file", F.lit(0).cast("long").alias("at")).distinct(), "warc-reached")
    count = reached.count()
    while True:
        step = reached.join(jumps, ["file", "at"]).filter("exit IS NOT NULL").select("file", F.col("exit").alias("at"))
        reached = stage(reached.union(step).distinct(), "warc-reached")
        now = reached.count()
        if now == count:
            break
        count = now
        ahead = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("_next"))
        jumps = stage(jumps.join(ahead, ["file", "exit"], "left").select("file", "at", F.col("_next").alias("exit")), "warc-jumps")
    entries = placed.join(reached.withColumn("entry", F.lit(True)), ["file", "at"]).select("file", "block", "place", "entry")
    rows = narrow.join(entries, ["file", "block", "place"], "left").join(bases.drop("block_bytes"), ["file", "block"])
    marked = stage(rows.groupBy("file", "block").applyInPandas(
        _mark, "file string, block long, place long, offset long, chosen boolean, own long"), "warc-marked")
    # Pieces at the start of a block belong to the record that reaches into it.
    lasts = marked.filter("chosen").groupBy("file", "block").agg(F.max("offset").alias("_last"))
    crossing = bases.select("file", "block").join(lasts, ["file", "block"], "left").select(
        "file", "block", F.last("_last", ignorenulls=True).over(before).alias("_from"))
    return marked.join(crossing, ["file", "block"], "left").select(
        "file", "block", "place", "offset", F.when(F.col("own") >= 0, F.col("own")).otherwise(F.col("_from")).alias("owner"))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``path``: file, offset, header, http, payload (if asked for), its bytes and SHA-1."""
    found = stage(candidates(spark, path, payloads), "warc-found")
    chain = stage(verify_chain(found), "warc-chain")
    rows = found.join(chain, ["file", "block", "place"]).withColumn("heads", F.col("offset") == F.col("owner"))
    # A record is one piece, or several where its payload holds the magic.
    sizes = rows.groupBy("file", "owner").agg(F.count(F.lit(1)).alias("pieces"))
    many = stage(sizes.filter("pieces > 1 AND owner IS NOT NULL").drop("pieces"), "warc-many")
    heads = rows.filter("heads AND step = span").join(many, ["file", "owner"], "left_anti")
    whole = heads.select("file", "offset", "header", "http", "stored_bytes", "stored_digest", *(["raw"] if payloads else []))
    parts = rows.join(many, ["file", "owner"])
    if not payloads and parts.filter("raw IS NULL").limit(1).count():
        return read_warc(spark, path, True).drop("raw", "payload")
    joined = parts.groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("offset", "place", "raw"))).alias("_p"), F.max(F.when(F.col("heads"), F.col("step"))).alias("step"))
    magic = F.lit(MAGIC).cast("binary")
    text = F.aggregate(F.expr("slice(_p, 2, size(_p))"), F.expr("_p[0].raw"), lambda a, x: F.concat(a, magic, x["raw"]))
    whole_raw = joined.select("file", F.col("owner").alias("offset"), text.alias("raw"), "step").filter(
        F.octet_length("raw") + len(MAGIC) >= F.col("step")).withColumn("raw", F.substring(F.col("raw"), F.lit(1), (F.col("step") - len(MAGIC)).cast("int")))
    both = whole.unionByName(_split_raw(whole_raw).select(whole.columns) if payloads else _split_raw(whole_raw).drop("raw"))
    if payloads:
        both = both.withColumn("payload", _payload_of(F.col("raw"))).drop("raw")
    return both


def _body(raw: Column) -> Column:
    head = F.octet_length(F.substring_index(raw.cast("string"), END, 1))
    return F.substring(raw, head + len(END) + 1, F.greatest(F.octet_length(raw) - head - 2 * len(END), F.lit(0)))


def _payload_of(raw: Column) -> Column:
    body = _body(raw)
    head = F.octet_length(F.substring_index(body.cast("string"), END, 1))
    return F.substring(body, head + len(END) + 1, F.greatest(F.octet_length(body) - head - len(END), F.lit(0)))


def _split_raw(df: DataFrame) -> DataFrame:
    payload = _payload_of(F.col("raw"))
    return df.select(
        "file", "offset", F.substring_index(F.col("raw").cast("string"), END, 1).alias("header"),
        F.substring_index(_body(F.col("raw")).cast("string"), END, 1).alias("http"),
        F.octet_length(payload).cast("long").alias("stored_bytes"), F.sha1(payload).alias("stored_digest"), "raw")


def page_records(records: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")
    header = F.col("header")
    named = records.withColumns({
        "_id": _field(header, "WARC-Record-ID"), "_to": _field(header, "WARC-Refers-To"),
        "record_type": _field(header, "WARC-Type"),
        "_sent": _field(F.col("http"), "Content-Length").cast("long"),
        "_digest": F.regexp_replace(_field(header, "WARC-Payload-Digest"), "^sha1:", "")})
    revisit = F.col("record_type") == "revisit"
    return named.select(
        page("_id").alias("page_id"),
        F.when(revisit, F.col("_sent")).otherwise(F.col("stored_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("_digest")).otherwise(F.col("stored_digest")).alias("payload_digest"),
        "record_type", page("_to").alias("refers_to"), (revisit | (F.col("_digest") == F.col("stored_digest"))).alias("digest_ok"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    return page_records(read_warc(spark, path, payloads=False))
