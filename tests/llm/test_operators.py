"""The operators against brute force, and their results for odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from martweave.llm import (
    components, decontamination, jaccard, mixing, privacy, quality, scoring, sharding, substrings, tokens, warc, words)
from tests.llm import brute

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def texts(seed, n=60):
    """Documents with copies, near copies, a shared passage and short ones."""
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(voc) for _ in range(40))
    base = [r.choice(voc) for _ in range(90)]
    rows = []
    for i in range(n):
        if i % 4 == 0:
            near = list(base)
            for _ in range(r.randrange(6)):
                near[r.randrange(len(near))] = r.choice(voc)
            rows.append((i, " ".join(near)))
        elif i % 4 == 1:
            rows.append((i, " ".join(r.choice(voc) for _ in range(r.randrange(0, 60))) + "\n" + passage))
        elif i % 4 == 2:
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, "  ".join(r.choice(voc) for _ in range(r.randrange(0, 12)))))
    return rows


# --- words ------------------------------------------------------------------------------


def test_words_are_cut_like_the_contract_says(odd_rows):
    import pyarrow as pa

    column = pa.array([t for _, t in odd_rows])
    got = {}
    for s in words.text_slices(column):
        for r in range(s.n_rows):
            own = slice(s.rows[r], s.rows[r + 1])
            got[s.first_row + r] = [s.data[a:b].tobytes().decode() for a, b in zip(s.starts[own], s.ends[own])]
    assert got == {i: brute.words(t) for i, (_, t) in enumerate(odd_rows)}


def test_equal_words_have_equal_hashes_wherever_they_stand():
    import pyarrow as pa

    slices = list(words.text_slices(pa.array(["ab cd ab", None, "cd ab", "abcd a b c d"]), words.LOWER))
    h = slices[0].hashes().tolist()
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h)) == 7


# --- 1 token counts ------------------------------------------------------------------------


def test_rollup_adds_changes_once(spark, tmp_path):
    rollup = tokens.TokenRollup(spark, str(tmp_path / "r"))
    row = "kind string, source string, lang string, tokenizer string, before long, after long"
    one = spark.createDataFrame([("insert", "s", "en", "t", None, 5), ("insert", "s", "en", "t", None, 7), ("insert", None, "en", "t", None, 1)], row)
    two = spark.createDataFrame([("delete", "s", "en", "t", 5, None), ("revise", "s", "en", "t", 7, 9), ("revise", "s", "en", "t", None, None)], row)
    assert rollup.apply("b1", one) and rollup.apply("b2", two)
    assert not rollup.apply("b1", one)
    expected = {(None, "en", "t", 1, 1), ("s", "en", "t", 1, 9)}
    assert {tuple(r) for r in rollup.current().collect()} == expected
    rollup.compact()
    assert not rollup.apply("b2", two) and len(rollup.committed()) == 1
    assert {tuple(r) for r in rollup.current().collect()} == expected
    assert rollup.apply("b3", one.limit(0)) and {tuple(r) for r in rollup.current().collect()} == expected


def test_a_rollup_lives_through_many_batches(spark, tmp_path):
    rollup = tokens.TokenRollup(spark, str(tmp_path / "r"))
    row = "kind string, source string, lang string, tokenizer string, before long, after long"
    one = spark.createDataFrame([("insert", "s", "en", "t", None, 5)], row).coalesce(1)
    ids = ["x" * 1000, "a/b: é", *[f"batch number {i:08d}" for i in range(30)]]
    for n, name in enumerate(ids):
        assert rollup.apply(name, one)
        if n % 10 == 9:
            rollup.compact()
    rollup.compact()
    assert [tuple(r) for r in rollup.current().collect()] == [("s", "en", "t", len(ids), 5 * len(ids))]
    assert len(rollup.committed()) == 1 and not any(rollup.apply(name, one) for name in (ids[0], ids[1], ids[-1]))
    rollup.compact()
    assert len(tokens.TokenRollup(spark, str(tmp_path / "r")).committed()) == 1


def test_token_counts_replace_a_column_of_their_name(documents):
    got = tokens.token_counts(documents([(1, "a b"), (2, None)], extra=True), VOCABULARY)
    assert got.columns.count("tokens") == 1 and {r.doc_id: r.tokens for r in got.collect()} == {1: 2, 2: 0}
    assert tokens.token_counts(documents([]), VOCABULARY).collect() == []


def test_registered_token_counts_equal_plain_ones(spark, tmp_path):
    import duckdb

    from martweave.llm import queries
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text, source, lang FROM '{root}/documents.parquet'").fetchall()
    toxic = {r[0] for r in con.execute(f"SELECT doc_id FROM '{root}/labels.parquet' WHERE toxic = 1").fetchall()}
    encoding, expected = tokens._encoding(VOCABULARY), {}
    for d, text, source, lang in docs:
        for kind, n in (("words", len(brute.words(text))), ("byte_bpe_50k", len(encoding.encode_ordinary(text or "")))):
            if kind == "words" and d in toxic:
                continue
            old = expected.get((source, lang, kind), (0, 0))
            expected[source, lang, kind] = (old[0] + 1, old[1] + n)
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in queries.op1_token_counts(spark, root).collect()}
    assert got == expected


def test_token_counts_of_odd_texts(documents, odd_rows):
    import tiktoken  # noqa: F401

    got = tokens.token_counts(documents(odd_rows, extra=True).select("doc_id", "text"), VOCABULARY).collect()
    count = {r.doc_id: r.tokens for r in got if r.doc_id is not None}
    encoding = tokens._encoding(VOCABULARY)
    assert len(got) == len(odd_rows)
    assert all(count[d] == len(encoding.encode_ordinary(t or "")) for d, t in odd_rows if d is not None)


# --- 2 WARC --------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("x")).repartition(2)


def test_archives_keep_pages_and_reject_magic_in_payloads(spark):
    big = "p" * 1200
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big), (4, "u", None), (5, "u", ""), (None, "u", big),
            (6, "u", "x WARC/1.1\r\n y" + record + "é" * 700), (7, "u", record * 3), (8, "u", "WARC/1.1\r\n"), (9, "u", "short"), (10, "u", "short"),
            (11, "u", "q" * 999), (12, "u", "q" * 999), (13, "u", "z\r\n\r\n" * 400), (13, "u", "z\r\n\r\n" * 400)]
    got = warc.round_trip(pages_of(spark, rows)).collect()
    import hashlib

    keeper = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 1000:
            keeper[h] = max(keeper.get(h, p or 0), p or 0)
    expected = sorted(
        ((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
          "revisit" if h in keeper and p != keeper[h] else "response", keeper[h] if h in keeper and p != keeper[h] else None)
         for p, _, h in rows), key=repr)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected
    assert all(r.digest_ok for r in got)


def test_payloads_come_back_whole(spark, tmp_path):
    html = "a WARC/1.1\r\nb" * 5 + "é"
    warc.write_warc(pages_of(spark, [(1, "u", html), (2, "v", "x")]), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted([html, "x"])


def test_archives_over_many_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        rows = [(i, "u", f"WARC/1.1\r\n{i}" * (1 + i % 70)) for i in range(60)]
        got = warc.round_trip(pages_of(spark, rows).coalesce(1))
        assert sorted((r.page_id, r.payload_bytes, r.digest_ok) for r in got.collect()) == [(i, len(h), True) for i, _, h in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_pages(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0


# --- 3 Jaccard join --------------------------------------------------------------------------


@pytest.mark.parametrize("block, small", [(2048, 64), (8, 4), (8, 10)])
def test_components_equal_all_pairs(documents, monkeypatch, block, small):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "STAR", 4)
    rows = texts(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(documents(rows, extra=True), 4, 85).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_of_odd_rows(documents, odd_rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(documents(odd_rows), 4, 85).collect()), key=repr)
    names = {d: c for d, _, c in got if d is not None}
    assert len(got) == len(odd_rows)
    assert names[1] == 1 and names[5] == 1 and names[2] == 2 and names[3] == 3 and names[7] == 6 and names[12] == 11
    assert (None, 1, 1) in got and (None, 0, None) in got and (None, 1, None) in got


def test_no_documents(documents):
    assert jaccard.jaccard_join(documents([]), 4, 85).count() == 0
    assert substrings.dedup(documents([])).count() == 0
    assert scoring.score(documents([])).count() == 0
    assert mixing.mix(documents([])).count() == 0
    assert sharding.shard(documents([]), 8).count() == 0
    assert privacy.report(privacy.protect(documents([]))).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# --- 4 quality rules --------------------------------------------------------------------------


def metrics_of(text):
    w = brute.words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    again = {x for x in windows if windows.count(x) > 1}
    covered = {j for i, x in enumerate(windows) if x in again for j in range(i, i + 8)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_metrics_equal_plain_counts(documents, odd_rows):
    rows = [*odd_rows[:9], *odd_rows[10:], *[(d + 100, t) for d, t in texts(2)], (900, "a b\n\na b\n a b\na b\r\n#|<>*$%&é"), (901, "x y z " * 9), (902, "\n")]
    got = quality.text_metrics(documents(rows, extra=True), ("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == metrics_of(r.text), r.text


def test_bounds_are_exact():
    from math import comb

    for k, n, e in ((0, 50, 0.05), (3, 100, 0.01), (7, 40, 0.2)):
        p = quality.upper_bound(k, n, e)
        assert abs(sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)) - e) < 1e-9
    assert quality.upper_bound(5, 5, 0.1) == 1.0 and quality.upper_bound(0, 0, 0.1) == 1.0


def test_thresholds_reject_junk_and_keep_good(documents, spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["word", "other", "third", "and"]) + str(r.randrange(99)) for _ in range(60))) for i in range(3000)]
    rows = [(i, t.replace(" ", " ### ") if i % 10 == 0 else t) for i, t in rows]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(2900)] + [(None, 1, 0), (5, None, 0), (10 ** 9, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    got = {x.doc_id: x.kept for x in quality.apply_rules(docs, labels).collect()}
    good = [i for i in range(3000) if i % 10]
    assert not any(got[i] for i in range(0, 3000, 10)) and sum(not got[i] for i in good) <= 0.01 * len(good)
    few = quality.apply_rules(docs, labels.limit(20)).collect()
    assert all(x.kept for x in few if not x.base_failed)  # too few labels: the method rejects nothing
    assert all(x.kept for x in quality.apply_rules(docs, labels.limit(0)).collect() if not x.base_failed)


def test_strata_with_few_labels_are_tested_together(documents, spark):
    r = random.Random(14)
    rows = [(i, " ".join(r.choice(["word", "other", "third", "and"]) + str(r.randrange(99)) for _ in range(60))) for i in range(1600)]
    rows = [(i, t.replace(" ", " ### ") if i % 10 == 0 else t) for i, t in rows]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(1600)], "doc_id long, quality int, toxic int")
    docs = documents(rows).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 4).cast("string")))
    cutoffs = quality.fit_thresholds(quality.text_metrics(docs, ("doc_id", "lang")), labels, "lang").collect()
    assert sorted(c.stratum for c in cutoffs) == ["l0", "l1", "l2", "l3"] and all(c.pooled and c.bound <= 0.01 for c in cutoffs)
    got = {x.doc_id: x.kept for x in quality.apply_rules(docs, labels).collect()}
    good = [i for i in range(1600) if i % 10]
    assert not any(got[i] for i in range(0, 1600, 10)) and sum(not got[i] for i in good) <= 0.01 * len(good)
    # A stratum without labels is not judged by the others' cutoffs.
    other = docs.withColumn("lang", F.when(F.col("doc_id") < 1200, F.col("lang")).otherwise(F.lit("new")))
    got = quality.apply_rules(other, labels.filter("doc_id < 1200"), keep=("doc_id", "lang")).collect()
    assert all(x.kept for x in got if x.lang == "new" and not x.base_failed)


# --- 5 privacy --------------------------------------------------------------------------------


def test_base_spans(documents, odd_rows):
    rows = [*odd_rows, (50, "x@y.z a.b@c.d-e_f@g.h 1.2.3.4.5.6.7.8 300.1.1.1 000255.1.1.1 +1 (2) 3-4.5678999 +1234567890123456"),
            (51, "4111 1111 1111 1111 4111-1111-1111-1112 é😀 a@b.co 1.2.3.4"), (52, "9" * 5000 + " 1 1" * 3000 + " a@b.c1.2.3.4" * 500)]
    got = privacy.report(privacy.protect(documents(rows, extra=True))).collect()
    assert len(got) == len(rows)
    known = {d: brute.personal_data(t) for d, t in rows if d is not None}
    assert all(tuple(r)[1:6] == known[r.doc_id] for r in got if r.doc_id is not None)


def test_terms_that_give_an_entity_away(documents):
    rows = [(i, f"filler{i} one Zorblatt a@b.co the end {'more ' * (i % 5)}") for i in range(6)] + [(i, f"the end of text {i} one") for i in range(6, 200)]
    protected = privacy.protect(documents(rows))
    out = {r.doc_id: r.spans for r in privacy.report(protected).collect()}
    start = rows[0][1].index("Zorblatt")
    assert f"term:{start}:{start + 8}" in out[0] and all(out[i] == "" for i in range(6, 200))
    assert ":" not in out[0].replace("email:", "").replace("term:", "").split(",")[0].split(":")[2:]
    clean = {r.doc_id: r.text for r in privacy.sanitise(documents(rows)).collect()}
    assert "Zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and "the end" in clean[0] and clean[7] == rows[7][1]


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_equal_brute_force(documents, odd_rows, seed):
    r = random.Random(seed)
    voc = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["É", "ñu", "naïve", "x1y"]
    people = [f"p{i}@a.example" for i in range(12)] + ["10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    rows = [x for x in odd_rows if len(x[1] or "") < 10_000]
    for i in range(100, 260):
        ws = [r.choice(voc) for _ in range(r.randrange(1, 9))] + [f"only{chr(97 + i % 26)}{chr(97 + i // 26)}"] * (i % 7 == 0)
        if i % 3 == 0:
            ws += r.sample(people, r.randrange(1, 3))
        if i % 9 == 0:
            ws += ["Tell-tale", "p3@a.example", "p4@a.example"] if i % 18 == 0 else ["(telltale) tale"]
        r.shuffle(ws)
        rows.append((i, " ".join(ws)))
    rows += [(i, rows[-1][1] + " secretword p7@a.example") for i in range(300, 306)]
    got = privacy.protect(documents(rows, extra=True)).collect()
    expected = brute.disclosed(rows)
    known = {rows[i][0]: v for i, v in expected.items() if rows[i][0] is not None and sum(x[0] == rows[i][0] for x in rows) == 1}
    assert {g.doc_id: {tuple(t) for t in g.terms} for g in got if g.doc_id in known} == known
    assert sum(map(len, known.values())) > 50 and any(t[2] for v in known.values() for t in v)


def test_privacy_of_empty_and_repetitive_tables(documents):
    assert privacy.report(privacy.protect(documents([]))).collect() == []
    rows = [(1, "a@b.co " + "lone " * 30_000), *[(i, "common text") for i in range(2, 9)]]
    got = {r.doc_id: r.n_term for r in privacy.report(privacy.protect(documents(rows))).collect()}
    assert got == {1: 30_000, **{i: 0 for i in range(2, 9)}}


# --- 6 substrings -----------------------------------------------------------------------------


@pytest.mark.parametrize("size", [20, 7, 2])
def test_removed_words_equal_brute_force(documents, size):
    rows = texts(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(documents(rows, extra=True), size).collect()}
    assert got == brute.substring_dedup(rows, size)


def test_substrings_of_odd_rows(documents, odd_rows):
    got = substrings.dedup(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in got if r.doc_id is not None}
    assert removed[7] == (40_000, 40_000) and removed[2] == (0, 0) and removed[1] == (3, 0) and removed[8] == (1, 0)
    assert removed[6][1] == brute.substring_dedup([odd_rows[9]])[6][1]


# --- 7 sharding -------------------------------------------------------------------------------


def test_shards_grow_into_the_new_one_only(documents, odd_rows):
    rows = [*odd_rows, *[(i, f"t{i}") for i in range(100, 2100)]]
    got = sharding.shard(documents(rows, extra=True), 8).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard != r.shard for r in got) / len(got)
    assert 0.08 < moved < 0.15 and max(map(len, slots.values())) < 1.3 * len(got) / 8


# --- 8 scoring --------------------------------------------------------------------------------


def test_scores_equal_plain_counts(documents, odd_rows):
    rows = texts(5)
    got = {r.doc_id: r for r in scoring.score(documents(rows, extra=True)).collect()}
    for d, (n, mean) in brute.stupid_backoff(rows).items():
        assert got[d].n_words == n and (got[d].log_score is None if mean is None else abs(got[d].log_score - mean) < 1e-5)
    odd = scoring.score(documents(odd_rows)).collect()
    assert len(odd) == len(odd_rows) and len({r.log_score for r in odd if r.doc_id == 1}) == 1


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_rare_words_keep_their_own_counts(documents, bits):
    rows = [*texts(5), (900, "junk1 junk2 " * 6 + "once w1"), (901, "junk1 w1 once2 junk2"), (902, "Once3"), (903, "w1 w1 w2 junk1 junk2 junk2")]
    got = {r.doc_id: r for r in scoring.score(documents(rows), bits).collect()}
    assert len(got) == len(rows)
    for d, (n, mean) in brute.stupid_backoff(rows).items():
        assert got[d].n_words == n and (got[d].log_score is None if mean is None else abs(got[d].log_score - mean) < 1e-5)
    assert got[902].backed_off == 1.0 and 0 < got[900].backed_off < 0.5


# --- 9 decontamination ------------------------------------------------------------------------


def test_tiles_cover_reordered_passages(documents, spark):
    item = [f"t{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "only three words"), (3, None), (3, ""), (4, "unrelated text of some more words here")], "item_id long, text string")
    swapped = " ".join(item[15:] + ["gap"] * 3 + item[:15])
    rows = [(1, "pre " + " ".join(item).upper() + " post"), (2, swapped), (3, " ".join(item[:10]) + " x " * 50), (4, None), (5, "so only, three WORDS!"),
            (6, " ".join(f"t{i} q" for i in range(30))), (7, "clean text " * 40), (1, "again clean")]
    got = decontamination.contaminated(documents(rows, extra=True), bench).collect()
    assert sorted((r.doc_id, r.n_items) for r in got) == [(1, 0), (1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, 0), (7, 0)]
    blocks = decontamination.contaminated(documents(rows), bench, block_tokens=5).groupBy("doc_id").agg(F.sum("n_items").alias("n"))
    assert {r.doc_id: r.n for r in blocks.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0}
    assert not any(r.contaminated for r in decontamination.contaminated(documents(rows), bench.limit(0)).collect())


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_blocks_give_one_row_per_row(documents, spark, monkeypatch, held):
    monkeypatch.setattr(decontamination, "HELD_BYTES", held)
    item = [f"t{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "only three words"), (3, " ".join(item[:20])), (4, "unrelated text of some more words here")], "item_id long, text string")
    rows = [(1, "pre " + " ".join(item) + " post"), (1, "again clean"), (2, "clean"), (2, "clean"), (3, None), (None, "Only three words"), (4, " ".join(item[:9]))]
    one = decontamination.find_overlaps(documents(rows), bench).collect()
    many = decontamination.find_overlaps(documents(rows), bench, block_tokens=5).collect()
    assert len(many) == len(rows) and sorted(map(repr, many)) == sorted(map(repr, one))
    judged = decontamination.contaminated(documents(rows), bench, block_tokens=5).collect()
    assert sorted((str(r.doc_id), r.n_items, r.contaminated) for r in judged) == [
        ("1", 0, False), ("1", 2, True), ("2", 0, False), ("2", 0, False), ("3", 0, False), ("4", 0, False), ("None", 1, True)]


def test_tiling_is_greedy_and_without_overlap():
    import numpy as np

    r = random.Random(6)
    for _ in range(40):
        a = np.array([r.randrange(4) for _ in range(r.randrange(1, 40))], np.uint64)
        b = np.array([r.randrange(4) for _ in range(r.randrange(1, 60))], np.uint64)
        tiles = decontamination.tile(a, b, 3)
        used_a, used_b = [], []
        for p, t, n in tiles:
            assert n >= 3 and (a[p:p + n] == b[t:t + n]).all()
            used_a += range(p, p + n)
            used_b += range(t, t + n)
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        free_a, free_b = set(range(len(a))) - set(used_a), set(range(len(b))) - set(used_b)
        assert not any(all(p + i in free_a and t + i in free_b and a[p + i] == b[t + i] for i in range(3)) for p in free_a for t in free_b)


# --- 10 mixing --------------------------------------------------------------------------------


def test_targets_stop_at_the_cap_and_are_shared_again(spark):
    sizes = {"a": 1000, "b": 1, "c": 10, None: 500, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * w / free for s, w in weights.items()}
        above = {s for s in weights if target[s] > 3 * sizes[s] + 1e-9}
        if not above:
            break
        capped |= above
    assert all(abs(got[s] - target[s]) < 1e-6 for s in sizes)


def test_mixture_meets_its_targets_and_repeats(documents, odd_rows):
    r = random.Random(8)
    rows = [*odd_rows[:9], *[(i, "w " * r.randrange(1, 40)) for i in range(100, 900)]]
    first = sorted(mixing.mix(documents(rows, extra=True)).select("doc_id", "source", "size", "source_size", "target", "taken").collect(), key=repr)
    again = sorted(mixing.mix(documents(rows).repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect(), key=repr)
    assert [tuple(x) for x in first] == [tuple(x) for x in again] and len(first) == len(rows)
    taken = {}
    for x in first:
        assert 0 <= x.taken <= 3 * x.size
        taken.setdefault(x.source, [x.target, 0])[1] += x.taken
    assert all(abs(t - got) <= 1 for t, got in taken.values())
