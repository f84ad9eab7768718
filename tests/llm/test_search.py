"""Licence scan, ranked search and vector codes against brute force, and their results for odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from martweave.llm import licenses, ranking, vectors
from tests.llm import brute

# --- 11 licences ------------------------------------------------------------------------------

NOTICES = {
    100: "Released under the MIT License.",
    101: "# Licensed under the Apache License, Version 2.0.\nAll rights reserved. all   RIGHTS\nreserved!",
    102: "This work is licensed under the GNU General Public License, version 3. CC BY-NC 4.0; cc-by",
    103: "the version 3 of a public general gnu license; rights all reserved",
    104: " ".join(licenses.TEMPLATES[4][1].split()).upper(),
    105: "permission is hereby granted, free of charge, to any other person obtaining a copy of the software",
    106: "mit é license mitKlicense mıt license MİT License cc by cc_by",
}


def test_base_places_equal_plain_ones(documents, odd_rows):
    rows = [*odd_rows, *NOTICES.items()]
    got = licenses.scan(documents(rows, extra=True).withColumns({n: F.lit("x") for n in ("hits", "row", "labels", "score", "w", "at")})).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        n, found = brute.licence_places(dict(rows)[r.doc_id], licenses.BASE)
        every = sorted(p for ps in found.values() for p in ps)
        assert (r.n_words, r.n_base) == (n, len(every))
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.base_labels == ",".join(sorted(k for k, ps in found.items() if ps))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_notices_give_their_labels(documents):
    rows = [*NOTICES.items(), *[(i, f"plain text number {i} of a version with no terms to copy") for i in range(60)]]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(documents(rows)).collect()}
    assert got[100] == ("mit", 1.0) and got[101] == ("apache-2.0,reserved", 1.0)
    assert got[102] == ("cc-by,cc-by-nc-4.0,gpl,gpl-3.0", 1.0)
    assert got[103] == ("", 0.0) and got[105] == ("", 0.0)
    assert got[104] == ("mit", 1.0)
    assert got[106][0] == "cc-by"
    assert all(got[i] == ("", 0.0) for i in range(60))


def test_a_notice_repeated_many_times(documents):
    text = "released under the mit license " * 60_000
    got = licenses.scan(documents([(1, text), (2, "license " * 200_000), (3, None)])).collect()
    assert {r.doc_id: (r.n_words, r.labels) for r in got} == {1: (300_000, "mit"), 2: (200_000, ""), 3: (0, "")}


def test_no_licences(documents):
    assert licenses.scan(documents([])).collect() == []


def test_index_holds_the_heaviest_places():
    weigh = {w: 10 for w in licenses.VOCABULARY} | {"mit": 50, "license": 7}
    mine = [p for p in licenses.index(weigh) if p[1] == 3]
    assert mine == [("mit", 3, 0, 50), ("license", 3, 1, 7)]
    assert all(sum(p[1] == t for p in licenses.index(weigh)) == min(licenses.RARE, len(words)) for t, (_, words, _) in enumerate(licenses.NOTICES))


# --- 12 ranked search -------------------------------------------------------------------------


def searched(spark, docs, items, **how):
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    return sorted((tuple(r) for r in ranking.search(docs, frame, **how).collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("block", [1 << 22, 1 << 13])
def test_ranks_equal_brute_force(spark, documents, odd_rows, block):
    r = random.Random(1)
    voc = [f"t{i}" for i in range(60)] + ["é", "Ñ", "x1"]
    texts = [(i, " ".join(r.choice(voc) for _ in range(r.randrange(0, 50)))) for i in range(100, 400)]
    texts += [(i, "t1 t2 t3, T1!") for i in range(400, 460)] + [(i, "t3 t1 (t2) t1") for i in range(460, 500)]
    rows = [*odd_rows, *texts]
    items = [(i, " ".join(r.choice(voc) for _ in range(r.randrange(1, 8)))) for i in range(12)] + [(12, None), (13, "t1 t2"), (13, "t1 t2"), (14, "?!"), (15, "A b q zz")]
    assert searched(spark, documents(rows, extra=True), items, block_bytes=block) == sorted(brute.ranked_search(rows, items))


def test_classes_are_scored_in_whole_numbers_of_any_size(spark, documents, monkeypatch):
    rows = [(i, "a " * (i % 4) + "b " * (i % 3)) for i in range(50)]
    items = [(1, "a a b"), (2, "b")]
    monkeypatch.setattr(ranking, "EXACT", 0)
    monkeypatch.setattr(ranking, "CELLS", 4)
    assert searched(spark, documents(rows), items) == sorted(brute.ranked_search(rows, items))


def test_search_of_empty_tables(spark, documents):
    assert searched(spark, documents([]), [(1, "a")]) == []
    assert searched(spark, documents([(1, "a")]), []) == []
    assert searched(spark, documents([(1, None), (2, " ")]), [(1, "a")]) == []


# --- 13 vector codes --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, part int"


def coded(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], VECTORS).repartition(4)
    return vectors.compress(df).collect()


def test_codes_equal_a_full_search(spark):
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.gauss(0, 1) if i % 3 else r.choice([-0.5, 0.0, 0.25]))) for _ in range(16)], i % 4 or None) for i in range(150)]
    rows += [(150, None, 1), (151, [None] + [0.0] * 15, 1), (152, [float("nan")] + [0.0] * 15, 1), (153, [float("inf")] + [0.0] * 15, 1),
             (7, rows[7][1], 2), (7, rows[8][1], 2), (None, rows[9][1], None)]
    got = coded(spark, rows)
    expected, digest = brute.vector_codes(rows)
    plain = sorted(((x.vec_id, x.code, x.error, x.label_error) for x in got), key=repr)
    assert plain == sorted(expected, key=repr) and {x.codebooks_sha256 for x in got} == {digest}


def test_equal_average_search_stops_late_enough():
    r = np.random.default_rng(3)
    for width in (1, 2, 5):
        entries, parts = r.integers(-6, 6, (16, width)), r.integers(-6, 6, (500, width))
        index, best = vectors.nearest(parts, entries)
        far = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_vectors_that_cannot_be_cut(spark):
    short = [(i, [0.5] * 12, 1) for i in range(4)]
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in coded(spark, short)} == {(i, None, None, None) for i in range(4)}
    mixed = [*[(i, [float(i)] * 8, 1) for i in range(5)], (9, [1.0] * 16, 1), (10, [1e30] * 8, 1), (11, [], 1)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in coded(spark, mixed)}
    assert got == {**{i: (f"{i:02x}" * 8, 0, 0) for i in range(5)}, 9: (None, None, None), 10: (None, None, None), 11: (None, None, None)}
    assert coded(spark, []) == []
