"""The pipeline on a small corpus, stage by stage, against plain versions."""

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def root(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    item = " ".join(f"bench{i}" for i in range(25))
    rows = [*texts(9), (500, "pre " * 3 + item + " " + " ".join(f"p{i}" for i in range(30))), (501, None), (None, " ".join(f"n{i}" for i in range(40))),
            (502, "again and again " * 20)]
    rows.append(rows[0])
    documents(rows, extra=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
        kept[name] = docs.collect()
        if name != "shards":
            assert docs.columns == COLUMNS
            docs = spark.createDataFrame(kept[name], docs.schema)
    passed = kept["quality_rules"]
    assert {r.doc_id for r in passed} == {r.doc_id for r in spark.read.parquet(f"{root}/documents.parquet").collect()
                                          if len(brute.words(r.text)) >= 20 and r.doc_id != 502}
    known = [(r.doc_id, r.text) for r in passed if r.doc_id is not None]
    leaders = {c for _, c in brute.jaccard_components(dict(known).items(), 5, 80).values()}
    unique = kept["near_duplicates"]
    assert sorted(r.doc_id for r in unique if r.doc_id is not None) == sorted(leaders)
    assert sum(r.doc_id is None for r in unique) == 1
    assert {r.doc_id for r in unique} - {r.doc_id for r in kept["benchmark_passages"]} == {500}
    assert {r.doc_id for r in kept["mixture"]} <= {r.doc_id for r in kept["benchmark_passages"]}
    final = kept["shards"]
    assert sorted((r.doc_id or -1) for r in final) == sorted((r.doc_id or -1) for r in kept["mixture"])
    assert all(0 <= r.shard < 8 for r in final)


def test_run_and_empty_tables(spark, root, tmp_path):
    assert corpus_pipeline.run(spark, root).count() > 0
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_go_whatever_the_blocks(spark, documents, tmp_path, monkeypatch):
    from functools import partial

    from martweave.llm import decontamination

    monkeypatch.setattr(decontamination, "find_overlaps", partial(decontamination.find_overlaps, block_tokens=5))
    items = [(i, " ".join(f"b{i}x{j}" for j in range(12))) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents([(1, "pre " + items[1][1]), (2, "clean text"), (3, items[2][1]), (4, "clean text"), (2, "clean text")])
    kept = corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 4]
