"""The pipeline against plain versions of its stages, on one small corpus."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from cairn.llm import decontaminate, secrets, set_join

from .test_corpus_operators import item, plain_components, toxic_rows


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [r[:3] for r in toxic_rows(400, 7)]
    base = [f"n{i}" for i in range(150)]
    near = list(base)
    near[70] = "changed"
    rows += [(1000, " ".join(base)), (1001, " ".join(near)), (1002, " ".join(base)), (1003, "lead " * 9 + item(3)), (1004, "my password = hunter2hunter2 end"), (1005, None), (1006, ""), (1007, "")]
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[3]) for r in toxic_rows(400, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, item(i)) for i in range(5)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r[0] for r in toxic_rows(400, 7) if r[3]}
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns
    ids = {r["doc_id"] for r in clean.collect()}
    assert len(ids & toxic) <= 0.1 * len(toxic) and len(ids - toxic) >= 0.95 * (408 - len(toxic))
    one = corpus_pipeline.drop_near_copies(spark, docs, folder)
    want = {i for i, (_, c) in plain_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80).items() if c == i}
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == want and not {1001, 1002} & want
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, folder).collect()} == {1003}
    masked = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, docs, folder).collect()}
    assert masked[1004]["text"] == "my [assign] end" and masked[1004]["n_chars"] == 15 and masked[1005]["text"] is None


def test_run_packs_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and 1000 in ids and not {1001, 1002, 1003} & set(ids)
    assert {1005, 1006, 1007} <= set(ids)


def test_stages_on_repeats_and_nothing(spark, folder, make_docs):
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s"), (None, "t u v")])
    got = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert got.schema == docs.schema and sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "q r s"), (0, "t u v"), (1, "a b c d e f")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []
        stage(spark, docs, folder).collect()


def test_entry_lists_every_operator():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
