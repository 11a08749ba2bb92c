import os

import pytest

import corpus_pipeline
from declcensus.llm import decontamination as D
from declcensus.llm import near_dedup, queries
from tests.llm.test_near_dedup import brute_classes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_match_brute_force(spark):
    docs, plain = spark.read.parquet(f"{DATA}/documents.parquet"), None
    items = [(r["item_id"], D.normalised(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            plain = {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i], i)
            plain = set(first.values())
        elif name == "near_dedup":
            plain = {i for i, c in brute_classes(sorted(before.items())).items() if i == c}
        elif name == "decontamination":
            plain = {i for i, t in before.items() if not any(D.edit_search(x, D.normalised(t), int(len(x) * D.RATE)) for _, x in items)}
        else:
            plain = {r["doc_id"] for r in queries.mixed(docs).filter("sampled").select("row.doc_id").collect()}
        assert after == plain, name
        assert name == "mixing" or out.columns == docs.columns
        docs = out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == after


def test_stages_take_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "mixing" or out.columns == docs.columns
            assert out.count() <= docs.count()


def test_shingles_of_short_texts():
    assert len(near_dedup.labelled_shingles("one two")) == 1
    assert len(near_dedup.labelled_shingles(None)) == 0
