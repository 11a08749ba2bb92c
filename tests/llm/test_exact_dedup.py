from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from declcensus.llm import exact_dedup


def _expected(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    rank = (lambda x: (x is not None, x or 0)) if keep == "largest" else (lambda x: (x is not None, x or 0))
    best = {t: (max if keep == "largest" else min)(ids, key=rank) for t, ids in groups.items()}
    return sorted(((r["doc_id"], best[r["text"] or ""], len(groups[r["text"] or ""])) for r in rows), key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("splits", [4096, 2])
def test_classes_of_awkward_rows(awkward, monkeypatch, keep, splits):
    monkeypatch.setattr(exact_dedup, "SPLITS", splits)
    got = exact_dedup.classes(awkward, keep=keep).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == _expected(awkward.collect(), keep)
    assert sum(r["kept"] for r in got) == len({r["text"] or "" for r in awkward.collect()})


@pytest.mark.parametrize("splits", [4096, 3])
def test_a_text_with_most_rows_is_parted(spark, monkeypatch, splits):
    monkeypatch.setattr(exact_dedup, "SPLITS", splits)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 < 3, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.classes(rows, keep="largest").collect()
    same = [r for r in got if r["group_size"] == 300]
    assert len(same) == 300 and {r["keep_id"] for r in same} == {398} and [r["doc_id"] for r in same if r["kept"]] == [398]
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(rows).collect()) == [0, *range(3, 400, 4)]


def test_keep_one_carries_all_columns(awkward, nothing):
    kept = exact_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({r["text"] or "" for r in awkward.collect()})
    assert exact_dedup.keep_one(nothing).count() == exact_dedup.classes(nothing).count() == 0


def test_texts_that_share_a_long_start_stay_apart(spark):
    rows = spark.createDataFrame([(k, "x" * 200 + str(k % 3)) for k in range(9)], "doc_id long, text string")
    assert {r["group_size"] for r in exact_dedup.classes(rows).collect()} == {3}
