from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from declcensus.llm import mixing


def raked(cells, wanted, sweeps):
    share = {c: float(n) for c, n in cells.items()}
    for _ in range(sweeps):
        for k, weights in enumerate(wanted):
            total = defaultdict(float)
            for c, s in share.items():
                total[c[k]] += s
            share = {c: s * weights[c[k]] / total[c[k]] if total[c[k]] else 0 for c, s in share.items()}
    return share


def test_rake_matches_plain_fitting(spark):
    cells = {(a, b): 10 + 7 * i * j + i for i, a in enumerate("xyz") for j, b in enumerate("pqrs")}
    rows = spark.createDataFrame([(*c, n) for c, n in cells.items()], "a string, b string, tokens long")
    got = mixing.rake(rows, {"a": None, "b": {"p": 0.5, "q": 0.3, "r": 0.15, "s": 0.05}}).collect()
    expected = raked(cells, [dict.fromkeys("xyz", 1 / 3), {"p": 0.5, "q": 0.3, "r": 0.15, "s": 0.05}], mixing.SWEEPS)
    for r in got:
        assert r["share"] == pytest.approx(expected[r["a"], r["b"]])
    by_b = defaultdict(float)
    for r in got:
        by_b[r["b"]] += r["share"]
    assert by_b["p"] == pytest.approx(0.5) and by_b["s"] == pytest.approx(0.05)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_sample_meets_the_target(documents, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "_BROADCAST_CELLS", broadcast)
    got = mixing.sample(documents, {"source": F.col("source")}, {"source": None}, fraction=0.3)
    taken = {r["source"]: r["n"] for r in got.filter("sampled").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(taken.values())
    assert len(taken) == 6 and total == pytest.approx(0.3 * 400_000, rel=0.05)
    assert all(n / total == pytest.approx(1 / 6, rel=0.12) for n in taken.values())


def test_awkward_rows(awkward, nothing):
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"), {"q": "?"}, "rest")}
    targets = {"source": None, "lang": {"xx": 0.5}, "topic": {"q": 0.5, "rest": 0.5}}
    got = mixing.sample(awkward, dimensions, targets, fraction=0.9).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert r["row"].asDict().keys() == set(awkward.columns)
        assert 0 <= r["probability"] <= 1 and r["sampled"] is not None
        assert r["tokens"] == len((r["row"]["text"] or "").split())
    assert mixing.sample(nothing, dimensions, targets).count() == 0
    assert len({r["sampled"] for r in got if r["row"]["doc_id"] == 13}) == 1


def _shares(spark, cells, targets, fraction):
    rows = spark.createDataFrame([(*c, n) for c, n in cells.items()], "a string, b string, tokens long")
    found = mixing.rates(rows, targets, fraction, bounded=True)
    taken = rows.join(found, ["a", "b"]).agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    return taken, {(r["dimension"], r["value"]): (r["target"], r["reached"]) for r in mixing.shares(rows, found, targets).collect()}


def test_full_cells_make_room_for_others(spark):
    cells = {("x", "p"): 900, ("x", "q"): 100, ("y", "p"): 100, ("y", "q"): 300, ("z", "p"): 400, ("z", "q"): 200}
    taken, got = _shares(spark, cells, {"a": None, "b": {"p": 0.5, "q": 0.5}}, 0.5)
    assert taken == pytest.approx(1000, rel=1e-3)
    assert all(reached == pytest.approx(target, abs=1e-3) for target, reached in got.values())


def test_a_scarce_value_is_taken_whole(spark):
    cells = {("x", "p"): 500, ("x", "q"): 20, ("x", "r"): 480, ("y", "p"): 500, ("y", "q"): 20, ("y", "r"): 480}
    taken, got = _shares(spark, cells, {"a": None, "b": {"p": 0.4, "q": 0.2, "r": 0.4}}, 0.5)
    assert taken == pytest.approx(1000, rel=1e-3)
    assert got["b", "q"] == (pytest.approx(0.2), pytest.approx(0.04, abs=1e-3))
    assert got["b", "p"][1] == pytest.approx(0.48, abs=1e-3) and got["a", "x"][1] == pytest.approx(0.5, abs=1e-3)


def test_bounded_sample_takes_awkward_rows(awkward, nothing):
    dimensions, targets = {"source": F.col("source"), "lang": F.col("lang")}, {"source": None, "lang": {"xx": 0.5}}
    got = mixing.sample(awkward, dimensions, targets, bounded=True).collect()
    assert len(got) == awkward.count() and all(0 <= r["probability"] <= 1 for r in got)
    assert mixing.sample(nothing, dimensions, targets, bounded=True).count() == 0


def test_the_largest_feasible_sample_meets_all_weights(spark):
    """A scarce cell bounds the sample; at that size all weights hold."""
    cells = {(a, b): n for a, row in zip("xyz", ((900, 40, 60), (500, 70, 30), (700, 20, 80))) for b, n in zip("pqr", row)}
    rows = spark.createDataFrame([(*c, n) for c, n in cells.items()], "a string, b string, tokens long")
    targets = {"a": None, "b": {"p": 0.6, "q": 0.25, "r": 0.15}}
    share = raked(cells, [dict.fromkeys("xyz", 1 / 3), targets["b"]], 60)
    fitted = mixing.rake(rows, targets, 60)
    size = mixing.feasible(fitted)
    assert size == pytest.approx(min(cells[c] / share[c] for c in cells) / 2400) and size < 0.25
    assert mixing.feasible(fitted, 0.01) == 0.01 and mixing.feasible(fitted.limit(0)) == mixing.FRACTION
    found = mixing.rates(rows, targets, None, sweeps=60)
    for r in mixing.shares(rows, found, targets).collect():
        assert r["reached"] == pytest.approx(r["target"], abs=1e-6)
    assert max(r["probability"] for r in found.collect()) == pytest.approx(1)
