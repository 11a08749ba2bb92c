"""Where a literal of a script starts: only there the costly alternatives are tried."""

from pyspark.sql import functions as F

from declcensus.functions import masking


def test_script_mask_starts_are_whole(spark):
    text = "a/b/c; x = /q\"/; return /'/g; retypeof/d/e; (`n${m}`)"
    df = spark.createDataFrame([(text, "JavaScript")], "text string, language string")
    masked = df.select(masking.mask(F.col("text"), F.col("language"))).first()[0]
    assert [w for w in ("a/b/c", "retypeof/d/e", "m") if w in masked] == ["a/b/c", "retypeof/d/e", "m"]
    assert not set("q\"'") & set(masked)


def test_most_places_are_passed_by():
    assert masking._SCRIPT_START in masking.SCRIPT_MASK
