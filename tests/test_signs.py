"""Signs led by words: found as whole words, by patterns that start with one plain word."""

import pytest
from helpers import files
from pyspark.sql import functions as F

from declcensus.functions import detection
from declcensus.operators import language


def test_no_sign_starts_with_a_choice_of_words():
    patterns = [p for signs in detection._SETS.values() for s in signs for _, p in s.ways()]
    assert not [p for p in patterns if p.startswith(r"\b(?:")]


@pytest.mark.parametrize(
    "line, found",
    [("private int f(", True), ("xprivate int f(", False), ("éprivate int f(", False), ("protected a.B f (", True)],
)
def test_word_led_sign(spark, line, found):
    sign = next(s for s in detection.JAVA_SIGNS if s.leads)
    df = spark.createDataFrame([(line,)], "text string")
    assert df.select(F.expr(detection._found("text", sign))).first()[0] is found


def test_label_by_words(spark):
    text = "const fs = require('fs');\nlet x = 1;\nconsole.log(x);\n"
    df = language.with_content_language(files(spark, {"a": text, "b": text.replace("const", "aconst").replace("let", "alet")}))
    assert {r["path"]: r["content_language"] for r in df.collect()} == {"a": "JavaScript", "b": "JavaScript"}
