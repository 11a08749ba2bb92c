"""A chain of replacements names its text once, so that no step is computed twice."""

import re

from pyspark.sql import functions as F

from declcensus.functions import counting


def test_text_is_named_once(spark):
    code = spark.createDataFrame([("class A {}", "Java")], "masked string, language string").select(
        counting.code_only(F.col("masked"), F.col("language")).alias("code")
    )
    plan = code._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"masked#\d+", plan.split("LogicalRDD")[0])) == 1
