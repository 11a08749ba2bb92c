"""Labels that cannot be the best are not scored, and the best one is that of all scores."""

import random

import numpy as np
from helpers import files
from pyspark.sql import functions as F

from declcensus.functions import detection as D
from declcensus.operators import language

PIECES = [
    "use std::fmt;\n", "let mut x = 1;\n", "fn f(a: i32) -> bool { a }\n", "#[test]\n", "impl A for B {\n", "package a.b;\n",
    "import java.util.List;\n", "public class A {\n", "private int f(\n", "System.out.println(1);\n", "package main\n",
    "func f(a int) {\n", "x := 1\n", 'import "fmt"\n', "def f(self):\n", "import os\n", "    return x\n", "class A:\n",
    "const a = 1;\n", "console.log(1);\n", "export default x\n", "f(a: string)\n", "): void {\n", "interface A { b: c }\n",
    "const a: number = 1;\n", "type A = {\n", "    private x: string;\n", "as any;\n", "```\n", "===\n", "a === b\n", "#!/bin/python\n",
    "public let export type import class\n", "string number void\n", "Grüße, 関\n", "namespace a;\n", "<?php\n", "\x00\n",
]


def _plain(scores):
    """The label by all scores."""
    own = dict(scores)
    own["typescript"] = own["typescript"] + own["javascript"] if own["typescript"] >= 300 else 0
    value, label = max((v, x) for x, v in own.items())
    return label if value >= 300 and value % 100 >= 2 else None


def test_labels_are_those_of_all_scores(spark):
    rng = random.Random(7)
    texts = {str(k): "".join(rng.choices(PIECES, k=rng.randrange(0, 9))) for k in range(400)}
    every = files(spark, texts)
    text = "CAST(content AS STRING)"
    found = D.with_label(every, "content", "label").select("path", "label", D.clues(F.col("content")).alias("clues"), *(
        F.expr(" + ".join(f"CASE WHEN {D._found(text, s)} THEN {s.weight * 100 + s.signs} ELSE 0 END" for s in signs)).alias(x)
        for x, signs in D._SETS.items()
    ), F.expr(" OR ".join(D._found(text, s) for s in D.FOREIGN_SIGNS)).alias("foreign")).collect()
    assert len({r["label"] for r in found}) == 7
    for r in found:
        scores = {x: r[x] for x in D.LABELS}
        assert r["label"] == (None if r["foreign"] else _plain(scores)), texts[r["path"]]
        tops = dict(zip(D.LABELS, r["clues"]["tops"], strict=True))
        assert all(tops[x] >= scores[x] for x in D.LABELS if x != "typescript")


def test_a_label_without_marks_has_no_bound():
    found = np.zeros((1, len(D._MARKS)), bool)
    assert D._bounds(found).tolist() == [[0] * 6]
    found[0, D._PLACES["package"]] = True
    assert dict(zip(D.LABELS, D._bounds(found)[0].tolist(), strict=True))["java"] == 201


def test_null_content_has_no_label(spark):
    df = files(spark, {"a": "x"}).withColumn("content", F.lit(None).cast("binary"))
    assert language.with_content_language(df).first()["content_language"] is None
