"""URL filter: rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame and ML-library operations on the executors.  The trees learn
from labelled URLs: here those that a rule decides.  At most about ``TRAIN_ROWS`` of
them are used, chosen by a hash of the URL; all other statistics cover all rows.

Defined results: host and path of a null URL, or of one without ``://``, are empty; a URL
that no rule fits is judged by the trees; if the labelled URLs are of one kind only, that
is the verdict, and ``allow`` if there are none; of rules that fit, the one with the most
characters in host and path wins; repeated rows have a row each and count as often; an empty
table gives no rows; URLs of any length are read whole; only the id and the URL are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
TRAIN_ROWS = 200_000
ROUNDS = 10
DEPTH = 4
_PRIOR = 20.0

Rule = tuple[str, str, str]

_LEXICAL = (
    "length", "host_length", "path_length", "depth", "labels", "digits", "letters", "hyphens",
    "entropy", "parameters", "fragment", "longest_segment",
)
_PARTS = ("top", "site", "section")
_STATISTICS = tuple(f"{p}_{s}" for p in _PARTS for s in ("rows", "rate"))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    after = F.coalesce(F.substring(rest, F.length(host) + 1, F.length(rest)), F.lit(""))
    return df.select(
        "*",
        F.translate(host, ascii_uppercase, ascii_lowercase).alias("host"),
        F.regexp_extract(after, r"^[^?#]*", 0).alias("path"),
    )


def matched(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _lexical(url: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    length = F.length(text).cast("double")
    some = F.greatest(length, F.lit(1.0))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)

    def add(total: Column, c: Column) -> Column:
        share = (length - F.length(F.replace(text, c, F.lit("")))) / some
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    characters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return {
        "length": length,
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/[^/]"),
        "labels": _count(F.col("host"), r"[^.]+"),
        "digits": _count(text, "[0-9]") / some,
        "letters": _count(text, "[A-Za-z]") / some,
        "hyphens": _count(F.col("host"), "-"),
        "entropy": F.aggregate(characters, F.lit(0.0), add),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "fragment": F.contains(text, F.lit("#")).cast("double"),
        "longest_segment": F.coalesce(
            F.array_max(F.transform(F.split("path", "/"), F.length)).cast("double"), F.lit(0.0)
        ),
    }


def _with_statistics(rows: DataFrame) -> DataFrame:
    """Rows per suffix of one and two labels and per first folder, and the smoothed share of
    blocked ones among its labelled rows."""
    labelled = rows.agg(F.avg("label")).first()[0]
    prior = 0.5 if labelled is None else labelled
    out = (
        rows.withColumn("_top", F.substring_index("host", ".", -1))
        .withColumn("_site", F.substring_index("host", ".", -2))
        .withColumn("_section", F.regexp_extract("path", r"^/[^/]*/?", 0))
    )
    for name in _PARTS:
        found = out.groupBy(f"_{name}").agg(
            F.log1p(F.count(F.lit(1)).cast("double")).alias(f"{name}_rows"),
            ((F.coalesce(F.sum("label"), F.lit(0.0)) + prior * _PRIOR) / (F.count("label") + _PRIOR)).alias(f"{name}_rate"),
        )
        out = out.join(found, f"_{name}")
    return out


def judge(
    df: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url",
    train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, depth: int = DEPTH,
) -> DataFrame:
    """One row per row of ``df``: id, ``host``, ``path``, ``rule``, ``verdict``, ``block_probability``."""
    name, verdict = matched(rules)
    parts = with_parts(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url")))
    ruled = parts.withColumn("rule", name).withColumn("ruled", verdict)
    rows = ruled.select(
        "*",
        F.when(F.col("ruled") == BLOCK, 1.0).when(F.col("ruled") == ALLOW, 0.0).alias("label"),
        *[c.alias(n) for n, c in _lexical(F.col("url")).items()],
    )
    known = ruled.groupBy("ruled").count().filter("ruled IS NOT NULL").collect()  # two rows at most
    counts = {r["ruled"]: r["count"] for r in known}
    if len(counts) < 2:
        only = next(iter(counts), ALLOW)
        probability, judged = F.lit(1.0 if only == BLOCK else 0.0), rows
    else:
        features = VectorAssembler(inputCols=[*_LEXICAL, *_STATISTICS], outputCol="features")
        ready = features.transform(_with_statistics(rows))
        most = min(1.0, train_rows / sum(counts.values()))
        chosen = F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(most * (1 << 20))
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7)
        model = trees.fit(ready.filter(F.col("label").isNotNull() & chosen).select("features", "label"))
        judged, probability = model.transform(ready), vector_to_array("probability")[1]
    return judged.select(
        F.col("id").alias(key), "host", "path", "rule",
        F.coalesce("ruled", F.when(probability > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        probability.alias("block_probability"),
    )
