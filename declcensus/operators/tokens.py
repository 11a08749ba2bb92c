"""Bracket-aware method count: brackets as rows, matched by windows.

The column patterns follow nested parentheses to a fixed depth; this operator
follows them to any depth and is the exact cross-check where that matters.  Each
file is reduced in place to one character per parenthesis, so what is shuffled is
a small part of the text, and a file is cut into chunks, so that the tokens of a
very large file are spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from declcensus.functions import brackets, counting
from declcensus.operators import counts, ordering
from declcensus.operators.language import barrier

CHUNK = 1 << 16

# One private-use character per role of a parenthesis.
_OPEN_BODY = "\ue001"  # opens a header that needs a body
_OPEN_ANY = "\ue002"  # opens a header that may end in a semicolon
_CLOSE_BODY = "\ue003"
_CLOSE_END = "\ue004"
_ROLES = _OPEN_BODY + _OPEN_ANY + _CLOSE_BODY + _CLOSE_END


def with_bracket_roles(files: DataFrame) -> DataFrame:
    """Reduce ``code`` to ``roles``: one character per parenthesis, in order.

    The rules are applied one kind at a time, each in a projection of its own; the
    closings first, as they look at the brace that an opening may take in.
    """
    open_body, open_any, close_body, close_end = zip(*counting.METHOD_BRACKETS.values())
    reduced = files.withColumn("marked", F.translate("code", _ROLES + brackets.MARKS.replace(brackets.MEMBER, ""), "")).drop("code")
    for patterns, role in (
        (close_body, _CLOSE_BODY),
        (close_end, _CLOSE_END),
        (open_body, _OPEN_BODY),
        (open_any, _OPEN_ANY),
    ):
        text = F.col("marked")
        marked = F.when(F.lit(False), text)
        for name, pattern in zip(counting.METHOD_BRACKETS, patterns):
            if pattern is not None:
                replaced = F.regexp_replace(text, F.lit(pattern), F.lit(role))
                marked = marked.when(F.col("language") == name, replaced)
        reduced = reduced.withColumn("marked", marked.otherwise(text))
    only_roles = F.regexp_replace("marked", F.lit(rf"[^(){_ROLES}]++"), F.lit(""))
    return barrier(reduced, roles=only_roles).drop("marked")


def _opens(role: Column) -> Column:
    return role.isin("(", _OPEN_BODY, _OPEN_ANY)


def bracket_chunks(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows ``(file, path, language, chunk, before, roles)``: ``before`` is the nesting
    depth at the start of the chunk, summed up inside the row; ``file`` is a number, and
    the path is there in the first chunk only."""
    code = counts.with_code(files.filter(F.col("language").isin(*counting.METHOD_BRACKETS)))
    reduced = with_bracket_roles(code.select("path", "language", "code"))
    kept = reduced.filter(F.rlike("roles", F.lit(f"[{_OPEN_BODY}{_OPEN_ANY}]"))).withColumn(
        "file", F.monotonically_increasing_id()
    )
    last = F.floor((F.length("roles") - 1) / chunk).cast("int")
    cut = kept.select(
        "file",
        "path",
        "language",
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.substr(F.col("roles"), i * chunk + 1, F.lit(chunk)),
        ).alias("parts"),
    )
    net = F.transform(
        F.col("parts"),
        lambda p: 2 * F.length(F.regexp_replace(p, F.lit(f"[){_CLOSE_BODY}{_CLOSE_END}]"), F.lit("")))
        - F.length(p),
    )
    before = F.aggregate(
        net,
        F.array(F.lit(0)),
        lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n),
    )
    return cut.select(
        "file", "path", "language", F.posexplode(F.arrays_zip("parts", before.alias("before"))).alias("chunk", "part")
    ).select(
        "file",
        F.when(F.col("chunk") == 0, F.col("path")).alias("path"),
        "language",
        "chunk",
        F.col("part.before").alias("before"),
        F.col("part.parts").alias("roles"),
    ).filter(F.col("roles").isNotNull())


def method_counts(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows ``(path, language, method_count)`` of the files that have a method.

    The chunks are a small part of the text and are read twice, so they are
    materialized.  Tokens carry a file number; the path is joined to the counts.
    """
    chunks = ordering.materialize(bracket_chunks(files, chunk))
    tokens = chunks.select(
        "file", "chunk", "before", F.posexplode(F.split("roles", "")).alias("pos", "role")
    ).filter(F.col("role") != "")

    # Depth of a pair: the running sum at its opening, one more than at its closing.
    step = F.when(_opens(F.col("role")), 1).otherwise(-1)
    running = F.sum(step).over(
        W.partitionBy("file", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    opened = _opens(F.col("role"))
    depth = F.col("before") + running + F.when(opened, 0).otherwise(1)
    nested = tokens.select("file", "chunk", "pos", "role", depth.alias("depth"))

    # Inside a chunk the next parenthesis of the same depth is the partner.
    same_depth = W.partitionBy("file", "chunk", "depth").orderBy("pos")
    local = nested.select(
        "*",
        F.lead("role").over(same_depth).alias("partner"),
        F.lag("role").over(same_depth).alias("previous"),
    )
    role, partner = F.col("role"), F.col("partner")
    is_method = ((role == _OPEN_BODY) & (partner == _CLOSE_BODY)) | (
        (role == _OPEN_ANY) & partner.isin(_CLOSE_BODY, _CLOSE_END)
    )
    # Pairs cut by a chunk end: at most two rows per chunk and depth are left over.
    left_over = (opened & partner.isNull()) | (~opened & F.col("previous").isNull())
    found = ordering.materialize(local.filter(left_over | is_method).drop("previous"))
    across = found.filter(partner.isNull() | ~opened).withColumn(
        "partner", F.lead("role").over(W.partitionBy("file", "depth").orderBy("chunk", "pos"))
    )
    counted = (
        found.filter(is_method).select("file")
        .unionByName(across.filter(opened & is_method).select("file"))
        .groupBy("file")
        .agg(F.count("*").alias("method_count"))
    )
    named = chunks.filter(F.col("chunk") == 0).select("file", "path", "language")
    return counted.join(named, "file").select("path", "language", "method_count")
