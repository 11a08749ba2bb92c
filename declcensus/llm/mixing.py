"""Mixing to target weights: rake token weights to several marginals, then sample.

Documents are counted into cells, one per combination of the dimensions.  Iterative
proportional fitting scales the token weights of the cells to the target share of each
dimension in turn.  A document is taken with the probability that its cell's fitted
weight asks for, decided by a hash of its id, so a rerun takes the same documents.

With ``bounded`` no cell is asked for more tokens than it has: cells that are full stay so
and the others are scaled to what is left, until the marginals hold.  A value that has too
few tokens for its weight is taken whole, and the other values of its dimension share the
rest by their weights, so the sample has the wanted size.  Without it the weights are
fitted first and clipped last, which makes the sample smaller and misses the weights where
a cell has too few tokens.  :func:`feasible` gives the largest sample for which none has too
few, :func:`shares` what is wanted and what is reached.

The cells are a table of their own and stay distributed.  They are broadcast to the
documents if they are counted and found few; else they are joined.

Defined results: a null value of a dimension is the value ``''``; a value without a
listed weight gets ``OTHER``; a cell without tokens is taken with probability 0; a
probability cannot exceed 1, so a cell that has too few tokens is taken whole; a null
id counts as empty text; rows with the same id are taken or left together; an empty table
gives no rows.  Texts of any length are counted whole.  The columns of the input come back in
one struct, so their names cannot clash with the others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from declcensus.operators.ordering import materialize

SWEEPS = 12
FRACTION = 0.5
OTHER = 0.05
_BROADCAST_CELLS = 10_000
_AT_ONCE = 4
_CLOSE = 1e-4
_MOST = 100

Targets = Mapping[str, Mapping[str, float] | None]


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+")).cast("long")


def topic(text: Column, rules: Mapping[str, str], rest: str) -> Column:
    """The first topic whose mark the text contains."""
    out = F.lit(rest)
    for name, mark in reversed(rules.items()):
        out = F.when(F.coalesce(F.contains(text, F.lit(mark)), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _weight(name: str, weights: Mapping[str, float] | None) -> Column:
    if weights is None:
        return F.lit(1.0)
    listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(listed, F.col(name)), F.lit(OTHER))


def rake(cells: DataFrame, targets: Targets, sweeps: int = SWEEPS) -> DataFrame:
    """``cells(*targets, tokens)`` with ``share``: the fitted share of all tokens."""
    out = cells.withColumn("share", F.col("tokens").cast("double"))
    for name, weights in targets.items():
        weighted = cells.select(name).distinct().select(name, _weight(name, weights).alias("_weight"))
        total = weighted.agg(F.coalesce(F.sum("_weight"), F.lit(1.0))).first()[0]
        wanted = weighted.select(name, (F.col("_weight") / F.lit(total)).alias(f"_{name}"))
        out = out.join(wanted, name)
    out = materialize(out)
    for sweep in range(sweeps):
        for name in targets:
            present = F.sum("share").over(W.partitionBy(name))
            out = out.withColumn("share", F.when(present > 0, F.col("share") * F.col(f"_{name}") / present).otherwise(0.0))
        if (sweep + 1) % _AT_ONCE == 0 or sweep + 1 == sweeps:
            out = materialize(out)
    return out.select(*targets, "tokens", "share")


def feasible(raked: DataFrame, most: float = FRACTION) -> float:
    """The largest share of all tokens, up to ``most``, at which no cell of the fit is asked for
    more than it has, so that all weights hold."""
    total = F.sum("tokens")
    least = F.min(F.when(F.col("share") > 0, F.col("tokens") / F.col("share")))
    found = raked.agg((least / F.when(total > 0, total)).alias("share")).first()[0]
    return most if found is None else min(most, float(found))


def _wanted(cells: DataFrame, name: str, weights: Mapping[str, float] | None, size: float) -> DataFrame:
    """``(name, _name)``: the tokens wanted of each value, ``size`` in all and no more than it has."""
    has = materialize(cells.groupBy(name).agg(F.sum("tokens").alias("_has")).withColumn("_weight", _weight(name, weights)))
    level, full = 0.0, -1
    while True:
        short = F.col("_has") <= F.col("_weight") * F.lit(level)
        whole, rest, found = has.agg(
            F.sum(F.when(short, F.col("_has")).otherwise(0)), F.sum(F.when(short, 0.0).otherwise(F.col("_weight"))), F.count_if(short)
        ).first()
        if not rest or found == full:
            break
        level, full = (size - whole) / rest, found
    return has.select(name, F.least(F.col("_has").cast("double"), F.col("_weight") * F.lit(level)).alias(f"_{name}"))


def _bounded(cells: DataFrame, targets: Targets, size: float, sweeps: int) -> DataFrame:
    """``taken``: the tokens to take of each cell, no more than it has, ``size`` in all."""
    out = rake(cells, targets, sweeps).withColumn("mass", F.col("share") * F.lit(size)).drop("share")
    for name, weights in targets.items():
        out = out.join(_wanted(cells, name, weights, size), name)
    out = materialize(out)
    taken, full = F.least("mass", "tokens"), F.col("mass") >= F.col("tokens")
    last = None
    for _ in range(_MOST // _AT_ONCE):
        for _ in range(_AT_ONCE):
            for name in targets:
                own = W.partitionBy(name)
                now = F.sum(taken).over(own)
                fixed = F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(own)
                free = F.sum(F.when(full, 0.0).otherwise(F.col("mass"))).over(own)
                wanted = F.col(f"_{name}")
                scaled = out.withColumns({"_now": now, "_fixed": fixed, "_free": free})
                scale = F.when(F.col("_now") > wanted, wanted / F.col("_now")).when(
                    F.col("_free") > 0, (wanted - F.col("_fixed")) / F.col("_free")
                ).otherwise(1.0)
                out = scaled.withColumn("mass", F.col("mass") * scale).drop("_now", "_fixed", "_free")
        out = materialize(out)
        off = max(
            out.groupBy(name).agg(F.abs(F.sum(taken) - F.first(f"_{name}")).alias("off")).agg(F.max("off")).first()[0] or 0.0
            for name in targets
        )
        # Marginals that contradict each other cannot all hold: then the miss no longer shrinks.
        if off <= _CLOSE * size or (last is not None and off > 0.99 * last):
            break
        last = off
    return out.select(*targets, "tokens", taken.alias("taken"))


def rates(
    cells: DataFrame, targets: Targets, fraction: float | None = FRACTION, sweeps: int = SWEEPS, bounded: bool = False
) -> DataFrame:
    """``probability`` per cell, for a sample of ``fraction`` of all tokens.

    Without a ``fraction`` the sample is as large as the weights allow: see :func:`feasible`.
    """
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if fraction is None:
        fitted = rake(cells, targets, sweeps)
        wanted = F.col("share") * F.lit(feasible(fitted) * total) / F.col("tokens")
    elif bounded:
        fitted = _bounded(cells, targets, float(fraction * total), sweeps)
        wanted = F.col("taken") / F.col("tokens")
    else:
        fitted = rake(cells, targets, sweeps)
        wanted = F.col("share") * F.lit(fraction * total) / F.col("tokens")
    return fitted.select(
        *targets, F.when(F.col("tokens") > 0, F.least(wanted, F.lit(1.0))).otherwise(0.0).alias("probability")
    )


def shares(cells: DataFrame, found: DataFrame, targets: Targets) -> DataFrame:
    """``(dimension, value, target, reached)``: shares of the expected sample at the rates ``found``."""
    joined = materialize(cells.join(found, list(targets)).withColumn("taken", F.col("tokens") * F.col("probability")))
    size = joined.agg(F.sum("taken")).first()[0] or 1.0
    out = None
    for name, weights in targets.items():
        values = joined.groupBy(name).agg(F.sum("taken").alias("taken")).withColumn("weight", _weight(name, weights))
        total = values.agg(F.sum("weight")).first()[0] or 1.0
        rows = values.select(
            F.lit(name).alias("dimension"), F.col(name).alias("value"),
            (F.col("weight") / F.lit(total)).alias("target"), (F.col("taken") / F.lit(size)).alias("reached"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def uniform(key: Column) -> Column:
    """A number from 0 to 1 that depends on the id only."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample(
    df: DataFrame, dimensions: Mapping[str, Column], targets: Targets, key: str = "doc_id", text: str = "text",
    fraction: float | None = FRACTION, sweeps: int = SWEEPS, bounded: bool = False,
) -> DataFrame:
    """The input row as ``row``, its dimensions, ``tokens``, ``probability`` and ``sampled``.

    Without a ``fraction`` the sample is as large as the weights allow: see :func:`feasible`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    values = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in dimensions.items()]
    tokens = token_count(F.col(f"`{text}`").cast("string")).alias("tokens")
    cells = materialize(df.select(*values, tokens).groupBy(*dimensions).agg(F.sum("tokens").alias("tokens")))
    found = rates(cells, targets, fraction, sweeps, bounded)
    if cells.count() <= _BROADCAST_CELLS:
        found = F.broadcast(found)
    rows = df.select(row, *values, tokens).join(found, list(dimensions))
    sampled = uniform(F.col(f"row.{key}")) < F.col("probability")
    return rows.select("row", *dimensions, "tokens", "probability", sampled.alias("sampled"))
