"""Filters on source files; the path filters never touch the content."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declcensus import schemas as S


def ignore(files: DataFrame, patterns: Iterable[str] = ()) -> DataFrame:
    """Drop files whose full path contains any of the literal ``patterns``.

    An error of the walk (no ``length``) is not a file and stays.
    """
    patterns = list(patterns)
    if not patterns:
        return files
    hit = reduce(or_, (F.col("path").contains(p) for p in patterns))
    walk_error = F.col("io_error").isNotNull() & F.col("length").isNull()
    return files.filter(~hit | walk_error)


def within_depth(files: DataFrame, max_depth: int = S.DEFAULT_MAX_DEPTH) -> DataFrame:
    """Keep files at most ``max_depth`` levels below the root (its children are 1)."""
    return files.filter(F.col("depth") <= max_depth)


def links(files: DataFrame, follow_links: bool = False) -> DataFrame:
    """Drop files reached through a linked directory, unless links are followed."""
    return files if follow_links else files.filter(~F.col("via_link"))
