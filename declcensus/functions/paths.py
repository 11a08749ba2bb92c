"""Path columns: extension, depth, order key."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from declcensus import schemas as S


def file_extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name, NULL if there is none.

    A leading dot does not start an extension, and the dots of a directory do
    not count.
    """
    name = F.substring_index(path, "/", -1)
    found = F.regexp_extract(F.lower(name), r"(?s)^.+\.([^.]*)$", 1)
    return F.when(F.rlike(name, F.lit(r"(?s)^.+\.[^.]*$")), found)


def language_of_extension(extension: Column) -> Column:
    return _lookup(S.EXTENSION_TO_LANGUAGE, extension)


def language_of_label(label: Column) -> Column:
    return _lookup(S.LABEL_TO_LANGUAGE, label)


def label_of_language(language: Column) -> Column:
    return _lookup({name: label for label, name in S.LABEL_TO_LANGUAGE.items()}, language)


def path_depth(path: Column, root: str = "") -> Column:
    """Number of components below ``root``: 1 for the root's own children."""
    relative = path
    if root:
        relative = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    return F.size(F.split(relative, "/"))


def path_order(path: Column) -> Column:
    """Key whose plain byte order is the component-wise order of paths.

    No file name holds NUL, and NUL sorts below every other byte, so a directory
    comes before a sibling whose name merely starts the same (``a/b``, ``a-b/c``).
    """
    return F.replace(path, F.lit("/"), F.lit("\x00"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    literal = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.try_element_at(literal, key)
