"""Counting operators: masked code, per-file counts, declaration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declcensus import schemas as S
from declcensus.functions import counting, masking


def with_masked(files: DataFrame) -> DataFrame:
    """Add ``masked`` and drop the raw content."""
    text = F.col("content").cast("string")
    return files.withColumn("masked", masking.mask(text, F.col("language"))).drop("content")


def with_code(files: DataFrame) -> DataFrame:
    """Add ``code``: masked text without the spans in which nothing is declared, with marks
    that say what follows a bracket."""
    return with_masked(files).withColumn(
        "code", counting.with_headers(F.col("masked"), F.col("language"))
    )


def file_counts(files: DataFrame) -> DataFrame:
    """Rows ``(path, language, function_count, class_struct_count)``: one per file,
    also for empty ones, with no shuffle."""
    code, language = F.col("code"), F.col("language")
    return with_code(files).select(
        "path",
        "language",
        counting.function_count(code, language).alias("function_count"),
        counting.class_struct_count(code, language).alias("class_struct_count"),
    )


def file_stats(files: DataFrame) -> DataFrame:
    """Rows ``(path, language, stats)``."""
    return file_counts(files).select(
        "path",
        "language",
        F.struct("function_count", "class_struct_count").alias("stats"),
    )


def _is_type(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^(?:struct|enum|type|class|interface)\s"))


def _kind(language: Column, text: Column) -> Column:
    """Kind of a declaration, told from its keyword or the lack of one."""
    script = language.isin(S.JAVASCRIPT, S.TYPESCRIPT)
    # An expression, or a nameless function, is matched up to its parenthesis.
    function = F.rlike(text, F.lit(r"^function(?![\p{L}\p{N}_$])"))
    opened = F.rlike(text, F.lit(r"[(<]$"))
    return (
        F.when(language == S.RUST, F.when(text.startswith("struct"), F.lit("struct_item"))
              .when(text.startswith("enum"), F.lit("enum_item"))
              .otherwise(F.lit("function_item")))
        .when(language == S.GO, F.when(text.startswith("type"), F.lit("type_spec"))
              .when(F.rlike(text, F.lit(r"^func\s*\(")), F.lit("method_declaration"))
              .otherwise(F.lit("function_declaration")))
        .when(language == S.PYTHON, F.when(_is_type(text), F.lit("class_definition"))
              .otherwise(F.lit("function_definition")))
        .when(script, F.when(_is_type(text), F.lit("class_declaration"))
              .when(text == "=>", F.lit("arrow_function"))
              .when(function & opened, F.lit("function_expression"))
              .when(function, F.lit("function_declaration"))
              .otherwise(F.lit("method_definition")))
        .when(language == S.JAVA, F.when(F.rlike(text, F.lit(r"^interface\s")), F.lit("interface_declaration"))
              .when(_is_type(text), F.lit("class_declaration"))
              .when(F.rlike(text, F.lit(r"^(?:(?:public|protected|private)\s|[{};)])")),
                    F.lit("constructor_declaration"))
              .otherwise(F.lit("method_declaration")))
    )


def _name(language: Column, text: Column) -> Column:
    """Declared name; NULL for arrows, nameless functions and computed names."""
    bare = F.regexp_replace(text, F.lit(r"\s*+[(<]$"), F.lit(""))
    last = F.regexp_extract(bare, r"((?:r#)?[#\p{L}_$][\p{L}\p{N}\p{M}_$]*+|^\d[\w.]*+)\s*$", 1)
    nameless = text.isin("=>", "[") | (
        language.isin(S.JAVASCRIPT, S.TYPESCRIPT) & (bare == "function")
    )
    return F.when(~nameless, last)


def declarations(files: DataFrame) -> DataFrame:
    """Rows ``(path, language, category, kind, ord, name)``, one per declaration.

    The array of matches is exploded in place: no shuffle.
    """
    found = with_code(files).select(
        "path",
        "language",
        F.posexplode(
            counting.declaration_texts(F.col("code"), F.col("language"))
        ).alias("ord", "matched"),
    )
    text = F.regexp_replace(F.col("matched"), F.lit(r"^\s++(?:async[ \t]++)?+|^async[ \t]++"), F.lit(""))
    typed = found.select("path", "language", "ord", text.alias("text"))
    language, text = F.col("language"), F.col("text")
    return typed.select(
        "path",
        "language",
        F.when(_is_type(text), F.lit(S.CLASS_STRUCT)).otherwise(F.lit(S.FUNCTION)).alias("category"),
        _kind(language, text).alias("kind"),
        "ord",
        _name(language, text).alias("name"),
    )
