"""Small source-file tables for tests."""

from pyspark.sql import functions as F

from declcensus.operators import analysis, counts, language
from declcensus.sources import table

EXTENSION = {
    "Rust": "rs",
    "Go": "go",
    "Python": "py",
    "JavaScript": "js",
    "TypeScript": "ts",
    "Java": "java",
}


def files(spark, contents):
    """``{path: text or bytes}`` as a source_files table."""
    rows = [(p, c if isinstance(c, bytes) else c.encode()) for p, c in contents.items()]
    return table.source_files(spark.createDataFrame(rows, "path string, content binary"))


def counted(spark, contents, **options):
    """``{path: (language, functions, types)}`` of a run over ``contents``."""
    analyzed = analysis.analyze_files(files(spark, contents), **options)
    return {
        r["path"]: (r["language"], r["function_count"], r["class_struct_count"])
        for r in analysis.file_counts(analyzed).collect()
    }


def snippet_counts(spark, snippets):
    """Counts of ``[(name, language, text), ...]`` with the language given."""
    rows = [(name, lang, text.encode()) for name, lang, text in snippets]
    df = spark.createDataFrame(rows, "path string, language string, content binary")
    return {
        r["path"]: (r["function_count"], r["class_struct_count"])
        for r in counts.file_counts(df).collect()
    }
