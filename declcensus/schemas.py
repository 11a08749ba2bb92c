"""Names and schemas shared by every operator."""

from pyspark.sql import types as T

# The six languages under their report names, their content
# labels and their file extensions.
RUST = "Rust"
GO = "Go"
PYTHON = "Python"
JAVASCRIPT = "JavaScript"
TYPESCRIPT = "TypeScript"
JAVA = "Java"

LANGUAGES = (GO, JAVA, JAVASCRIPT, PYTHON, RUST, TYPESCRIPT)

LABEL_TO_LANGUAGE = {
    "rust": RUST,
    "go": GO,
    "python": PYTHON,
    "javascript": JAVASCRIPT,
    "typescript": TYPESCRIPT,
    "java": JAVA,
}

EXTENSION_TO_LANGUAGE = {
    "rs": RUST,
    "go": GO,
    "py": PYTHON,
    "js": JAVASCRIPT,
    "ts": TYPESCRIPT,
    "java": JAVA,
}

FUNCTION = "function"
CLASS_STRUCT = "class_struct"

# The default of a tree; a table has no limit.
DEFAULT_MAX_DEPTH = 100
ANY_DEPTH = (1 << 31) - 1

SOURCE_FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("content", T.BinaryType(), True),
        T.StructField("length", T.LongType(), True),
        T.StructField("depth", T.IntegerType(), True),
        T.StructField("via_link", T.BooleanType(), True),
        T.StructField("io_error", T.StringType(), True),
    ]
)

STATS = T.StructType(
    [
        T.StructField("function_count", T.LongType(), True),
        T.StructField("class_struct_count", T.LongType(), True),
    ]
)

FILE_STATS = T.StructType(
    [
        T.StructField("path", T.StringType(), True),
        T.StructField("language", T.StringType(), True),
        T.StructField("stats", STATS, True),
    ]
)

LANGUAGE_TOTALS = T.StructType(
    [
        T.StructField("file_count", T.LongType(), True),
        T.StructField("function_count", T.LongType(), True),
        T.StructField("class_struct_count", T.LongType(), True),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("files", T.ArrayType(FILE_STATS), True),
        T.StructField("total_by_language", T.MapType(T.StringType(), LANGUAGE_TOTALS), True),
        T.StructField("total_stats", STATS, True),
    ]
)
