"""Declaration census: counts functions and types in source-code corpora on Spark."""
