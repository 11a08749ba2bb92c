"""SQL checks of the registered queries.

The expected results come from counting the lines of ``documents`` and from what
each block template is known to declare; no code is parsed, and no pattern is
shared with the engine.
"""

from __future__ import annotations

from declcensus import schemas as S
from declcensus.plans import corpus
from declcensus.plans.queries import IGNORED, MAX_DEPTH


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _values(name: str, columns: str, rows: list[str]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join(f"({r})" for r in rows) + ")"


_SCRIPTS = (S.JAVASCRIPT, S.TYPESCRIPT)
_SLOTS = len(corpus.SLOTS)
_FOLDERS = len(corpus.FOLDERS)

_FILES = f"""
files AS (
  SELECT doc_id, source, text, len(string_split(text, chr(10))) AS n,
    'corpus/' || source || '/' || {_list(corpus.FOLDERS)}[doc_id % {_FOLDERS} + 1] || 'd' || doc_id
      || {_list(e for _, e in corpus.SLOTS)}[doc_id % {_SLOTS} + 1] AS path,
    {_list(l for l, _ in corpus.SLOTS)}[doc_id % {_SLOTS} + 1] AS language,
    doc_id % {corpus.LINKED_EVERY} = 0 AS via_link,
    doc_id % {corpus.INVALID_EVERY} = {corpus.INVALID_EVERY - 1} AS invalid
  FROM documents
)"""

_BLOCKS = _values(
    "blocks",
    "language, v, k, functions, types, methods, template, masked",
    [
        ", ".join(
            [
                _text(language),
                str(v),
                str(len(blocks)),
                str(sum(c == S.FUNCTION for c, _, _ in b.declares)),
                str(sum(c == S.CLASS_STRUCT for c, _, _ in b.declares)),
                str(sum(
                    kind in ("method_definition", "constructor_declaration")
                    or (kind == "method_declaration" and language == S.JAVA)
                    for _, kind, _ in b.declares
                )),
                _text(b.text),
                _text(b.masked(language in _SCRIPTS)),
            ]
        )
        for language, blocks in corpus.BLOCKS.items()
        for v, b in enumerate(blocks)
    ],
)

_DECLARED = _values(
    "declared",
    "language, v, k, seq, category, kind, name",
    [
        ", ".join(
            [_text(language), str(v), str(len(blocks)), str(seq)]
            + [_text(category), _text(kind), _text(name)]
        )
        for language, blocks in corpus.BLOCKS.items()
        for v, b in enumerate(blocks)
        for seq, (category, kind, name) in enumerate(b.declares)
    ],
)

_HEADS = _values(
    "heads",
    "language, head, masked",
    [
        f"{_text(l)}, {_text(corpus.strip_marks(h))}, {_text(corpus.Block(h, ()).masked(l in _SCRIPTS))}"
        for l, h in corpus.HEADS.items()
    ],
)

# How often block v of k turns up in n lines.
_TIMES = "((n - v + k - 1) // k)"

_COUNTED = f"""
counted AS (
  SELECT path, language,
    CAST(sum(functions * {_TIMES}) AS BIGINT) AS function_count,
    CAST(sum(types * {_TIMES}) AS BIGINT) AS class_struct_count,
    CAST(sum(methods * {_TIMES}) AS BIGINT) AS method_count
  FROM files JOIN blocks USING (language) WHERE NOT invalid GROUP BY path, language
)"""

_BY_LANGUAGE = """
by_language AS (
  SELECT language, count(*) AS file_count, CAST(sum(function_count) AS BIGINT) AS function_count,
    CAST(sum(class_struct_count) AS BIGINT) AS class_struct_count
  FROM counted GROUP BY language
)"""

_TOTALS = """
totals AS (
  SELECT CAST(coalesce(sum(file_count), 0) AS BIGINT) AS file_count,
    CAST(coalesce(sum(function_count), 0) AS BIGINT) AS function_count,
    CAST(coalesce(sum(class_struct_count), 0) AS BIGINT) AS class_struct_count
  FROM by_language
)"""

_SUMMARY = """
summary AS (
  SELECT row_number() OVER (ORDER BY language) AS position,
    printf('  %-12s %4d functions, %4d structs/classes in %d files',
      language || ':', function_count, class_struct_count, file_count) AS text
  FROM by_language
  UNION ALL SELECT 0, 'Language Summary:'
  UNION ALL SELECT (SELECT count(*) FROM by_language) + 1, ''
  UNION ALL SELECT (SELECT count(*) FROM by_language) + 2,
    printf('Total: %d functions, %d structs/classes in %d files',
      function_count, class_struct_count, file_count) FROM totals
)"""

_PLACED = """
placed AS (
  SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM counted
)"""

_ERRORS = """
errors AS (
  SELECT path, 'IoError' AS error_kind,
    'IO error: Failed to read ' || path || ': stream did not contain valid UTF-8' AS message
  FROM files WHERE invalid AND language IS NOT NULL
)"""


def _sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _extension(path: str) -> str:
    name = f"string_split({path}, '/')[-1]"
    return (
        f"CASE WHEN strpos(substr({name}, 2), '.') > 0 "
        f"THEN lower(string_split({name}, '.')[-1]) END"
    )


_BY_EXTENSION = "CASE extension " + " ".join(
    f"WHEN {_text(e)} THEN {_text(l)}" for e, l in S.EXTENSION_TO_LANGUAGE.items()
) + " END"

_WITH_EXTENSION = f"extended AS (SELECT *, {_extension('path')} AS extension FROM files)"


def _line_template() -> str:
    numbered = "replace(b.template, '{i}', CAST(i AS VARCHAR))"
    quoted = f"replace({numbered}, '{{quoted}}', translate(line, {_text(corpus.QUOTE_CHARACTERS)}, ''))"
    closed = f"replace({quoted}, '{{line_c}}', translate(line, '*/', ''))"
    return f"replace({closed}, '{{line}}', line)"


_LINES = """
numbered AS (
  SELECT doc_id, language, path, n, unnest(range(n)) AS i, unnest(string_split(text, chr(10))) AS line
  FROM files
)"""


def _language_counts(language: str) -> str:
    extension = next(e for l, e in corpus.SLOTS if l == language)
    return f"""WITH {_BLOCKS}, docs AS (
      SELECT 'corpus/d' || doc_id || '{extension}' AS path, {_text(language)} AS language,
        len(string_split(text, chr(10))) AS n FROM documents)
    SELECT path, language, CAST(sum(functions * {_TIMES}) AS BIGINT) AS function_count,
      CAST(sum(types * {_TIMES}) AS BIGINT) AS class_struct_count
    FROM docs JOIN blocks USING (language) GROUP BY path, language"""


def _plain_counts(functions: str, types: str) -> str:
    plain = corpus.PLAIN_EXTENSIONS
    return f"""SELECT
      'corpus/d' || doc_id || {_list(e for _, e in plain)}[doc_id % {len(plain)} + 1] AS path,
      {_list(l for l, _ in plain)}[doc_id % {len(plain)} + 1] AS language,
      CAST({functions} AS BIGINT) AS function_count, CAST({types} AS BIGINT) AS class_struct_count
    FROM documents"""


_N = "len(string_split(text, chr(10)))"

_FILE_JSON = (
    "printf('    {' || chr(10) || '      \"path\": \"%s\",' || chr(10) || '      \"language\": \"%s\",'"
    " || chr(10) || '      \"stats\": {' || chr(10) || '        \"function_count\": %d,' || chr(10)"
    " || '        \"class_struct_count\": %d' || chr(10) || '      }' || chr(10) || '    }',"
    " path, language, function_count, class_struct_count)"
)
_LANGUAGE_JSON = (
    "printf('    \"%s\": {' || chr(10) || '      \"file_count\": %d,' || chr(10)"
    " || '      \"function_count\": %d,' || chr(10) || '      \"class_struct_count\": %d'"
    " || chr(10) || '    }', language, file_count, function_count, class_struct_count)"
)

ORACLES: dict[str, str] = {
    "file_extension": _sql(_FILES, _WITH_EXTENSION, select="SELECT path, extension FROM extended"),
    "detect_by_extension": _sql(
        _FILES, _WITH_EXTENSION,
        select=f"SELECT path, {_BY_EXTENSION} AS extension_language FROM extended",
    ),
    "detect_by_content": _sql(_FILES, select="SELECT path, language AS content_language FROM files"),
    "detect_language": _sql(_FILES, select="SELECT path, language FROM files"),
    "supported_files": _sql(
        _FILES, select="SELECT path, language FROM files WHERE language IS NOT NULL"
    ),
    "source_scan": _sql(
        _FILES, _BLOCKS, _HEADS, _LINES,
        f"""
bodies AS (
  SELECT l.doc_id, string_agg({_line_template()}, '' ORDER BY i) AS body
  FROM numbered l JOIN blocks b ON b.language = l.language AND b.v = l.i % b.k GROUP BY l.doc_id
),
contents AS (
  SELECT f.*, encode(CASE WHEN f.language IS NULL THEN f.text ELSE
      CASE WHEN doc_id % {_SLOTS} = 6 THEN '{corpus.SHEBANG.strip()}' || chr(10) ELSE '' END
      || h.head || b.body END)
      || CASE WHEN invalid THEN '\\xFF\\xFE'::BLOB ELSE ''::BLOB END AS content
  FROM files f LEFT JOIN bodies b USING (doc_id) LEFT JOIN heads h ON h.language = f.language
)""",
        select="""SELECT path, CAST(octet_length(content) AS BIGINT) AS length,
  CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, via_link, md5(content) AS digest FROM contents""",
    ),
    "ignore_filter": _sql(
        _FILES,
        select="SELECT path FROM files WHERE NOT ("
        + " OR ".join(f"contains(path, {_text(p)})" for p in IGNORED) + ")",
    ),
    "depth_filter": _sql(
        _FILES,
        select=f"""SELECT path, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth FROM files
WHERE len(string_split(path, '/')) - 1 <= {MAX_DEPTH}""",
    ),
    "link_filter": _sql(_FILES, select="SELECT path, via_link FROM files WHERE NOT via_link"),
    "utf8_errors": _sql(_FILES, _ERRORS, select="SELECT * FROM errors"),
    "first_error": _sql(
        _FILES, _ERRORS, select="SELECT * FROM errors ORDER BY string_split(path, '/') LIMIT 1"
    ),
    "run_status": _sql(
        _FILES, _ERRORS,
        select="""SELECT
  (SELECT count(*) FROM files WHERE language IS NOT NULL AND NOT invalid) AS file_count,
  (SELECT count(*) FROM errors) AS error_count,
  (SELECT count(*) FROM errors) > 0
    AND (SELECT count(*) FROM files WHERE language IS NOT NULL AND NOT invalid) = 0 AS failed,
  (SELECT message FROM errors ORDER BY string_split(path, '/') LIMIT 1) AS first_error""",
    ),
    "mask_code": _sql(
        _FILES, _BLOCKS, _HEADS, _LINES,
        """
bodies AS (
  SELECT l.doc_id, string_agg(replace(b.masked, '{i}', CAST(i AS VARCHAR)), '' ORDER BY i) AS body
  FROM numbered l JOIN blocks b ON b.language = l.language AND b.v = l.i % b.k GROUP BY l.doc_id
)""",
        select="""SELECT path, md5(h.masked || b.body) AS code_digest
FROM files f JOIN bodies b USING (doc_id) JOIN heads h ON h.language = f.language WHERE NOT invalid""",
    ),
    "rust_counts": _language_counts(S.RUST),
    "go_counts": _language_counts(S.GO),
    "python_counts": _language_counts(S.PYTHON),
    "js_counts": _language_counts(S.JAVASCRIPT),
    "ts_counts": _language_counts(S.TYPESCRIPT),
    "java_counts": _language_counts(S.JAVA),
    "nested_counts": f"""SELECT 'corpus/d' || doc_id || '.js' AS path, 'JavaScript' AS language,
      CAST(2 * {_N} AS BIGINT) AS function_count, CAST(0 AS BIGINT) AS class_struct_count FROM documents""",
    "empty_files": _plain_counts("0", "0"),
    "broken_syntax": _plain_counts("0", "0"),
    "unicode_counts": _plain_counts(_N, _N),
    "declarations": _sql(
        _FILES, _DECLARED, _LINES,
        select="""SELECT l.path, l.language, d.category, d.kind,
  CAST(row_number() OVER (PARTITION BY l.path ORDER BY i, seq) - 1 AS INTEGER) AS ord,
  replace(d.name, '{i}', CAST(i AS VARCHAR)) AS name
FROM numbered l JOIN files f USING (doc_id)
JOIN declared d ON d.language = l.language AND d.v = l.i % d.k WHERE NOT f.invalid""",
    ),
    "methods_exact": _sql(
        _FILES, _BLOCKS, _COUNTED,
        select="""SELECT path, language, method_count FROM counted
WHERE method_count > 0 AND language IN ('JavaScript', 'TypeScript', 'Java')""",
    ),
    "file_stats": _sql(
        _FILES, _BLOCKS, _COUNTED,
        select="SELECT path, language, function_count, class_struct_count FROM counted",
    ),
    "single_file_stats": _sql(
        _FILES, _BLOCKS, _COUNTED,
        select="""SELECT path, 'Analyzing file: ' || path || ' (Language: ' || language || ')' || chr(10)
  || 'Code Statistics:' || chr(10) || 'Functions: ' || function_count || chr(10)
  || 'Classes/Structs: ' || class_struct_count AS text FROM counted""",
    ),
    "one_file_stats": _sql(
        _FILES, _BLOCKS, _COUNTED,
        select="""SELECT path, 'Analyzing file: ' || path || ' (Language: ' || language || ')' || chr(10)
  || 'Code Statistics:' || chr(10) || 'Functions: ' || function_count || chr(10)
  || 'Classes/Structs: ' || class_struct_count AS text
FROM counted WHERE path = (SELECT min(path) FROM counted)""",
    ),
    "language_summary": _sql(
        _FILES, _BLOCKS, _COUNTED, _BY_LANGUAGE,
        select="SELECT *, CAST(row_number() OVER (ORDER BY language) AS INTEGER) AS rank FROM by_language",
    ),
    "totals": _sql(_FILES, _BLOCKS, _COUNTED, _BY_LANGUAGE, _TOTALS, select="SELECT * FROM totals"),
    "summary_with_total": _sql(
        _FILES, _BLOCKS, _COUNTED, _BY_LANGUAGE, _TOTALS,
        select="SELECT * FROM by_language UNION ALL SELECT 'Total', * FROM totals",
    ),
    "files_ordered": _sql(
        _FILES, _BLOCKS, _COUNTED, _PLACED,
        select="SELECT path, language, place AS position FROM placed",
    ),
    "summary_lines": _sql(
        _FILES, _BLOCKS, _COUNTED, _BY_LANGUAGE, _TOTALS, _SUMMARY,
        select="SELECT CAST(position AS BIGINT) AS position, text FROM summary",
    ),
    "detail_lines": _sql(
        _FILES, _BLOCKS, _COUNTED, _BY_LANGUAGE, _TOTALS, _SUMMARY, _PLACED,
        select="""SELECT CAST((place - 1) * 4 + 1 AS BIGINT) AS position, path || ' (' || language || '):' AS text FROM placed
UNION ALL SELECT (place - 1) * 4 + 2, '  Functions: ' || function_count FROM placed
UNION ALL SELECT (place - 1) * 4 + 3, '  Structs/Classes: ' || class_struct_count FROM placed
UNION ALL SELECT (place - 1) * 4 + 4, '' FROM placed
UNION ALL SELECT position + 1 + 4 * (SELECT file_count FROM totals), text FROM summary""",
    ),
    "json_report": _sql(
        _FILES, _BLOCKS, _COUNTED, _BY_LANGUAGE, _TOTALS, _PLACED,
        select=f"""SELECT CAST(place AS BIGINT) AS position,
  {_FILE_JSON} || CASE WHEN place < (SELECT file_count FROM totals) THEN ',' ELSE '' END AS text FROM placed
UNION ALL SELECT 0, '{{' || chr(10) || '  "files": ['
UNION ALL SELECT file_count + 1, '  ],' || chr(10) || '  "total_by_language": {{' || chr(10)
  || (SELECT string_agg({_LANGUAGE_JSON}, ',' || chr(10) ORDER BY language) FROM by_language)
  || chr(10) || '  }},' || chr(10) || '  "total_stats": {{' || chr(10)
  || printf('    "function_count": %d,' || chr(10) || '    "class_struct_count": %d', function_count, class_struct_count)
  || chr(10) || '  }}' || chr(10) || '}}' FROM totals""",
    ),
    "json_roundtrip": _sql(
        _FILES, _BLOCKS, _COUNTED,
        select="SELECT path, language, function_count, class_struct_count FROM counted",
    ),
}

ORACLES["format_choice"] = " UNION ALL ".join(
    f"SELECT '{format}' AS format, {detail} AS detail, position, text FROM ({ORACLES[lines]})"
    for format, detail, lines in (
        ("summary", "false", "summary_lines"), ("summary", "true", "detail_lines"),
        ("detail", "false", "detail_lines"), ("json", "true", "json_report"),
    )
)
# A text file has a line feed after each document.
ORACLES["tree_scan"] = """
    SELECT source, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes,
           CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes_read,
           CAST(2 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS errors
    FROM documents GROUP BY source
"""
