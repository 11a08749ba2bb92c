"""Masking: blank out comments and literals so that only code is left to match.

One left-to-right alternation per language: whichever of comment or literal
starts first wins, as in a lexer.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declcensus import schemas as S
from declcensus.functions import regex as R

_LINE_COMMENT = r"//[^\n]*+"
# A comment that is not closed runs to the end of the file, so each character is read once.
_BLOCK_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
_CHARACTER = r"'(?:[^'\\\n]|\\[^\n][0-9A-Fa-f]*+)'"


def _triple(quote: str) -> str:
    return rf"{quote * 3}(?:[^{quote}\\]++|\\(?s:.)|{quote}(?!{quote * 2}))*+{quote * 3}"


def _template_parts(depth: int = 3) -> tuple[str, str]:
    """(text of a template literal, code inside one of its substitutions)."""
    text = r"(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+"
    literals = rf"{R.unrolled(chr(34))}|{R.unrolled(chr(39))}|{_BLOCK_COMMENT}|{_LINE_COMMENT}"
    code = rf"(?:[^{{}}`\"'/]++|{literals}|[/\"'])*+"
    for _ in range(depth - 1):
        nested = rf"`(?:{text}\$\{{{code}\}})*+{text}`"
        code = rf"(?:[^{{}}`\"'/]++|{literals}|[/\"']|{nested}|\{{{code}\}})*+"
    return text, code


RUST_MASK = R.any_of(
    _LINE_COMMENT,
    _BLOCK_COMMENT,
    r'(?<![\p{L}\p{N}_])[bc]?r(#*+)"(?s:.*?)(?:"\1|\z)',
    R.unrolled('"', multiline=True),
    r"'(?:[^'\\\n]|\\(?:u\{[^}\n]*+\}|x[0-9A-Fa-f]{2}|[^\n]))'",
)
GO_MASK = R.any_of(_LINE_COMMENT, _BLOCK_COMMENT, R.unrolled('"'), "`[^`]*+`", _CHARACTER)
JAVA_MASK = R.any_of(_LINE_COMMENT, _BLOCK_COMMENT, _triple('"'), R.unrolled('"'), _CHARACTER)
PYTHON_MASK = R.any_of(
    _triple('"'), _triple("'"), r"#[^\n]*+", R.unrolled('"'), R.unrolled("'")
)

_TEXT, _CODE = _template_parts()

# A slash starts a pattern literal only where an operand is expected; what says so is put back.
_REGEX_LITERAL = (
    r"((?:[(,=:\[!&|?{;+~^%*\-]|\b(?:return|typeof|case|in|of))\s*+)/(?![*/])"
    r"(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-z]*+"
)

# In text between tags an apostrophe follows a letter, and a URL has its two slashes;
# neither starts a literal or a comment.
_NOT_IN_A_WORD = (
    r"(?:(?<![\p{L}\p{N}_$])|(?<=\b(?:return|case|typeof|in|of|default|from|import|else|await|yield|void)))"
)
_NOT_A_URL = r"(?<!\bhttps?:)"

# Put back: the code of each substitution of a template literal (groups 1, 6), a
# quoted method name (2), the quote of a plain literal (3 to 5), twice, so that an
# operand is left where one was, and what stands before a pattern literal (7).  ``\G`` after a closing brace can only follow a
# substitution: no other alternative ends in a brace.
# What the alternatives without ``\G`` start with: most places are passed by after one look.
_SCRIPT_START = r"(?=[/\"'`(,=:\[!&|?{;+~^%*\-]|(?=[rtcio])\b)"
SCRIPT_MASK = R.any_of(
    rf"\G(?<=\}}){_TEXT}\$\{{({_CODE})\}}",
    rf"\G(?<=\}}){_TEXT}`",
    _SCRIPT_START
    + R.any_of(
        rf"{_NOT_A_URL}//[^\n]*+(?:\n|\z)",
        _BLOCK_COMMENT,
        rf"[\"']({R.DOLLAR_NAME})[^\"'\n]*+[\"'](?=\s*+\([^()]*+\)\s*+\{{)",
        R.unrolled('"', close='(")'),
        _NOT_IN_A_WORD + R.unrolled("'", close="(')"),
        rf"`{_TEXT}(`)",
        rf"`{_TEXT}\$\{{({_CODE})\}}",
        _REGEX_LITERAL,
    ),
)
_SCRIPT_KEEP = "$7 $2 $6 $1 $3$3$4$4$5$5 \n"


def _mask_script(text: Column) -> Column:
    once = F.regexp_replace(text, F.lit(SCRIPT_MASK), F.lit(_SCRIPT_KEEP))
    # The code put back from a substitution has literals of its own.
    twice = F.regexp_replace(once, F.lit(SCRIPT_MASK), F.lit(_SCRIPT_KEEP))
    return F.when(F.contains(text, F.lit("${")), twice).otherwise(once)


# Where a comment of Rust can start, and what keeps it from starting.
_RUST_TOKEN = re.compile(
    r"""//[^\n]*|(?<!\w)[bc]?r(#*)".*?(?:"\1|\Z)|"(?:[^"\\]|\\.)*+"|'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x[0-9A-Fa-f]{2}|[^\n]))'|/\*""",
    re.S,
)
_COMMENT_EDGE = re.compile(r"/\*|\*/")
_NESTED = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*"


def flat_comments(text: str) -> str:
    """Text of Rust with its nested comments made flat: each is read once, to any depth."""
    parts, at = [], 0
    while (token := _RUST_TOKEN.search(text, at)) is not None:
        end = token.end()
        if token.group() != "/*":
            parts.append(text[at:end])
        else:
            depth = 1
            while depth and (edge := _COMMENT_EDGE.search(text, end)) is not None:
                depth += 1 if edge.group() == "/*" else -1
                end = edge.end()
            parts.append(text[at : token.start()] + "/**/")
            end = len(text) if depth else end
        at = end
    return "".join([*parts, text[at:]])


@F.arrow_udf(T.StringType())
def _flat_comments(text: pa.Array) -> pa.Array:
    # Bytes that are not valid UTF-8 go back as they came.
    texts = (t if t is None else t.decode("utf-8", "surrogateescape") for t in text.view(pa.binary()).to_pylist())
    flat = [t if t is None else flat_comments(t).encode("utf-8", "surrogateescape") for t in texts]
    return pa.array(flat, pa.binary()).view(pa.string())


def _mask_rust(text: Column, language: Column) -> Column:
    # Nested comments are rare: only texts with one are sent to Python.
    nested = F.when((language == S.RUST) & F.rlike(text, F.lit(_NESTED)), text)
    return F.regexp_replace(F.coalesce(_flat_comments(nested), text), F.lit(RUST_MASK), F.lit(" "))


def mask(text: Column, language: Column) -> Column:
    """``text`` with comments and literals blanked, by the rules of ``language``."""
    blank = F.lit(" ")
    return (
        F.when(language == S.RUST, _mask_rust(text, language))
        .when(language == S.GO, F.regexp_replace(text, F.lit(GO_MASK), blank))
        .when(language == S.PYTHON, F.regexp_replace(text, F.lit(PYTHON_MASK), blank))
        .when(language == S.JAVA, F.regexp_replace(text, F.lit(JAVA_MASK), blank))
        .when(language.isin(S.JAVASCRIPT, S.TYPESCRIPT), _mask_script(text))
    )
