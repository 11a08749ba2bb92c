"""Declaration matching over masked text, one rule set per language.

``code_only`` takes out the spans in which the language allows look-alikes of a
declaration that are not one (type positions), and says of which brackets the
contents are not declarations (macro arguments, elements of annotation types).
:mod:`brackets` then marks what follows each bracket's partner, to any depth.  The
patterns match each declaration once and consume its keyword and name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from declcensus import schemas as S
from declcensus.functions import brackets as B
from declcensus.functions import regex as R

# An opening that a body follows, once it is closed; one that is closed.
_BODY = f"[{B.BODY}{B.MEMBER}]"
_CLOSED = f"[{B.BODY}-{B.MEMBER}]"

# --- Rust ------------------------------------------------------------------

# Arguments of a macro call are tokens, not items.
_RUST_MACRO = rf"(?<=[\p{{L}}\p{{N}}_])!(?!=)\s*+(?:{R.NAME}\s*+)?+[(\[{{]"
_RUST_NAME = rf"(?:r#)?+{R.NAME}"
_RUST_FN = (
    rf"{R.keyword('fn')}\s++{_RUST_NAME}"
    rf"(?=\s*+[(<]{_BODY})"
)
_RUST_TYPE = rf"{R.keyword('struct', 'enum')}\s++{_RUST_NAME}(?=\s*+(?:[{{(;<]|where\b))"

# --- Go --------------------------------------------------------------------

# Names and a constraint; an array length is one expression.
_GO_PARAMETERS = rf"\[{_BODY}\s*+{R.NAME}(?:\s*+,\s*+{R.NAME})*+\s++(?=[\p{{L}}_~\[(*])(?!\*\s)"
# Inside ``type ( ... )`` each line is a type of its own.
_GO_GROUP = rf"{R.keyword('type')}\s*+\("
_GO_FN = (
    rf"{R.keyword('func')}(?:\s++{R.NAME}(?=[ \t]*+[(\[]{_CLOSED})"
    rf"|\s*+\([^()]*+\)\s*+(?!(?:func|interface|struct|map|chan)\b){R.NAME}(?=[ \t]*+\({_CLOSED}))"
)
_GO_STRUCT = (
    rf"{R.keyword('type')}\s++{R.NAME}"
    rf"(?=\s*+(?:{_GO_PARAMETERS}|struct(?!{R.WORD})))"
)

# --- Python ----------------------------------------------------------------

_PY_LINE = r"(?m:^)[ \t]*+"
_PY_FN = (
    rf"{_PY_LINE}(?:async[ \t]++)?+def[ \t]++{R.NAME}"
    rf"(?=\s*+[(\[]{_BODY})"
)
_PY_CLASS = rf"{_PY_LINE}class[ \t]++{R.NAME}(?=\s*+[:(\[])"

# --- JavaScript and TypeScript ----------------------------------------------

_OPERAND = r"(?<=(?:[=(,:?\[!&|+]|=>|\b(?:return|typeof|yield|await|void|new|delete))[\s\x01-\x08]{0,40}(?:async\s{1,4})?function)"
# ``catch`` is a method name only where it starts a line and its parenthesis follows
# at once; elsewhere it is the clause.
_NOT_A_METHOD = (
    r"(?!(?:if|for|while|switch|with|function|await|super)(?![\p{L}\p{N}_$]))"
    r"(?:(?!catch(?![\p{L}\p{N}_$]))|(?<=\n\s{0,40})(?=catch\())"
)
_METHOD_EDGE = r"(?<![\p{L}\p{N}\p{M}_$.#@])"
_NO_METHOD_AFTER = (
    r"(?<!\b(?:new|function|extends|case|return|await)\s{1,40})(?<!function\s{0,4}\*\s{0,4})"
)
_ANGLES = rf"(?:{R.ANGLES}\s*+)?+"


# In a class body any name is a method's; a number is one wherever a body follows.
_MEMBER = rf"{_METHOD_EDGE}(?:if|for|while|switch|with|catch|await|super)"
_NUMBER = r"\d(?<![\p{L}\p{N}\p{M}_$.)\]]\d)[\w.]*+"


def _script_body(typed: bool) -> str:
    """What follows the parameters of a function that has a body."""
    result = rf"(?::(?:[^{{}};=()]++|{R.PARENS})*+(?:{R.BRACES}\s*+(?=\{{))?+)?+" if typed else ""
    return rf"\s*+{result}\{{"


def _script_method(typed: bool, rest: str) -> str:
    """Method name before ``rest``.

    The look-ahead comes before the long look-behinds: few names have a body after
    them, so the look-behinds are seldom tried.
    """
    context = _NO_METHOD_AFTER + (r"(?<!\?\s{0,8})" if typed else "")
    return (
        rf"{_METHOD_EDGE}(?=#?+{R.DOLLAR_NAME}{rest}){_NOT_A_METHOD}{context}#?+{R.DOLLAR_NAME}"
    )


def _script_patterns(typed: bool) -> tuple[str, str]:
    header = rf"\s*+[(<]{_BODY}"
    function = (
        rf"{R.keyword('function')}(?=\s*+(?:{R.DOLLAR_NAME}|){header})"
        rf"(?:{_OPERAND}\s*+(?:{R.DOLLAR_NAME}\s*+)?+[(<]|\s*+{R.DOLLAR_NAME}|\s*+[(<])"
    )
    method = _script_method(typed, header)
    computed = rf"(?=\[)(?<![\p{{L}}\p{{N}}_$)\]])\[(?={_BODY})"
    member, number = rf"{_MEMBER}(?=\s*+\({B.MEMBER})", rf"{_NUMBER}(?=\s*+\({_BODY})"
    functions = R.any_of(function, "=>", member, method, number, computed)
    types = (
        rf"(?=class\s)(?<![.$=(,:?\[!&|][\s\x01-\x08]{{0,40}})(?<!=>\s{{0,40}})"
        rf"(?<!\b(?:return|extends|abstract|new|typeof|yield|await|of|in)\s{{1,40}})"
        rf"{R.keyword('class')}\s++(?!extends\b|implements\b){R.DOLLAR_NAME}"
    )
    return functions, types


_CLASS_BODY = (
    rf"(?=class[\s{{]){R.keyword('class')}(?:(?!class\b)[^{{}};()]|\([^(){{}};]*+\))*+\{{"
)

_JS_FN, _JS_CLASS = _script_patterns(typed=False)
_TS_FN, _TS_CLASS = _script_patterns(typed=True)

# Type positions of TypeScript, where ``=>`` makes a function type.
_TYPE = rf"(?:[^(){{}}\[\]<>,;=\n]++|=>\s*+|{R.PARENS}|{R.BRACES}|{R.BRACKETS}|{R.ANGLES})"
# A line ends a type unless the next one goes on with it.
_LONG_TYPE = rf"(?:{_TYPE}|\n(?=\s*+[|&?:])|(?<=[|&?:]\s{{0,8}})\n)"
_TS_INTERFACE = (
    rf"(?=[it])(?:{R.keyword('interface')}\s++{R.DOLLAR_NAME}[^{{}};]*+{R.BRACES}"
    rf"|{R.keyword('type')}\s++{R.DOLLAR_NAME}\s*+(?:{R.ANGLES}\s*+)?+=(?![=>])\s*+\|?"
    rf"{_LONG_TYPE}*+)"
)
_TS_ARGUMENTS = rf"(?=<)(?<=[\p{{L}}\p{{N}}_$]){R.ANGLES}(?=\s*+[(\[;,)=>{{|&])"
# An arrow before the name of a built-in type makes a type wherever it stands.
_TS_BUILT_IN = (
    r"=>\s*+(?:void|string|number|boolean|any|unknown|never|bigint|symbol|object)(?![\p{L}\p{N}_$])"
    r"(?![ \t]*+[\p{L}\p{N}_$(.+\-*/])"
)
_TS_CAST = rf"(?=(?:as|satisfies)\s)\b(?:as|satisfies)\s++{R.PARENS}\s*+=>"
_TS_MODIFIER = r"(?:(?:public|private|protected|readonly|override)\s++)*+"
# Parameters are followed one by one from the opening parenthesis, so that the
# same text inside an object literal is left alone.
_TS_PARAMETER = (
    rf"(?=[(,])((?:\(|(?!\A)\G,)\s*+{_TS_MODIFIER}(?:\.\.\.)?+(?:{R.DOLLAR_NAME}|{R.BRACES}|{R.BRACKETS})\??+)"
    rf"(?:\s*+:{_TYPE}++)?+(?=\s*+(?:[,)]|=(?![=>])))"
)
_TS_VARIABLE = (
    rf"(?=[\p{{L}}_$])(?:((?:const|let|var)\s++{R.DOLLAR_NAME}!?+)\s*+:{_LONG_TYPE}++(?=\s*+(?:;|=(?![=>]))|[ \t]*+(?:\n|\z))"
    rf"|((?<![\p{{L}}\p{{N}}_$.])(?={R.DOLLAR_NAME}[?!]?+\s*+:\s*+\()(?<!\?\s{{0,8}}){R.DOLLAR_NAME}[?!]?+)\s*+:\s*+"
    rf"{R.PARENS}\s*+=>{_TYPE}++(?=\s*+(?:;|=(?![=>]))))"
)
_TS_RESULT = (
    rf"(\))\s*+:\s*+{R.PARENS}(?:\s*+=>\s*+"
    rf"(?:[^(){{}}\[\]<>,;=\n]++|{R.BRACKETS}|{R.ANGLES})++(?=\{{|=>)"
    rf"|(?:\[\])*+(?=\s*+(?:=>|\{{)))"
)

# --- Java ------------------------------------------------------------------

_JAVA_ANNOTATION_TYPE = rf"@interface\s++{R.DOLLAR_NAME}\s*+\{{"
# Constants come first in an enum; a mark after its brace keeps the first from looking like
# a constructor.
_JAVA_ENUM = rf"({R.keyword('enum')}\s++{R.DOLLAR_NAME}[^{{}};()]*+\{{)"
_JAVA_MODIFIERS = "(?:public|protected|private)"
_JAVA_NOT_A_TYPE = (
    r"(?:new|return|else|throw|case|yield|do|assert|record|instanceof|public|protected|private)"
)
_JAVA_CONTROL = (
    r"(?!(?:if|for|while|switch|catch|synchronized|try|super|this|return)(?![\p{L}\p{N}_$]))"
)
_JAVA_AFTER = r"\s*+(?:\[\s*\]\s*+)*+(?:throws\s[^{};]*+)?+"
_JAVA_BODY = rf"\s*+\({B.BODY}"
_JAVA_HEADER = rf"\s*+\([{B.BODY}{B.END}]"
_JAVA_NAME = rf"{_JAVA_CONTROL}{R.DOLLAR_NAME}"
# What comes before the name is matched forwards, from its last character on: a
# modifier, a bracket or a semicolon before a constructor, the end of the return
# type before a method.
_JAVA_MODIFIED = rf"(?=p){_JAVA_MODIFIERS}(?<![\p{{L}}\p{{N}}_$]{_JAVA_MODIFIERS})\s++"


def _java_constructor(rest: str) -> str:
    name = rf"{_JAVA_NAME}(?={rest})"
    return R.any_of(
        rf"{_JAVA_MODIFIED}{name}", rf"[}};]\s*+{name}", rf"\{{\s*+{name}"
    )


def _java_method(rest: str) -> str:
    # Most letters have no blank after them, so what stands before is seldom looked at.
    word = rf"[\p{{L}}\p{{N}}_$](?=\s)(?<!(?<![\p{{L}}\p{{N}}_$]){_JAVA_NOT_A_TYPE})"
    return rf"(?:{word}|\]|>(?<=[\p{{L}}\p{{N}}_$\]?>]>))\s++{_JAVA_NAME}(?={rest})"


# After the closing parenthesis of an annotation.
_JAVA_ANNOTATED = rf"\)\s*+{_JAVA_NAME}(?={_JAVA_BODY})"
_JAVA_FN = R.any_of(
    _java_constructor(_JAVA_BODY), _JAVA_ANNOTATED, _java_method(_JAVA_HEADER)
)
_JAVA_TYPE = rf"{R.keyword('class', 'interface')}\s++{R.DOLLAR_NAME}"

def _script_opening(typed: bool, before: str) -> str:
    member, number = rf"{_MEMBER}\s*+\((?={B.MEMBER})", rf"{_NUMBER}\s*+\("
    return R.any_of(member, _script_method(typed, rf"{before}\(") + rf"{before}\(", number)


# The same method rules for matching brackets as rows, in text without other marks than MEMBER: (opening that needs a body, opening that needs a body or a semicolon,
# rest of a header with a body, rest of one without).
METHOD_BRACKETS = {
    S.JAVASCRIPT: (_script_opening(False, r"\s*+"), None, rf"\)(?={_script_body(False)})", None),
    S.TYPESCRIPT: (_script_opening(True, rf"\s*+{_ANGLES}"), None, rf"\)(?={_script_body(True)})", None),
    S.JAVA: (
        R.any_of(_java_constructor(r"\s*+\("), rf"(?<=\))\s*+{_JAVA_NAME}") + r"\s*+\(",
        _java_method(r"\s*+\(") + r"\s*+\(",
        rf"\)(?={_JAVA_AFTER}\{{)",
        rf"\)(?={_JAVA_AFTER};)",
    ),
}

FUNCTION_PATTERNS = {
    S.RUST: _RUST_FN,
    S.GO: _GO_FN,
    S.PYTHON: _PY_FN,
    S.JAVASCRIPT: _JS_FN,
    S.TYPESCRIPT: _TS_FN,
    S.JAVA: _JAVA_FN,
}
TYPE_PATTERNS = {
    S.RUST: _RUST_TYPE,
    S.GO: _GO_STRUCT,
    S.PYTHON: _PY_CLASS,
    S.JAVASCRIPT: _JS_CLASS,
    S.TYPESCRIPT: _TS_CLASS,
    S.JAVA: _JAVA_TYPE,
}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it.

    A column that is named twice inside a branch is computed twice, and one built from such
    columns twice as often again.
    """
    return F.get(F.transform(F.array(value), use), 0)


def _if_contains(text: Column, word: str, use: Callable[[Column], Column]) -> Column:
    return _once(text, lambda t: F.when(F.contains(t, F.lit(word)), use(t)).otherwise(t))


def _strip(text: Column, pattern: str, keep: str = " ") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(keep))


def _even(masked: Column) -> Column:
    """Runs of blanks as one blank or one line feed, so that look-behinds reach over them."""
    return F.regexp_replace(masked, F.lit(r"(?=[ \t\r\f\n])(?:[ \t\r\f]*+(\n)\s*+|[ \t\r\f]{2,}+)"), F.lit("$1 "))


def _strip_types(masked: Column) -> Column:
    """TypeScript text without the type positions that can hold an arrow."""
    text = _strip(masked, _TS_INTERFACE)
    for pattern, keep in (
        (_TS_BUILT_IN, " : T "),
        (_TS_CAST, " "),
        (_TS_ARGUMENTS, " "),
        (_TS_PARAMETER, "$1"),
        (_TS_VARIABLE, "$1$2"),
        (_TS_RESULT, "$1"),
    ):
        text = _strip(text, pattern, keep)
    return text


def _marked_opening(text: Column, pattern: str, mark: str, only_if: str) -> Column:
    return _if_contains(text, only_if, lambda t: _strip(t, pattern, f"$0{mark}"))


def code_only(masked: Column, language: Column) -> Column:
    """Masked text without the spans in which nothing is a declaration, and with marks after
    the openings of brackets that hold no declarations, or those of another kind."""
    return _once(_once(masked, B.without_marks), lambda plain: _code_only(plain, language))


def _code_only(plain: Column, language: Column) -> Column:
    java = _marked_opening(_even(plain), _JAVA_ANNOTATION_TYPE, B.ANNOTATION, "@interface")
    typescript = _if_contains(_even(plain), "=>", _strip_types)
    return (
        F.when(language == S.RUST, _marked_opening(plain, _RUST_MACRO, B.DROP, "!"))
        .when(language == S.GO, _marked_opening(plain, _GO_GROUP, B.GROUP, "type"))
        .when(language == S.PYTHON, _if_contains(plain, "\\", lambda t: _strip(t, r"\\\r?+\n")))
        .when(language == S.TYPESCRIPT, _marked_opening(typescript, _CLASS_BODY, B.CLASS, "class"))
        .when(language == S.JAVA, _if_contains(java, "enum", lambda t: _strip(t, _JAVA_ENUM, "$1@ ")))
        .when(language == S.JAVASCRIPT, _marked_opening(_even(plain), _CLASS_BODY, B.CLASS, "class"))
        .otherwise(plain)
    )


def with_headers(masked: Column, language: Column) -> Column:
    """The text that declarations are matched in."""
    return B.marked(code_only(masked, language), language)


def _count(code: Column, language: Column, patterns: dict[str, str]) -> Column:
    counted = F.when(F.lit(False), F.lit(0))
    for name, pattern in patterns.items():
        counted = counted.when(language == name, F.regexp_count(code, F.lit(pattern)))
    return counted.cast("bigint")


def function_count(code: Column, language: Column) -> Column:
    return _count(code, language, FUNCTION_PATTERNS)


def class_struct_count(code: Column, language: Column) -> Column:
    return _count(code, language, TYPE_PATTERNS)


def declaration_texts(code: Column, language: Column) -> Column:
    """Array of the matched keyword-and-name texts of a file, in source order."""
    found = F.when(F.lit(False), F.array(F.lit("")))
    for name, functions in FUNCTION_PATTERNS.items():
        either = R.any_of(functions, TYPE_PATTERNS[name])
        found = found.when(language == name, F.regexp_extract_all(code, F.lit(either), F.lit(0)))
    return found
