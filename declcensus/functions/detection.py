"""Language from content: a few weighted signs per language over the whole text.

A label needs weight and variety, so that prose, a stray snippet or a very short
file gives none and the extension decides.

A sign is tried only where the text contains one of its marks.  Every match of its
pattern contains one, so that saves time and changes no result, at any size.  The marks
of a batch of texts are looked for at once, and they bound the score of each label: one that
cannot be the best is not scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declcensus.functions import regex as R

MIN_WEIGHT = 3
MIN_SIGNS = 2


@dataclass(frozen=True)
class Sign:
    """A pattern, its weight and the number of signs it stands for; each match has one of ``marks``.

    With ``leads`` a match starts with one of ``marks``, as a word, and ``pattern`` is what follows.
    """

    marks: tuple[str, ...]
    pattern: str
    weight: int
    signs: int
    leads: bool = False

    def ways(self) -> list[tuple[tuple[str, ...], str]]:
        """Marks and pattern of each way to find the sign.

        A pattern that starts with one plain word is searched for by skips; one that starts with
        a choice of words is tried at every place.
        """
        if not self.leads:
            return [(self.marks, self.pattern)]
        return [((m,), rf"{re.escape(m)}(?<=\b{re.escape(m)}){self.pattern}") for m in self.marks]


def _sign(*marks: str, pattern: str, weight: int, signs: int = 1) -> Sign:
    return Sign(marks, pattern, weight, signs)


def _leading(*marks: str, pattern: str, weight: int) -> Sign:
    return Sign(marks, pattern, weight, 1, leads=True)


def _line_start(word: str) -> str:
    """``word`` at the start of a line; the literal leads, so the matcher can skip."""
    # Not in a group: only a pattern that starts with a plain word is searched for by skips.
    return rf"(?m){word}(?<=^{word})"


def _up_to(excluded: str, again: str) -> str:
    """Text without ``excluded``, up to the next line on which ``again`` would start anew.

    Each stretch of a file is read for one start only, so a file of headers that never
    end takes no longer than another.
    """
    return rf"(?:[^{excluded}\n]++|\n(?!{again}))*+"


PYTHON_SIGNS = [
    _sign("python", pattern=r"\A#![^\n]*\bpython", weight=3, signs=2),
    _sign(
        "def",
        pattern=r"(?m)^[ \t]*+(?:async[ \t]++)?+def[ \t]++\w++[ \t]*+" + R.PARENS + r"[^\n:{};]*+:[ \t]*+(?:#.*+)?+$",
        weight=2,
    ),
    _sign(
        "class",
        pattern=r"(?m)class(?<=^[ \t]{0,40}class)[ \t]++\w++[ \t]*+(?:\([^(){};]*+\))?+:[ \t]*+(?:#.*+)?+$",
        weight=2,
    ),
    _sign(
        "import",
        pattern=rf"(?=[fi])(?:{_line_start('from')}[ \t]++[\w.]++[ \t]++import[ \t]"
        rf"|{_line_start('import')}[ \t]++[\w.]++[ \t]*+(?:as[ \t]++\w++[ \t]*+)?+$)",
        weight=2,
    ),
    _sign("self", pattern=r"def[ \t]++\w++\(self\b", weight=1),
    _sign("__name__", pattern=r"(?m)^if[ \t]++__name__[ \t]*+==", weight=2),
    _sign(
        "else", "elif", "except", "try",
        pattern=r"(?m)^[ \t]++(?:elif\b[^\n{};]*+|except\b[^\n{};]*+|else[ \t]*+|try[ \t]*+):[ \t]*+$",
        weight=1,
    ),
    _sign("return", pattern=r"(?m)^[ \t]++return\b[^;{}\n]*+$", weight=1),
    _sign("print", pattern=r"(?m)^[ \t]*+print\([^;\n]*+$", weight=1),
]

RUST_SIGNS = [
    _sign("fn", pattern=rf"fn(?<=\bfn)\s++\w++\s*+(?:{R.ANGLES})?+\s*+{R.PARENS}[^{{}}();]*+\{{", weight=2),
    _sign("use", pattern=r"(?m)^[ \t]*+(?:pub\s++)?+use\s++\w++(?:::|;)", weight=2),
    _sign("impl", pattern=r"(?m)^[ \t]*+(?:unsafe\s++)?+impl\b" + _up_to(r";{}()=", r"[ \t]*+(?:unsafe\s++)?+impl\b") + r"\{", weight=2),
    _sign("let mut", pattern=r"let mut(?<=\blet mut)\s++\w", weight=2),
    _leading(
        "println!", "eprintln!", "format!", "vec!", "assert!", "assert_eq!", "panic!", "write!", "writeln!", "matches!",
        pattern=r"\s?[(\[{]",
        weight=2,
    ),
    _sign("mod", pattern=r"(?m)^[ \t]*+(?:pub\s++)?+mod\s++\w++\s*+[;{]", weight=2),
    _sign("#[", "#![", pattern=r"(?m)^\s*+#!?\[\w", weight=2),
    _sign(
        "->",
        pattern=r"->\s*+(?:Self\b|Result<|Option<|[iu](?:8|16|32|64|128|size)\b|&|String\b|bool\b|Vec<|Box<)",
        weight=1,
    ),
    _sign(
        "struct", "enum", "trait",
        pattern=r"(?m)^[ \t]*+(?:pub(?:\([^)]*+\))?+\s++)?+(?:struct|enum|trait)\s++\w++"
        + _up_to(r";{}()=", r"[ \t]*+(?:pub\b|struct\b|enum\b|trait\b)") + r"[{;(]",
        weight=1,
    ),
    _sign("&", pattern=r"&mut\s|&self\b|&'\w|&str\b", weight=1),
    _sign("let", pattern=r"let(?<=\blet)\s++\w++(?:\s*+:\s*+[\w<>&]++)?+\s*+=[^=]", weight=1),
]

GO_SIGNS = [
    _sign("package", pattern=rf"(?m){_line_start('package')}\s++\w++[ \t]*+(?://.*+)?+$", weight=2),
    _sign("func", pattern=rf"{_line_start('func')}\s++(?:\([^()]*+\)\s*+)?+\w++\s*+[(\[]", weight=2),
    _sign(
        "type",
        pattern=r"(?m)type(?<=^[ \t]{0,40}type)\s++\w++(?:\[[^\]\n]*+\])?+\s++(?:struct|interface|func)\b",
        weight=2,
    ),
    _sign(
        "import",
        pattern=rf"(?m){_line_start('import')}\s++(?:\(|\"[^\"\n]++\"[ \t]*+$)",
        weight=2,
    ),
    _sign(":=", pattern=r":=(?<=\w\s{0,4}:=)\s", weight=1),
    _leading(
        "fmt.", "strings.", "errors.", "http.", "context.", "sync.",
        pattern=r"[A-Z]\w",
        weight=1,
    ),
]

JAVA_SIGNS = [
    _sign("package", pattern=rf"{_line_start('package')}\s++[\w.]++;", weight=2),
    _sign(
        "import",
        pattern=rf"{_line_start('import')}\s++(?:static\s++)?+\w++(?:\.\w++)++(?:\.\*)?+;",
        weight=2,
    ),
    _leading(
        "public", "protected", "private",
        pattern=r"\s++(?:(?:static|final|abstract|synchronized)\s++)*+"
        r"(?!async\b|get\b|set\b|readonly\b|class\b|function\b|override\b)"
        r"[\w.]++(?:" + R.ANGLES + r")?+(?:\[\])*+\s++\w++\s*+\(",
        weight=2,
    ),
    _leading(
        "public", "protected", "private",
        pattern=r"\s++(?:(?:static|final|abstract)\s++)*+class\s++\w",
        weight=2,
    ),
    _sign("System", pattern=r"System(?<=\bSystem)\.(?:out|err)\.print", weight=2),
    _sign("Override", pattern=r"(?m)^\s*+@Override\b", weight=2),
    _leading(
        "void", "int", "boolean", "long", "double", "String",
        pattern=r"\s++\w++\s*+\([^(){};]*+\)\s*+[{;]",
        weight=2,
    ),
    _sign(
        "class", "interface",
        pattern=r"(?m)^\s*+(?:(?:public|abstract|final)\s++)*+(?:class|interface)\s++\w++"
        + _up_to(r";{}()=:", r"\s*+(?:public\b|abstract\b|final\b|class\b|interface\b)") + r"\{",
        weight=1,
    ),
    _sign("String", pattern=r"String(?<=\bString)\[\]\s++\w", weight=1),
]

SCRIPT_SIGNS = [
    _sign(
        "function",
        pattern=r"(?m)^[ \t]*+(?:export\s++(?:default\s++)?+)?+(?:async\s++)?+function\b\s*+\*?+\s*+\w*+\s*+(?:<[^>(]*+>)?+\(",
        weight=2,
    ),
    _leading(
        "const", "let", "var",
        pattern=r"\s++(?:\w++|\{[^{}]*+\}|\[[^\[\]]*+\])\s*+(?::[^=;{}\n]*+)?+=(?!=)",
        weight=2,
    ),
    _sign("=>", pattern=r"=>(?<=\)\s{0,4}=>)|=\s*+(?:async\s++)?+\w++\s*+=>|\(\w++\s*+=>", weight=1),
    _sign("console", pattern=r"console(?<=\bconsole)\.(?:log|error|warn|info)\(", weight=2),
    _sign(
        "export",
        pattern=rf"{_line_start('export')}\s++(?:default|const|function|class|async|interface|type|\{{|\*)",
        weight=2,
    ),
    _sign(
        "import",
        pattern=rf"{_line_start('import')}\s++(?:[\w{{*](?:(?!\sfrom\s)[^;\"'\n]|\n(?!from\s|import\b))*+\sfrom\s++)?+[\"'][^\"'\n]++[\"']",
        weight=2,
    ),
    _sign("require", pattern=r"require(?<=\brequire)\([\"']", weight=2),
    _sign("exports", pattern=r"module(?<=\bmodule)\.exports\b", weight=2),
    _sign("===", pattern=r"===(?<=[^=!]===)[^=]", weight=1),
    _sign(
        "class",
        pattern=r"(?m)^\s*+(?:export\s++(?:default\s++)?+)?+class\s++\w++(?:\s++extends\s++[\w.]++)?+\s*+\{",
        weight=1,
    ),
    _sign("return", pattern=r"return(?<=\breturn)\s*+\(?\s*+<[A-Za-z]", weight=1),
    _sign("constructor", pattern=r"(?m)^\s*+constructor\([^()]*+\)\s*+\{", weight=1),
]

_TYPES = ("string", "number", "boolean", "any", "unknown", "never")

TYPED_SIGNS = [
    _sign(
        "interface",
        pattern=r"(?m)^\s*+(?:export\s++)?+(?:declare\s++)?+interface\s++\w++"
        + _up_to("{};", r"\s*+(?:export\b|declare\b|interface\b)") + r"\{\s*+(?:readonly\s++)?+\w++\??[:(]",
        weight=2,
    ),
    # A parameter, a result, a member or a variable with a built-in type.
    _sign(
        *_TYPES,
        pattern=rf"\(\s*+\w++\??\s*+:\s*+(?:{'|'.join(_TYPES)})(?:\[\])*+\s*+[,)=|]",
        weight=2,
    ),
    _sign(
        *_TYPES, "void", "Promise",
        pattern=rf"\)\s*+:\s*+(?:(?:{'|'.join(_TYPES)}|void)(?:\[\])*+\s*+(?:[{{;|]|=>)|Promise<)",
        weight=2,
    ),
    _sign(
        *_TYPES,
        pattern=rf"(?m)^\s++(?:(?:private|public|protected|readonly|static)\s++)*+\w++[?!]?+:\s*+(?:{'|'.join(_TYPES)})(?:\[\])*+;",
        weight=2,
    ),
    _leading(
        "const", "let", "var",
        pattern=r"\s++\w++\s*+:\s*+\w[\w.<>\[\], |]*+=[^=]",
        weight=2,
    ),
    _sign(
        "type",
        pattern=r"(?m)^\s*+(?:export\s++)?+type\s++\w++(?:<[^>=]*+>)?+\s*+=\s*+[{(|\"'\[]",
        weight=2,
    ),
    _leading(
        "private", "public", "protected", "readonly",
        pattern=r"\s++(?:(?:static|readonly|async)\s++)*+\w++\??\s*+:\s*+\w",
        weight=1,
    ),
    _sign(
        "as",
        pattern=r"as(?<=\bas)\s++(?:const|any|unknown|string|number)\s*+[;,)\]}]",
        weight=1,
    ),
    _sign("type", pattern=rf"{_line_start('import')}\s++type\b", weight=2),
]

# Signs of binary data, of marked-up prose that quotes code and of languages outside
# the supported six; one of them vetoes any label.
FOREIGN_SIGNS = [
    _sign(r"\u0000", pattern=r"\x00", weight=1),
    _sign("```", pattern=r"(?m)^[ \t]*+```", weight=1),
    _sign("====", pattern=r"(?m)^={4,}+[ \t]*+$", weight=1),
    _sign("Metadata", pattern=r"\AMetadata-Version: ", weight=1),
    _sign("include", pattern=r"(?m)^[ \t]*+#include[ \t]*+[<\"]", weight=1),
    _sign("php", pattern=r"<\?php", weight=1),
    _sign("using", pattern=rf"{_line_start('using')}\s++[\w.]++;", weight=1),
    _sign("namespace", pattern=r"(?m)^\s*+namespace\s++[\w.:\\]++\s*+[;{]", weight=1),
    _sign(
        "fun",
        pattern=r"(?m)^\s*+(?:(?:private|public|internal|override|suspend|open)\s++)*+fun\s++\w++\s*+[(<]",
        weight=1,
    ),
    _sign("object", pattern=r"(?m)^\s*+object\s++\w++\s++extends\s", weight=1),
    _sign("<", pattern=r"\A\s*+(?i:<!DOCTYPE|<html)", weight=1),
]


_SETS = {
    "go": GO_SIGNS,
    "java": JAVA_SIGNS,
    "javascript": SCRIPT_SIGNS,
    "python": PYTHON_SIGNS,
    "rust": RUST_SIGNS,
    "typescript": TYPED_SIGNS,
}
LABELS = tuple(_SETS)

_PLACES = {m: k for k, m in enumerate(sorted({m for own in (*_SETS.values(), FOREIGN_SIGNS) for s in own for m in s.marks}))}
_MARKS = [m.encode().replace(rb"\u0000", b"\x00") for m in _PLACES]


def _bounds(found: np.ndarray) -> np.ndarray:
    """For each text what the score of each label is at most: that of all signs of which it has a mark."""
    tops = {
        x: sum(found[:, [_PLACES[m] for m in s.marks]].any(axis=1) * (s.weight * 100 + s.signs) for s in signs)
        for x, signs in _SETS.items()
    }
    tops["typescript"] = np.where(tops["typescript"] >= MIN_WEIGHT * 100, tops["typescript"] + tops["javascript"], 0)
    return np.stack([tops[x] for x in LABELS], axis=1)


@F.arrow_udf(T.StructType().add("marks", T.ArrayType(T.BooleanType())).add("tops", T.ArrayType(T.IntegerType())))
def clues(content: pa.Array) -> pa.Array:
    """Which marks a text has, told from its bytes, and a bound for the score of each label."""
    texts = [x.as_py() or b"" for x in content]
    found = np.array([[m in t for m in _MARKS] for t in texts], bool).reshape(len(texts), len(_MARKS))
    tops = _bounds(found).astype(np.int32)
    columns = [
        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        for x in (found, tops)
    ]
    return pa.StructArray.from_arrays(columns, names=["marks", "tops"])


# The expressions below are long sums of small terms; written as SQL text they are
# parsed in one go, where building them call by call takes seconds.  ``text`` is a SQL
# expression, and so is ``marks``, the marks that the text has.


def _found(text: str, sign: Sign, marks: str | None = None) -> str:
    # A raw literal keeps the backslashes; a quote in it is written as its code.
    found = []
    for words, pattern in sign.ways():
        quoted = pattern.replace("'", r"\x27")
        there = " OR ".join(f"get({marks}, {_PLACES[m]})" if marks else f"contains({text}, '{m}')" for m in words)
        found.append(f"(({there}) AND rlike({text}, r'{quoted}'))")
    return f"({' OR '.join(found)})"


def _score(text: str, marks: str, label: str) -> str:
    """Weight and number of the signs of one label found, as one number: weight * 100 + signs."""
    return " + ".join(
        f"CASE WHEN {_found(text, s, marks)} THEN {s.weight * 100 + s.signs} ELSE 0 END" for s in _SETS[label]
    )


def enough(value: Column) -> Column:
    return (value >= MIN_WEIGHT * 100) & (value % 100 >= MIN_SIGNS)


def _foreign(text: str, marks: str) -> Column:
    return F.expr(" OR ".join(_found(text, sign, marks) for sign in FOREIGN_SIGNS))


def _best(text: str, marks: str, tops: str) -> Column:
    """The best ``(score, label)``.  Labels are tried from the highest bound on, and one is scored
    only if its bound reaches the best score so far and has weight enough: else it could
    neither be the best nor be taken for a label.
    """
    totals = {x: f"({_score(text, marks, x)})" for x in LABELS}
    # TypeScript takes the script signs too, once its own have weight enough.
    totals["typescript"] = (
        f"get(transform(array({totals['typescript']}), t -> "
        f"CASE WHEN t >= {MIN_WEIGHT * 100} THEN t + {totals['javascript']} ELSE 0 END), 0)"
    )
    scores = " ".join(f"WHEN '{x}' THEN {totals[x]}" for x in LABELS)
    ranked = ", ".join(f"struct(get({tops}, {k}) AS top, '{x}' AS label)" for k, x in enumerate(LABELS))
    return F.expr(
        f"aggregate(reverse(array_sort(array({ranked}))), struct(0 AS score, '' AS label), (best, x) -> "
        f"CASE WHEN x.top >= greatest({MIN_WEIGHT * 100}, best.score) "
        f"THEN greatest(best, struct(CASE x.label {scores} END AS score, x.label AS label)) ELSE best END)"
    )


def with_label(df: DataFrame, content: str, name: str) -> DataFrame:
    """Add the label with the best score, NULL where the evidence is thin or foreign."""
    text = f"CAST({content} AS STRING)"
    found = df.withColumn("_clues", clues(F.col(content).cast("binary")))
    scored = found.withColumn("_best", _best(text, "_clues.marks", "_clues.tops"))
    label = F.when(enough(F.col("_best.score")) & ~_foreign(text, "_clues.marks"), F.col("_best.label"))
    return scored.withColumn(name, label).drop("_clues", "_best")
