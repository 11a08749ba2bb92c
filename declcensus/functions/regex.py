"""Building blocks for the Java regular expressions used by the column functions.

Two rules hold for every pattern built here.  A group is only ever repeated
possessively (``*+``, ``++``): the JVM runs those as a loop, while a greedy
repeat recurses once per round and overflows the stack on a large file.  And a
declaration is matched up to its name only, with the rest of its header checked
by look-ahead, so that declarations inside a parameter list are still seen.
"""

from __future__ import annotations

# Patterns cannot count: in types they follow brackets to this depth.  The brackets of
# headers, macros and groups are followed to any depth by ``brackets``.
NESTING = 24


def balanced(opening: str, closing: str, depth: int = NESTING) -> str:
    """Pattern for a bracketed group whose own kind of bracket is balanced."""
    other = rf"[^\{opening}\{closing}]++"
    group = rf"\{opening}(?:{other})*+\{closing}"
    for _ in range(depth - 1):
        group = rf"\{opening}(?:{other}|{group})*+\{closing}"
    return group


PARENS = balanced("(", ")")
BRACES = balanced("{", "}")
BRACKETS = balanced("[", "]")


def angles(depth: int = 12) -> str:
    """Pattern for ``<...>`` type arguments; arrows inside do not close them."""
    groups = "|".join(balanced(*pair, 12) for pair in ("()", "[]", "{}"))
    inner = rf"[^<>(){{}};=\-\[\]]++|->|=>|[=\-]|{groups}"
    group = rf"<(?:{inner})*+>"
    for _ in range(depth - 1):
        group = rf"<(?:{inner}|{group})*+>"
    return group


ANGLES = angles()

# Letters of any script, so that names are not limited to ASCII.
WORD = r"[\p{L}\p{N}\p{M}_$]"
NAME = r"[\p{L}_][\p{L}\p{N}\p{M}_]*+"
DOLLAR_NAME = r"[\p{L}_$][\p{L}\p{N}\p{M}_$]*+"


def keyword(*words: str) -> str:
    """Pattern for a whole keyword.

    The word comes first and its left boundary is checked afterwards: the
    matcher can then skip ahead on a literal instead of testing a look-behind
    at every character.
    """
    options = "|".join(rf"{w}(?<![\p{{L}}\p{{N}}\p{{M}}_$#.@]{w})" for w in words)
    return rf"(?:{options})(?!{WORD})"


def any_of(*patterns: str) -> str:
    return "(?:" + "|".join(patterns) + ")"


def unrolled(quote: str, multiline: bool = False, close: str | None = None) -> str:
    """Quoted literal with backslash escapes."""
    plain = rf"[^{quote}\\]*+" if multiline else rf"[^{quote}\\\n]*+"
    return rf"{quote}{plain}(?:\\(?s:.){plain})*+{close or quote}"
