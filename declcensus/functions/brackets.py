"""Brackets of any depth: what follows a bracket's partner, told at its opening.

A pattern cannot count, so whether the bracket after a name is closed, and what comes after
it, is found here for all brackets of a batch of files at once, by sorting them by depth.
The answer is one control character after the opening; the patterns then look at that
character only, whatever the depth, and read each header once.  The work is a few passes
over the text and a sort of its brackets, for any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declcensus import schemas as S

# Set here, after an opening that is closed: a body follows (in a class body: MEMBER), a
# semicolon, or anything.
BODY, END, CLOSED, MEMBER = "\x01", "\x02", "\x03", "\x04"
# Set by patterns before, after an opening: its contents go; the members are elements of an
# annotation type; the members are those of a class; one type per line.
DROP, ANNOTATION, CLASS, GROUP = "\x05", "\x06", "\x07", "\x08"
MARKS = "".join(map(chr, range(1, 9)))

_AT_ONCE = 1 << 16
_KEEPS = np.ones(256, bool)


def _bytes(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


_BLANK = _bytes(" \t\n\r\f\v" + MARKS)
_TOKEN = _bytes("()[]{}<>;=:")
_ROUND, _SQUARE, _CURLY, _ANGLE = "()", "[]", "{}", "<>"


def _is(data: np.ndarray, at: np.ndarray, character: str) -> np.ndarray:
    return data[at] == ord(character)


def _partners(opens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For brackets of one kind in order, by group: the place of each one's partner, or -1."""
    step = np.where(opens, 1, -1)
    depth = np.cumsum(step) + ~opens
    order = np.lexsort((depth, group))  # stable, so in the order of the text
    same = (depth[order][1:] == depth[order][:-1]) & (group[order][1:] == group[order][:-1])
    pair = np.flatnonzero(same & opens[order][:-1] & ~opens[order][1:])
    found = np.full(len(opens), -1)
    found[order[pair]] = order[pair + 1]
    found[order[pair + 1]] = order[pair]
    return found


def _next(stop: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows in order: the next row that is a stop among those with the same keys, or -1."""
    if len(stop) == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort(keys)
    place = np.where(stop[order], np.arange(len(order)), len(order))
    ahead = np.append(np.minimum.accumulate(place[::-1])[::-1][1:], len(order))
    there = ahead < len(order)
    target = order[np.minimum(ahead, len(order) - 1)]
    for k in keys:
        there &= k[target] == k[order]
    found = np.full(len(order), -1)
    found[order[there]] = target[there]
    return found


def _last(mark: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows in order: the last row before that is marked among those with the same keys, or -1."""
    ahead = _next(mark[::-1], *(k[::-1] for k in keys))[::-1]
    return np.where(ahead >= 0, len(mark) - 1 - ahead, -1)


def _skip(data: np.ndarray, at: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """From each place on, the first byte that is not one of ``skipped``."""
    at = at.copy()
    active = np.flatnonzero(skipped[data[at]])
    while len(active):
        at[active] += 1
        active = active[skipped[data[at[active]]]]
    return at


class Texts:
    """Some texts in one, with the brackets, the text of each, and its partner."""

    def __init__(self, texts: list[bytes], languages: list[str | None]) -> None:
        # Two bytes that no text has end each text, so that looking one byte on is always possible.
        self.data = np.frombuffer(b"".join(t + b"\x00\xff" for t in texts), np.uint8)
        self.ends = np.cumsum([len(t) + 2 for t in texts])
        newline = np.zeros(256, bool)
        newline[10] = S.GO in languages
        at = np.flatnonzero((_TOKEN | newline)[self.data])
        self.text = np.searchsorted(self.ends, at, "right")
        self.at, self.kind = at, self.data[at]
        names = np.array([x or "" for x in languages])
        self.language = names[self.text]
        self.partner = np.full(len(at), -1)
        for kind in (_ROUND, _SQUARE, _CURLY):
            own = np.flatnonzero(_bytes(kind)[self.kind])
            pairs = _partners(self.kind[own] == ord(kind[0]), self.text[own])
            self.partner[own] = np.where(pairs >= 0, own[pairs], -1)
        self.opens = _bytes("([{")[self.kind]
        closes = _bytes(")]}")[self.kind]
        depth = np.cumsum(self.opens.astype(int) - closes)
        # The innermost opening around each token: the last one whose inside is at its depth.
        self.inside = self._around(depth)
        self.marks = np.zeros(len(at), np.uint8)
        self.gone = np.zeros(len(self.data) + 1, np.int32)

    def _around(self, depth: np.ndarray) -> np.ndarray:
        outer = depth - self.opens  # a bracket stands at the depth outside of it
        outer[_bytes(")]}")[self.kind]] = depth[_bytes(")]}")[self.kind]]
        opening = np.flatnonzero(self.opens)
        rows = np.concatenate((np.arange(len(depth)), opening))
        level = np.concatenate((outer, depth[opening]))
        place = np.concatenate((2 * np.arange(len(depth)), 2 * opening + 1))
        marked = np.arange(len(rows)) >= len(depth)
        order = np.argsort(place, kind="stable")
        before = _last(marked[order], level[order], self.text[rows[order]])
        found = np.full(len(depth), -1)
        plain = ~marked[order]
        found[rows[order][plain]] = np.where(before[plain] >= 0, rows[order][before[plain]], -1)
        return found

    def _follows(self, at: np.ndarray) -> np.ndarray:
        """The first byte after each place that is not blank."""
        return _skip(self.data, self.at[at] + 1, _BLANK)

    def mark(self) -> None:
        opening = np.flatnonzero((self.kind == ord("(")) & (self.partner >= 0))
        closing = self.partner[opening]
        language = self.language[opening]
        following = self._follows(closing)
        after = self.data[following]
        stop = self._stops()[closing]
        stop_kind = np.where(stop >= 0, self.kind[stop], 0)
        body = after == ord("{")
        typed = (language == S.TYPESCRIPT) & (after == ord(":")) & (stop_kind == ord("{"))
        python = (after == ord(":")) | ((after == ord("-")) & (self.data[following + 1] == ord(">")))
        java = self._java(closing, following)
        around = self.inside[opening]
        within = np.where(around >= 0, self.data[self.at[around] + 1], 0)
        marks = np.full(len(opening), ord(CLOSED), np.uint8)
        script = np.isin(language, (S.JAVASCRIPT, S.TYPESCRIPT))
        marks[script & (body | typed)] = ord(BODY)
        marks[script & (body | typed) & (within == ord(CLASS))] = ord(MEMBER)
        marks[(language == S.RUST) & (stop_kind == ord("{"))] = ord(BODY)
        marks[(language == S.PYTHON) & python] = ord(BODY)
        marks[(language == S.JAVA) & (java == ord("{"))] = ord(BODY)
        marks[(language == S.JAVA) & (java == ord(";"))] = ord(END)
        self.marks[opening] = marks
        self._angles()
        self._squares()
        self._drop(opening[(language == S.JAVA) & (within == ord(ANNOTATION))], whole=True)
        self._member_types(opening, following, within)
        self._drop(np.flatnonzero(self.opens & (self.partner >= 0) & (self.data[self.at + 1] == ord(DROP))))

    def _stops(self) -> np.ndarray:
        """For each closing parenthesis the next token that ends a header, inside the same brackets.

        Rust: a curly bracket or semicolon outside of square brackets.  TypeScript: those or an
        equals sign outside of parentheses.
        """
        found = np.full(len(self.at), -1)
        for language, kind, ends in ((S.RUST, _SQUARE, "{};"), (S.TYPESCRIPT, _ROUND, "{};=")):
            own = self.language == language
            is_open, is_close = (self.kind == ord(kind[0])) & own, (self.kind == ord(kind[1])) & own
            matched = self.partner >= 0
            level = np.cumsum((is_open & matched).astype(int) - (is_close & matched))
            rows = np.flatnonzero(own & (_bytes(ends + "()[]")[self.kind]))
            closer = is_close[rows] & matched[rows]
            # A closing is a stop for what is inside of it; after a closing one looks on outside.
            stop_rows, ask_rows = rows, rows[self.kind[rows] == ord(")")]
            stops = _bytes(ends)[self.kind[rows]] | closer | ((is_open | is_close)[rows] & ~matched[rows])
            everything = np.concatenate((stop_rows, ask_rows))
            place = np.concatenate((2 * stop_rows, 2 * ask_rows + 1))
            depth = np.concatenate((level[stop_rows] + closer, level[ask_rows]))
            is_stop = np.concatenate((stops, np.zeros(len(ask_rows), bool)))
            order = np.argsort(place, kind="stable")
            ahead = _next(is_stop[order], depth[order], self.text[everything[order]])
            asked = order >= len(stop_rows)
            found[everything[order[asked]]] = np.where(ahead[asked] >= 0, everything[order][ahead[asked]], -1)
        return found

    def _java(self, closing: np.ndarray, following: np.ndarray) -> np.ndarray:
        """What ends a header of Java: the byte after the parenthesis, dimensions and exceptions."""
        after = self.data[following].copy()
        dimensions = np.flatnonzero((after == ord("[")) & (self.language[closing] == S.JAVA))
        at = _skip(self.data, following[dimensions], _BLANK | _bytes("[]"))
        after[dimensions] = self.data[at]
        ends = np.flatnonzero(_bytes("{};")[self.kind])
        throws = np.flatnonzero(after == ord("t"))
        throws = throws[self.language[closing[throws]] == S.JAVA]
        start = following[throws].copy()
        start[np.isin(throws, dimensions)] = at[np.isin(dimensions, throws)]
        word = np.stack([self.data[np.minimum(start + k, len(self.data) - 1)] for k in range(7)], axis=1)
        spelled = (word[:, :6] == np.frombuffer(b"throws", np.uint8)).all(axis=1) & _BLANK[word[:, 6]]
        after[throws] = 0
        nearest = np.searchsorted(ends, closing[throws])
        there = spelled & (nearest < len(ends))
        target = ends[nearest[there]]
        same = self.text[target] == self.text[closing[throws[there]]]
        after[throws[there][same]] = self.kind[target[same]]
        return after

    def _passed_on(self, opening: np.ndarray, to: str) -> None:
        """A bracket takes the mark of the opening that its partner is followed by."""
        following = self._follows(self.partner[opening])
        place = np.searchsorted(self.at, following)
        there = _bytes(to)[self.data[following]]
        marks = self.marks[place[there]]
        self.marks[opening[there]] = marks

    def _angles(self) -> None:
        """Type parameters: pairs inside the same bracket and statement, without arrows."""
        before = self.data[np.maximum(self.at - 1, 0)]
        arrow = (self.kind == ord(">")) & ((before == ord("=")) | (before == ord("-")))
        able = np.isin(self.language, (S.RUST, S.JAVASCRIPT, S.TYPESCRIPT))
        rows = np.flatnonzero(able & _bytes("<>;")[self.kind] & ~arrow)
        if len(rows) == 0:
            return
        around = self.inside[rows] * len(self.ends) + self.text[rows]
        order = np.lexsort((rows, around))
        rows, around = rows[order], around[order]
        ended = self.kind[rows] == ord(";")
        fresh = np.concatenate(([False], around[1:] != around[:-1]))
        statement = np.cumsum(fresh | ended)[~ended]
        own = rows[~ended]
        pairs = _partners(self.kind[own] == ord("<"), statement)
        self.partner[own] = np.where(pairs >= 0, own[pairs], -1)
        self._passed_on(own[(pairs >= 0) & (self.kind[own] == ord("<"))], "(")

    def _squares(self) -> None:
        opening = np.flatnonzero((self.kind == ord("[")) & (self.partner >= 0))
        self._passed_on(opening, "(<")
        go = opening[self.language[opening] == S.GO]
        following = self._follows(self.partner[go])
        word = np.stack([self.data[np.minimum(following + k, len(self.data) - 1)] for k in range(6)], axis=1)
        self.marks[go[(word == np.frombuffer(b"struct", np.uint8)).all(axis=1)]] = ord(BODY)

    def _drop(self, opening: np.ndarray, whole: bool = False) -> None:
        start, end = self.at[opening] + 1 - whole, self.at[self.partner[opening]] + whole
        np.add.at(self.gone, start, 1)
        np.add.at(self.gone, end, -1)

    def _member_types(self, opening: np.ndarray, following: np.ndarray, within: np.ndarray) -> None:
        """Function types of class members: after a colon, before an arrow."""
        arrow = (self.data[following] == ord("=")) & (self.data[following + 1] == ord(">"))
        able = (self.language[opening] == S.TYPESCRIPT) & (within == ord(CLASS)) & arrow
        for k in np.flatnonzero(able):
            before = self.at[opening[k]] - 1
            while before > 0 and _BLANK[self.data[before]]:
                before -= 1
            if self.data[before] == ord(":"):
                self._drop(opening[k : k + 1], whole=True)
                self.gone[following[k]] += 1
                self.gone[following[k] + 2] -= 1

    def grouped(self) -> np.ndarray:
        """Where a type of a group of Go types starts."""
        group = (self.kind == ord("(")) & (self.partner >= 0) & (self.data[self.at + 1] == ord(GROUP))
        if not group.any():
            return np.zeros(0, np.int64)
        direct = (self.inside >= 0) & group[self.inside] & _bytes(";\n")[self.kind]
        start = _skip(self.data, self.at[np.flatnonzero(direct | group)] + 1, _BLANK)
        return np.unique(start[self.data[start] != ord(")")])

    def rewritten(self) -> list[bytes]:
        self.mark()
        marked = np.flatnonzero(self.marks)
        groups = self.grouped()
        word = np.frombuffer(b" type ", np.uint8)
        at = np.concatenate((self.at[marked] + 1, np.repeat(groups, len(word))))
        values = np.concatenate((self.marks[marked], np.tile(word, len(groups))))
        keep = np.cumsum(self.gone)[:-1] == 0
        order = np.argsort(at, kind="stable")
        shown = keep[at[order]] | keep[at[order] - 1]
        at, values = at[order][shown], values[order][shown]
        out = np.insert(self.data, at, values)[np.insert(keep, at, True)]
        added = np.searchsorted(at, self.ends, "left")  # none is at the end of a text
        ends = np.concatenate(([0], np.cumsum(keep)))[self.ends] + added
        return [out[s : e - 2].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``_AT_ONCE`` bytes, or one longer text."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + _AT_ONCE, "right")))
        yield start, end
        start = end


def rewrite(texts: list[bytes], languages: list[str | None]) -> list[bytes]:
    return Texts(texts, languages).rewritten() if texts else []


@F.arrow_udf(T.StringType())
def _marked(code: pa.Array, language: pa.Array) -> pa.Array:
    out: list[pa.Array] = []
    raw = code.view(pa.binary())
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in raw], np.int64)
    for start, end in _slices(sizes):
        own = raw.slice(start, end - start).to_pylist()
        there = [k for k, t in enumerate(own) if t]
        names = language.slice(start, end - start).to_pylist()
        for k, t in zip(there, rewrite([own[k] for k in there], [names[k] for k in there]), strict=True):
            own[k] = t
        out.append(pa.array(own, pa.binary()))
    # A view, as text that is not valid UTF-8 goes back as it came.
    return (pa.concat_arrays(out) if out else pa.array([], pa.binary())).view(pa.string())


def marked(code: Column, language: Column) -> Column:
    """``code`` with a mark after each opening bracket that the patterns look at."""
    return _marked(code, language)


def without_marks(code: Column) -> Column:
    return F.when(F.rlike(code, F.lit("[\x01-\x08]")), F.translate(code, MARKS, "")).otherwise(code)
