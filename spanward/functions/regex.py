"""Patterns: one meaning in Python and in the JVM, and cheap necessary conditions."""

from __future__ import annotations

import functools
import re
import re._constants as rc
import re._parser as rp

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode meaning of the shorthand classes, spelled out because the JVM reads them as ASCII.
_INSIDE = {"d": r"\p{Nd}", "s": r"\s\x0b\x1c-\x1f\x85\p{Z}", "w": r"\p{L}\p{N}_"}
# The inner class comes first on purpose: it is a bit set, and most characters are in it.
_WORD = r"[[A-Za-z0-9_]\p{L}\p{N}]"
_BORDERS = {
    r"\b": f"(?<!{_WORD}(?={_WORD}))(?:(?<={_WORD})|(?={_WORD}))",  # not both, but one: inside words one look is enough
    r"\B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
}
# A border next to a character known to be inside (True) or outside (False) a word has one side left to look at.
_BEFORE_KNOWN = {(r"\b", True): f"(?<!{_WORD})", (r"\b", False): f"(?<={_WORD})", (r"\B", True): f"(?<={_WORD})", (r"\B", False): f"(?<!{_WORD})"}
_AFTER_KNOWN = {key: look.replace("(?<", "(?") for key, look in _BEFORE_KNOWN.items()}


def _char_kind(code: int) -> bool:
    return chr(code).isalnum() or code == ord("_")


def _set_kind(members) -> bool | None:
    """Are all characters of a class inside words (True), all outside (False), or neither?"""
    kinds = set()
    for op, arg in members:
        if op is rc.LITERAL:
            kinds.add(_char_kind(arg))
        elif op is rc.RANGE and arg[1] - arg[0] < 512:
            kinds |= {_char_kind(c) for c in range(arg[0], arg[1] + 1)}
        elif op is rc.CATEGORY and arg in (rc.CATEGORY_DIGIT, rc.CATEGORY_WORD):
            kinds.add(True)
        elif op is rc.CATEGORY and arg is rc.CATEGORY_SPACE:
            kinds.add(False)
        else:
            return None
    return kinds.pop() if len(kinds) == 1 else None


def _edge_kind(items: list, beyond: bool | None, last: bool) -> bool | None:
    """Kind of the first (or last) character of whatever ``items`` match, ``beyond`` of what stands behind them."""
    if not items:
        return beyond
    (op, arg), rest = (items[-1], items[:-1]) if last else (items[0], items[1:])
    if op is rc.LITERAL:
        return _char_kind(arg)
    if op is rc.IN:
        return _set_kind(arg)
    if op is rc.AT:
        return _edge_kind(rest, beyond, last)
    if op is rc.SUBPATTERN and not arg[1] and not arg[2]:
        return _edge_kind(rest + list(arg[3]) if last else list(arg[3]) + rest, beyond, last)
    if op is rc.BRANCH:
        kinds = {_edge_kind(rest + list(b) if last else list(b) + rest, beyond, last) for b in arg[1]}
        return kinds.pop() if len(kinds) == 1 else None
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        kind = _edge_kind(list(arg[2]), None, last)
        return kind if arg[0] or kind == _edge_kind(rest, beyond, last) else None
    return None


def _border_kinds(items: list, before: bool | None, after: bool | None) -> list[tuple[bool | None, bool | None]]:
    """For each border, in order, the kinds of the characters on its sides."""
    out = []
    for i, (op, arg) in enumerate(items):
        sides = _edge_kind(items[:i], before, True), _edge_kind(items[i + 1 :], after, False)
        if op is rc.AT and arg in (rc.AT_BOUNDARY, rc.AT_NON_BOUNDARY):
            out.append(sides)
        elif op is rc.SUBPATTERN:
            out += _border_kinds(list(arg[3]), *(sides if not arg[1] and not arg[2] else (None, None)))
        elif op is rc.BRANCH:
            out += [x for b in arg[1] for x in _border_kinds(list(b), *sides)]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            out += _border_kinds(list(arg[2]), None, None)
        elif op in (rc.ASSERT, rc.ASSERT_NOT):
            out += _border_kinds(list(arg[1]), None, None)
    return out


def _borders(pattern: str, wanted: list[str]) -> list[str]:
    """What each border of ``wanted`` becomes: one look at the unknown side where the other is known."""
    try:
        kinds = _border_kinds(list(rp.parse(pattern)), None, None)
    except re.error:
        kinds = []
    if len(kinds) != len(wanted):  # the parser has merged some
        return [_BORDERS[b] for b in wanted]
    return [
        _BEFORE_KNOWN[b, after] if after is not None else _AFTER_KNOWN[b, before] if before is not None else _BORDERS[b]
        for b, (before, after) in zip(wanted, kinds)
    ]


@functools.lru_cache(maxsize=None)
def jvm_pattern(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """Rewrite a Python pattern for ``rlike``/``split``/``regexp_extract_all``.

    ``\\b`` and ``\\B`` are written out, since what they mean depends on the JVM; next to a class that lies inside or
    outside of words only the other side is looked at. Only a line feed ends a line.
    """
    out, in_class, lines, borders = [], False, False, []
    for token in re.findall(r"\\.|\(\?P<|.", pattern, re.DOTALL):
        kind = token[1:].lower() if token[0] == "\\" else ""
        if kind in _INSIDE:
            body = _INSIDE[kind]
            if token[1].isupper():
                out.append(f"[^{body}]")
            else:
                out.append(body if in_class else f"[{body}]")
        elif token in _BORDERS and not in_class:
            borders.append((len(out), token))
            out.append("")
        elif token == r"\Z":
            out.append(r"\z")
        elif token == "(?P<":
            out.append("(?<")
        elif token == "[":
            out.append(r"\[" if in_class else "[")
            in_class = True
        elif token == "]" and in_class and out[-1] not in ("[", "^"):
            in_class = False
            out.append("]")
        elif token == "&" and in_class:
            out.append(r"\&")
        else:
            lines = lines or (token in ".$^" and not in_class)
            out.append(token)
    for (at, _), look in zip(borders, _borders(pattern, [b for _, b in borders])):
        out[at] = look
    flags = ("iu" if ignore_case else "") + ("s" if dotall else "") + ("d" if lines else "")
    return (f"(?{flags})" if flags else "") + "".join(out)


def full_pattern(pattern: str) -> str:
    """Pattern that must cover the whole value (a trailing newline is not forgiven)."""
    return rf"\A(?:{jvm_pattern(pattern)})\z"


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _literals(seq) -> list[str] | None:
    options: list[list[str]] = []
    run = ""
    for op, arg in list(seq) + [(None, None)]:
        if op is rc.LITERAL:
            run += chr(arg)
            continue
        if op is rc.AT:
            continue
        if run:
            options.append([run])
            run = ""
        if op is rc.BRANCH:
            parts = [_literals(branch) for branch in arg[1]]
            if all(parts):
                options.append([lit for part in parts for lit in part])
        elif op is rc.SUBPATTERN:
            options.append(_literals(arg[3]) or [])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            options.append(_literals(arg[2]) or [])
    options = [o for o in options if o]
    if not options:
        return None
    return max(options, key=lambda o: (min(map(len, o)), -len(o)))


@functools.lru_cache(maxsize=None)
def required_literals(pattern: str, ignore_case: bool = False) -> tuple[str, ...] | None:
    """Strings of which every match contains at least one; None if there is no such set."""
    found = _literals(rp.parse(pattern))
    if not found:
        return None
    return tuple(sorted({f.lower() if ignore_case else f for f in found}))


def _class_source(members) -> str | None:
    """A class of the JVM with these members; None for one with exclusions."""
    out = []
    for op, arg in members:
        if op is rc.LITERAL:
            out.append(f"\\x{{{arg:x}}}")
        elif op is rc.RANGE:
            out.append(f"\\x{{{arg[0]:x}}}-\\x{{{arg[1]:x}}}")
        elif op is rc.CATEGORY and arg in _CATEGORIES:
            out.append(_INSIDE[_CATEGORIES[arg]])
        else:
            return None
    return "[" + "".join(out) + "]"


_CATEGORIES = {rc.CATEGORY_DIGIT: "d", rc.CATEGORY_WORD: "w", rc.CATEGORY_SPACE: "s"}


def _runs(seq) -> list[tuple[int, str]]:
    out = []
    for op, arg in seq:
        if op is rc.SUBPATTERN and not arg[1] and not arg[2]:
            out += _runs(arg[3])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            inner = list(arg[2])
            source = _class_source(inner[0][1]) if len(inner) == 1 and inner[0][0] is rc.IN else None
            if source:
                out.append((arg[0], source))
            out += _runs(inner)
    return out


@functools.lru_cache(maxsize=None)
def required_run(pattern: str) -> str | None:
    """The longest run of one class that every match holds, from where such a run begins; None below four characters."""
    longest = max(_runs(rp.parse(pattern)), default=(0, ""), key=lambda r: r[0])
    size, members = longest
    return f"(?<!{members}){members}{{{size}}}" if size >= 4 else None


def sql_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folded_sql(text: str) -> str:
    """Lower case, with the letters that case-insensitive matching treats as i, s and k."""
    return f"lower(translate({text}, '\u0130\u0131\u017f\u212a', 'iisk'))"


def may_match_sql(text: str, pattern: str, ignore_case: bool = False) -> str:
    """False only where ``pattern`` cannot match: a byte search or one for a run of a class, far cheaper than the regex.

    With ``ignore_case``, ``text`` must already be folded.
    """
    literals, run = required_literals(pattern, ignore_case), None if ignore_case else required_run(pattern)
    tests = ["(" + " OR ".join(f"contains({text}, {sql_literal(x)})" for x in literals) + ")"] if literals else []
    tests += [f"{text} RLIKE {sql_literal(run)}"] if run else []
    return "(" + " AND ".join(tests) + ")" if tests else "true"


def found_sql(text: str, low: str, pattern: str) -> str:
    """Case-insensitive search over line breaks, behind the literal test."""
    return f"{may_match_sql(low, pattern, True)} AND {text} RLIKE {sql_literal(jvm_pattern(pattern, True, True))}"


_SPACE = "[" + _INSIDE["s"] + "]"
NOT_SPACE = "[^" + _INSIDE["s"] + "]"


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def words(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, f"{_SPACE}+", -1), lambda w: w != "")
