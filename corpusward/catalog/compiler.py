"""Rules of the user's own: from the dialect they are written in to the one Spark runs.

A rule is parsed by the standard library, which also says what is wrong with one
that is no expression, and written again from its syntax tree.  What Spark's
dialect cannot say is an error of that rule alone; the others go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as C, _parser

from pyspark.sql import SparkSession

from ..functions.regex import _BLANK, _EDGE, _INNER, _NAME

#: Members of a class, and what is not one, by category.
_UNICODE = {C.CATEGORY_DIGIT: r'\p{Nd}', C.CATEGORY_SPACE: _BLANK, C.CATEGORY_WORD: _NAME}
_ASCII = {C.CATEGORY_DIGIT: '0-9', C.CATEGORY_SPACE: r' \t\n\r\f\x0b', C.CATEGORY_WORD: 'a-zA-Z0-9_'}
_NOT = {C.CATEGORY_NOT_DIGIT: C.CATEGORY_DIGIT, C.CATEGORY_NOT_SPACE: C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD: C.CATEGORY_WORD}
_ASCII_EDGE = r'(?:(?<=[a-zA-Z0-9_])(?![a-zA-Z0-9_])|(?<![a-zA-Z0-9_])(?=[a-zA-Z0-9_]))'
_ASCII_INNER = r'(?:(?<=[a-zA-Z0-9_])(?=[a-zA-Z0-9_])|(?<![a-zA-Z0-9_])(?![a-zA-Z0-9_]))'
_ANY = '(?s:.)'


class CannotSay(ValueError):
    """The expression has no form in the other dialect."""


@dataclass(frozen=True)
class Compiled:
    java: str = ''
    groups: int = 0
    word: str = ''
    error: str | None = None


def _char(code: int) -> str:
    letter = chr(code)
    return letter if letter.isascii() and letter.isalnum() else rf'\x{{{code:x}}}'


def _class(items: Iterable, ascii_only: bool) -> str:
    """A class with these members, or a look-ahead and any character for what is not in it."""
    items, members, members_of = list(items), [], _ASCII if ascii_only else _UNICODE
    negated = bool(items) and items[0][0] is C.NEGATE
    for kind, value in items[negated:]:
        if kind is C.LITERAL:
            members.append(_char(value))
        elif kind is C.RANGE:
            members.append(f'{_char(value[0])}-{_char(value[1])}')
        elif kind is C.CATEGORY and value in members_of:
            members.append(members_of[value])
        elif kind is C.CATEGORY and value in _NOT:
            members.append(f'[^{members_of[_NOT[value]]}]')
        else:
            raise CannotSay(f'{kind} in a class')
    inside = f'[{"".join(members)}]'
    # the negation of a class within a class is not the same in all versions: say it in two steps
    return f'(?:(?!{inside}){_ANY})' if negated else inside


def _written(tree, flags: int) -> str:
    return ''.join(_node(kind, value, flags) for kind, value in tree)


def _node(kind, value, flags: int) -> str:
    ascii_only = bool(flags & re.A)
    if kind is C.LITERAL:
        return _char(value)
    if kind is C.NOT_LITERAL:
        return f'[^{_char(value)}]'
    if kind is C.ANY:
        return _ANY if flags & re.S else r'[^\n]'
    if kind is C.IN:
        return _class(value, ascii_only)
    if kind is C.CATEGORY:
        return _class([(kind, value)], ascii_only)
    if kind is C.BRANCH:
        return '(?:' + '|'.join(_written(part, flags) for part in value[1]) + ')'
    if kind is C.SUBPATTERN:
        group, add, drop, part = value
        inner = (flags | add) & ~drop
        text = _written(part, inner)
        if (inner ^ flags) & (re.I | re.A):
            text = f'(?{_letters(inner)}:{text})'
        return f'({text})' if group else f'(?:{text})'
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, part = value
        times = f'{{{least},{"" if most is C.MAXREPEAT else most}}}'
        return f'(?:{_written(part, flags)}){times}{ {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}[kind]}'
    if kind is C.ATOMIC_GROUP:
        return f'(?>{_written(value, flags)})'
    if kind in (C.ASSERT, C.ASSERT_NOT):
        direction, part = value
        return f'(?{"<" if direction < 0 else ""}{"=" if kind is C.ASSERT else "!"}{_written(part, flags)})'
    if kind is C.AT:
        return {C.AT_BEGINNING: r'(?<![^\n])' if flags & re.M else r'\A', C.AT_BEGINNING_STRING: r'\A',
                C.AT_END: r'(?=\n|\z)' if flags & re.M else r'(?=\n?\z)', C.AT_END_STRING: r'\z',
                C.AT_BOUNDARY: _ASCII_EDGE if ascii_only else _EDGE, C.AT_NON_BOUNDARY: _ASCII_INNER if ascii_only else _INNER}[value]
    if kind is C.GROUPREF:
        return rf'(?:\{value})'
    if kind is C.FAILURE:
        return '(?!)'
    raise CannotSay({C.GROUPREF_EXISTS: 'a choice by whether a group matched'}.get(kind, str(kind).lower()))


def _letters(flags: int) -> str:
    on = ('i' if flags & re.I else '') + ('' if flags & re.A else 'u')
    off = ('' if flags & re.I else 'i') + ('u' if flags & re.A else '')
    return on + (f'-{off}' if off else '')


def _required(tree) -> list[str]:
    """Runs of plain characters, lower-cased, that every match holds."""
    runs, run = [], ''
    for kind, value in tree:
        if kind is C.LITERAL and 32 < value < 127:
            run += chr(value).lower()
            continue
        if kind is C.SUBPATTERN:
            inner = _required(value[3])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _required(value[2])
        elif kind is C.ATOMIC_GROUP:
            inner = _required(value)
        else:
            inner = []
        # an anchor has no width, but what is on its sides need not touch in the folded text: end the run all the same
        runs += [run, *inner]
        run = ''
    return [r for r in [*runs, run] if r]


def compiled(expression: str | None, flags: int = re.I | re.M) -> Compiled:
    """The rule in Spark's dialect with its number of groups and a word that every match holds ('' if none), or an error."""
    if expression is None:
        return Compiled(error='no expression')
    try:
        tree = _parser.parse(expression, flags)
        re.compile(expression, flags)
        flags = tree.state.flags
        java = f'(?{_letters(flags)})' + _written(tree, flags)
        word = max(_required(tree), key=len, default='')
        groups = tree.state.groups - 1
    except (re.error, CannotSay, RecursionError, OverflowError) as problem:
        return Compiled(error=str(problem) if isinstance(problem, re.error) else f'not supported: {problem}')
    return Compiled(java, groups, word, _refused(java))


def _refused(java: str) -> str | None:
    """What the engine that runs the rule says against it; nothing if no session is there to ask."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as problem:  # the reason of the engine, whatever its kind
        return f'not supported: {str(problem).splitlines()[-1]}'
    return None
