"""Regular expressions in the dialect Spark runs."""

from __future__ import annotations

import re

# Character classes with the meaning the rules were written for: names are any
# letters and numbers, blanks include the four information separators.
_NAME = r'\p{L}\p{N}_'
_BLANK = r'\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000'
_EDGE = f'(?:(?<=[{_NAME}])(?![{_NAME}])|(?<![{_NAME}])(?=[{_NAME}]))'
_INNER = f'(?:(?<=[{_NAME}])(?=[{_NAME}])|(?<![{_NAME}])(?![{_NAME}]))'
_SHORTHAND = re.compile(r'\\.|\[\^?\]?|\]|&&', re.S)


def java_regex(expression: str, ignore_case: bool = True) -> str:
    """Spark form of a rule: case folding over all letters, anchors at every line, shorthands spelled out.

    Inside a class, an opening bracket and '&&' are plain characters, as in the rule.
    """
    inside = False

    def spell(m: re.Match) -> str:
        nonlocal inside
        token = m.group(0)
        if token[0] == '[' and not inside:
            inside = True
        elif token[0] == '[':
            return token.replace('[', r'\[')
        elif token == '&&':
            return r'&\&' if inside else token
        elif token == ']':
            inside = False
        elif token == r'\W':
            return f'[^{_NAME}]'
        elif token == r'\S':
            return f'[^{_BLANK}]'
        elif token == r'\D':
            return r'\P{Nd}'
        elif token == r'\B':
            return _INNER
        elif token == r'\w':
            return _NAME if inside else f'[{_NAME}]'
        elif token == r'\s':
            return _BLANK if inside else f'[{_BLANK}]'
        elif token == r'\d':
            return r'\p{Nd}'
        elif token == r'\b':
            return _EDGE
        return token

    text = expression.replace('(?i)', '').replace(r'[\s\S]', r'(?s:.)')
    return ('(?iumd)' if ignore_case else '(?d)') + _SHORTHAND.sub(spell, text)


def any_word(words: list[str]) -> str:
    """Expression that finds any of a few plain words (kept as one pattern, so one small plan node)."""
    return '|'.join(r'\Q' + w + r'\E' for w in words)


def sql_text(value: str) -> str:
    """The value as a Spark SQL string literal."""
    return "'" + value.replace('\\', '\\\\').replace("'", "\\'").replace('\n', '\\n') + "'"
