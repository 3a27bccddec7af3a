"""Calls and assignments of risky interfaces, found in code with strings and comments blanked.

Two shapes are matched on the blanked text: a (dotted) name followed by an
opening bracket, and an assignment to a risky property.  Texts with template
placeholders or regular-expression literals go through a lexer.  A deliberate
limit: computed properties are not resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..catalog import Rule, words as W
from ..functions.labels import has_any
from .lexer import blank_nested, nests

# A name, tried only where one starts (else every tail of every word would be tried).
_IDENT = r'[a-zA-Z_$\p{L}\p{Nl}][a-zA-Z0-9_$\p{L}\p{N}\p{M}]*+'
_START = r'(?<![a-zA-Z0-9_$\p{L}\p{N}\p{M}])'
_LITERAL = (r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
            r"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
            r'|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`'
            r'|//[^\n]*+|/\*(?s:.)*?\*/')
CALL = rf'(?:\b(function|new)\s++)?(\.\s*+)?{_START}({_IDENT}(?:\s*+\.\s*+{_IDENT})*+)\s*+\('
ASSIGNMENT = (rf'(?:{_START}(?:{_IDENT}\s*+\.\s*+)++|\.\s*+)({"|".join(W.ASSIGNED_SINKS)})'
              r'\s*+(?:[-+*/%&|^]|\*\*|<<|>>>?|&&|\|\||\?\?)?=(?![=>])')

_TRIGGERS = [row[0] for row in W.RISK_CATALOG]


def blank_literals(content: Column) -> Column:
    """The code with every string and comment overwritten by blanks.

    Length and line breaks stay, so positions hold.  One expression does for
    texts whose literals do not nest.
    """
    parts = F.split(content, _LITERAL, -1)
    literals = F.regexp_extract_all(content, F.lit(_LITERAL), F.lit(0))
    blanked = F.transform(literals, lambda t: F.regexp_replace(t, r'[^\n]', ' '))
    flat = F.array_join(F.zip_with(parts, blanked, lambda a, b: F.concat(a, F.coalesce(b, F.lit('')))), '')
    return F.when(nests(content), blank_nested(content)).otherwise(flat)


def code_of(content: Column, max_chars: int | None = None) -> Column:
    """Blanked code of files that name a risky interface at all (and are not longer than ``max_chars``, if given).

    The two-letter modules are common in other words, so these must be used as one
    (a blank or a comment may stand in between).
    """
    long_names = [t for t in _TRIGGERS if len(t) > 2]
    wanted = F.rlike(content, F.lit(r'(?:fs|vm)\s*+[.(/]'))
    for name in long_names:
        wanted = F.contains(content, F.lit(name.split('.')[0])) | wanted
    if max_chars is not None:
        wanted = (F.length(content) <= max_chars) & wanted
    return F.when(wanted, blank_literals(content)).otherwise(F.lit(''))


def sink_rules() -> list[Rule]:
    shapes = [('call', CALL, ()), ('assignment', ASSIGNMENT, (tuple(s.lower() for s in W.ASSIGNED_SINKS),))]
    return [Rule('sink_calls', 'xss_vulnerabilities', i, label, '', java, None, None, needs)
            for i, (label, java, needs) in enumerate(shapes)]


def triggers(match: Column, rule_ord: Column) -> Column:
    """Catalog entries a match stands for: none, one or two.

    ``obj.m(...)`` stands for ``obj.m`` or else ``obj``, and besides for ``m``.
    """
    def group(regex: str, n: int) -> Column:
        return F.regexp_extract(match, regex, n)

    chain = F.split(F.regexp_replace(group(CALL, 3), r'\s+', ''), r'\.')
    last = F.element_at(chain, -1)
    whole = F.concat_ws('.', chain)
    owner = F.when((F.size(chain) == 2) & (group(CALL, 2) == ''),
                   F.when(whole.isin(_TRIGGERS), whole).when(F.get(chain, F.lit(0)).isin(_TRIGGERS), F.get(chain, F.lit(0))))
    called = F.array_compact(F.array(owner, F.when(last.isin(_TRIGGERS), last)))
    none = F.array().cast('array<string>')
    return (F.when(rule_ord == 1, F.array(group(ASSIGNMENT, 1)))
            .when(group(CALL, 1) != '', none)
            .otherwise(called))


def routed_category(type_: Column, match: Column) -> Column:
    low = F.lower(type_)
    is_sink = has_any(low, ['xss', 'injection']) | match.isin(W.SINK_MATCHES)
    return F.when(is_sink, F.lit('xss_vulnerabilities')).otherwise(F.lit('xss_functions'))


def routed_label(type_: Column, match: Column) -> Column:
    """Extra label of routed rows: risky modules are a 'Dangerous API'."""
    dangerous = F.contains(F.lower(type_), F.lit('dangerous')) | match.isin(W.MODULE_MATCHES)
    is_sink = routed_category(type_, match) == 'xss_vulnerabilities'
    return F.when(~is_sink & dangerous, F.lit('Dangerous API'))
