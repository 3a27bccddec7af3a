"""Code without its literals where these nest: templates with code in them, and regular expressions.

Every character that can begin or end a literal is a token.  Tokens are folded in
order with the kind of literal they are in and a stack of open braces, one entry
for each template whose placeholder is open; so code in ``${...}`` is code again,
at any depth, and a quote in a regular expression opens no string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import bound

# A token; the group holds it too if what it opens is closed again: on its line for quotes
# and regular expressions, anywhere for templates.
_TOKEN = (r'(["\'`/](?:(?<=")(?=[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+")'
          r"|(?<=')(?=[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+')"
          r'|(?<=`)(?=[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`)'
          r'|(?<=/)(?=[^/\\\n\[]*+(?:(?:\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])[^/\\\n\[]*+)*+/)))'
          r'|["\'`\\/*${}\[\]\n]')
# What stands before a regular expression and not before a division.
_BEFORE_REGEX = ['', '(', ',', '=', ':', '[', '!', '&', '|', '?', '{', '}', ';', '+', '-', '*', '%', '~', '^', '=>', 'return', 'typeof', 'case',
                 'in', 'of', 'void', 'delete', 'throw', 'new', 'else', 'do', 'instanceof', 'yield', 'await']
_REGEX_LIKE = r'(?:[(,=:\[!&|?{};+*%~^-]|=>|\b(?:return|typeof|case|in|of|void|delete|throw|else|do)|^)\s*+/(?![/*>])'
_BLOCK = 256
CODE, DOUBLE, SINGLE, TEMPLATE, LINE, BLOCK, REGEX, CLASS = range(8)


def nests(content: Column) -> Column:
    """Whether a text has anything that single expressions for literals cannot tell apart."""
    return F.contains(content, F.lit('${')) | F.rlike(content, F.lit(_REGEX_LIKE))


def _tokens(found: Column) -> Column:
    """(c, opens, gap, before, next) of every token: the text before it, the last word or sign of that, the next character."""
    def one(c: Column, i: Column) -> Column:
        gap, after = F.get(found['gaps'], i), F.get(found['gaps'], i + 1)
        return F.struct(
            c.alias('c'), (F.get(found['opens'], i) != '').alias('opens'), F.length(gap).alias('gap'),
            F.regexp_extract(gap, r'(=>|[\p{L}\p{N}_.]+|\S)\s*$', 1).alias('before'),
            F.when(F.length(after) == 0, F.coalesce(F.get(found['chars'], i + 1), F.lit(''))).otherwise(F.substr(after, F.lit(1), F.lit(1))).alias('next'))
    return F.transform(found['chars'], one)


def _step(s: Column, t: Column, last_end: Column) -> Column:
    """State after a token.  ``until``: characters before that place are no tokens, ``blank``: they are blanked."""
    at = s['pos'] + t['gap']
    c, mode, nothing = t['c'], s['mode'], F.lit('')
    last = F.when(t['before'] != '', t['before']).otherwise(s['last'])
    live, code = at >= s['until'], mode == CODE
    slash = c == '/'

    # what happens, as a number that the fields below look at
    closes = (((mode == DOUBLE) & (c == '"')) | ((mode == SINGLE) & (c == "'")) | ((mode == TEMPLATE) & (c == '`')) | ((mode == REGEX) & slash))
    act = (F.when(~live, F.lit('skip'))
           .when(code, F.when((c == '"') & t['opens'], F.lit('double')).when((c == "'") & t['opens'], F.lit('single'))
                 .when((c == '`') & t['opens'], F.lit('template'))
                 .when(slash & (t['next'] == '/'), F.lit('line'))
                 .when(slash & (t['next'] == '*') & (at + 4 <= last_end), F.lit('block'))
                 .when(slash & t['opens'] & (t['next'] != '*') & last.isin(_BEFORE_REGEX), F.lit('regex'))
                 .when(c == '{', F.lit('deeper'))
                 .when((c == '}') & (s['depth'] > 0), F.lit('up'))
                 .when((c == '}') & (F.size(s['stack']) > 0), F.lit('resume')).otherwise(F.lit('code')))
           .when(closes, F.lit('close'))
           .when((mode == TEMPLATE) & (c == '$') & (t['next'] == '{'), F.lit('placeholder'))
           .when((c == '\\') & ~mode.isin(LINE, BLOCK), F.lit('escape'))
           .when((mode == LINE) & (c == '\n'), F.lit('line end'))
           .when((mode == BLOCK) & (c == '*') & (t['next'] == '/'), F.lit('block end'))
           .when((mode == REGEX) & (c == '['), F.lit('class'))
           .when((mode == CLASS) & (c == ']'), F.lit('class end')).otherwise(F.lit('inside')))

    def after(a: Column) -> Column:
        opened = F.when(a == 'double', F.lit(DOUBLE)).when(a == 'single', F.lit(SINGLE)).when(a.isin('template', 'resume'), F.lit(TEMPLATE)) \
            .when(a == 'line', F.lit(LINE)).when(a == 'block', F.lit(BLOCK)).when(a.isin('regex', 'class end'), F.lit(REGEX)).when(a == 'class', F.lit(CLASS)) \
            .when(a.isin('close', 'placeholder', 'line end', 'block end'), F.lit(CODE)).otherwise(mode)
        blank_gap = ~code | (s['pos'] < s['blank'])
        blank = (c != '\n') & (~code | (at < s['blank']) | (opened != CODE))
        return F.struct(
            (at + 1).alias('pos'), opened.alias('mode'),
            F.when(a.isin('escape', 'placeholder', 'block', 'block end'), at + 2).otherwise(s['until']).alias('until'),
            F.when(a.isin('placeholder', 'block end'), at + 2).otherwise(s['blank']).alias('blank'),
            F.when(a == 'deeper', s['depth'] + 1).when(a == 'up', s['depth'] - 1).when(a == 'placeholder', F.lit(0))
            .when(a == 'resume', F.element_at(s['stack'], -1)).otherwise(s['depth']).alias('depth'),
            F.when(a == 'placeholder', F.concat(s['stack'], F.array(s['depth'])))
            .when(a == 'resume', F.slice(s['stack'], F.lit(1), F.size(s['stack']) - 1)).otherwise(s['stack']).alias('stack'),
            F.when(a == 'close', F.lit('literal')).when(a == 'placeholder', F.lit('{')).when(a.isin('line', 'block'), last)
            .when(code & live, F.when(c == '\n', last).otherwise(c)).otherwise(F.coalesce(s['last'], nothing)).alias('last'),
            F.concat(s['out'], F.array(F.struct((blank_gap & (t['gap'] > 0)).alias('gap'), blank.alias('c')))).alias('out'))
    return bound(act, after)


_STATE = ('pos', 'mode', 'until', 'blank', 'depth', 'stack', 'last')


def blank_nested(content: Column) -> Column:
    """The text with every literal and comment overwritten by blanks; code in placeholders stays.  Length and lines stay."""
    none = F.array().cast('array<struct<gap: boolean, c: boolean>>')
    start = F.struct(F.lit(0).alias('pos'), F.lit(CODE).alias('mode'), F.lit(0).alias('until'), F.lit(0).alias('blank'), F.lit(0).alias('depth'),
                     F.array().cast('array<int>').alias('stack'), F.lit('').alias('last'), none.alias('out'))

    def code(found: Column) -> Column:
        # no comment is open for good: what begins after the last end of one is none
        last_end = F.length(content) - F.length(F.substring_index(content, '*/', -1))

        def fold(tokens: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / _BLOCK).cast('int')), lambda b: F.slice(tokens, b * _BLOCK + 1, F.lit(_BLOCK)))

            def block(s: Column, part: Column) -> Column:
                fresh = F.struct(*[s[f].alias(f) for f in _STATE], none.alias('out'))
                return F.aggregate(part, fresh, lambda a, t: _step(a, t, last_end), lambda a: F.struct(
                    *[a[f].alias(f) for f in _STATE], F.concat(s['out'], a['out']).alias('out')))
            return F.aggregate(blocks, start, block)

        def written(done: Column) -> Column:
            def one(o: Column, i: Column) -> Column:
                gap, c = F.get(found['gaps'], i), F.get(found['chars'], i)
                return F.concat(F.when(o['gap'], F.repeat(F.lit(' '), F.length(gap))).otherwise(gap), F.when(o['c'], F.lit(' ')).otherwise(c))
            tail = F.element_at(found['gaps'], -1)
            return F.concat(F.array_join(F.transform(done['out'], one), ''),
                            F.when(done['mode'] == CODE, tail).otherwise(F.repeat(F.lit(' '), F.length(tail))))
        return bound(bound(_tokens(found), fold), written)

    found = F.struct(F.regexp_extract_all(content, F.lit(_TOKEN), F.lit(0)).alias('chars'),
                     F.regexp_extract_all(content, F.lit(_TOKEN), F.lit(1)).alias('opens'), F.split(content, _TOKEN, -1).alias('gaps'))
    return bound(found, lambda f: F.when(F.size(f['chars']) == 0, content).otherwise(code(f)))
