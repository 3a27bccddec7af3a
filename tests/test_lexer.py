"""Nested literals against a lexer that reads one character after another."""

import random

import pytest
from pyspark.sql import functions as F

from corpusward.operators.lexer import _BEFORE_REGEX, blank_nested
from corpusward.operators.scan import scan_files

from .test_scan import texts


def closing(text, at, end, stops='\n'):
    """Place of the character that closes what begins at ``at``, or None."""
    inside_class, i = False, at + 1
    while i < len(text):
        c = text[i]
        if c == '\\' and not (end == '/' and text[i + 1:i + 2] == '\n'):
            if i + 1 >= len(text):
                return None
            i += 2
            continue
        if c in stops or (c == '\\'):
            return None
        if end == '/' and inside_class:
            inside_class = c != ']'
        elif end == '/' and c == '[':
            inside_class = True
        elif c == end:
            return i
        i += 1
    return None


def blanked(text):
    out, i, stack, depth, last = list(text), 0, [], 0, ''

    def wipe(a, b):
        for k in range(a, min(b, len(text))):
            if text[k] != '\n':
                out[k] = ' '

    def template(i):
        """Blank template text from ``i``; the place behind it and whether a placeholder opened."""
        while i < len(text):
            if text[i] == '\\':
                wipe(i, i + 2)
                i += 2
            elif text[i] == '`':
                wipe(i, i + 1)
                return i + 1, False
            elif text[i:i + 2] == '${':
                wipe(i, i + 2)
                return i + 2, True
            else:
                wipe(i, i + 1)
                i += 1
        return i, False

    while i < len(text):
        c, two = text[i], text[i:i + 2]
        word = ''
        if c.isalnum() or c in '_.':
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] in '_.'):
                j += 1
            word, last, i = text[i:j], text[i:j], j
            continue
        if c in '"\'' and closing(text, i, c) is not None:
            end = closing(text, i, c)
            wipe(i, end + 1)
            last, i = 'literal', end + 1
            continue
        resumes = c == '}' and depth == 0 and stack
        if resumes or c == '`' and closing(text, i, '`', '') is not None:
            if resumes:
                depth = stack.pop()
            wipe(i, i + 1)
            i, opened = template(i + 1)
            last = '{' if opened else 'literal'
            if opened:
                stack.append(depth)
                depth = 0
            continue
        if two == '//':
            end = text.find('\n', i)
            end = len(text) if end < 0 else end
            wipe(i, end)
            i = end
            continue
        if two == '/*' and text.find('*/', i + 2) >= 0:
            end = text.find('*/', i + 2) + 2
            wipe(i, end)
            i = end
            continue
        if c == '/' and two != '/*' and last in _BEFORE_REGEX and closing(text, i, '/') is not None:
            end = closing(text, i, '/')
            wipe(i, end + 1)
            last, i = 'literal', end + 1
            continue
        if c == '{':
            depth += 1
        elif c == '}' and depth:
            depth -= 1
        if two == '=>':
            last, i = '=>', i + 2
            continue
        if not c.isspace():
            last = c
        i += 1
    return ''.join(out)


FRAGMENTS = ['`a ${eval(b)} c`', '`${`in ${x} ner`} \\` ${ {a: 1}.a }`', '`it\'s "${f("}")}"`', "/['\"]/g.test(x)", 'x = /a\\/[/"]+b/', 'return /\'/', 'a / b / c',
             '"s\\"t"', "'it'", "don't", '// it\'s\n', '/* " */', '*/*', '{', '}', '(', ')', '=', '=>', ';', '\n', '\\', '$', '${', '`', '/', '[', ']', '</b>', 'é', 'eval(x)',
             '/*', '*/', ' ', 'f(/x"y/)', 'i++ /2', '1', '/ "', "'a\\\nb'"]


@pytest.mark.parametrize('seed', range(3))
def test_blanking_like_one_character_after_another(spark, seed):
    rng = random.Random(seed)
    samples = [''.join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    samples += ['', '\n', '`' * 5, '`${' * 400, '`a${`' * 300 + '}`' * 300, 'x = `${a}`;\n' * 2000]
    rows = spark.createDataFrame(list(enumerate(samples)), 'i int, content string').repartition(8).select('i', blank_nested(F.col('content')).alias('code')).collect()
    for r in rows:
        assert r.code == blanked(samples[r.i]), repr(samples[r.i])


def test_flat_texts_are_blanked_alike(spark):
    from corpusward.operators.sinks import blank_literals
    rows = spark.createDataFrame([(t,) for t in texts(200) if '${' not in t], 'content string')
    both = rows.select(blank_nested(F.col('content')).alias('a'), blank_literals(F.col('content')).alias('b')).collect()
    assert both and all(r.a == r.b for r in both)


def test_calls_in_placeholders_and_after_regular_expressions(files):
    text = 's = `a ${eval(b)} eval(c)`;\nr = /[\'"]/.test(x); document.write(y)\nq = a / b; "eval(z)"; `${`${exec(w)}`}`'
    found = scan_files(files(text), ['sink_calls'], with_text=False).collect()
    assert sorted((r.line, r.match) for r in found) == [(1, 'eval'), (2, 'document.write'), (3, 'exec')]
