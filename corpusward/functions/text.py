"""Text helpers as column expressions: trimming, folding, entropy, match positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Blanks removed at both ends of a line (every Unicode blank plus the four separators).
BLANKS = ('\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        '
          '        　')

_BLOCK = 512  # matches folded per inner step, see `match_positions`


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit('"\''))


def fold_case(text: Column) -> Column:
    """Lower-case form under which every case-insensitive match contains its plain words.

    Three letters fold to ASCII only by way of upper case, so they are mapped first.
    """
    rare = F.contains(text, F.lit('İ')) | F.contains(text, F.lit('ı')) | F.contains(text, F.lit('ſ'))
    return F.lower(F.when(rare, F.translate(text, 'İıſ', 'iis')).otherwise(text))


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('\n'), F.lit('')))


def py_slice(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of the text; empty when the range is empty."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def head(text: Column, n: int) -> Column:
    return F.substr(text, F.lit(1), F.lit(n))


def shannon_entropy(text: Column) -> Column:
    """Bits per character over code points 0-255; the full length is the denominator.

    Characters are folded in code-point order so that sums repeat to the last bit.
    """
    size = F.length(text)
    latin = F.array_sort(F.filter(F.array_distinct(F.split(text, '')),
                                  lambda c: (c != '') & F.ascii(c).between(0, 255)))
    terms = F.transform(latin, lambda c: (size - F.length(F.replace(text, c, F.lit('')))) / size)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log(2.0, p))
    return F.when(size == 0, F.lit(0.0)).otherwise(total)


def base64_text(candidate: Column) -> Column:
    """Decoded text of a strict base64 string if it is printable UTF-8, else null."""
    decoded = F.try_to_binary(candidate, F.lit('base64')).cast('string')
    printable = F.is_valid_utf8(decoded) & ~F.rlike(decoded, F.lit(r'[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]'))
    return F.when(printable, decoded)


def gaps_before(content: Column, regex: Column, matches: Column) -> Column:
    """One step per match: its text, with sizes of the gap before it and of itself.

    Splitting at a rule gives exactly the texts between its matches, but for an
    empty match at the very beginning, which splits nothing off.
    """
    parts = F.element_at(F.transform(F.array(F.split(content, regex, -1)), lambda p: F.when(
        F.size(p) <= F.size(matches), F.concat(F.array(F.lit('')), p)).otherwise(p)), 1)
    gaps = F.slice(parts, F.lit(1), F.size(matches))
    return F.zip_with(gaps, matches, lambda gap, text: F.struct(
        text.alias('match'),
        F.length(gap).alias('gap_len'), F.length(text).alias('text_len'),
        count_newlines(gap).alias('gap_nl'), count_newlines(text).alias('text_nl'),
        F.length(F.substring_index(gap, '\n', -1)).alias('gap_tail'),
        F.length(F.substring_index(text, '\n', -1)).alias('text_tail')))


def match_positions(steps: Column) -> Column:
    """array<struct<match, start, line, col>> from the steps of `gaps_before`.

    ``start`` and ``col`` are 0-based character offsets in the file and in the
    line, ``line`` is 1-based.  A running fold in blocks: the array built so far is
    copied once per block and not once per match, so large files stay cheap.
    """
    spot = 'array<struct<match:string,start:int,line:int,col:int>>'
    start_state = F.struct(F.lit(0).alias('pos'), F.lit(1).alias('line'), F.lit(0).alias('col'),
                           F.array().cast(spot).alias('out'))

    def advance(state: Column, step: Column) -> Column:
        pos = state['pos'] + step['gap_len']
        line = state['line'] + step['gap_nl']
        col = F.when(step['gap_nl'] > 0, step['gap_tail']).otherwise(state['col'] + step['gap_tail'])
        here = F.struct(step['match'].alias('match'), pos.alias('start'), line.alias('line'), col.alias('col'))
        return F.struct(
            (pos + step['text_len']).alias('pos'),
            (line + step['text_nl']).alias('line'),
            F.when(step['text_nl'] > 0, step['text_tail']).otherwise(col + step['text_tail']).alias('col'),
            F.concat(state['out'], F.array(here)).alias('out'))

    def advance_block(state: Column, block: Column) -> Column:
        fresh = F.struct(state['pos'].alias('pos'), state['line'].alias('line'), state['col'].alias('col'),
                         F.array().cast(spot).alias('out'))
        return F.aggregate(block, fresh, advance, lambda s: F.struct(
            s['pos'].alias('pos'), s['line'].alias('line'), s['col'].alias('col'),
            F.concat(state['out'], s['out']).alias('out')))

    # A one-element array binds the steps to a name, so they are evaluated once.
    blocks = F.transform(F.array(steps), lambda all_steps: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / _BLOCK).cast('int')),
        lambda b: F.slice(all_steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    return F.aggregate(F.element_at(blocks, 1), start_state, advance_block, lambda s: s['out'])
