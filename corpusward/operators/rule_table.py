"""Thousands of rules from a table, without a word test for each of them.

Every rule is looked for only in files that hold a word which all of its matches
hold.  These words make one expression, a tree of their letters, so one pass over
a file's folded text gives all words in it, whatever their number; the words then
join the rules.  Rules without such a word are tried on every file.
"""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import Rule, custom_rule
from ..catalog.compiler import compiled
from ..functions.text import fold_case
from .dedup import dedup_first_findings
from .scan import EXTRACT_FAMILIES, FILE_KEYS, findings_of, spots_of

#: Rules in one pass over the files; a larger table takes several passes.
BLOCK = 20_000
#: Shorter words are in almost every file; longer ones tell no more.
LEAST, MOST = 3, 24


def word_tree(words: list[str]) -> str:
    """An expression for all of the words at once; none of them may be the beginning of another."""
    def branches(group: list[str], depth: int) -> str:
        if len(group) == 1:
            return _plain(group[0][depth:])
        shared = depth
        while len({w[shared] for w in group}) == 1:
            shared += 1
        by_letter: dict[str, list[str]] = {}
        for w in group:
            by_letter.setdefault(w[shared], []).append(w)
        return _plain(group[0][depth:shared]) + '(?:' + '|'.join(branches(part, shared) for part in by_letter.values()) + ')'
    return branches(sorted(words), 0)


def _plain(text: str) -> str:
    return ''.join(c if c.isalnum() else f'\\x{{{ord(c):x}}}' for c in text)


def lead_words(words: set[str]) -> dict[str, str]:
    """For every word the shortest of the words that it begins with: these can stand in one tree."""
    return {w: next(w[:n] for n in range(1, len(w) + 1) if w[:n] in words) for w in words}


def words_in(folded: Column, words: list[str]) -> Column:
    """Which of the words are in the folded text, overlapping ones too: they are looked for at every place."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f'(?=({word_tree(words)}))'), F.lit(1)))


def read_rules(rules: DataFrame, family: str = 'custom', category: str = 'custom') -> tuple[list[list[Rule]], DataFrame]:
    """Blocks of rules that can run, and rows (family, rule_ord, type, regex, error) for the others.

    ``rules`` has ``regex``, ``label`` and, if wanted, ``flag`` (boolean: strict,
    or string: severity).  Rules are numbered by label and expression; equal rows
    are one rule.  They come to the driver block by block: they are written by
    people and compiled once, files are not.
    """
    columns = ['regex', 'label', *(['flag'] if 'flag' in rules.columns else [])]
    blocks, wrong, block = [], [], []
    rows = rules.select(*columns).distinct().orderBy('label', 'regex', *columns[2:])
    for at, row in enumerate(rows.toLocalIterator()):
        form = compiled(row['regex'])
        if form.error is not None:
            wrong.append((family, at, str(row['label']), row['regex'], form.error))
            continue
        word = form.word[:MOST]
        rule = custom_rule(tuple(v if v is not None else False for v in row) if len(row) == 3 else tuple(row), at, family, category, form)
        block.append(replace(rule, needs=((word,),) if len(word) >= LEAST else ()))
        if len(block) == BLOCK:
            blocks, block = [*blocks, block], []
    table = pa.table(dict(zip(('family', 'rule_ord', 'type', 'regex', 'error'), map(list, zip(*wrong))))) if wrong else None
    schema = 'family string, rule_ord int, type string, regex string, error string'
    spark = rules.sparkSession
    errors = spark.createDataFrame(table.cast(pa.schema([(f, pa.int32() if f == 'rule_ord' else pa.string()) for f in table.column_names]))) \
        if table else spark.createDataFrame([], schema)
    return [*blocks, *([block] if block else [])], errors


def _candidates(files: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """(keys, content, rule): files with the rules whose word they hold."""
    kind = 'struct<ord: int, java: string, groups: int>'
    base = files.where(F.length('content') > 0).select(*keep, 'content')
    words = {r.needs[0][0] for r in rules if r.needs}
    lead, found = lead_words(words), None
    if words:
        table = [(lead[r.needs[0][0]], r.ord, r.java, r.groups) for r in rules if r.needs]
        names = ('word', 'ord', 'java', 'groups')
        by_word = files.sparkSession.createDataFrame(pa.table({n: pa.array(c, k) for n, c, k in zip(
            names, zip(*table), (pa.string(), pa.int32(), pa.string(), pa.int32()))}))  # at most BLOCK rows
        seen = base.withColumn('word', F.explode(words_in(fold_case(F.col('content')), sorted(set(lead.values())))))
        found = seen.join(F.broadcast(by_word), 'word').select(*keep, 'content', F.struct('ord', 'java', 'groups').cast(kind).alias('rule'))
    others = [r for r in rules if not r.needs]
    if others or found is None:
        every = F.array(*[F.struct(F.lit(r.ord).alias('ord'), F.lit(r.java).alias('java'), F.lit(r.groups).alias('groups')) for r in others])
        tried = base.withColumn('rule', F.explode(every.cast(f'array<{kind}>')))
        found = tried if found is None else found.unionByName(tried)
    return found


def scan_rule_table(files: DataFrame, rules: DataFrame, *, family: str = 'custom', category: str = 'custom', context_lines: int = 5,
                    with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """Findings of the rules in the one wide schema, and the error rows of rules that can't run.

    Results are those of ``scan_files`` with the same rules: of equal matches on a
    line under one label the first counts.  That needs a shuffle of the findings,
    left out where all labels differ (and for the families that show a group,
    whose rules have their own keys).
    """
    blocks, errors = read_rules(rules, family, category)
    owners: dict[str, int] = {}
    shared, extracts, parts = False, family in EXTRACT_FAMILIES, []
    for block in blocks or [[]]:
        for r in block:
            shared |= owners.setdefault(r.label, r.ord) != r.ord
        rows = _candidates(files, block, FILE_KEYS)
        java, groups = F.col('rule.java'), F.col('rule.groups')

        def all_of(n: int) -> Column:
            return F.when(groups >= n, F.regexp_extract_all('content', java, F.lit(n)))

        hits = F.struct(F.col('rule.ord').alias('rule_ord'), java.alias('regex'), F.regexp_extract_all('content', java, F.lit(0)).alias('texts'),
                        *([all_of(1).alias('one'), all_of(2).alias('two')] if extracts else []))
        hit = rows.select(*FILE_KEYS, 'content', F.split('content', '\n').alias('lines'), F.lit(family).alias('family'), F.array(hits).alias('hits'))
        located = spots_of(hit.where(F.size(F.get('hits', F.lit(0))['texts']) > 0), F.col('content'), [*FILE_KEYS, 'lines'], extracts)
        parts.append(findings_of(located, {family: block}, context_lines=context_lines, with_text=with_text, own_label_each=True))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return (dedup_first_findings(found) if shared and not extracts else found), errors
