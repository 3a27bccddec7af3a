"""Rules of the user's own against the standard library, expression by expression."""

import random
import re
import warnings

from pyspark.sql import functions as F

from corpusward.catalog import custom_rules, rule_errors
from corpusward.catalog.compiler import compiled
from corpusward.operators.rule_table import lead_words, scan_rule_table, words_in
from corpusward.operators.scan import scan_files

TEXT = 'xxkey=abc;\nkey=ABC\nKey=é1 key=zz;\n\nfoo(bar, baz)\nfoo = "q\\"x" \'y\'\n\t$el.html(a_b) 12.5 v2\nKKey=Kſ\n<a href="x">y</a>\nend'
EXPRESSIONS = [
    r'(?P<k>key)=\w+', r'(?P<q>["\']).*?(?P=q)', r'k{,2}ey=\w+', r'(?<=xx)key=(\w+)', r'key=(\w+)(?=;)', r'(?<!xx)key', r'key(?!=a)', r'end\Z', r'\Axx',
    r'^key', r';$', r'^$', r'\bkey\b', r'\Bey', r'[^\W\d_]+', r'[^\s;]+;', r'[\d.]+', r'[]x-]+', r'[^]a]{2}', r'[a&&b]+', r'(a|b)(c)?', r'(\w)\1', r'(?:ab|cd)+',
    r'(?i:KEY)=(?-i:ABC)', r'(?s)a.b', r'(?s:;.k)', r'(?x) k e y # word', r'(?a)\w+', r'\S+?=', r'x*', r'(?=k)', r'a{2}|b{1,}?|z{0,1}e', r'(?>k|ke)y', r'\w++=', r'\x6bey',
    r'K', r'k', r's', r'\.', r'\$el', r'["\'][^"\'\n]*', r'(foo)\s*(?:\((?P<args>[^)]*)\)|=)', r'\t', r'\\"', r'(?#note)end', r'[\x00-\x1f]', r'é', r'É', '\n', r'}|{']


def in_text(expression):
    with warnings.catch_warnings():
        warnings.simplefilter('ignore')
        return [(TEXT[:m.start()].count('\n') + 1, m) for m in re.finditer(expression, TEXT, re.I | re.M)]


def test_like_the_standard_library(files):
    """Every expression as a rule of its own, in one scan."""
    rules = custom_rules([(e, f'r{i}', True) for i, e in enumerate(EXPRESSIONS)])
    assert len(rules) == len(EXPRESSIONS)
    found = {}
    for r in scan_files(files(TEXT), rules={'custom': rules}, with_text=False).collect():
        found.setdefault(r.type, set()).add((r.line, r.match))
    for i, expression in enumerate(EXPRESSIONS):
        assert found.get(f'r{i}', set()) == {(line, m.group()) for line, m in in_text(expression)}, expression


def test_groups_are_those_in_the_file(files):
    """Path rules show a group, which may depend on what is around the match."""
    grouped = [e for e in EXPRESSIONS if re.compile(e).groups]
    found = {}
    for r in scan_files(files(TEXT), rules={'paths': custom_rules([(e, f'r{i}') for i, e in enumerate(grouped)])}, with_text=False).collect():
        found.setdefault(r.type, set()).add((r.line, r.path))
    for i, expression in enumerate(grouped):
        assert found.get(f'r{i}', set()) == {(line, m.group(1) or '') for line, m in in_text(expression)}, expression


def test_the_second_group_of_endpoint_rules(files):
    expression = r'(foo)\s*(?:\((?P<args>[^)]*)\)|=)'
    found = scan_files(files(TEXT), rules={'endpoints': custom_rules([(expression, 'e')])}, with_text=False).collect()
    assert {(r.line, r.path) for r in found} == {(line, m.group(2) or '') for line, m in in_text(expression)} and len(found) == 2


def test_rules_without_a_group_and_built_in_rules_side_by_side(files):
    from corpusward.catalog import family_rules
    own = custom_rules([(r'/raw/\w+', 'raw'), (r'(?<=go:)(/\w+)', 'go')])
    built_in = [r for r in family_rules('paths') if r.label == 'System Path (Linux)']
    assert built_in and built_in[0].ord > 1
    found = scan_files(files('a /raw/b go:/c "/etc/passwd"'), rules={'paths': own + built_in}, with_text=False).collect()
    assert {(r.type, r.path) for r in found} == {('raw', '/raw/b'), ('go', '/c'), ('System Path (Linux)', '/etc/passwd')}


def test_wrong_rules_fail_alone(spark, files):
    rows = [('[bad', 'Bad', True), (r'ke\w', 'Good', True), ('(a)?(?(1)b|c)', 'Choice'), (None, 'None'), ('a**', 'Twice'), (r'(?<=a+)b', 'Wide'), ('(' * 5000, 'Deep'), ('x{99999999999}', 'Huge')]
    rules = custom_rules(rows)
    assert [(r.ord, r.label) for r in rules] == [(1, 'Good')]
    assert {r.match for r in scan_files(files('key [bad'), rules={'custom': rules}, with_text=False).collect()} == {'key'}
    errors = {r.type: (r.rule_ord, r.error) for r in rule_errors(spark, rows).collect()}
    assert {k: v[0] for k, v in errors.items()} == {'Bad': 0, 'Choice': 2, 'None': 3, 'Twice': 4, 'Wide': 5, 'Deep': 6, 'Huge': 7}
    assert errors['Bad'][1].startswith('unterminated character set') and errors['Choice'][1].startswith('not supported')
    assert scan_files(files('key'), rules={'custom': custom_rules(rows[:1])}, with_text=False).collect() == []
    assert rule_errors(spark, []).collect() == []


def test_words_that_every_match_holds():
    words = {e: compiled(e).word for e in EXPRESSIONS}
    for expression, word in words.items():
        for m in re.finditer(expression, TEXT, re.I | re.M):
            folded = m.group().lower().replace('ſ', 's')
            assert word in folded or not folded, (expression, word)
    assert words[r'(?P<k>key)=\w+'] == 'key' and words[r'(?<=xx)key=(\w+)'] == 'key=' and words[r'(a|b)(c)?'] == ''


# --- rules from a table ---------------------------------------------------------

def table_of(spark, rows):
    return spark.createDataFrame(rows, 'regex string, label string, flag boolean')


def test_a_table_gives_what_a_list_gives(spark, files):
    """Words that begin with or overlap another, rules without a word, shared labels, wrong rules."""
    rows = [(e, f'rule {i % 9}', i % 2 == 0) for i, e in enumerate(EXPRESSIONS)]
    rows += [(r'passw', 'p', True), (r'password\s*=', 'q', True), (r'wordy|sword', 'r', True), (r'ssword', 's', True), (r'PASSWORD', 't', True), ('[bad', 'u', True)]
    texts = [TEXT, 'my PassWord = "pw"; ſsword', '', None, 'nothing', 'words and a passwordpassword=1']
    rows.sort(key=lambda r: (r[1], r[0]))
    want = scan_files(files(*texts), rules={'custom': custom_rules(rows)})
    got, errors = scan_rule_table(files(*texts), table_of(spark, rows + rows[:5]))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100
    assert [(r.type, r.rule_ord) for r in errors.collect()] == [('u', len(rows) - 1)]


def test_groups_of_a_table(spark, files):
    rows = [(e, f'rule {i}', True) for i, e in enumerate(EXPRESSIONS) if '(' in e]
    rows.sort(key=lambda r: (r[1], r[0]))
    want = scan_files(files(TEXT), rules={'paths': custom_rules(rows)}, with_text=False)
    got, _ = scan_rule_table(files(TEXT), table_of(spark, rows), family='paths', category='custom', with_text=False)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 10


def test_words_are_all_found(spark):
    rng = random.Random(3)
    words = sorted({''.join(rng.choice('ab=.') for _ in range(rng.randint(3, 6))) for _ in range(60)})
    lead = lead_words(set(words))
    tree = sorted(set(lead.values()))
    assert not any(a != b and b.startswith(a) for a in tree for b in tree)
    texts = [''.join(rng.choice('ab=.') for _ in range(rng.randint(0, 80))) for _ in range(50)]
    frame = spark.createDataFrame([(t,) for t in texts], 'folded string').select('folded', words_in(F.col('folded'), tree).alias('words'))
    for r in frame.collect():
        assert sorted(r.words) == [w for w in tree if w in r.folded]


def test_many_rules_are_one_expression(spark, files):
    rows = [(f'token_{i}_[0-9]+', f'rule {i}', True) for i in range(5000)]
    text = 'token_77_1 token_4999_2 TOKEN_5000_1 token_4_x'
    got, errors = scan_rule_table(files(text), table_of(spark, rows), with_text=False)
    assert {(r.type, r.match) for r in got.collect()} == {('rule 77', 'token_77_1'), ('rule 4999', 'token_4999_2')}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 'Window' not in plan and errors.count() == 0


def test_no_rules_or_files(spark, files):
    got, errors = scan_rule_table(files('a'), table_of(spark, []))
    assert got.collect() == [] and errors.collect() == []
    got, _ = scan_rule_table(files('a').where('false'), table_of(spark, [('a', 'b', True)]))
    assert got.collect() == []
