import re

from pyspark.sql import functions as F

from corpusward.catalog import FAMILIES, LEGACY_FAMILIES, family_rules, legacy_rule_catalog, rule_catalog
from corpusward.functions.regex import java_regex, sql_text
from corpusward.functions.text import fold_case
from corpusward.operators.scan import needed_words
from corpusward.plans.corpus import code_corpus, table

from .conftest import MEDIUM

RULES = [r for f in FAMILIES for r in family_rules(f)] + family_rules('script_refs')
LEGACY = [r for f in LEGACY_FAMILIES for r in family_rules(f, 'legacy')]

TRICKY = [
    'naïve_key = "?prénom=été&âge=3" x&ümlaut=1',
    'émail: joé@exämple.io, a.b+c@corp.io; ٣.1.2.3 10.20.30.40 v1.2.3.4.5',
    'PASSWORD = "sécret1"; paſſword = "abc123"; api_key=\x1c"abcdefghij0123456789"',
    '{a: 1, b: c ? d : e, f} { x:y; z } {{a:b}} { é : 1 }',
    'a1function = b:function (x) { y.innerHTML; z = function () { q.write',
    'x.writeln = function () { a.write } k.outerHTMLfoo : function(){ .write',
    "'\\u00e9?x=1' `a?b=${c}&d` \"/v²/x\" '/v٣/y'",
    '// TODO  //\x0bFIXME /* a\r\nXXX */ // KEY',
    'aws_secret_access_key: "' + 'a1B2' * 10 + '"; eval(location.hash); eval(x, userInput)',
    'var _0xAB = "\\x41\\x42\\x43"; İD = 1; login = "ıtem"',
]


def test_sizes_and_flags(spark):
    assert len([r for f in FAMILIES for r in family_rules(f)]) == 146
    assert [len(family_rules(f, 'legacy')) for f in LEGACY_FAMILIES] == [17, 3, 3, 10, 12]
    rows = {r.label: r for r in rule_catalog(spark).collect()}
    assert rows['JWT Token'].checks_fp and rows['JWT Token'].confidence == 'Medium'
    assert not rows['Vue v-html'].checks_fp and rows['Vue v-html'].confidence == 'High'
    assert rows['React dangerouslySetInnerHTML'].technique == 'Dependency and supply-chain analysis'
    assert rows['document.write()'].technique == 'DOM-based vulnerability analysis'
    assert rows['URL Query Parameter'].last_group == 1 and rows['Query Parameter'].last_group == 2
    assert rows['File Path'].last_group == 1
    assert legacy_rule_catalog(spark).count() == 45


def test_every_rule_matches_as_python_does_and_passes_its_word_test(spark):
    """Same match texts on the corpus, the documents and tricky text, with and without the word test."""
    texts = code_corpus(spark, MEDIUM).select('content').unionByName(
        table(spark, MEDIUM, 'documents').select(F.col('text').alias('content'))).unionByName(
        spark.createDataFrame([(t,) for t in TRICKY], 'content string'))
    rows = texts.select('content', fold_case(F.col('content')).alias('folded')).cache()
    contents = [r.content for r in rows.collect()]
    per_query = 30
    for rules in (RULES, LEGACY):
        unmatched = []
        for at in range(0, len(rules), per_query):
            part = rules[at:at + per_query]
            found = rows.select('content', *[
                F.expr(f'regexp_extract_all(content, {sql_text(r.java)}, 0)').alias(f'm{i}') for i, r in enumerate(part)],
                *[F.expr(needed_words(r)).alias(f'n{i}') for i, r in enumerate(part)]).collect()
            for i, r in enumerate(part):
                pattern = re.compile(r.regex, re.I | re.M)
                total = 0
                for row in found:
                    expected = [m[0] for m in pattern.finditer(row.content)]
                    assert row[f'm{i}'] == expected, (r.label, row.content[:200])
                    assert row[f'n{i}'] or not expected, (r.label, 'lost by its word test')
                    total += len(expected)
                unmatched += [] if total else [r.label]
        assert not unmatched
    rows.unpersist()


def test_object_rule_is_not_exponential(spark):
    text = '{' + ', '.join(f'a{i} ? b : c' for i in range(400)) + ';'
    rule = next(r for r in RULES if r.label == 'Object Parameters')
    frame = spark.createDataFrame([(text,)], 'content string')
    assert frame.select(F.expr(f'regexp_extract_all(content, {sql_text(rule.java)}, 0)')).first()[0] == []


def test_shorthands_are_spelled_out():
    assert java_regex(r'[^\w\s]\d') == '(?iumd)[^' + java_regex(r'[\w]')[8:-1] + java_regex(r'[\s]')[8:-1] + r']\p{Nd}'
