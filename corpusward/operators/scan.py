"""The core scan: rule x file -> finding rows, in one pass and without a shuffle.

All rules run as literal expressions in one projection over the file text, each
behind a cheap word test.  A file with matches yields one row per rule family;
positions, names, filters and first-wins de-duplication are array expressions
on that row, and only then are findings exploded.  The text itself never leaves
the scan, so later stages move findings and not files.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import (FAMILIES, PATTERN_FAMILIES, Rule, family_rules, risk_catalog,
                       rule_catalog, rules as R, words as W)
from ..functions.filters import (fp_endpoint, fp_path, is_css_value, is_entropy_candidate,
                                 is_false_positive)
from ..functions.labels import has_any
from ..functions.params import is_css_parameter, param_name_value, shown_name
from ..functions.regex import java_regex, sql_text
from ..functions.text import (base64_text, fold_case, gaps_before, head, match_positions, py_slice,
                              shannon_entropy, strip, strip_quotes)
from ..functions.url import is_subdomain, url_directory
from .sinks import code_of, routed_category, routed_label, sink_rules, triggers

FILE_KEYS = ['file_id', 'url']
EXTRACT_FAMILIES = ['endpoints', 'parameters', 'paths', 'script_refs']
SECRET_FAMILIES = ['entropy', 'base64']
ALL_FAMILIES = [*FAMILIES, 'script_refs', *SECRET_FAMILIES, 'sink_calls']

# Order of the families inside a category (rules first, then the added analyses).
_PART = {'ip_addresses': 1, 'entropy': 1, 'base64': 1, 'script_refs': 1, 'sink_calls': 1}


def _secret_rules(family: str) -> list[Rule]:
    category, label, regex = {
        'entropy': ('api_keys', 'High Entropy String', R.ENTROPY_CANDIDATE),
        'base64': ('obfuscation_findings', 'Base64 Encoded Secret', R.BASE64_CANDIDATE),
    }[family]
    return [Rule(family, category, 0, label, regex, java_regex(regex, ignore_case=False), None, None, ())]


def rules_of(family: str) -> list[Rule]:
    if family in SECRET_FAMILIES:
        return _secret_rules(family)
    return sink_rules() if family == 'sink_calls' else family_rules(family)


# --- matches and their positions ----------------------------------------------

def needed_words(rule: Rule, folded: str = 'folded') -> str:
    """Cheap necessary condition of a rule on the folded text, as SQL."""
    groups = [' or '.join(f'contains({folded}, {sql_text(w)})' for w in group) for group in rule.needs]
    if rule.shape:
        groups.append(f'rlike({folded}, {sql_text(rule.shape)})')
    return ' and '.join(f'({g})' for g in groups) or 'true'


def _rule_matches(rules: list[Rule], text: str, with_groups: bool = False) -> str:
    """array<struct<rule_ord, regex, texts[, one, two]>> of the rules with at least one match, as SQL.

    SQL text because it is one expression per family instead of thousands of
    small ones; the patterns are literals, so each is compiled once per task.
    ``one`` and ``two`` are the first groups of rules of the user's own.
    """
    def all_of(r: Rule, group: int) -> str:
        if group > r.groups or group and not r.own:
            return 'cast(null as array<string>)'
        return f'regexp_extract_all({text}, {sql_text(r.java)}, {group})'

    def groups(r: Rule) -> str:
        return f", 'one', {all_of(r, 1)}, 'two', {all_of(r, 2)}" if with_groups else ''

    if not rules:
        return 'cast(null as array<struct<rule_ord: int, regex: string, texts: array<string>>>)'
    hits = [f"if({needed_words(r)}, named_struct('rule_ord', {r.ord}, 'regex', {sql_text(r.java)}, "
            f"'texts', {all_of(r, 0)}{groups(r)}), null)" for r in rules]
    return f"filter(array({', '.join(hits)}), h -> size(h.texts) > 0)"


def locate(files: DataFrame, families: dict[str, list[Rule]], keep: list[str] = FILE_KEYS, with_lines: bool = True) -> DataFrame:
    """One row per file and family with matches.

    Columns: the kept file columns, ``family``, ``lines`` (the text as lines, if
    wanted), ``one_long_line`` and ``spots`` - an array of (rule_ord, regex, match_ord,
    match, start, line, col) in rule, then position order, with the groups one
    and two if any rule is the user's own.
    """
    families = {name: rules for name, rules in families.items() if rules} or dict(list(families.items())[:1])
    with_groups = any(r.own for rules in families.values() for r in rules)
    with_code = 'sink_calls' in families
    base = files.where(F.length('content') > 0).select(*keep, 'content', fold_case(F.col('content')).alias('folded'))
    if with_lines:
        base = base.withColumn('lines', F.split('content', '\n'))
    if with_code:
        base = base.withColumn('code', code_of(F.col('content')))
    text_of = {name: 'code' if name == 'sink_calls' else 'content' for name in families}
    families_with_hits = F.array(*[
        F.struct(F.lit(name).alias('family'), F.expr(_rule_matches(rules, text_of[name], with_groups)).alias('hits'))
        for name, rules in families.items()])
    carried = ['content'] + (['lines'] if with_lines else []) + (['code'] if with_code else [])
    matched = (base.select(*keep, *carried, F.explode(families_with_hits).alias('f'))
               .select(*keep, *carried, F.col('f.family').alias('family'), F.col('f.hits').alias('hits'))
               .where(F.size('hits') > 0))
    text = F.col('content')
    if with_code:
        text = F.when(F.col('family') == 'sink_calls', F.col('code')).otherwise(text)
    return spots_of(matched, text, [*keep, *(['lines'] if with_lines else [])], with_groups)


def spots_of(hits: DataFrame, text: Column, keep: list[str], with_groups: bool) -> DataFrame:
    """Positions of the matches of rows (content, family, hits); see ``locate``."""
    spots = F.flatten(F.transform('hits', lambda h: F.transform(
        match_positions(gaps_before(text, h['regex'], h['texts'])),
        lambda s, i: F.struct(h['rule_ord'].alias('rule_ord'), h['regex'].alias('regex'), i.alias('match_ord'),
                              s['match'].alias('match'), s['start'].alias('start'),
                              s['line'].alias('line'), s['col'].alias('col'),
                              *([F.get(h['one'], i).alias('one'), F.get(h['two'], i).alias('two')] if with_groups else [])))))
    return hits.select(
        *keep, 'family', ((F.instr('content', '\n') == 0) & (F.length('content') > 10000)).alias('one_long_line'),
        spots.alias('spots'))


# --- what a match says, per family ---------------------------------------------

SPOT_FIELDS = ('rule_ord', 'regex', 'match_ord', 'match', 'start', 'line', 'col')


def bind(items: Column, fields: tuple[str, ...], **values) -> Column:
    """Add computed fields to every struct of an array.

    A later step reads the field instead of repeating the expression: array
    functions evaluate an expression as often as it is written.
    """
    return F.transform(items, lambda s: F.struct(
        *[s[f].alias(f) for f in fields], *[value(s).alias(name) for name, value in values.items()]))


def _group(n, rules: list[Rule] = ()) -> callable:
    """Capture group of a match; the match itself for rules of the user's own that have no group.

    No built-in extraction rule looks beyond its match, so the match text alone
    gives the same groups as the whole file.  Groups of other rules were taken
    from the file.
    """
    own, bare = [r.ord for r in rules if r.own and r.groups], [r.ord for r in rules if r.own and not r.groups]

    def of(s: Column) -> Column:
        number = n(s) if callable(n) else F.lit(n)
        found = F.call_function('regexp_extract', s['match'], s['regex'], number)
        if len(own) + len(bare) == len(rules) and rules:
            found = F.lit(None).cast('string')
        if bare:
            found = F.when(s['rule_ord'].isin(bare), s['match']).otherwise(found)
        return F.when(s['rule_ord'].isin(own), F.when(number == 2, s['two']).otherwise(s['one'])).otherwise(found) if own else found
    return of


def _said(spot: Column, *, key: Column, key_rule: Column | int, key_line: Column | int | None = None,
          match: Column | None = None, path: Column | None = None, full: Column | None = None,
          name: Column | None = None, detail: Column | None = None, drop: Column | None = None,
          match_ord: Column | None = None) -> Column:
    """Uniform record of a match; records with equal ``key`` columns are duplicates."""
    def text(c: Column | None) -> Column:
        return (F.lit(None) if c is None else c).cast('string')

    def number(c: Column | int) -> Column:
        return F.lit(c) if isinstance(c, int) else c

    return F.struct(
        number(spot['line'] if key_line is None else key_line).alias('key_line'), number(key_rule).alias('key_rule'),
        text(key).alias('key'), spot['rule_ord'].alias('rule_ord'),
        (spot['match_ord'] if match_ord is None else match_ord).alias('match_ord'),
        spot['line'].alias('line'), spot['start'].alias('start'), spot['col'].alias('col'),
        F.length(spot['match']).alias('size'),
        text(match).alias('match'), text(path).alias('path'), text(full).alias('full_match'),
        text(name).alias('name'), text(detail).alias('detail'),
        F.coalesce(F.lit(False) if drop is None else drop, F.lit(False)).alias('drop'))


def _shared_labels(rules: list[Rule], rule_ord: Column) -> Column:
    """First rule with the same label: rules that share a label share findings."""
    first = {}
    number = None
    for r in rules:
        owner = first.setdefault(r.label, r.ord)
        if owner != r.ord:
            number = (F if number is None else number).when(rule_ord == r.ord, F.lit(owner))
    return rule_ord if number is None else number.otherwise(rule_ord)


def _patterns(spots, rules, own_label_each, **_):
    return F.transform(spots, lambda s: _said(
        s, key=s['match'], key_rule=s['rule_ord'] if own_label_each else _shared_labels(rules, s['rule_ord']), match=s['match']))


def _endpoints(spots, rules, url, filtered, **_):
    second = [r.ord for r in rules if r.groups > 1]
    group = _group(lambda s: F.when(s['rule_ord'].isin(second), F.lit(2)).otherwise(F.lit(1)), rules)
    return F.transform(bind(spots, SPOT_FIELDS, path=group), lambda s: _said(
        s, key=s['path'], key_rule=0, path=s['path'], full=s['match'], detail=s['path'],
        drop=(fp_endpoint(s['path']) | is_subdomain(s['path'], url)) if filtered else None))


def _parameters(spots, rules, **_):
    grouped = [r.ord for r in rules if r.groups]
    second = [r.ord for r in rules if r.last_closed_group >= 2]
    spots = bind(spots, SPOT_FIELDS,
                 one=lambda s: F.when(s['rule_ord'].isin(grouped), _group(1, rules)(s)),
                 two=lambda s: F.when(s['rule_ord'].isin(second), _group(2, rules)(s)))
    spots = bind(spots, SPOT_FIELDS, param=lambda s: param_name_value(
        s['match'], s['one'], s['two'], s['rule_ord'].isin(grouped), s['rule_ord'].isin(second)))
    return F.transform(spots, lambda s: _said(
        s, key=shown_name(s['param']), key_rule=s['rule_ord'], match=s['param']['text'],
        name=shown_name(s['param']), drop=is_css_parameter(s['param'])))


def _paths(spots, rules, **_):
    return F.transform(bind(spots, SPOT_FIELDS, path=_group(1, rules)), lambda s: _said(
        s, key=s['path'], key_rule=s['rule_ord'], path=s['path'], match=s['match'],
        drop=fp_path(s['path']) | is_css_value(s['path'])))


def _scripts(spots, rules, url, **_):
    # every reference counts, so the position is the key
    return F.transform(bind(spots, SPOT_FIELDS, path=_group(1, rules)), lambda s: _said(
        s, key=s['start'], key_rule=0, path=s['path'], match=s['match'], drop=is_subdomain(s['path'], url)))


def _entropy(spots, rules, entropy_threshold, **_):
    return F.transform(bind(spots, SPOT_FIELDS, text=_group(1, rules)), lambda s: _said(
        s, key=s['text'], key_rule=0, key_line=0, match=s['text'],
        drop=~is_entropy_candidate(s['text']) | (shannon_entropy(s['text']) <= entropy_threshold)))


def _base64(spots, **_):
    spots = bind(spots, SPOT_FIELDS, text=lambda s: strip_quotes(s['match']))
    spots = bind(F.filter(spots, lambda s: F.length(s['text']) >= 20), (*SPOT_FIELDS, 'text'),
                 decoded=lambda s: base64_text(s['text']))

    def dull(decoded: Column) -> Column:
        return ~(has_any(F.lower(decoded), W.BASE64_WORDS) | (shannon_entropy(decoded) > W.BASE64_ENTROPY_THRESHOLD))
    return F.transform(F.filter(spots, lambda s: s['decoded'].isNotNull()), lambda s: _said(
        s, key=s['text'], key_rule=0, key_line=0, match=s['text'], detail=s['decoded'],
        drop=dull(s['decoded'])))


def _sinks(spots, **_):
    # one record per catalog entry, in order of their place in the code
    return F.flatten(F.transform(spots, lambda s: F.transform(triggers(s['match'], s['rule_ord']), lambda t, i: _said(
        s, key=F.concat_ws(':', s['start'], i), key_rule=0, match=t, match_ord=s['start'] * 2 + i))))


_SAY = {'endpoints': _endpoints, 'parameters': _parameters, 'paths': _paths, 'script_refs': _scripts,
        'entropy': _entropy, 'base64': _base64, 'sink_calls': _sinks}


# --- lines and context ----------------------------------------------------------

def line_text(lines: Column, line: Column) -> Column:
    return strip(F.element_at(lines, line))


def shortened_line(lines: Column, line: Column) -> Column:
    """The line; beyond 500 characters its first and last 200."""
    text = F.element_at(lines, line)
    cut = F.concat(head(text, 200), F.lit('...'), F.right(text, F.lit(200)))
    return strip(F.when(F.length(text) > 500, cut).otherwise(text))


def context_range(lines: Column, line: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """0-based half-open range of lines around a 1-based line."""
    return F.greatest(F.lit(0), line - before - 1), F.least(F.size(lines), line + after)


def context_text(lines: Column, first: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, end - first), '\n')


def context_snippet(context: Column, start: Column, col: Column, size: Column) -> Column:
    """Contexts over 1000 characters are cut around the match's offset in its line.

    The offset counts from the last newline if that is at most 500 characters
    back, else from the start of the file, and is applied to the context as is.
    """
    offset = F.when(col < 500, col + 1).otherwise(start + 1)
    first = F.greatest(F.lit(0), offset - 200)
    end = F.least(F.length(context), offset + size + 200)
    return F.when(F.length(context) > 1000, py_slice(context, first, end)).otherwise(context)


def _first_of_key(records: str) -> Column:
    """Of the records in key order, the first of every key."""
    def is_first(r, i):
        before = F.get(F.col(records), i - 1)
        same = (before['key_line'] == r['key_line']) & (before['key_rule'] == r['key_rule']) & (before['key'] == r['key'])
        return (i == 0) | ~same
    return F.filter(records, is_first)


# --- the scan -------------------------------------------------------------------

def scan_files(files: DataFrame, families: list[str] = ALL_FAMILIES, *, rules: dict[str, list[Rule]] | None = None,
               context_lines: int = 5, entropy_threshold: float = W.ENTROPY_THRESHOLD,
               filtered: bool = True, with_text: bool = True, shortened: bool = False) -> DataFrame:
    """Findings of the families, in the one wide schema.

    ``rules`` replaces the families by rules of the caller's own.  ``filtered``
    turns the endpoint filters off.  ``with_text=False`` leaves out line text and
    context, for roll-ups that only count or link findings; else they are whole.
    ``shortened`` cuts them for display: lines over 500 and contexts over 1000
    characters, and a file of one line over 10000 has no context.
    """
    rules = {f: [replace(r, family=f) for r in own] for f, own in rules.items()} if rules else {f: rules_of(f) for f in families}
    return findings_of(locate(files, rules, with_lines=with_text), rules, context_lines=context_lines, entropy_threshold=entropy_threshold,
                       filtered=filtered, with_text=with_text, shortened=shortened)


def findings_of(located: DataFrame, rules: dict[str, list[Rule]], *, context_lines: int = 5, entropy_threshold: float = W.ENTROPY_THRESHOLD,
                filtered: bool = True, with_text: bool = True, shortened: bool = False, own_label_each: bool = False) -> DataFrame:
    """Findings from the rows of ``locate``.

    ``own_label_each`` takes every rule's label for its own, where rows hold one
    rule each and equal labels are dealt with later.
    """
    said = F
    for family, own in rules.items():
        said = said.when(F.col('family') == family, _SAY.get(family, _patterns)(
            F.col('spots'), rules=own, own_label_each=own_label_each, url=F.col('url'), entropy_threshold=entropy_threshold, filtered=filtered))
    # Sorted by key, then place; two steps so that the sorted array is computed once.
    records = (located.withColumn('records', F.array_sort(F.filter(said, lambda r: ~r['drop'])))
               .drop('spots')
               .withColumn('records', _first_of_key('records')))
    if with_text:
        records = records.withColumn('stripped', F.transform('lines', strip))
    rows = records.select(*FILE_KEYS, 'family', F.inline(_rows(F.col('records'), context_lines, with_text, shortened)))
    return _describe(rows, rules, entropy_threshold, with_text)


_ROW_FIELDS = ('rule_ord', 'match_ord', 'line', 'match', 'path', 'full_match', 'name', 'detail')


def _rows(records: Column, context_lines: int, with_text: bool, shortened: bool) -> Column:
    """Output structs of the records, with line text and context cut from ``lines``."""
    if not with_text:
        return bind(records, _ROW_FIELDS)
    lines, family = F.col('lines'), F.col('family')
    secret = family.isin(SECRET_FAMILIES)
    pattern = ~family.isin([*EXTRACT_FAMILIES, *SECRET_FAMILIES, 'sink_calls'])
    k = F.when(F.col('one_long_line'), F.lit(0)).otherwise(F.lit(context_lines)) if shortened else F.lit(context_lines)
    before, after = F.when(secret, F.lit(2)).otherwise(k), F.when(secret, F.lit(3)).otherwise(k)
    extent = (*_ROW_FIELDS, 'start', 'col', 'size')
    records = bind(records, extent,
                   first=lambda r: context_range(lines, r['line'], before, after)[0],
                   end=lambda r: context_range(lines, r['line'], before, after)[1])
    # evaluated by the explode, and only values that all findings of a line share are
    # not small: the stripped lines are made once, a finding points to its own
    def around(r: Column) -> Column:
        return context_text(lines, r['first'], r['end'])

    return bind(
        records, _ROW_FIELDS,
        line_content=lambda r: F.when(F.lit(shortened) & pattern, shortened_line(lines, r['line']))
        .when(family != 'sink_calls', F.element_at(F.col('stripped'), r['line'])),
        context=lambda r: F.when(F.lit(shortened) & pattern, context_snippet(around(r), r['start'], r['col'], r['size']))
        .when(pattern | secret, around(r)),
        context_start_line=lambda r: F.when(pattern | secret, r['first'] + 1),
        context_end_line=lambda r: F.when(pattern | secret, r['end']))


def _describe(rows: DataFrame, rules: dict[str, list[Rule]], entropy_threshold: float, with_text: bool) -> DataFrame:
    """Label, confidence, technique and the other fixed attributes of every finding."""
    spark = rows.sparkSession
    catalog = rule_catalog(spark, [r for rs in rules.values() for r in rs])
    rows = rows.join(F.broadcast(catalog.select(
        'family', F.col('ord').alias('rule_ord'), 'category', F.col('label').alias('label'),
        'confidence', 'technique', 'severity', 'checks_fp')), ['family', 'rule_ord'])

    is_sink, is_entropy, is_base64 = (F.col('family') == f for f in ('sink_calls', 'entropy', 'base64'))
    extracted = F.col('family').isin(EXTRACT_FAMILIES)
    if 'sink_calls' in rules:
        risk = F.broadcast(risk_catalog(spark).withColumnsRenamed({'severity': 'risk_severity'}))
        rows = rows.join(risk, is_sink & (F.col('match') == F.col('trigger')), 'left')
    else:
        rows = rows.withColumns({c: F.lit(None).cast('string') for c in
                                 ('trigger', 'cwe', 'owasp', 'risk_severity', 'description')})
    pattern = ~extracted & ~is_sink & ~is_entropy & ~is_base64
    rows = rows.where(~(pattern & F.col('checks_fp') & is_false_positive(F.col('match'), F.col('label'))))

    shown_entropy = F.bround(shannon_entropy(F.col('match')), 2)
    label, detail = F.col('label'), F.col('detail')
    logic = (F.when(is_sink, F.concat(F.lit("AST Analysis identified '"), F.col('match'), F.lit("' usage. "),
                                      F.col('description'), F.lit(' (Category: '), F.col('cwe'), F.lit(')')))
             .when(is_entropy, F.concat(F.lit('Calculated Shannon Entropy: '), shown_entropy.cast('string'),
                                        F.lit(f' (Threshold: {entropy_threshold}). High entropy indicates randomness typical of secrets.')))
             .when(is_base64, F.concat(F.lit("Identified Base64 string and decoded it. Decoded content: '"), detail, F.lit("...'")))
             .when(F.col('family') == 'endpoints', F.concat(F.lit('Matched API pattern: '), label, F.lit(" request to '"), detail, F.lit("'")))
             .when(F.col('family') == 'parameters', F.concat(F.lit('Extracted parameter using regex: '), label))
             .when(F.col('family') == 'paths', F.concat(F.lit('Matched path pattern: '), label))
             .when(F.col('family') == 'script_refs', F.lit("Extracted 'src' attribute from <script> tag"))
             .otherwise(F.concat(F.lit("Matched specific regex pattern for '"), label, F.lit("' in source code."))))
    technique = (F.when(is_sink, F.lit(W.TECHNIQUE_SINK_CALL)).when(is_entropy, F.lit(W.TECHNIQUE_ENTROPY))
                 .when(is_base64, F.lit(W.TECHNIQUE_BASE64)).when(pattern, F.col('technique')))
    confidence = (F.when(is_sink | is_base64, F.lit('High')).when(is_entropy, F.lit('Medium'))
                  .when(pattern, F.col('confidence')))
    type_ = F.when(is_sink, F.col('description')).when(F.col('family') != 'endpoints', label)
    text_columns = ['line_content', 'context', 'context_start_line', 'context_end_line'] if with_text else []
    part = F
    for family in rules:
        part = part.when(F.col('family') == family, F.lit(_PART.get(family, 0)))
    return rows.select(
        *FILE_KEYS,
        F.when(is_sink, routed_category(F.col('description'), F.col('match'))).otherwise(F.col('category')).alias('category'),
        'family', part.alias('part'), 'rule_ord', 'match_ord', type_.alias('type'),
        F.when(F.col('family') == 'endpoints', label).alias('method'),
        'path', 'full_match', 'name', 'match', 'line', *text_columns,
        confidence.alias('confidence'), technique.alias('technique'),
        F.when(is_sink, F.col('risk_severity')).otherwise(F.col('severity')).alias('severity'),
        F.when(is_entropy, shown_entropy).alias('entropy'), 'cwe', 'owasp',
        F.when(is_sink, routed_label(F.col('description'), F.col('match'))).alias('api_class'),
        logic.alias('detection_logic'),
        F.when(F.col('category') == 'api_keys', url_directory(F.col('url'))).alias('directory'))


def raw_matches(files: DataFrame, families: list[str], profile_rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """Every match of every rule, before filters and de-duplication, with its place and groups."""
    rules = profile_rules or {f: rules_of(f) for f in families}
    spots = bind(F.col('spots'), SPOT_FIELDS, one=_group(1)) if all(r.groups for rs in rules.values() for r in rs) \
        else bind(F.col('spots'), SPOT_FIELDS, one=lambda s: F.lit(None).cast('string'))
    rows = locate(files, rules).select(*FILE_KEYS, 'family', F.size('lines').alias('n_lines'), F.inline(spots))
    catalog = rule_catalog(files.sparkSession, [r for rs in rules.values() for r in rs])
    return rows.drop('regex').join(F.broadcast(catalog.select(
        'family', F.col('ord').alias('rule_ord'), F.col('label').alias('type'), 'checks_fp')), ['family', 'rule_ord'])


def context_frame(files: DataFrame, families: list[str], before: int, after: int) -> DataFrame:
    """Matches with the lines around them."""
    rules = {f: rules_of(f) for f in families}
    lines = F.col('lines')
    spots = bind(F.col('spots'), SPOT_FIELDS,
                 first=lambda s: context_range(lines, s['line'], F.lit(before), F.lit(after))[0],
                 end=lambda s: context_range(lines, s['line'], F.lit(before), F.lit(after))[1])
    spots = bind(spots, ('rule_ord', 'match_ord', 'line', 'first', 'end'),
                 context=lambda s: context_text(lines, s['first'], s['end']))
    return locate(files, rules).select(*FILE_KEYS, 'family', F.inline(spots))


def scan_patterns_legacy(files: DataFrame, context_lines: int = 2) -> DataFrame:
    """Older semantics: every match counts, nothing is filtered or de-duplicated."""
    families = {f: family_rules(f, 'legacy') for f in ('api_keys', 'credentials', 'comments', 'xss_sinks')}
    catalog = rule_catalog(files.sparkSession, [r for rs in families.values() for r in rs])

    def finding(s: Column) -> Column:
        k = F.lit(context_lines)
        first, end = context_range(F.col('lines'), s['line'], k, k)
        return F.struct(s['rule_ord'].alias('rule_ord'), s['match_ord'].alias('match_ord'),
                        s['match'].alias('match'), s['line'].alias('line'),
                        context_text(F.col('lines'), first, end).alias('context'))

    rows = locate(files, families).select(*FILE_KEYS, 'family', F.inline(F.transform('spots', finding)))
    attributes = F.broadcast(catalog.select(
        'family', F.col('ord').alias('rule_ord'), 'category', F.col('label').alias('type'), 'severity'))
    return rows.join(attributes, ['family', 'rule_ord'])


def scan_endpoints_legacy(files: DataFrame) -> DataFrame:
    """Endpoints of the older profile: same shapes, no false-positive or subdomain filter."""
    return scan_files(files, rules={'endpoints': family_rules('endpoints', 'legacy')}, filtered=False, with_text=False)
