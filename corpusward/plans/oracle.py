"""The queries of the registry as plain SQL, for checking results with another engine.

Written from the meaning of the operators and not from their Spark plans: every
match is unnested, positions are running sums over windows, first-wins is
``row_number``.
"""

from __future__ import annotations

from ..catalog import FAMILIES, Rule, family_rules, rules as R, words as W
from ..functions.text import BLANKS
from .corpus import CODE_BY_KIND, PROBE_LINES

NL = 'chr(10)'


def q(value: str | None) -> str:
    return 'NULL' if value is None else "'" + value.replace("'", "''") + "'"


_SPACE = r'\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}'


def re2(expression: str, ignore_case: bool = True) -> str:
    """The rule in RE2 syntax; blanks and names are spelled out over all letters."""
    out, inside, i = [], False, 0
    text = expression.replace('(?i)', '').replace(r'[\s\S]', r'(?s:.)')
    while i < len(text):
        token = text[i:i + 2] if text[i] == '\\' else text[i]
        i += len(token)
        if token == r'\s':
            token = _SPACE if inside else f'[{_SPACE}]'
        elif token == r'\w':
            token = r'\p{L}\p{N}_' if inside else r'[\p{L}\p{N}_]'
        elif token == '[' and not inside:
            inside = True
        elif token == ']':
            inside = False
        out.append(token)
    return ('(?im)' if ignore_case else '') + ''.join(out)


def strip(x: str) -> str:
    return f'trim({x}, {q(BLANKS)})'


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {NL}, '')))"


def any_of(x: str, words: list[str]) -> str:
    return '(' + ' OR '.join(f'contains({x}, {q(w)})' for w in words) + ')'


def corpus(ascii_only: bool) -> str:
    code = CODE_BY_KIND.replace('\\\\', '\\')
    probes = ', '.join(q(p) for p in PROBE_LINES)
    content = f"""concat(concat_ws({NL}, html, {code}), {NL},
      replace(replace(replace([{probes}][page_id % {len(PROBE_LINES)} + 1], '~', h), '|NL|', {NL}), '^', chr(92)))"""
    if ascii_only:
        content = f"regexp_replace({content}, '[^\\x00-\\x7F]', ' ', 'g')"
    return f"""
    p AS (SELECT page_id, url, html, md5(CAST(page_id AS VARCHAR)) AS h, md5(concat('x', CAST(page_id AS VARCHAR))) AS g,
        CAST(page_id % 8 AS INT) AS k, CAST(page_id AS VARCHAR) AS n,
        CASE WHEN page_id % 16 = 4 THEN 'c2VjcmV0X2tleTogaHVudGVyMiE=' ELSE 'QUFBQUFBQUFBQUFBQUFBQUFB' END AS to_b64 FROM pages),
    corpus AS (SELECT page_id AS file_id, concat(regexp_replace(url, '[?].*$', ''), CASE WHEN k < 6 THEN '.js' ELSE '' END) AS url,
        {content} AS content FROM p)"""


def technique(label: str) -> str:
    for name, marks in W.TECHNIQUE_BY_LABEL_WORD:
        if any(m in label for m in marks):
            return name
    return W.TECHNIQUE_SIGNATURE


def _rule_values(rules: list[Rule]) -> str:
    rows = []
    for r in rules:
        sure = r.strict or r.severity in ('critical', 'high')
        check = r.strict is False
        rows.append(f"({r.ord}, {q(re2(r.regex))}, {q(r.label)}, {q('High' if sure else 'Medium')}, {q(technique(r.label))}, "
                    f"CAST({q(r.severity)} AS VARCHAR), {check}, {r.groups}, {r.last_closed_group})")
    return ', '.join(rows)


def matches(name: str, rules_sql: str, source: str = 'corpus', text: str = 'content') -> str:
    """CTE ``name``: every match with rule attributes, place, line and the file's lines."""
    return f"""
    {name}_rules(ord, regex, label, confidence, technique, severity, checks_fp, groups, last_group) AS (VALUES {rules_sql}),
    {name}_hit AS (SELECT file_id, url, r.*, string_split(content, {NL}) AS lines, length(content) AS n_chars,
        regexp_extract_all({text}, r.regex) AS m, string_split_regex({text}, r.regex) AS seg
        FROM {source}, {name}_rules r WHERE content <> '' AND regexp_matches({text}, r.regex)),
    {name}_each AS (SELECT * EXCLUDE (m, seg), m[i + 1] AS match, seg[i + 1] AS gap, CAST(i AS INTEGER) AS match_ord
        FROM (SELECT *, unnest(range(len(m))) AS i FROM {name}_hit)),
    {name} AS (SELECT *, CAST(coalesce(sum(length(gap) + length(match)) OVER w, 0) + length(gap) AS INTEGER) AS start,
        CAST(1 + coalesce(sum({newlines('gap')} + {newlines('match')}) OVER w, 0) + {newlines('gap')} AS INTEGER) AS line
        FROM {name}_each
        WINDOW w AS (PARTITION BY file_id, ord ORDER BY match_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def fp(match: str, label: str) -> str:
    low = f'lower({match})'
    credential = f"""{label} IN ({', '.join(map(q, W.FP_CREDENTIAL_LABELS))}) AND (
        regexp_matches({low}, {q(re2(W.FP_CREDENTIAL_EMPTY, False))}) OR regexp_matches({low}, {q(re2(W.FP_CREDENTIAL_DECLARATION, False))})
        OR (regexp_matches({low}, {q(re2(W.FP_CREDENTIAL_CALL, False))}) AND NOT regexp_matches({low}, '["'']')))"""
    jwt = f"{label} = 'JWT Token' AND (len(string_split({match}, '.')) < 3 OR length({match}) < 50)"
    return f"({any_of(low, W.FP_GENERAL)} OR {any_of(low, W.FP_PLACEHOLDERS)} OR ({credential}) OR ({jwt}))"


def netloc(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def bare_host(url: str) -> str:
    return f"regexp_replace(split_part(lower({netloc(url)}), ':', 1), '^www[.]', '')"


def is_subdomain(url: str, base: str) -> str:
    return f"""(regexp_matches({url}, '^(http:|https:|//)') AND {netloc(url)} <> '' AND {netloc(base)} <> ''
        AND {bare_host(url)} <> {bare_host(base)} AND ends_with({bare_host(url)}, '.' || {bare_host(base)}))"""


def css_value(x: str) -> str:
    return f"regexp_matches(trim({x}, '\"'''), {q(re2(W.CSS_VALUE))})"


def directory(url: str) -> str:
    path = f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    head = f"regexp_extract({path}, '^(.*/)[^/]*$', 1)"
    return f"""CASE WHEN {path} = '' THEN NULL WHEN {head} = '' THEN '/' WHEN rtrim({head}, '/') = '' THEN {head}
        ELSE rtrim({head}, '/') END"""


def context(first: str, end: str) -> str:
    return f'array_to_string(lines[{first} + 1:{end}], {NL})'


def entropy(x: str) -> str:
    """Shannon entropy of a text as a correlated sum over its distinct characters."""
    return f"""(SELECT coalesce(sum(-(c / length({x})) * log2(c / length({x})) ORDER BY ch), 0.0) FROM (
        SELECT ch, count(*)::DOUBLE AS c FROM (SELECT unnest(string_split({x}, '')) AS ch) WHERE ch <> '' AND unicode(ch) < 256 GROUP BY ch))"""


FIELDS = ['file_id', 'url', 'category', 'part', 'rule_ord', 'match_ord', 'type', 'method', 'path', 'full_match', 'name', 'match',
          'line', 'confidence', 'technique', 'severity', 'cwe', 'owasp', 'detection_logic']
TEXT_FIELDS = ['line_content', 'context', 'context_start_line', 'context_end_line']


def _select(**values: str) -> str:
    missing = {'method': 'VARCHAR', 'path': 'VARCHAR', 'full_match': 'VARCHAR', 'name': 'VARCHAR', 'match': 'VARCHAR',
               'type': 'VARCHAR', 'confidence': 'VARCHAR', 'technique': 'VARCHAR', 'severity': 'VARCHAR', 'cwe': 'VARCHAR',
               'owasp': 'VARCHAR', 'context': 'VARCHAR', 'line_content': 'VARCHAR', 'context_start_line': 'INTEGER',
               'context_end_line': 'INTEGER'}
    return ', '.join(f"{values[f]} AS {f}" if f in values else f if f not in missing else f'CAST(NULL AS {missing[f]}) AS {f}'
                     for f in FIELDS + TEXT_FIELDS)


def family_cte(family: str, name: str | None = None, shortened: bool = False) -> str:
    """CTE with the family's findings in the common columns."""
    name = name or f'f_{family}'
    if family in FAMILIES and family not in ('endpoints', 'parameters', 'paths'):
        return _pattern(family, name, shortened)
    build = {'endpoints': _endpoints, 'parameters': _parameters, 'paths': _paths, 'script_refs': _scripts,
             'entropy': _entropy, 'base64': _base64, 'sink_calls': _sinks}[family]
    return build(family, name)


def _pattern(family: str, name: str, shortened: bool) -> str:
    category, _ = FAMILIES[family]
    part = 1 if family == 'ip_addresses' else 0
    k = 'CASE WHEN len(lines) = 1 AND n_chars > 10000 THEN 0 ELSE 5 END' if shortened else '5'
    return matches(f'{name}_m', _rule_values(family_rules(family))) + f""",
    {name}_ctx AS (SELECT *, {context('first_line', 'end_line')} AS ctx,
        -- distance back to the last newline if it is near, else the offset in the file
        CASE WHEN line > 1 AND start - line_start + 1 <= 500 THEN start - line_start + 1 ELSE start + 1 END AS off
        FROM (SELECT *, greatest(0, line - k - 1) AS first_line, least(len(lines), line + k) AS end_line,
              line - 1 + length(array_to_string(lines[1:line - 1], '')) AS line_start
              FROM (SELECT *, {k} AS k FROM {name}_m WHERE NOT (checks_fp AND {fp('match', 'label')})
                    QUALIFY row_number() OVER (PARTITION BY file_id, line, match, label ORDER BY ord, match_ord) = 1))),
    {name} AS (SELECT {_select(
        category=q(category), part=f'CAST({part} AS INTEGER)', rule_ord='CAST(ord AS INTEGER)', type='label', match='match',
        confidence='confidence', technique='technique', severity='severity',
        detection_logic="'Matched specific regex pattern for ''' || label || ''' in source code.'",
        line_content=strip("CASE WHEN length(lines[line]) > 500 THEN left(lines[line], 200) || '...' || right(lines[line], 200) ELSE lines[line] END"
                           if shortened else 'lines[line]'),
        context="CASE WHEN length(ctx) > 1000 THEN substr(ctx, CAST(greatest(0, off - 200) AS BIGINT) + 1, CAST(greatest(0, "
                "least(length(ctx), off + length(match) + 200) - greatest(0, off - 200)) AS BIGINT)) ELSE ctx END" if shortened else 'ctx',
        context_start_line='CAST(first_line + 1 AS INTEGER)', context_end_line='CAST(end_line AS INTEGER)')} FROM {name}_ctx)"""


def _group(n: int) -> str:
    return f'regexp_extract(match, regex, {n})'


def _endpoints(family: str, name: str, filtered: bool = True) -> str:
    keep = f"NOT {any_of('lower(u)', W.FP_ENDPOINT_WORDS)} AND NOT {is_subdomain('u', 'url')}" if filtered else 'true'
    return matches(f'{name}_m', _rule_values(family_rules('endpoints'))) + f""",
    {name}_u AS (SELECT *, CASE WHEN groups > 1 THEN {_group(2)} ELSE {_group(1)} END AS u FROM {name}_m),
    {name} AS (SELECT {_select(
        category="'api_endpoints'", part='CAST(0 AS INTEGER)', rule_ord='CAST(ord AS INTEGER)', method='label', path='u',
        full_match='match', line_content=strip('lines[line]'),
        detection_logic="'Matched API pattern: ' || label || ' request to ''' || u || ''''")}
        FROM {name}_u WHERE {keep}
        QUALIFY row_number() OVER (PARTITION BY file_id, u, line ORDER BY ord, match_ord) = 1)"""


def _parameters(family: str, name: str) -> str:
    before = lambda x, mark: strip(f"split_part({x}, '{mark}', 1)")
    props = ', '.join(map(q, W.CSS_PROPERTIES))
    return matches(f'{name}_m', _rule_values(family_rules('parameters'))) + f""",
    {name}_g AS (SELECT *, CASE WHEN groups >= 1 THEN {_group(1)} END AS g1,
        CASE WHEN last_group >= 2 THEN {_group(2)} WHEN groups >= 1 THEN {_group(1)} END AS args FROM {name}_m),
    {name}_k AS (SELECT *, split_part(g1, '&', 1) AS pair, split_part(args, ',', 1) AS arg,
        CASE WHEN groups = 0 THEN 'none' WHEN contains(match, '?') OR contains(match, '&') THEN 'query'
             WHEN contains(match, '(') AND contains(match, ')') THEN 'call' WHEN contains(match, '{{') THEN 'brace'
             ELSE 'other' END AS kind FROM {name}_g),
    {name}_n AS (SELECT *,
        CASE kind WHEN 'query' THEN CASE WHEN contains(pair, '=') THEN {strip("ltrim(split_part(pair, '=', 1), '?&')")} END
            WHEN 'call' THEN CASE WHEN contains(arg, '=') THEN {before('arg', '=')} WHEN contains(arg, ':') THEN {before('arg', ':')} ELSE {strip('arg')} END
            WHEN 'brace' THEN CASE WHEN contains(g1, ':') THEN {before('g1', ':')} ELSE {before('g1', ',')} END
            WHEN 'other' THEN CASE WHEN contains(g1, '=') THEN {before('g1', '=')} END END AS pname,
        CASE WHEN kind = 'query' AND contains(pair, '=') THEN {strip("substr(pair, position('=' IN pair) + 1)")} END AS pvalue FROM {name}_k),
    {name}_t AS (SELECT *, CASE kind WHEN 'none' THEN match WHEN 'query' THEN coalesce(pname || '=' || pvalue, match)
            WHEN 'call' THEN args ELSE g1 END AS ptext FROM {name}_n),
    {name}_s AS (SELECT *, CASE WHEN coalesce(pname, '') <> '' THEN pname ELSE ptext END AS shown FROM {name}_t
        WHERE NOT (lower(coalesce(pname, '')) IN ({props})) AND NOT (coalesce(pvalue, '') <> '' AND {css_value("coalesce(pvalue, '')")})),
    {name} AS (SELECT {_select(
        category="'parameters'", part='CAST(0 AS INTEGER)', rule_ord='CAST(ord AS INTEGER)', type='label', name='shown',
        match='ptext', line_content=strip('lines[line]'),
        detection_logic="'Extracted parameter using regex: ' || label")}
        FROM {name}_s QUALIFY row_number() OVER (PARTITION BY file_id, shown, line, label ORDER BY ord, match_ord) = 1)"""


def _paths(family: str, name: str) -> str:
    return matches(f'{name}_m', _rule_values(family_rules('paths'))) + f""",
    {name}_u AS (SELECT *, {_group(1)} AS u FROM {name}_m),
    {name} AS (SELECT {_select(
        category="'paths_directories'", part='CAST(0 AS INTEGER)', rule_ord='CAST(ord AS INTEGER)', type='label', path='u',
        match='match', line_content=strip('lines[line]'), detection_logic="'Matched path pattern: ' || label")}
        FROM {name}_u WHERE NOT {any_of('lower(u)', W.FP_PATH_WORDS)} AND NOT {css_value('u')}
        QUALIFY row_number() OVER (PARTITION BY file_id, u, line, label ORDER BY ord, match_ord) = 1)"""


def _scripts(family: str, name: str) -> str:
    return matches(f'{name}_m', _rule_values(family_rules('script_refs'))) + f""",
    {name} AS (SELECT {_select(
        category="'paths_directories'", part='CAST(1 AS INTEGER)', rule_ord='CAST(ord AS INTEGER)', type='label', path=_group(1),
        match='match', line_content=strip('lines[line]'),
        detection_logic="'Extracted ''src'' attribute from <script> tag'")}
        FROM {name}_m WHERE NOT {is_subdomain(_group(1), 'url')})"""


def _one_rule(regex: str, label: str) -> str:
    return f"(0, {q(re2(regex, False))}, {q(label)}, '', '', CAST(NULL AS VARCHAR), false, 1, 1)"


def _entropy(family: str, name: str) -> str:
    return matches(f'{name}_m', _one_rule(R.ENTROPY_CANDIDATE, 'High Entropy String')) + f""",
    {name}_c AS (SELECT * EXCLUDE (match), {_group(1)} AS match FROM {name}_m
        QUALIFY row_number() OVER (PARTITION BY file_id, {_group(1)} ORDER BY match_ord) = 1),
    {name}_e AS (SELECT *, {entropy('match')} AS entropy FROM {name}_c WHERE NOT starts_with(match, 'http')),
    {name} AS (SELECT {_select(
        category="'api_keys'", part='CAST(1 AS INTEGER)', rule_ord='CAST(0 AS INTEGER)', type='label', match='match',
        confidence="'Medium'", technique=q(W.TECHNIQUE_ENTROPY), line_content=strip('lines[line]'),
        context=context('greatest(0, line - 3)', 'least(len(lines), line + 3)'),
        context_start_line='CAST(greatest(0, line - 3) + 1 AS INTEGER)', context_end_line='CAST(least(len(lines), line + 3) AS INTEGER)',
        detection_logic="'Calculated Shannon Entropy: ' || CAST(round_even(entropy, 2) AS VARCHAR) || "
                        "' (Threshold: 4.5). High entropy indicates randomness typical of secrets.'")}
        FROM {name}_e WHERE entropy > {W.ENTROPY_THRESHOLD})"""


def _base64(family: str, name: str) -> str:
    return matches(f'{name}_m', _one_rule(R.BASE64_CANDIDATE, 'Base64 Encoded Secret')) + f""",
    {name}_c AS (SELECT * EXCLUDE (match), trim(match, '"''') AS match FROM {name}_m WHERE length(trim(match, '"''')) >= 20
        QUALIFY row_number() OVER (PARTITION BY file_id, trim(match, '"''') ORDER BY match_ord) = 1),
    {name}_b AS (SELECT *, from_base64(match) AS bytes FROM {name}_c),
    -- a blob prints bytes outside printable ASCII as escapes, which marks texts that cannot show
    {name}_d AS (SELECT *, CASE WHEN NOT contains(CAST(bytes AS VARCHAR), '\\x') THEN CAST(bytes AS VARCHAR) END AS decoded FROM {name}_b),
    {name} AS (SELECT {_select(
        category="'obfuscation_findings'", part='CAST(1 AS INTEGER)', rule_ord='CAST(0 AS INTEGER)', type='label', match='match',
        confidence="'High'", technique=q(W.TECHNIQUE_BASE64), line_content=strip('lines[line]'),
        context=context('greatest(0, line - 3)', 'least(len(lines), line + 3)'),
        context_start_line='CAST(greatest(0, line - 3) + 1 AS INTEGER)', context_end_line='CAST(least(len(lines), line + 3) AS INTEGER)',
        detection_logic="'Identified Base64 string and decoded it. Decoded content: ''' || decoded || '...'''")}
        FROM {name}_d WHERE decoded IS NOT NULL AND ({any_of('lower(decoded)', W.BASE64_WORDS)} OR {entropy('decoded')} > 4.0))"""


# Names in the tables' code are ASCII; classes over all letters make RE2 sixty times slower here.
_IDENT = r'[A-Za-z_$][\w$]*'
# first the beginning of a template up to its code, the rest of it behind the code, and a regular expression after a sign of equality
_LITERAL = r'''`[^`$\\]*\$\{|\}[^`{};\n]*`|= /[^/*\n][^/\n]*/|"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*'|`(?:[^`\\]|\\(?s:.))*`|//[^\n]*|/\*(?s:.)*?\*/'''
_CALL = rf'(?:\b(function|new)\s+)?(\.\s*)?({_IDENT}(?:\s*\.\s*{_IDENT})*)\s*\('
_ASSIGN = (rf'(?:(?:{_IDENT}\s*\.\s*)+|\.\s*)({"|".join(W.ASSIGNED_SINKS)})\s*'
           r'(?:[-+*/%&|^]|\*\*|<<|>>>?|&&|\|\||\?\?)?=[^=>]')


def _sinks(family: str, name: str) -> str:
    rows = ', '.join(f"({i}, {q(x)}, '{n}', '', '', CAST(NULL AS VARCHAR), false, 3, 3)" for i, (n, x) in
                     enumerate([('call', _CALL), ('assignment', _ASSIGN)]))
    names = ', '.join(q(r[0]) for r in W.RISK_CATALOG)
    values = ', '.join('(' + ', '.join(map(q, r)) + ')' for r in W.RISK_CATALOG)
    return f"""
    {name}_code AS (SELECT * EXCLUDE (parts, lits), array_to_string([x[1] || coalesce(regexp_replace(x[2], '[^\\n]', ' ', 'g'), '')
            FOR x IN list_zip(parts, lits)], '') AS code
        FROM (SELECT *, string_split_regex(content, {q(_LITERAL)}) AS parts, regexp_extract_all(content, {q(_LITERAL)}) AS lits
              FROM corpus WHERE {any_of('content', [r[0] for r in W.RISK_CATALOG])})),
    {matches(f'{name}_m', rows, f'{name}_code', 'code')},
    {name}_p AS (SELECT *, CASE WHEN label = 'call' THEN {_group(1)} ELSE '' END AS prefix, CASE WHEN label = 'call' THEN {_group(2)} ELSE '' END AS dot,
        string_split(regexp_replace(CASE WHEN label = 'call' THEN {_group(3)} ELSE {_group(1)} END, '\\s+', '', 'g'), '.') AS chain FROM {name}_m),
    {name}_w AS (SELECT *, array_to_string(chain, '.') AS whole,
        CASE WHEN label = 'call' AND len(chain) = 2 AND dot = '' THEN
            CASE WHEN array_to_string(chain, '.') IN ({names}) THEN array_to_string(chain, '.') WHEN chain[1] IN ({names}) THEN chain[1] END END AS owner
        FROM {name}_p WHERE prefix = ''),
    {name}_t AS (SELECT *, owner AS trigger, 0 AS sub FROM {name}_w WHERE owner IS NOT NULL
        UNION ALL SELECT *, chain[-1] AS trigger, CASE WHEN owner IS NULL THEN 0 ELSE 1 END AS sub FROM {name}_w WHERE chain[-1] IN ({names})),
    {name}_risk(risk, risk_cwe, risk_owasp, risk_severity, description) AS (VALUES {values}),
    {name}_j AS (SELECT * FROM {name}_t JOIN {name}_risk ON trigger = risk),
    {name} AS (SELECT {_select(
        category="CASE WHEN contains(lower(description), 'xss') OR contains(lower(description), 'injection') OR trigger IN ("
                 + ', '.join(map(q, W.SINK_MATCHES)) + ") THEN 'xss_vulnerabilities' ELSE 'xss_functions' END",
        part='CAST(1 AS INTEGER)', rule_ord='CAST(ord AS INTEGER)', match_ord='CAST(start * 2 + sub AS INTEGER)', type='description',
        match='trigger', confidence="'High'", technique=q(W.TECHNIQUE_SINK_CALL), severity='risk_severity', cwe='risk_cwe',
        owasp='risk_owasp', detection_logic="'AST Analysis identified ''' || trigger || ''' usage. ' || description || ' (Category: ' || risk_cwe || ')'")}
        FROM {name}_j)"""


def with_findings(families: list[str], body: str, ascii_only: bool = True, extra: str = '', shortened: bool = False) -> str:
    """SQL over ``findings`` (all listed families) and ``corpus``."""
    ctes = [corpus(ascii_only)] + [family_cte(f, shortened=shortened) for f in families]
    union = ' UNION ALL '.join(f'SELECT * FROM f_{f}' for f in families)
    return f"WITH {', '.join(ctes)}, findings AS ({union}){extra} {body}"


def with_matches(families: dict[str, list[Rule]], body: str, ascii_only: bool = True) -> str:
    """SQL over ``raw``: all matches of the families before filters."""
    ctes = [corpus(ascii_only)] + [matches(f'm_{f}', _rule_values(rules)) for f, rules in families.items()]
    union = ' UNION ALL '.join(f"SELECT '{f}' AS family, * FROM m_{f}" for f in families)
    return f"WITH {', '.join(ctes)}, raw AS ({union}) {body}"


RESPONSES = """
    responses AS (SELECT page_id AS file_id, url, html AS body,
        CAST(CASE page_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 401 WHEN 3 THEN 503 ELSE 200 END AS INTEGER) AS status,
        CASE page_id % 5 WHEN 0 THEN 'nginx/1.25.3' WHEN 1 THEN 'Apache' WHEN 2 THEN 'cloudflare' WHEN 3 THEN 'Microsoft-IIS/10.0' END AS server,
        CASE WHEN page_id % 3 = 0 THEN 'Express' END AS x_powered_by,
        CASE page_id % 4 WHEN 0 THEN 'default-src *; script-src ''unsafe-inline'' ''unsafe-eval''' WHEN 1 THEN 'img-src x'
            WHEN 2 THEN 'default-src ''self''; script-src *' END AS csp,
        CASE WHEN page_id % 5 = 2 THEN concat('ray', CAST(page_id AS VARCHAR)) END AS cf_ray,
        CASE WHEN page_id % 6 = 0 THEN '100' END AS x_ratelimit_limit,
        CASE WHEN page_id % 11 = 0 THEN 'ak' END AS x_akamai_trans_id,
        CASE WHEN page_id % 8 < 6 THEN 'application/javascript' ELSE 'text/html' END AS content_type,
        CAST(length(html) * 5000 AS VARCHAR) AS content_length,
        concat('10.', CAST(page_id % 250 AS VARCHAR), '.0.1') AS ip FROM pages)"""


def csp_weaknesses(policy: str) -> str:
    """Weaknesses of a policy, joined with bars."""
    def directive(name: str) -> str:
        name_of = f"lower(regexp_extract({strip('d')}, '^(\\S+)', 1))"
        value_of = strip(f"regexp_replace({strip('d')}, '^\\S+', '')")
        return f"([{value_of} FOR d IN string_split({policy}, ';') IF {name_of} = '{name}'])[-1]"
    script, default = directive('script-src'), directive('default-src')
    return f"""concat_ws('|',
        CASE WHEN {policy} IS NULL THEN {q(W.CSP_MISSING)} END,
        CASE WHEN contains({script}, '''unsafe-inline''') THEN {q(W.CSP_UNSAFE_INLINE)} END,
        CASE WHEN contains({script}, '''unsafe-eval''') THEN {q(W.CSP_UNSAFE_EVAL)} END,
        CASE WHEN contains({script}, '*') AND NOT (contains({script}, '''self''') AND length({script}) < 10)
             THEN {q(W.CSP_SCRIPT_WILDCARD)} END,
        CASE WHEN {policy} IS NOT NULL AND {script} IS NULL AND {default} IS NULL THEN {q(W.CSP_NO_SOURCE)} END,
        CASE WHEN contains({default}, '*') THEN {q(W.CSP_DEFAULT_WILDCARD)} END)"""


SERVER_TYPE = ('CASE WHEN server IS NULL THEN NULL ' + ' '.join(
    f'WHEN contains(lower(server), {q(m)}) THEN {q(n)}' for m, n in W.SERVER_TYPES) + " ELSE 'Unknown' END")
PROVIDER = ("CASE WHEN x_akamai_trans_id IS NOT NULL THEN 'Akamai' WHEN cf_ray IS NOT NULL THEN 'Cloudflare' "
            "WHEN x_ratelimit_limit IS NOT NULL THEN 'Standard/Custom' END")
