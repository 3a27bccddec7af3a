"""Rule catalog: families of rules, prepared for Spark and visible as a table."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import confidence_of, technique_of
from ..functions.regex import java_regex
from . import rules as R
from . import words as W
from .compiler import Compiled, compiled
from .prefilter import NEEDS, SHAPES

# Category of the findings table each rule family feeds.
FAMILIES = {
    'api_keys': ('api_keys', R.API_KEYS),
    'credentials': ('credentials', R.CREDENTIALS),
    'emails': ('emails', R.EMAILS),
    'ip_addresses': ('emails', R.IP_ADDRESSES),
    'comments': ('interesting_comments', R.COMMENTS),
    'xss_sinks': ('xss_vulnerabilities', R.XSS_SINKS),
    'xss_functions': ('xss_functions', R.XSS_FUNCTIONS),
    'endpoints': ('api_endpoints', R.ENDPOINTS),
    'parameters': ('parameters', R.PARAMETERS),
    'paths': ('paths_directories', R.PATHS),
    'server_banners': ('server_info_findings', R.SERVER_BANNERS),
    'libraries': ('libraries', R.LIBRARIES),
    'obfuscation': ('obfuscation_findings', R.OBFUSCATION),
}
CURRENT_ROWS = {row for _, rows in FAMILIES.values() for row in rows}
SCRIPT_FAMILY = {'script_refs': ('paths_directories', R.SCRIPT_REFS)}
LEGACY_FAMILIES = {
    'api_keys': ('api_keys', R.LEGACY_API_KEYS),
    'credentials': ('credentials', R.LEGACY_CREDENTIALS),
    'comments': ('interesting_comments', R.LEGACY_COMMENTS),
    'xss_sinks': ('xss_vulnerabilities', R.LEGACY_XSS_SINKS),
    'endpoints': ('api_endpoints', R.LEGACY_ENDPOINTS),
}
BUILT_IN_ROWS = CURRENT_ROWS | {row for table in (SCRIPT_FAMILY, LEGACY_FAMILIES) for _, rows in table.values() for row in rows}
PATTERN_FAMILIES = [f for f in FAMILIES if f not in ('endpoints', 'parameters', 'paths')]

# Forms with the same matches and a bounded amount of backtracking.
#  * A brace pair holds neither '}' nor ';', so "pairs separated by commas" says
#    no more than "some text, a colon, some text without a comma".  The original
#    tries every way to cut the text into pairs: exponential on long bodies.
#  * A name can only start where the last match ended or after a non-name
#    character; without saying so, every character of a long blob is tried.
#  * Word edges next to a known kind of character need one look instead of two,
#    and the cheap test of the next character goes first.
#  * A quoted text without a query mark is left at once instead of being walked
#    back character by character.
_SAME_MATCHES = {
    'Object Parameters': r'\{([^};]+:[^,};]+)\}',
    'Arrow function with DOM manipulation':
        r'(?:\G|(?<!\w))(\w++)\s*[:=]\s*function\s*\([^)]*\)\s*\{[^}]*\.(innerHTML|outerHTML|write)',
    'IPv4 Address':
        r'(?=[0-9])(?<!\w)(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?!\w)',
    'IPv6 Address': r'(?=[0-9a-f]{1,4}:)(?<!\w)([0-9a-f]{1,4}:){7,7}[0-9a-f]{1,4}(?!\w)',
    'Email Address':
        r'(?:(?=[.%+-])(?<=\w)|(?=\w)(?<!\w))[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?!\w)',
    'URL Query Parameter': r'["\'](?=[^"\'?&]*+[?&])([^"\']*[?&](\w+)\s*=\s*[^"\'&\s]+)["\']',
    'URL with Multiple Parameters':
        r'["\'](?=[^"\'&]*+&)([^"\']*[?&][\w\-]+\s*=\s*[^"\'&\s]+(?:\s*&\s*[\w\-]+\s*=\s*[^"\'&\s]+)+)["\']',
    'URL with Query Parameters': r'["\']([^"\'][^"\'?&]*+[?&][^"\']++)["\']',
    'JWT Token': r'(?=eyJ)(?<!\w)eyJ[A-Za-z0-9-_=]+\.eyJ[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]{10,}\b',
}


@dataclass(frozen=True)
class Rule:
    family: str
    category: str
    ord: int
    label: str
    regex: str
    java: str
    strict: bool | None
    severity: str | None
    needs: tuple = ()
    shape: str | None = None
    # groups are taken where the rule matched in the file: it may look beyond its match
    own: bool = False

    @property
    def groups(self) -> int:
        return re.compile(self.regex).groups

    @property
    def last_closed_group(self) -> int:
        """The group that closes last: the first one where groups are nested."""
        depth, order, open_groups, closed, skip = 0, 0, [], 0, False
        for token in re.findall(r'\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?|\(|\)', self.regex):
            if token == '(':
                order += 1
                open_groups.append(order)
            elif token == '(?':
                open_groups.append(0)
            elif token == ')' and open_groups:
                closed = open_groups.pop() or closed
        return closed


def make_rule(family: str, category: str, ord: int, row: tuple) -> Rule:
    regex, label, *flag = row
    flag = flag[0] if flag else False
    # word tests and equivalent forms belong to the built-in rows, not to their labels
    own = row in BUILT_IN_ROWS
    return Rule(
        family=family, category=category, ord=ord, label=label, regex=regex,
        java=java_regex(_SAME_MATCHES[label] if label in _SAME_MATCHES and row in CURRENT_ROWS else regex),
        strict=flag if isinstance(flag, bool) else None,
        severity=flag if isinstance(flag, str) else None,
        needs=tuple(tuple(g) for g in NEEDS.get(label, ())) if own else (), shape=SHAPES.get(label) if own else None,
    )


def family_rules(family: str, profile: str = 'current') -> list[Rule]:
    table = {**FAMILIES, **SCRIPT_FAMILY} if profile == 'current' else LEGACY_FAMILIES
    category, rows = table[family]
    return [make_rule(family, category, i, row) for i, row in enumerate(rows)]


def custom_rule(row: tuple, ord: int, family: str, category: str, form: Compiled) -> Rule:
    regex, label, *flag = row
    flag = flag[0] if flag else False
    return Rule(family=family, category=category, ord=ord, label=str(label), regex=regex, java=form.java,
                strict=flag if isinstance(flag, bool) else None, severity=flag if isinstance(flag, str) else None,
                needs=((form.word,),) if form.word else (), own=True)


def custom_rules(rows: list[tuple], family: str = 'custom', category: str = 'custom') -> list[Rule]:
    """Rules of the user's own, as (expression, label[, flag]) rows.

    A rule that is no expression, or none that Spark can run, is left out and
    does not stop the others; ``rule_errors`` names it.  Numbers are places in
    ``rows``, so they agree with the errors.
    """
    forms = [compiled(row[0]) for row in rows]
    return [custom_rule(row, i, family, category, form) for i, (row, form) in enumerate(zip(rows, forms)) if form.error is None]


def rule_errors(spark: SparkSession, rows: list[tuple], family: str = 'custom') -> DataFrame:
    """(family, rule_ord, type, regex, error) of the rules that ``custom_rules`` leaves out."""
    wrong = [(family, i, str(row[1]), row[0], error) for i, row in enumerate(rows) if (error := compiled(row[0]).error) is not None]
    return small_table(spark, wrong, 'family string, rule_ord int, type string, regex string, error string')


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table kept in the plan itself, so that joining it starts no extra job."""
    fields = [f.split() for f in schema.split(',')]
    kinds = {'string': pa.string(), 'int': pa.int32(), 'boolean': pa.bool_(), 'double': pa.float64()}
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.table({
        name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, columns)}))


def _rules_frame(spark: SparkSession, rules: list[Rule], profile: str) -> DataFrame:
    rows = [(profile, r.family, r.category, r.ord, r.label, r.regex, r.strict, r.severity,
             r.groups, r.last_closed_group) for r in rules]
    frame = small_table(
        spark, rows, 'profile string, family string, category string, ord int, label string, regex string, '
              'strict boolean, severity string, n_groups int, last_group int')
    return frame.withColumns({
        'confidence': confidence_of(F.col('strict'), F.col('severity')),
        'technique': technique_of(F.col('label')),
        'checks_fp': F.coalesce(~F.col('strict'), F.lit(False)),
    })


def rule_catalog(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The current profile's rules as a table (small and fixed: safe to broadcast)."""
    rules = rules or [r for f in FAMILIES for r in family_rules(f)]
    return _rules_frame(spark, rules, 'current')


def legacy_rule_catalog(spark: SparkSession) -> DataFrame:
    return _rules_frame(spark, [r for f in LEGACY_FAMILIES for r in family_rules(f, 'legacy')], 'legacy')


def risk_catalog(spark: SparkSession) -> DataFrame:
    return small_table(
        spark, W.RISK_CATALOG, 'trigger string, cwe string, owasp string, severity string, description string')


def css_properties(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(p,) for p in W.CSS_PROPERTIES], 'property string')


def technique_descriptions(spark: SparkSession) -> DataFrame:
    return small_table(spark, W.TECHNIQUE_DESCRIPTIONS, 'technique string, description string')
