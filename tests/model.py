"""Row-at-a-time model of the scans over Python's own regular expressions."""

import math
import re

from corpusward.catalog import words as W


def places(rules, text):
    for rule in rules:
        for i, m in enumerate(re.finditer(rule.regex, text, re.I | re.M)):
            yield rule, i, m, text.count('\n', 0, m.start()) + 1


def entropy(text):
    return -sum(p * math.log2(p) for c in set(text) if ord(c) < 256 for p in [text.count(c) / len(text)]) if text else 0.0


def pattern_rows(rules, text, judged=lambda match, label: False, shortened=False):
    """(rule_ord, match_ord, type, match, line, line_content, context, first, last) of the kept matches."""
    lines = text.split('\n')
    k = 0 if shortened and len(lines) == 1 and len(text) > 10000 else 5
    seen, rows = set(), []
    for rule, i, m, line in places(rules, text):
        if rule.strict is False and judged(m[0], rule.label):
            continue
        if (line, m[0], rule.label) in seen:
            continue
        seen.add((line, m[0], rule.label))
        first, end = max(0, line - 1 - k), min(len(lines), line + k)
        context = '\n'.join(lines[first:end])
        if shortened and len(context) > 1000:
            newline = text[max(0, m.start() - 500):m.start()].rfind('\n')
            back = len(text[max(0, m.start() - 500):m.start()]) - newline if newline >= 0 else m.start() + 1
            context = context[max(0, back - 200):min(len(context), back + len(m[0]) + 200)]
        shown = lines[line - 1]
        if shortened and len(shown) > 500:
            shown = shown[:200] + '...' + shown[-200:]
        rows.append((rule.ord, i, rule.label, m[0], line, shown.strip(), context, first + 1, end))
    return rows


def endpoint_rows(rules, text):
    seen, rows = set(), []
    for rule, i, m, line in places(rules, text):
        path = m[2] if len(m.groups()) > 1 else m[1]
        if any(w in path.lower() for w in W.FP_ENDPOINT_WORDS) or (path, line) in seen:
            continue
        seen.add((path, line))
        rows.append((rule.ord, i, rule.label, path, m[0], line))
    return rows


def path_rows(rules, text):
    seen, rows = set(), []
    for rule, i, m, line in places(rules, text):
        path = m[1]
        if any(w in path.lower() for w in W.FP_PATH_WORDS) or re.match(W.CSS_VALUE, path.strip('\'"'), re.I):
            continue
        if (path, line, rule.label) not in seen:
            seen.add((path, line, rule.label))
            rows.append((rule.ord, i, rule.label, path, m[0], line))
    return rows


def param_of(m):
    """(name, value, text) of a parameter match."""
    full = m[0]
    if not m.groups():
        return None, None, full
    if '?' in full or '&' in full:
        pair = m[1].partition('&')[0]
        if '=' not in pair:
            return None, None, full
        name, _, value = pair.partition('=')
        name, value = name.lstrip('?&').strip(), value.strip()
        return name, value, f'{name}={value}'
    if '(' in full and ')' in full:
        text = m[2] if m.lastindex >= 2 else m[1]
        arg = text.partition(',')[0]
        mark = '=' if '=' in arg else ':' if ':' in arg else None
        return (arg.partition(mark)[0] if mark else arg).strip(), None, text
    if '{' in full:
        return m[1].partition(':' if ':' in m[1] else ',')[0].strip(), None, m[1]
    return (m[1].partition('=')[0].strip() if '=' in m[1] else None), None, m[1]


def parameter_rows(rules, text):
    seen, rows = set(), []
    for rule, i, m, line in places(rules, text):
        name, value, shown = param_of(m)
        if name and name.lower() in W.CSS_PROPERTIES:
            continue
        if value and re.match(W.CSS_VALUE, value.strip('\'"'), re.I):
            continue
        name = name or shown
        if (name, line, rule.label) not in seen:
            seen.add((name, line, rule.label))
            rows.append((rule.ord, i, rule.label, name, shown, line))
    return rows
