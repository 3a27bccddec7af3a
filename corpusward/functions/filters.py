"""False-positive predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..catalog import words as W
from .labels import has_any
from .regex import java_regex
from .text import strip_quotes


def _java(expression: str) -> Column:
    return F.lit(java_regex(expression, ignore_case=False))


def fp_general(match: Column) -> Column:
    return has_any(F.lower(match), W.FP_GENERAL)


def fp_placeholder(match: Column) -> Column:
    return has_any(F.lower(match), W.FP_PLACEHOLDERS)


def fp_credential(match: Column, label: Column) -> Column:
    low = F.lower(match)
    empty = F.rlike(low, _java(W.FP_CREDENTIAL_EMPTY))
    declaration = F.rlike(low, _java(W.FP_CREDENTIAL_DECLARATION))
    call = F.rlike(low, _java(W.FP_CREDENTIAL_CALL)) & ~F.rlike(low, F.lit('["\']'))
    return label.isin(W.FP_CREDENTIAL_LABELS) & (empty | declaration | call)


def fp_css_object(match: Column, label: Column) -> Column:
    """An object literal that looks like a style sheet."""
    return (label == 'Object Parameters') & has_any(F.lower(match), [p + ':' for p in W.CSS_PROPERTIES])


def fp_jwt(match: Column, label: Column) -> Column:
    return (label == 'JWT Token') & ((F.size(F.split(match, r'\.', -1)) < 3) | (F.length(match) < 50))


def is_false_positive(match: Column, label: Column) -> Column:
    return (fp_general(match) | fp_placeholder(match) | fp_credential(match, label)
            | fp_css_object(match, label) | fp_jwt(match, label))


def fp_endpoint(path: Column) -> Column:
    return has_any(F.lower(path), W.FP_ENDPOINT_WORDS)


def fp_path(path: Column) -> Column:
    return has_any(F.lower(path), W.FP_PATH_WORDS)


def is_css_value(text: Column) -> Column:
    return F.rlike(strip_quotes(text), F.lit(java_regex(W.CSS_VALUE)))


def is_entropy_candidate(text: Column) -> Column:
    return ~F.contains(text, F.lit(' ')) & ~F.startswith(text, F.lit('http')) & ~F.startswith(text, F.lit('data:image'))
