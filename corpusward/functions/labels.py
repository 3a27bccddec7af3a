"""Columns derived from a rule's label and flag."""

from pyspark.sql import Column, functions as F

from ..catalog import words as W
from .regex import any_word


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the (short) text holds one of a few fixed words."""
    return F.rlike(text, F.lit(any_word(words)))


def technique_of(label: Column) -> Column:
    """Technique of a rule; the lists are tried in order and are case-sensitive."""
    result = F
    for technique, marks in W.TECHNIQUE_BY_LABEL_WORD:
        result = result.when(has_any(label, marks), F.lit(technique))
    return result.otherwise(F.lit(W.TECHNIQUE_SIGNATURE))


def confidence_of(strict: Column, severity: Column) -> Column:
    sure = F.coalesce(strict, severity.isin('critical', 'high'), F.lit(False))
    return F.when(sure, F.lit('High')).otherwise(F.lit('Medium'))


def refine_technique(technique: Column, label: Column) -> Column:
    """Split generic signature findings by words of their label, first list wins."""
    low = F.lower(F.coalesce(label, F.lit('')))
    generic = technique.isin(W.TECHNIQUE_SIGNATURE, 'Regex Pattern Matching')
    result = F.when(~generic, technique)
    for refined, marks in W.TECHNIQUE_REFINEMENT:
        result = result.when(has_any(low, marks), F.lit(refined))
    return result.otherwise(technique)
