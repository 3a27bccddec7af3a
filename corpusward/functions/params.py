"""Name and value of a parameter match."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..catalog import words as W
from .filters import is_css_value
from .regex import any_word
from .text import strip


def _before(text: Column, mark: str) -> Column:
    return strip(F.substring_index(text, mark, 1))


def _contains(text: Column, mark: str) -> Column:
    return F.contains(text, F.lit(mark))


def param_name_value(full: Column, group1: Column, group2: Column, has_groups: Column, uses_second: Column) -> Column:
    """struct<name, value, text>, decided in order by what the match contains.

    A query mark: the first ``name=value`` of group 1.  A call: the first
    argument's name.  A brace: the first property.  Else: what precedes '='.
    """
    first = F.substring_index(group1, '&', 1)
    pair_name = strip(F.ltrim(F.substring_index(first, '=', 1), F.lit('?&')))
    pair_value = strip(F.substr(first, F.locate('=', first) + 1))
    pair = F.struct(pair_name.alias('name'), pair_value.alias('value'),
                    F.concat(pair_name, F.lit('='), pair_value).alias('text'))

    def named(name: Column, text: Column) -> Column:
        return F.struct(name.alias('name'), F.lit(None).cast('string').alias('value'), text.alias('text'))

    nothing = F.lit(None).cast('string')
    query = F.when(_contains(first, '='), pair).otherwise(named(nothing, full))

    args = F.when(uses_second, group2).otherwise(group1)
    arg = F.substring_index(args, ',', 1)
    call = named(F.when(_contains(arg, '='), _before(arg, '=')).when(_contains(arg, ':'), _before(arg, ':'))
                 .otherwise(strip(arg)), args)
    brace = named(F.when(_contains(group1, ':'), _before(group1, ':')).otherwise(_before(group1, ',')), group1)
    other = named(F.when(_contains(group1, '='), _before(group1, '=')).otherwise(nothing), group1)

    return (F.when(~has_groups, named(nothing, full))
            .when(_contains(full, '?') | _contains(full, '&'), query)
            .when(_contains(full, '(') & _contains(full, ')'), call)
            .when(_contains(full, '{'), brace)
            .otherwise(other))


def is_css_parameter(param: Column) -> Column:
    """A style sheet property name, or a style sheet value."""
    name, value = param['name'], param['value']
    by_name = F.rlike(F.lower(name), F.lit(rf'\A(?:{any_word(W.CSS_PROPERTIES)})\z'))
    by_value = (value != '') & is_css_value(value)
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(by_value, F.lit(False))


def shown_name(param: Column) -> Column:
    return F.when(F.coalesce(param['name'], F.lit('')) != '', param['name']).otherwise(param['text'])
