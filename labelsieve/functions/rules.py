"""Text rules such as ``<2`` that turn a column into a 0/1 label."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER_RULE = re.compile(r"\s*(<=|>=|==|!=|<|>)\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*")
_TEXT_RULE = re.compile(r"""\s*(==|!=)\s*(?:'([^']*)'|"([^"]*)")\s*""")

_COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def truthy(column: Column, dtype: T.DataType) -> Column:
    """Non-zero number, non-empty text or collection, or true. Null is not."""
    if isinstance(dtype, T.BooleanType):
        test = column
    elif isinstance(dtype, T.StringType):
        test = F.length(column) > 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        test = F.size(column) > 0
    elif isinstance(dtype, T.NumericType):
        test = column != 0
    else:
        test = column.isNotNull()
    return F.coalesce(test, F.lit(False))


def rule_condition(column: Column, dtype: T.DataType, rule: str) -> Column:
    """Boolean column for ``rule``: empty, or an operator and one constant.

    The rule is read against a fixed grammar, never evaluated as code. NaN
    fails every comparison but ``!=``. A null value gives null, except under the
    empty rule, where it is false.
    """
    if not rule.strip():
        return truthy(column, dtype)
    number = _NUMBER_RULE.fullmatch(rule)
    if number:
        op, constant = number.group(1), float(number.group(2))
        value = column.cast("double")
        test = _COMPARE[op](value, F.lit(constant))
        if op == "!=":
            return test
        return F.when(value.isNotNull(), test & ~F.isnan(value))
    text = _TEXT_RULE.fullmatch(rule)
    if text:
        constant = text.group(2) if text.group(2) is not None else text.group(3)
        return _COMPARE[text.group(1)](column.cast("string"), F.lit(constant))
    raise ValueError(f"cannot read label rule {rule!r}; write an operator and one constant, such as '<2'")


def rule_label(column: Column, dtype: T.DataType, rule: str) -> Column:
    """1 where the rule holds, 0 where it does not, null where the value is null."""
    return rule_condition(column, dtype, rule).cast("int")
