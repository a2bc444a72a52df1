"""Checking spreadsheet expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKENS = re.compile(
    r"""\s*(?:
      (?P<text>"(?:[^"]|"")*")
    | (?P<func>[A-Za-z_][A-Za-z0-9_.]*)\s*\(
    | (?P<ref>(?:(?:'(?:[^']|'')+'|[A-Za-z_][A-Za-z0-9_.]*)!)?
        (?:\$?[A-Za-z]{1,3}\$?[1-9]\d*(?::\$?[A-Za-z]{1,3}\$?[1-9]\d*)?|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}|\$?[1-9]\d*:\$?[1-9]\d*)(?![A-Za-z0-9_.(!:]))
    | (?P<bool>(?:TRUE|FALSE)(?![A-Za-z0-9_.(]))
    | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z0-9_.]))
    | (?P<op><=|>=|<>|[-+*/^&=<>])
    | (?P<open>\()
    | (?P<close>\))
    | (?P<sep>[,;])
    | (?P<percent>%)
    )""",
    re.X,
)


def expression_ok(formula: str | None) -> bool:
    """Whether a value is ``=`` and a complete, balanced expression.

    Cell references count rows from 1 and may hold ``$``; texts stand in double
    quotes; error values and bare names are refused; an argument of a function
    may be left out.  Null and empty values are no expression.  The check keeps
    its own stack, so depth is no limit.
    """
    if not formula or formula[0] != "=":
        return False
    at, end = 1, len(formula.rstrip())
    depth: list[str] = []  # "f" for a function's parenthesis, "(" for another
    operand = False  # whether the last thing read is a complete operand
    empty_ok = False  # whether an argument may end here without an operand
    while at < end:
        m = _TOKENS.match(formula, at)
        if not m:
            return False
        kind = m.lastgroup
        at = m.end()
        if kind in ("text", "ref", "bool", "number"):
            if operand:
                return False
            operand, empty_ok = True, False
        elif kind in ("func", "open"):
            if operand:
                return False
            depth.append("f" if kind == "func" else "(")
            empty_ok = kind == "func"
        elif kind == "op":
            if not operand and m["op"] not in "+-":
                return False
            operand, empty_ok = False, False
        elif kind == "percent":
            if not operand:
                return False
        elif kind == "sep":
            if not depth or depth[-1] != "f" or not (operand or empty_ok):
                return False
            operand, empty_ok = False, True
        else:
            if not depth or not (operand or empty_ok and depth[-1] == "f"):
                return False
            depth.pop()
            operand, empty_ok = True, False
    return operand and not depth


@F.pandas_udf(T.BooleanType())
def expression_ok_udf(s: pd.Series) -> pd.Series:
    """Vector form of ``expression_ok``; every distinct value of a batch is checked once."""
    known = {x: expression_ok(x) for x in s.dropna().unique()}
    return s.map(lambda x: known.get(x, False))
