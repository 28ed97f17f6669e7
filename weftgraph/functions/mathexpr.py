"""Arithmetic expressions as text, compiled to double Columns. Undefined results are null."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|([A-Za-z_][A-Za-z_0-9]*)|(.))")

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "signum": F.signum, "sign": F.signum, "exp": F.exp, "sqrt": F.sqrt, "cbrt": F.cbrt,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "log": F.ln, "ln": F.ln, "log10": F.log10, "log2": F.log2, "min": F.least, "max": F.greatest, "pow": F.pow, "atan2": F.atan2,
}
CONSTANTS = {"pi": math.pi, "PI": math.pi, "e": math.e, "E": math.e}


def names(expression: str) -> list[str]:
    """Variables in order of their first use."""
    out = []
    for m in _TOKEN.finditer(expression):
        if m[2] and m[2] not in FUNCTIONS and m[2] not in CONSTANTS and m[2] not in out:
            out.append(m[2])
    return out


def compile_math(expression: str, variables: dict[str, Column]) -> Column:
    """A double Column; null where a variable is null or the result isn't finite."""
    tokens = [(m[1], m[2], m[3]) for m in _TOKEN.finditer(expression) if m[0].strip()]
    at = 0

    def peek() -> str | None:
        return tokens[at][2] if at < len(tokens) else None

    def expect(symbol: str) -> None:
        nonlocal at
        if peek() != symbol:
            raise ValueError(f"expected {symbol!r} in {expression!r}")
        at += 1

    def sums() -> Column:
        nonlocal at
        left = products()
        while peek() in ("+", "-"):
            op = peek()
            at += 1
            right = products()
            left = left + right if op == "+" else left - right
        return left

    def products() -> Column:
        nonlocal at
        left = signed()
        while peek() in ("*", "/", "%"):
            op = peek()
            at += 1
            right = signed()
            left = left * right if op == "*" else F.try_divide(left, right) if op == "/" else F.when(right != 0, left % right)
        return left

    def signed() -> Column:
        nonlocal at
        if peek() in ("-", "+"):
            op = peek()
            at += 1
            return -signed() if op == "-" else signed()
        return powers()

    def powers() -> Column:
        nonlocal at
        base = atom()
        if peek() == "^":
            at += 1
            return F.pow(base, signed())
        return base

    def atom() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"{expression!r} ends too early")
        number, name, symbol = tokens[at]
        at += 1
        if number:
            return F.lit(float(number))
        if name:
            if peek() == "(" and name in FUNCTIONS:
                at += 1
                args = [sums()]
                while peek() == ",":
                    at += 1
                    args.append(sums())
                expect(")")
                return FUNCTIONS[name](*args).cast("double")
            if name in variables:
                return variables[name].cast("double")
            if name in CONSTANTS:
                return F.lit(CONSTANTS[name])
            raise ValueError(f"unknown name {name!r} in {expression!r}")
        if symbol == "(":
            inner = sums()
            expect(")")
            return inner
        raise ValueError(f"unexpected {symbol!r} in {expression!r}")

    out = sums()
    if at != len(tokens):
        raise ValueError(f"unexpected rest in {expression!r}")
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)
