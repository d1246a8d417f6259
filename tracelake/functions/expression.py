"""Signal expressions as columns: ``+ - * / ^``, signs, parentheses, ``[Name]`` and a few functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|\[([^\]]+)\]|(abs|sqrt|min|max|clamp)(?=\s*\()|([-+*/^(),]))")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        kind = ("number", "name", "function", "sign")[m.lastindex - 1]
        out.append((kind, m.group(m.lastindex)))
        at = m.end()
    return out


def names_of(text: str) -> set[str]:
    """Names of the inputs that an expression reads; ValueError if it cannot be read."""
    names = {word for kind, word in _tokens(text) if kind == "name"}
    compile_expression(text, {n: F.lit(None).cast("double") for n in names})
    return names


def compile_expression(text: str, inputs: dict[str, Column]) -> Column:
    """Column of an expression; null where it divides by zero, lacks an input or is not finite.

    A sign binds tighter than ``^`` (-2^2 is 4) and ``^`` groups to the right.
    """
    tokens = _tokens(text)
    at = 0

    def peek(value: str) -> bool:
        return at < len(tokens) and tokens[at] == ("sign", value)

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or (value is not None and not peek(value)):
            raise ValueError(f"expected {value or 'a value'} in {text!r}")
        at += 1
        return tokens[at - 1]

    def total() -> Column:
        out = product()
        while peek("+") or peek("-"):
            out = out + product() if take()[1] == "+" else out - product()
        return out

    def product() -> Column:
        out = power()
        while peek("*") or peek("/"):
            out = out * power() if take()[1] == "*" else F.try_divide(out, power())
        return out

    def power() -> Column:
        base = signed()
        if not peek("^"):
            return base
        take()
        return F.pow(base, power())

    def signed() -> Column:
        if peek("-") or peek("+"):
            return -signed() if take()[1] == "-" else signed()
        return value()

    def value() -> Column:
        kind, word = take()
        if kind == "number":
            return F.lit(float(word))
        if kind == "name":
            if word not in inputs:
                raise ValueError(f"no input named {word!r}")
            return inputs[word].cast("double")
        if kind == "function":
            take("(")
            args = [total()]
            while peek(","):
                take()
                args.append(total())
            take(")")
            return call(word, args)
        if word == "(":
            out = total()
            take(")")
            return out
        raise ValueError(f"unexpected {word!r} in {text!r}")

    def call(name: str, args: list[Column]) -> Column:
        if len(args) != {"abs": 1, "sqrt": 1, "clamp": 3}.get(name, len(args)) or (name in ("min", "max") and len(args) < 2):
            raise ValueError(f"{name} has {len(args)} arguments")
        known = F.lit(True)
        for a in args:
            known = known & a.isNotNull()
        if name == "abs":
            return F.abs(args[0])
        if name == "sqrt":
            return F.sqrt(args[0])
        if name == "clamp":
            return F.when(known, F.least(F.greatest(args[0], args[1]), args[2]))
        return F.when(known, (F.least if name == "min" else F.greatest)(*args))

    out = total()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at][1]!r} in {text!r}")
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)
